"""Structural checks, and comparison of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import Graph


def violations(g: Graph) -> DataFrame:
    """(check, key): every broken rule, by the row that breaks it."""
    told = lambda df, name, key: df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
    n, m = g.node_count(), g.edge_count()
    idx, e = g.nodes.select("idx"), g.edges.select("e", "src", "dst")
    found = [
        told(idx.groupBy("idx").count().filter("count > 1"), "idx repeats", "idx"),
        told(idx.filter(F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= n)), "idx outside 0 .. n - 1", "idx"),
        told(g.nodes.filter("id is null"), "id is null", "idx"),
        told(g.nodes.groupBy("id").count().filter("count > 1"), "id repeats", "id"),
        told(e.groupBy("e").count().filter("count > 1"), "e repeats", "e"),
        told(e.filter(F.col("e").isNull() | (F.col("e") < 0) | (F.col("e") >= m)), "e outside 0 .. m - 1", "e"),
        told(e.join(idx.withColumnRenamed("idx", "src"), "src", "left_anti"), "src is no node", "e"),
        told(e.join(idx.withColumnRenamed("idx", "dst"), "dst", "left_anti"), "dst is no node", "e"),
        told(g.edges.filter(F.isnan("w")), "weight is NaN", "e"),
        told(g.edges.filter(F.col("w").isNotNull() & F.lit(not g.weighted)), "weight in an unweighted graph", "e"),
    ]
    for df, key in ((g.nodes, "idx"), (g.edges, "e")):
        for f in df.schema.fields:
            to = f.metadata.get("refersTo")
            if to in ("node", "edge"):
                ref = df.select(key, (F.explode(f.name) if f.dataType.typeName() == "array" else F.col(f.name)).alias("__r")).filter("__r is not null")
                there = idx.withColumnRenamed("idx", "__r") if to == "node" else e.select(F.col("e").alias("__r"))
                found.append(told(ref.join(there, "__r", "left_anti"), f"{f.name} refers to nothing", key))
    return reduce(DataFrame.unionByName, found)


def validate(g: Graph) -> None:
    """E_INVALID_SNAPSHOT with the first violation, if there is one."""
    bad = violations(g).orderBy("check", "key").limit(1).collect()
    if bad:
        raise GraphError("E_INVALID_SNAPSHOT", f"{bad[0]['check']}: {bad[0]['key']}", check=bad[0]["check"], key=bad[0]["key"])


def equal_topology(a: Graph, b: Graph, weights: bool = True) -> bool:
    """Whether two graphs have the same ids at the same indices and the same edges in the same order."""
    if a.directed != b.directed:
        return False
    cols = ["e", "src", "dst", *(["w"] if weights else [])]
    pairs = [(a.nodes.select("idx", "id"), b.nodes.select("idx", "id")), (a.edges.select(*cols), b.edges.select(*cols))]
    return not any(x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count() for x, y in pairs)


def content_hash(g: Graph) -> DataFrame:
    """One row, 16 hex digits: an order-free sum of row hashes, so tasks hash what they hold."""
    h = lambda df, tag: df.agg(F.coalesce(F.sum(F.xxhash64(F.lit(tag), *[F.col(c) for c in df.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(tag))
    both = h(g.nodes.select("idx", "id"), "nodes").crossJoin(h(g.edges.select("e", "src", "dst", "w"), "edges"))  # one row each
    return both.select(F.lower(F.lpad(F.hex(F.xxhash64("nodes", "edges", F.lit(g.directed))), 16, "0")).alias("hash"))
