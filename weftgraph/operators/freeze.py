"""Freezing a set of edges into a graph: loop and duplicate policies, weights, dense numbers and remaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._tables import Scratch, numbered
from ..errors import GraphError
from ..graph import Graph, weight
from .derive import REDUCERS, _pair


@dataclass(frozen=True)
class Report:
    """node_remap and edge_remap (old, new; new null if dropped), and counts of what the policies did."""

    node_remap: DataFrame
    edge_remap: DataFrame
    dropped_loops: int
    merged_edges: int


def freeze(g: Graph, self_loops: str = "keep", duplicates: str = "keep") -> tuple[Graph, Report]:
    """g with its policies applied, node and edge numbers dense again in their old order.

    self_loops: keep, drop or error (E_SELF_LOOP). duplicates: keep, error (E_DUPLICATE_EDGE), or first, last, sum,
    min, max, which leave one edge of each pair, unordered if undirected: the first, but for `last` the last; its
    weight is the policy's, summed as DOUBLE. `sum` of an unweighted graph counts.
    """
    scratch = Scratch(g.spark)
    edges = g.edges
    loops = edges.filter("src = dst")
    dropped = 0
    if self_loops == "error" and loops.limit(1).count():
        raise GraphError("E_SELF_LOOP", "the graph has a self-loop")
    if self_loops == "drop":
        dropped = loops.count()
        edges = edges.filter("src <> dst")
    merged, weighted = 0, g.weighted
    member = edges.select(F.col("e").alias("old"), F.col("e").alias("__to"))
    if duplicates != "keep":
        keys = _pair(g)
        by = edges.withColumn("__w", weight()).groupBy(*keys).agg(F.count("*").alias("__n"), (F.max("e") if duplicates == "last" else F.min("e")).alias("__to"), REDUCERS[duplicates if duplicates != "error" else "first"](F.col("__w"), F.col("e")).alias("__w"))
        if duplicates == "error":
            if by.filter("__n > 1").limit(1).count():
                raise GraphError("E_DUPLICATE_EDGE", "two edges join the same nodes")
        else:
            merged = by.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]
            member = edges.select(F.col("e").alias("old"), *keys).join(by.select("__u", "__v", "__to"), ["__u", "__v"]).select("old", "__to")
            weighted = g.weighted or duplicates == "sum"
            w = F.col("__w").cast("float") if weighted else F.lit(None).cast("float")
            edges = edges.join(by.select("__to", "__w"), edges["e"] == by["__to"]).withColumn("w", w).select(*g.edges.columns)
    nodes = numbered(g.nodes.withColumnRenamed("idx", "__old"), ["__old"], "idx", scratch)
    kept = numbered(edges.withColumnRenamed("e", "__old"), ["__old"], "e", scratch)
    s, d = (nodes.select(F.col("__old").alias(c), F.col("idx").alias(f"__{c}")) for c in ("src", "dst"))
    moved = kept.join(s, "src").join(d, "dst")
    out = g.with_(nodes=nodes.select("idx", *[c for c in g.nodes.columns if c != "idx"]), edges=moved.select("e", F.col("__src").alias("src"), F.col("__dst").alias("dst"), *[c for c in g.edges.columns if c not in ("e", "src", "dst")]), weighted=weighted)
    news = kept.select(F.col("__old").alias("__to"), F.col("e").alias("new"))
    remap = g.edges.select(F.col("e").alias("old")).join(member, "old", "left").join(news, "__to", "left").select("old", "new")
    return out, Report(nodes.select(F.col("__old").alias("old"), F.col("idx").alias("new")), remap, dropped, merged)


def inexact_weights(edges: DataFrame) -> DataFrame:
    """One row: whether a DOUBLE weight w64 isn't exact as FLOAT, so that its column has to be kept."""
    return edges.agg(F.coalesce(F.max((F.col("w64") != F.col("w64").cast("float").cast("double")).cast("int")) == 1, F.lit(False)).alias("inexact"))
