"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._tables import Scratch


def _least_of(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours. Partial sums before the shuffle, so a hub is no hot group."""
    return edges.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes with an edge in (a, b): the least node that can be reached.

    Each round is written to the shared folder; the loop ends when a round changes nothing. Null ends and loops
    are left out; repeated edges count once. No edges: no rows.
    """
    now = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = _both(now)
        large = both.join(_least_of(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now leads from a larger to a smaller node
        down = scratch.table(large, "large")
        least = _least_of(down)
        small = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        then = scratch.table(small, "small")
        scratch.drop(now, down)
        now, before = then, state
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == tuple(before):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, component): weak components of edges (src, dst), numbered by their least idx."""
    from .._tables import numbered

    scratch = Scratch(nodes.sparkSession)
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
    least = nodes.select("idx").join(found.withColumnRenamed("node", "idx"), "idx", "left").select("idx", F.coalesce("component", "idx").alias("least"))
    ranked = numbered(least.select("least").distinct(), ["least"], "component", scratch)
    return least.join(ranked, "least").select("idx", "component")
