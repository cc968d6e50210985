"""Views: pure functions of a graph that return a DataFrame aligned to idx, e or arc.

Arcs are the directed entries of an adjacency structure: one for an edge of a directed graph; two for an undirected
edge, one for an undirected loop. `arc` numbers them by (src, dst, e).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._tables import Scratch, numbered, running_sum
from ..errors import GraphError
from ..graph import Graph, weight


def halves(g: Graph) -> DataFrame:
    """(src, dst, e, w, forward): arcs without their numbers, which few operators need."""
    one = g.edges.select("src", "dst", "e", "w", F.lit(True).alias("forward"))
    if g.directed:
        return one
    return one.unionByName(g.edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "e", "w", F.lit(False).alias("forward")))


def arcs(g: Graph) -> DataFrame:
    """(arc, src, dst, e, w, forward): the adjacency entries in CSR order, numbered once for an edge table."""
    held = g.edges.__dict__.setdefault("_arcs", {})
    if g.directed not in held:
        out = numbered(halves(g), ["src", "dst", "e", "forward"], "arc", Scratch(g.spark))
        held[g.directed] = out.select("arc", "src", "dst", "e", "w", "forward")
    return held[g.directed]


def row_ptr(g: Graph) -> DataFrame:
    """(idx, first, past): each node's half-open range of arcs."""
    return running_sum(out_degree(g), "idx", "out_degree", "past").select("idx", (F.col("past") - F.col("out_degree")).alias("first"), "past")


def coo(g: Graph) -> DataFrame:
    """(arc, src, dst, w)"""
    return arcs(g).select("arc", "src", "dst", "w")


def edge_list(g: Graph) -> DataFrame:
    """(e, src, dst, w): each logical edge once, as declared."""
    return g.edges.select("e", "src", "dst", "w")


def reverse(g: Graph) -> DataFrame:
    """(arc, src, dst, e, w): in-adjacency; src is the node whose row it is, dst the neighbour the edge comes from.
    An undirected graph's is its out-adjacency."""
    if not g.directed:
        return arcs(g).select("arc", "src", "dst", "e", "w")
    turned = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "e", "w")
    return numbered(turned, ["src", "dst", "e"], "arc", Scratch(g.spark)).select("arc", "src", "dst", "e", "w")


def _per_node(g: Graph, rows: DataFrame, value, name: str, none) -> DataFrame:
    """(idx, name): an aggregate of rows (idx, ...) for every node, `none` for those without rows."""
    by = rows.groupBy("idx").agg(value.alias(name))
    return g.nodes.select("idx").join(by, "idx", "left").select("idx", F.coalesce(name, none).alias(name))


def out_degree(g: Graph) -> DataFrame:
    """(idx, out_degree): a node's row length; a loop counts once."""
    return _per_node(g, halves(g).select(F.col("src").alias("idx")), F.count("*"), "out_degree", F.lit(0).cast("long"))


def in_degree(g: Graph) -> DataFrame:
    """(idx, in_degree): undirected, the out-degree."""
    ends = halves(g).select(F.col("src" if not g.directed else "dst").alias("idx"))
    return _per_node(g, ends, F.count("*"), "in_degree", F.lit(0).cast("long"))


def ends(g: Graph) -> DataFrame:
    """(idx, e, w): both ends of every edge, so a loop has two."""
    both = F.explode(F.array("src", "dst")).alias("idx")
    return g.edges.select(both, "e", "w")


def degree(g: Graph) -> DataFrame:
    """(idx, degree): edge ends at the node."""
    return _per_node(g, ends(g), F.count("*"), "degree", F.lit(0).cast("long"))


def weighted_out_degree(g: Graph) -> DataFrame:
    return _per_node(g, halves(g).select(F.col("src").alias("idx"), "w"), F.sum(weight()), "weight", F.lit(0.0))


def weighted_in_degree(g: Graph) -> DataFrame:
    return _per_node(g, halves(g).select(F.col("dst" if g.directed else "src").alias("idx"), "w"), F.sum(weight()), "weight", F.lit(0.0))


def weighted_degree(g: Graph) -> DataFrame:
    return _per_node(g, ends(g), F.sum(weight()), "weight", F.lit(0.0))


def self_loop_arcs(g: Graph) -> DataFrame:
    """(arc, idx, e) of the loops."""
    return arcs(g).filter("src = dst").select("arc", F.col("src").alias("idx"), "e")


def self_loops(g: Graph) -> DataFrame:
    """(idx, loops, weight) of every node."""
    by = g.edges.filter("src = dst").groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("loops"), F.sum(weight()).alias("weight"))
    return g.nodes.select("idx").join(by, "idx", "left").na.fill({"loops": 0, "weight": 0.0})


def total_weight(g: Graph) -> DataFrame:
    """One row: the weight of all logical edges."""
    return g.edges.agg(F.coalesce(F.sum(weight()), F.lit(0.0)).alias("total_weight"))


def mate(g: Graph) -> DataFrame:
    """(arc, mate): the opposite arc of each arc of an undirected graph; a loop is its own. As an edge's two arcs
    share e, parallel edges pair up by it."""
    if g.directed:
        raise GraphError("E_DIRECTED", "arcs of a directed graph have no mates")
    a = arcs(g)
    other = a.select(F.col("arc").alias("mate"), F.col("e").alias("e_"), F.col("forward").alias("f_"))
    return a.join(other, (F.col("e") == F.col("e_")) & ((F.col("forward") != F.col("f_")) | (F.col("src") == F.col("dst")))).select("arc", "mate")


#: Degree tiers: the least degree of each but the last.
TIERS = (1024, 32, 1)


def degree_order(g: Graph, of: str = "forward") -> DataFrame:
    """(place, idx, degree, tier): by descending row length of the out- (or `reverse`: in-) adjacency, then idx."""
    d = out_degree(g).withColumnRenamed("out_degree", "degree") if of == "forward" else in_degree(g).withColumnRenamed("in_degree", "degree")
    tier = F.when(F.col("degree") >= TIERS[0], 0).when(F.col("degree") >= TIERS[1], 1).when(F.col("degree") >= TIERS[2], 2).otherwise(3)
    placed = numbered(d.withColumn("__neg", -F.col("degree")), ["__neg", "idx"], "place", Scratch(g.spark))
    return placed.select("place", "idx", "degree", tier.alias("tier"))


def is_symmetric(g: Graph) -> DataFrame:
    """One row, `symmetric`: every (u, v) has as many arcs of the same weights as (v, u). A weight of u -> v counts
    +1 on its unordered pair and v -> u counts -1, so no list of weights is gathered."""
    if not g.directed:
        return g.edges.sparkSession.range(1).select(F.lit(True).alias("symmetric"))
    signed = g.edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), weight().alias("w")).agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(-1)).alias("d"))
    return signed.agg(F.coalesce(F.max(F.abs("d")) == 0, F.lit(True)).alias("symmetric"))


def flags(g: Graph) -> DataFrame:
    """One row of predicates, each computed."""
    pair = (F.col("src"), F.col("dst")) if g.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    parallel = g.edges.groupBy(*[c.alias(n) for c, n in zip(pair, "uv", strict=True)]).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("multigraph"))
    w = F.col("w").cast("double")
    rest = g.edges.agg(
        F.coalesce(F.max((F.col("src") == F.col("dst")).cast("int")) == 1, F.lit(False)).alias("has_self_loops"),
        F.coalesce(F.min((weight() == 1.0).cast("int")) == 1, F.lit(True)).alias("all_weights_one"),
        F.coalesce(F.min((weight() >= 0.0).cast("int")) == 1, F.lit(True)).alias("non_negative_weights"),
        F.coalesce(F.max((F.abs(w) == F.lit(float("inf"))).cast("int")) == 0, F.lit(True)).alias("finite_weights"),
    )
    return parallel.crossJoin(rest).withColumn("weighted", F.lit(g.weighted))  # one row each


#: How arc values of an edge become one.
FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def fold_arcs(g: Graph, values: DataFrame, how: str = "first") -> DataFrame:
    """(e, value) from values (arc, value): `first` takes the declared orientation's."""
    both = arcs(g).select("arc", "e", "forward").join(values, "arc")
    if how == "first":
        return both.filter("forward").select("e", "value")
    return both.groupBy("e").agg(FOLDS[how]("value").alias("value"))


def expand_edges(g: Graph, values: DataFrame) -> DataFrame:
    """(arc, value) from values (e, value)."""
    return arcs(g).select("arc", "e").join(values, "e").select("arc", "value")


def adjacency(g: Graph) -> DataFrame:
    """(src, neighbours): array<struct<dst, e, w>> by (dst, e). For nodes of bounded degree; algorithms join instead."""
    return halves(g).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "e", "w"))).alias("neighbours"))
