"""Derived graphs. Each result carries where its rows came from.

node_origin (idx, old) and edge_origin (e, old) map new to old; node_remap and edge_remap (old, new) map old to new,
with null for what was dropped or, for merged rows, the row that took them in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._tables import Scratch, numbered
from ..errors import GraphError
from ..graph import EDGE_KEYS, NODE_KEYS, Graph, weight


@dataclass(frozen=True)
class Derived:
    graph: Graph
    node_origin: DataFrame
    edge_origin: DataFrame
    node_remap: DataFrame
    edge_remap: DataFrame


def _same_nodes(g: Graph) -> DataFrame:
    return g.nodes.select("idx", F.col("idx").alias("old"))


def _renumbered(g: Graph, edges: DataFrame, old: str = "e") -> DataFrame:
    """edges with a new dense `e` by ascending `old`, kept as `__old`."""
    return numbered(edges.withColumnRenamed(old, "__old"), ["__old"], "e", Scratch(g.spark))


def _remap(all_: DataFrame, key: str, origin: DataFrame, new: str) -> DataFrame:
    return all_.select(F.col(key).alias("old")).join(origin.select("old", F.col(new).alias("new")), "old", "left")


def _edges_only(g: Graph, edges: DataFrame, **changes) -> Derived:
    """A graph on the same nodes with some of the edges, in their order."""
    kept = _renumbered(g, edges)
    origin = kept.select("e", F.col("__old").alias("old"))
    out = g.with_(edges=kept.select("e", *[c for c in g.edges.columns if c != "e"]), **changes)
    return Derived(out, _same_nodes(g), origin, _same_nodes(g).select("old", F.col("idx").alias("new")), _remap(g.edges, "e", origin, "e"))


def transpose(g: Graph) -> Derived:
    """Ends swapped; rows and numbers stay. An undirected graph is itself."""
    turned = g.edges if not g.directed else g.edges.select("e", F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in g.edges.columns if c not in ("e", "src", "dst")])
    same_e = g.edges.select("e", F.col("e").alias("old"))
    return Derived(g.with_(edges=turned), _same_nodes(g), same_e, _same_nodes(g).select("old", F.col("idx").alias("new")), same_e.select("old", F.col("e").alias("new")))


def without_self_loops(g: Graph) -> Derived:
    return _edges_only(g, g.edges.filter("src <> dst"))


def filter_edges(g: Graph, mask: Column | DataFrame) -> Derived:
    """Edges where a condition over the edge columns is true, or whose e is in a table (e); an e that is no edge of the
    graph is E_MASK_LENGTH."""
    if not isinstance(mask, Column) and mask.select("e").join(g.edges.select("e"), "e", "left_anti").limit(1).count():
        raise GraphError("E_MASK_LENGTH", "the mask has an edge that the graph has not")
    kept = g.edges.filter(mask) if isinstance(mask, Column) else g.edges.join(mask.select("e").distinct(), "e", "left_semi")
    return _edges_only(g, kept)


def to_undirected(g: Graph, reciprocal: bool = False, weights: str = "first") -> Derived:
    """The k-th u -> v and the k-th v -> u, in edge order, become one undirected edge.

    The earlier of the two survives, in its orientation; weights: first, last, sum, min or max of both. reciprocal:
    edges with no partner go, but for loops. Unpaired edges and loops otherwise stay as they are.
    """
    if not g.directed:
        return filter_edges(g, F.lit(True))
    k = F.row_number().over(Window.partitionBy("src", "dst").orderBy("e"))
    ranked = g.edges.filter("src <> dst").withColumn("__k", k)
    pair = [F.least("src", "dst"), F.greatest("src", "dst"), F.col("__k")]
    by = Window.partitionBy(*pair)
    of = {"sum": F.sum(weight()).over(by), "min": F.min(weight()).over(by), "max": F.max(weight()).over(by), "first": F.min_by(weight(), "e").over(by), "last": F.max_by(weight(), "e").over(by)}[weights]
    told = ranked.withColumn("__n", F.count("*").over(by)).withColumn("__first", F.min("e").over(by)).withColumn("__w", of.cast("float"))
    told = told.withColumn("w", F.when(F.col("__n") == 2, F.col("__w") if g.weighted or weights == "sum" else F.col("w")).otherwise(F.col("w")))
    alive = told.filter("e = __first" + (" and __n = 2" if reciprocal else "")).select(*g.edges.columns)
    out = _edges_only(g, alive.unionByName(g.edges.filter("src = dst")), directed=False, weighted=g.weighted or weights == "sum")
    taken = told.filter("__n = 2 and e <> __first").select(F.col("e").alias("e_"), "__first")
    merged = out.edge_remap.join(taken, F.col("old") == F.col("e_"), "left").join(out.edge_origin.select(F.col("old").alias("o_"), F.col("e").alias("n_")), F.col("o_") == F.col("__first"), "left")
    return Derived(out.graph, out.node_origin, out.edge_origin, out.node_remap, merged.select("old", F.coalesce("new", "n_").alias("new")))


#: Reducers of a group of edges, by name: (value, order) to an aggregate. Nulls are unset rows.
REDUCERS = {
    "first": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, o),
    "sum": lambda v, o: F.sum(v.cast("double")),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "mean": lambda v, o: F.avg(v.cast("double")),
    "count": lambda v, o: F.count(F.lit(1)),
}


def exact_sum(w: Column, order: Column) -> Column:
    """The sum of FLOATs rounded to FLOAT at each step, in the given order; gathers its group, so only for small ones."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), w.alias("w"))))
    return F.aggregate(rows, F.lit(0.0).cast("float"), lambda a, x: (a + x["w"]).cast("float"))


def _pair(g: Graph) -> list[Column]:
    if g.directed:
        return [F.col("src").alias("__u"), F.col("dst").alias("__v")]
    return [F.least("src", "dst").alias("__u"), F.greatest("src", "dst").alias("__v")]


def reduced(rows: DataFrame, keys: list[Column], order: str, reducers: dict[str, str]) -> DataFrame:
    """One row for each key: the aggregates of the named columns and `__first`, the least order."""
    for name, how in reducers.items():
        if how != "drop" and how not in REDUCERS:
            raise GraphError("E_UNSUPPORTED", f"reducer {how}")
        if how != "count" and name not in rows.columns:
            raise GraphError("E_UNKNOWN_COLUMN", name)
    o = F.col(order)
    return rows.groupBy(*keys).agg(F.min(o).alias("__first"), *[REDUCERS[how](F.col(n) if n in rows.columns else o, o).alias(f"__r_{n}") for n, how in reducers.items() if how != "drop"])


def simplified(g: Graph, weights: str = "first", self_loops: str = "keep", reducers: dict[str, str] | None = None) -> Derived:
    """One edge for each (ordered, if directed) pair of nodes: the one of least e gives orientation, place and all
    columns that no reducer names. weights: first, last, sum, min or max; `sum` of an unweighted graph counts."""
    rows = g.edges if self_loops == "keep" else g.edges.filter("src <> dst")
    rows = rows.withColumn("__w", weight())
    named = {"__w": weights, **(reducers or {})}
    by = reduced(rows, _pair(g), "e", named)
    weighted = g.weighted or weights == "sum"
    alive = rows.join(by, rows["e"] == by["__first"])
    cols = [F.col("e"), F.col("src"), F.col("dst"), (F.col("__r___w").cast("float") if weighted else F.lit(None).cast("float")).alias("w")]
    names = [n for n in [*g.edge_attributes(), *[n for n in named if n not in g.edges.columns and n != "__w"]] if named.get(n) != "drop"]
    cols += [F.col(f"__r_{n}").alias(n) if n in named else F.col(n) for n in names]
    kept = _renumbered(g, alive.select(*cols))
    origin = kept.select("e", F.col("__old").alias("old"))
    out = g.with_(edges=kept.select("e", "src", "dst", "w", *names), weighted=weighted)
    member = rows.select("e", *_pair(g)).join(by.select("__u", "__v", "__first"), ["__u", "__v"]).join(origin.select(F.col("old").alias("__first"), F.col("e").alias("new")), "__first").select(F.col("e").alias("old"), "new")
    return Derived(out, _same_nodes(g), origin, _same_nodes(g).select("old", F.col("idx").alias("new")), g.edges.select(F.col("e").alias("old")).join(member, "old", "left"))


def induced_subgraph(g: Graph, chosen: Column | DataFrame) -> Derived:
    """The graph on some nodes: a condition over the node columns keeps their order; a table (idx[, place]) gives the
    new one. Repeated or unknown indices are E_INDEX_RANGE."""
    scratch = Scratch(g.spark)
    if isinstance(chosen, Column):
        picked = numbered(g.nodes.filter(chosen).select(F.col("idx").alias("old")), ["old"], "idx", scratch)
    else:
        place = "place" if "place" in chosen.columns else "idx"
        rows = chosen.select(F.col("idx").alias("old"), F.col(place).alias("__place"))
        n, m = rows.agg(F.count("*"), F.count_distinct("old")).first()
        if n != m or rows.join(g.nodes.select(F.col("idx").alias("old")), "old", "left_anti").limit(1).count():
            raise GraphError("E_INDEX_RANGE", "an index is repeated or not in the graph")
        picked = numbered(rows, ["__place"], "idx", scratch).select("old", "idx")
    return _on_nodes(g, picked)


def _on_nodes(g: Graph, picked: DataFrame) -> Derived:
    """The graph on the nodes of (old, idx), edges in their order."""
    nodes = g.nodes.withColumnRenamed("idx", "old").join(picked, "old").select("idx", *[c for c in g.nodes.columns if c != "idx"])
    s, d = (picked.select(F.col("old").alias(c), F.col("idx").alias(f"__{c}")) for c in ("src", "dst"))
    rest = [c for c in g.edges.columns if c not in ("e", "src", "dst")]
    edges = g.edges.join(s, "src").join(d, "dst").select("e", F.col("__src").alias("src"), F.col("__dst").alias("dst"), *rest)
    kept = _renumbered(g, edges)
    origin = kept.select("e", F.col("__old").alias("old"))
    return Derived(g.with_(nodes=nodes, edges=kept.select("e", "src", "dst", *rest)), picked.select("idx", "old"), origin, _remap(g.nodes, "idx", picked, "idx"), _remap(g.edges, "e", origin, "e"))


def relabel(g: Graph, permutation: DataFrame) -> Derived:
    """Node `old` becomes `new`, from a table (old, new) that permutes 0 .. n - 1 (E_INVALID_PERMUTATION); edges stay."""
    n = g.node_count()
    k, a, b, low, high = permutation.agg(F.count("*"), F.count_distinct("old"), F.count_distinct("new"), F.least(F.min("old"), F.min("new")), F.greatest(F.max("old"), F.max("new"))).first()
    if k != n or a != n or b != n or (n and (low != 0 or high != n - 1)):
        raise GraphError("E_INVALID_PERMUTATION", f"{k} rows for {n} nodes")
    picked = permutation.select(F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("idx"))
    nodes = g.nodes.withColumnRenamed("idx", "old").join(picked, "old").select("idx", *[c for c in g.nodes.columns if c != "idx"])
    s, d = (picked.select(F.col("old").alias(c), F.col("idx").alias(f"__{c}")) for c in ("src", "dst"))
    edges = g.edges.join(s, "src").join(d, "dst").select("e", F.col("__src").alias("src"), F.col("__dst").alias("dst"), *[c for c in g.edges.columns if c not in ("e", "src", "dst")])
    same_e = g.edges.select("e", F.col("e").alias("old"))
    return Derived(g.with_(nodes=nodes, edges=edges), picked.select("idx", "old"), same_e, picked.select("old", F.col("idx").alias("new")), same_e.select("old", F.col("e").alias("new")))


def renumber_partition(partition: DataFrame) -> DataFrame:
    """(idx, label) with labels 0 .. k - 1 by the least idx of each, from (idx, label)."""
    firsts = partition.groupBy("label").agg(F.min("idx").alias("__first"))
    ranked = numbered(firsts, ["__first"], "__new", Scratch(partition.sparkSession))
    return partition.join(ranked.select("label", "__new"), "label").select("idx", F.col("__new").alias("label"))


def contract(g: Graph, partition: DataFrame, weights: str = "sum", self_loops: str = "keep", parallel: str = "merge", reducers: dict[str, str] | None = None, node_reducers: dict[str, str] | None = None) -> tuple[Derived, DataFrame]:
    """Blocks of nodes become nodes, from (idx, label); also (idx, size) of the blocks.

    Labels that are 0 .. k - 1 stay; others are renumbered by first appearance. Ids of the result are its indices.
    Columns go unless a reducer names them. A node without a label is E_PARTITION. parallel: `merge` makes one edge
    of each pair of blocks, `keep` keeps all.
    """
    if g.nodes.join(partition.filter("label is not null"), "idx", "left_anti").limit(1).count():
        raise GraphError("E_PARTITION", "a node has no label")
    k, low, high = partition.agg(F.count_distinct("label"), F.min("label"), F.max("label")).first()
    dense = k == 0 or (isinstance(low, int) and low == 0 and high == k - 1)
    blocks = Scratch(g.spark).table(partition.select("idx", F.col("label").cast("long").alias("label")) if dense else renumber_partition(partition), "blocks")
    sizes = blocks.groupBy(F.col("label").alias("idx")).agg(F.count("*").alias("size"))
    named = node_reducers or {}
    if named:
        by = reduced(g.nodes.join(blocks, "idx"), [F.col("label")], "idx", named)
        nodes = by.select(F.col("label").alias("idx"), F.col("label").alias("id"), *[F.col(f"__r_{n}").alias(n) for n in named if named[n] != "drop"])
    else:
        nodes = sizes.select("idx", F.col("idx").alias("id"))
    s, d = (blocks.select(F.col("idx").alias(c), F.col("label").alias(f"__{c}")) for c in ("src", "dst"))
    rest = [c for c in g.edges.columns if c not in ("e", "src", "dst") and (c == "w" or c in (reducers or {}))]
    edges = g.edges.join(s, "src").join(d, "dst").select("e", F.col("__src").alias("src"), F.col("__dst").alias("dst"), *rest)
    moved = g.with_(nodes=nodes, edges=edges)
    if parallel == "merge":
        out = simplified(moved, weights, self_loops, reducers)
    else:
        out = _edges_only(moved, edges if self_loops == "keep" else edges.filter("src <> dst"))
    origin = blocks.groupBy("label").agg(F.min("idx").alias("old")).select(F.col("label").alias("idx"), "old")
    return Derived(out.graph, origin, out.edge_origin, blocks.select(F.col("idx").alias("old"), F.col("label").alias("new")), out.edge_remap), sizes


def with_columns(g: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """g with further columns from tables keyed by idx or e; rows without a value have null."""
    out = g
    if nodes is not None:
        taken = [c for c in nodes.columns if c in g.nodes.columns and c != "idx"]
        if taken:
            raise GraphError("E_COLUMN_EXISTS", ", ".join(taken))
        out = out.with_(nodes=g.nodes.join(nodes, "idx", "left"))
    if edges is not None:
        taken = [c for c in edges.columns if c in g.edges.columns and c != "e"]
        if taken:
            raise GraphError("E_COLUMN_EXISTS", ", ".join(taken))
        out = out.with_(edges=g.edges.join(edges, "e", "left"))
    return out


def attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*NODE_KEYS, *EDGE_KEYS)]
