"""Graphs from tables: edge lists with ids, dense edge arrays, CSR arrays, node-link records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._tables import Scratch, numbered
from ..errors import GraphError
from ..graph import Graph, empty_edges


def _weight(column: str | None) -> Column:
    return F.lit(None).cast("float") if column is None else F.col(column).cast("float")


def check_weights(edges: DataFrame, column: str = "w") -> None:
    """A weight may be infinite but not NaN."""
    if edges.filter(F.isnan(column)).limit(1).count():
        raise GraphError("E_INVALID_WEIGHT", "a weight is NaN")


def from_edges(edges: DataFrame, src: str, dst: str, order: list[str], weight: str | None = None, directed: bool = True, nodes: DataFrame | None = None, node_id: str = "id", node_order: list[str] | None = None, keep: list[str] | None = None, strict: bool = False) -> Graph:
    """A graph of an edge table with ids of one type.

    Edges are numbered by `order`, which has to be total. Nodes of the node table come first, by node_order; then
    endpoints by first appearance, sources before targets. strict: an endpoint that the node table lacks is
    E_UNKNOWN_NODE instead. Rows with a null endpoint are E_INVALID_ID. keep: edge columns kept as attributes.
    """
    scratch = Scratch(edges.sparkSession)
    kept = keep or []
    if edges.filter(F.col(src).isNull() | F.col(dst).isNull()).limit(1).count():
        raise GraphError("E_INVALID_ID", "an edge has a null endpoint")
    rows = numbered(edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"), _weight(weight).alias("w"), *kept, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]), [f"__o{i}" for i in range(len(order))], "e", scratch)
    ends = rows.select(F.explode(F.array(F.struct(F.col("__s").alias("id"), (2 * F.col("e")).alias("at")), F.struct(F.col("__d").alias("id"), (2 * F.col("e") + 1).alias("at")))).alias("x")).groupBy("x.id").agg(F.min("x.at").alias("at"))
    if nodes is None:
        found = numbered(ends, ["at"], "idx", scratch).select("idx", "id")
    else:
        listed = numbered(nodes.dropDuplicates([node_id]), node_order or [node_id], "idx", scratch).withColumnRenamed(node_id, "id")
        extra = ends.join(listed.select("id"), "id", "left_anti")
        if strict:
            if extra.limit(1).count():
                raise GraphError("E_UNKNOWN_NODE", "an endpoint is not in the node table")
            found = listed
        else:
            found = listed.unionByName(numbered(extra, ["at"], "idx", scratch, start=listed.count()).select("idx", "id"), allowMissingColumns=True)
        found = found.select("idx", "id", *[c for c in found.columns if c not in ("idx", "id")])
    of = lambda end, name: found.select(F.col("idx").alias(name), F.col("id").alias(end))
    out = rows.join(of("__s", "src"), "__s").join(of("__d", "dst"), "__d").select("e", "src", "dst", "w", *kept)
    graph = Graph(found, scratch.table(out, "edges"), directed, weight is not None)
    if weight is not None:
        check_weights(graph.edges)
    return graph


def from_edge_arrays(edges: DataFrame, node_count: int | None = None, directed: bool = True, weighted: bool = False) -> Graph:
    """A graph of dense indices: edges has e, src, dst and, if weighted, w.

    Without node_count, nodes are 0 .. the largest index; ids are the indices. An index outside is E_INDEX_RANGE.
    A weight that isn't exact as FLOAT keeps a `w64` column beside it.
    """
    spark = edges.sparkSession
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    n = node_count if node_count is not None else 0 if high is None else high + 1
    if high is not None and (low < 0 or high >= n):
        raise GraphError("E_INDEX_RANGE", f"endpoints from {low} to {high}, {n} nodes")
    nodes = spark.range(n).select(F.col("id").alias("idx"), F.col("id").alias("id"))
    rows = edges.select(F.col("e").cast("long").alias("e"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col("w").cast("float") if weighted else F.lit(None).cast("float")).alias("w"), *([F.col("w").cast("double").alias("w64")] if weighted else []))
    if weighted:
        check_weights(rows)
        if not rows.filter(F.col("w").cast("double") != F.col("w64")).limit(1).count():
            rows = rows.drop("w64")
    return Graph(nodes, rows, directed, weighted)


def from_csr(row_ptr: DataFrame, col_idx: DataFrame, directed: bool = True, weighted: bool = False) -> Graph:
    """A graph of CSR arrays: row_ptr (row, first, past) and col_idx (arc, dst[, w]), an edge for each arc of a
    directed graph. Row ranges that overlap, leave gaps or pass the arcs are E_INVALID_SNAPSHOT."""
    arcs = col_idx.count()
    n, least, most, total = row_ptr.agg(F.count("*"), F.min("first"), F.max("past"), F.sum(F.col("past") - F.col("first"))).first()
    bad = row_ptr.filter("past < first").limit(1).count()
    if bad or (total or 0) != arcs or (n and (least != 0 or most != arcs)):
        raise GraphError("E_INVALID_SNAPSHOT", "row ranges don't cover the arcs")
    rows = row_ptr.filter("past > first").select(F.col("row").alias("src"), F.explode(F.sequence("first", F.col("past") - 1)).alias("arc"))
    e = rows.join(col_idx, "arc").select(F.col("arc").cast("long").alias("e"), "src", "dst", *(["w"] if weighted else []))
    return from_edge_arrays(e, n, directed, weighted)


#: The keys that hold an edge's ends, in order of preference.
SOURCE_KEYS, TARGET_KEYS = ("source", "src", "from"), ("target", "dst", "to")


def from_records(nodes: DataFrame | None, links: DataFrame, order: list[str], node_id: str | None = "id", weight: str | None = None, directed: bool = True, node_order: list[str] | None = None) -> Graph:
    """A graph of node-link records. node_id None: links name nodes by their place in node_order."""
    pick = lambda keys: next((k for k in keys if k in links.columns), None)
    src, dst = pick(SOURCE_KEYS), pick(TARGET_KEYS)
    if src is None or dst is None:
        raise GraphError("E_UNKNOWN_COLUMN", f"no {SOURCE_KEYS} or {TARGET_KEYS}")
    keep = [c for c in links.columns if c not in (src, dst, weight, *order)]
    if node_id is None and nodes is not None:
        nodes = nodes.withColumnRenamed("id", "id_")  # the place is the id
        node_order = ["id_" if c == "id" else c for c in node_order or nodes.columns]
        placed = numbered(nodes, node_order or nodes.columns, "__place", Scratch(links.sparkSession))
        return from_edges(links, src, dst, order, weight, directed, placed, "__place", ["__place"], keep, strict=True)
    return from_edges(links, src, dst, order, weight, directed, nodes, node_id or "id", node_order, keep)


def edgeless(nodes: DataFrame, node_id: str, order: list[str], directed: bool = True) -> Graph:
    """A graph of isolated nodes."""
    listed = numbered(nodes.dropDuplicates([node_id]), order, "idx", Scratch(nodes.sparkSession)).withColumnRenamed(node_id, "id")
    return Graph(listed, empty_edges(nodes.sparkSession), directed)
