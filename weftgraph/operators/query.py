"""Point and bulk look-ups on arcs, edges and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import Graph
from . import views


def out_arcs(g: Graph, nodes: DataFrame) -> DataFrame:
    """(idx, arc, dst, e, w) of the given nodes (idx)."""
    a = views.arcs(g).withColumnRenamed("src", "idx")
    return a.join(nodes.select("idx").distinct(), "idx", "left_semi").select("idx", "arc", "dst", "e", "w")


def find_arcs(g: Graph, pairs: DataFrame) -> DataFrame:
    """(src, dst, arc, multiplicity) for each pair (src, dst): the first arc of the pair, the one of least e, null if
    there is none, and how many there are. The arcs of a pair are consecutive."""
    by = views.arcs(g).groupBy("src", "dst").agg(F.min("arc").alias("arc"), F.count("*").alias("multiplicity"))
    return pairs.select("src", "dst").distinct().join(by, ["src", "dst"], "left").select("src", "dst", "arc", F.coalesce("multiplicity", F.lit(0)).alias("multiplicity"))


def multiplicities(g: Graph) -> DataFrame:
    """(src, dst, multiplicity) of all pairs of nodes with an arc."""
    return views.halves(g).groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))


def arc_sources(g: Graph, arcs: DataFrame) -> DataFrame:
    """(arc, src, dst, e) of the given arcs; an arc that isn't there is E_INDEX_RANGE."""
    out = arcs.select("arc").join(views.arcs(g).select("arc", "src", "dst", "e"), "arc", "left")
    if out.filter("src is null").limit(1).count():
        raise GraphError("E_INDEX_RANGE", "no such arc")
    return out


def edge_ends(g: Graph, edges: DataFrame) -> DataFrame:
    """(e, src, dst) of the given edges; an edge that isn't there is E_INDEX_RANGE."""
    out = edges.select("e").join(g.edges.select("e", "src", "dst"), "e", "left")
    if out.filter("src is null").limit(1).count():
        raise GraphError("E_INDEX_RANGE", "no such edge")
    return out


def edges_by_id(g: Graph, ids: DataFrame, column: str) -> DataFrame:
    """(id, e) of edges by a unique id column, null e for unknown ids. Repeated ids are E_DUPLICATE_EDGE_ID."""
    check_unique(g.edges, column, "E_DUPLICATE_EDGE_ID")
    return ids.select("id").join(g.edges.select(F.col(column).alias("id"), "e"), "id", "left")


def check_unique(df: DataFrame, column: str, code: str = "E_DUPLICATE_ID") -> None:
    if df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").limit(1).count():
        raise GraphError(code, f"{column} repeats a value")


def self_loops_at(g: Graph, nodes: DataFrame) -> DataFrame:
    """(idx, loops)"""
    return nodes.select("idx").join(views.self_loops(g).select("idx", "loops"), "idx", "left")


def index_of(g: Graph, ids: DataFrame, strict: bool = False) -> DataFrame:
    """(id, idx), null for unknown ids; strict: E_UNKNOWN_NODE."""
    out = ids.select("id").join(g.nodes.select("id", "idx"), "id", "left")
    if strict and out.filter("idx is null").limit(1).count():
        raise GraphError("E_UNKNOWN_NODE", "an id is not in the graph")
    return out


def id_of(g: Graph, indices: DataFrame) -> DataFrame:
    """(idx, id); an index outside is E_INDEX_RANGE."""
    out = indices.select("idx").join(g.nodes.select("idx", "id"), "idx", "left")
    if out.filter("id is null").limit(1).count():
        raise GraphError("E_INDEX_RANGE", "no such node")
    return out


def keyed_by_id(g: Graph, values: DataFrame) -> DataFrame:
    """values (idx, ...) with the id in place of the index."""
    return values.join(g.nodes.select("idx", "id"), "idx").select("id", *[c for c in values.columns if c != "idx"])


def ids_slice(g: Graph, first: int, past: int) -> DataFrame:
    """(idx, id) of a range of indices."""
    return g.nodes.filter((F.col("idx") >= first) & (F.col("idx") < past)).select("idx", "id")
