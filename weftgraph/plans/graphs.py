"""Graphs on the sample tables, and the same graphs as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .._tables import Scratch, numbered
from ..graph import Graph
from ..sources.tables import from_edges

_built: dict[tuple, Graph] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> Graph:
    """Built once for an application and folder; its tables stay in the shared folder until the driver ends."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def transitions(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Users, with an edge from each event's user to the next event's (by time, then id), of the first's value."""

    def make() -> Graph:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
        at = numbered(events, ["ts", "event_id"], "pos", Scratch(spark)).select("pos", "user_id", "value")
        then = at.select((F.col("pos") - 1).alias("pos"), F.col("user_id").alias("next"))
        return from_edges(at.join(then, "pos"), "user_id", "next", ["pos"], "value")

    return _once(spark, sf_dir, "transitions", make).with_(directed=directed)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and parts, with an edge for each order line, of its quantity; price is an attribute."""

    def make() -> Graph:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
        named = lines.select(*order, F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("p"), "l_quantity", F.col("l_extendedprice").alias("price"))
        return from_edges(named, "s", "p", order, "l_quantity", keep=["price"])

    return _once(spark, sf_dir, "trade", make)


def containment(spark: SparkSession, sf_dir: str):
    """(idx, id, parent): regions, nations and customers, each row's parent by its index."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    r, n, c = read("region"), read("nation"), read("customer")
    one = lambda df, kind, key, parent: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), (F.col(parent).cast("long") if parent else F.lit(None).cast("long")).alias("up"))
    rows = one(r, 0, "r_regionkey", None).unionByName(one(n, 1, "n_nationkey", "n_regionkey")).unionByName(one(c, 2, "c_custkey", "c_nationkey"))
    placed = numbered(rows, ["kind", "key"], "idx", Scratch(spark))
    above = placed.select((F.col("kind") + 1).alias("k_"), F.col("key").alias("u_"), F.col("idx").alias("parent"))
    return placed.join(above, (F.col("kind") == F.col("k_")) & (F.col("up") == F.col("u_")), "left").select("idx", "kind", "key", "parent")


#: V (idx, id) and E (e, src, dst, w) of transitions.
TRANSITIONS = """
ev AS (SELECT user_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
e0 AS (SELECT a.pos AS e, a.user_id AS s, b.user_id AS d, a.value::FLOAT AS w FROM ev a JOIN ev b ON b.pos = a.pos + 1),
en AS (SELECT s AS id, 2 * e AS at_ FROM e0 UNION ALL SELECT d, 2 * e + 1 FROM e0),
V AS (SELECT row_number() OVER (ORDER BY min(at_)) - 1 AS idx, id FROM en GROUP BY id),
E AS (SELECT e, a.idx AS src, b.idx AS dst, w FROM e0 JOIN V a ON s = a.id JOIN V b ON d = b.id)"""

#: V and E of trade, with price.
TRADE = """
e0 AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS e,
  'S' || l_suppkey AS s, 'P' || l_partkey AS d, l_quantity::FLOAT AS w, l_extendedprice AS price FROM lineitem),
en AS (SELECT s AS id, 2 * e AS at_ FROM e0 UNION ALL SELECT d, 2 * e + 1 FROM e0),
V AS (SELECT row_number() OVER (ORDER BY min(at_)) - 1 AS idx, id FROM en GROUP BY id),
E AS (SELECT e, a.idx AS src, b.idx AS dst, w, price FROM e0 JOIN V a ON s = a.id JOIN V b ON d = b.id)"""

#: H (src, dst, e, w, forward): the arcs of the undirected graph.
HALVES = """
H AS (SELECT src, dst, e, w, true AS forward FROM E UNION ALL SELECT dst, src, e, w, false FROM E WHERE src <> dst)"""

#: T (idx, kind, key, parent) of containment.
CONTAINMENT = """
t0 AS (SELECT 0 AS kind, r_regionkey::BIGINT AS key, NULL::BIGINT AS up FROM region UNION ALL SELECT 1, n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 2, c_custkey, c_nationkey FROM customer),
t1 AS (SELECT *, row_number() OVER (ORDER BY kind, key) - 1 AS idx FROM t0),
T AS (SELECT a.idx, a.kind, a.key, b.idx AS parent FROM t1 a LEFT JOIN t1 b ON b.kind = a.kind - 1 AND b.key = a.up)"""
