"""Further registered queries with their SQL: sources, columns, masks, scalars, texts and dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._tables import Scratch, partitions
from ..functions import text as T
from ..graph import Graph, empty_edges, metadata
from ..operators import columns, derive, layout, query, tree, validate, views
from ..operators.freeze import freeze
from ..sources import formats, parsers, sinks, tables
from .builder import GraphBuilder
from .graphs import CONTAINMENT, HALVES, TRANSITIONS, containment, transitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[Graph], DataFrame], sql: str, directed: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(transitions(spark, sf_dir, directed))
    SQL[name] = f"WITH {TRANSITIONS}{'' if directed else ', ' + HALVES}\n{sql}"


def _on(name: str, table: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    SQL[name] = sql


# sources

_ARC = "row_number() OVER (ORDER BY src, dst, e) - 1"
_add("from_edge_arrays", lambda g: tables.from_edge_arrays(g.edges.select("e", "src", "dst", "w"), weighted=True).edges.select("e", "src", "dst", "w"), "SELECT e, src, dst, w FROM E")
_add("from_edge_arrays_nodes", lambda g: tables.from_edge_arrays(g.edges.select("e", "src", "dst"), g.node_count() + 5).nodes, "SELECT unnest(range((SELECT count(*) FROM V) + 5)) AS idx, idx AS id")
_add("from_csr", lambda g: tables.from_csr(views.row_ptr(g).withColumnRenamed("idx", "row"), views.coo(g).select("arc", "dst", "w"), weighted=True).edges.select("e", "src", "dst", "w"), f"SELECT {_ARC} AS e, src, dst, w FROM E")


def _records(spark: SparkSession, sf_dir: str, by_place: bool) -> Graph:
    """Nations as nodes, suppliers as links from their nation to another."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nodes = read("nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    links = read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("source"), (F.col("s_suppkey") % 25).cast("long").alias("target"), F.col("s_acctbal").alias("value"), "s_name")
    return tables.from_records(nodes, links, ["k"], None if by_place else "id", "value", node_order=["id"])


for _name, _by in (("from_records", False), ("from_records_by_place", True)):
    QUERIES[_name] = lambda spark, sf_dir, b=_by: _records(spark, sf_dir, b).edges.select("e", "src", "dst", "w", "s_name")
    SQL[_name] = "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS e, s_nationkey::BIGINT AS src, (s_suppkey % 25)::BIGINT AS dst, s_acctbal::FLOAT AS w, s_name FROM supplier"
QUERIES["from_records_nodes"] = lambda spark, sf_dir: _records(spark, sf_dir, False).nodes.select("idx", "id", "n_name")
SQL["from_records_nodes"] = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_nationkey::BIGINT AS id, n_name FROM nation"


def _edgeless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.degree(tables.edgeless(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")), "id", ["id"]))


QUERIES["edgeless"], SQL["edgeless"] = _edgeless, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, 0 AS degree FROM customer"

# formats: every dialect of JSON, mixed direction, hyperedges, sniffing


def _named(g: Graph) -> DataFrame:
    ids = g.nodes.select("idx", F.col("id").cast("string").alias("id"))
    return g.edges.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "dst").select("e", "source", "target", "w")


def _dialect(dialect: str):
    def run(g: Graph) -> DataFrame:
        at = Scratch(g.spark).path(dialect)
        sinks.save(sinks.document(g, dialect), at)
        return _named(formats.read(g.spark, f"{at}/part-*", "json", parts=True).graph)

    return run


_NAMED = "SELECT e, a.id::VARCHAR AS source, b.id::VARCHAR AS target, w FROM E JOIN V a ON src = a.idx JOIN V b ON dst = b.idx"
for _f in sinks.DIALECTS:
    _add("io_" + _f.replace("-", "_"), _dialect(_f), _NAMED)
    _add("io_" + _f.replace("-", "_") + "_undirected", _dialect(_f), _NAMED, False)


def _nested(format: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Regions, nations and customers written inside one another, and read back."""
        t = containment(spark, sf_dir)
        nodes = t.select("idx", F.concat_ws(" ", F.col("kind").cast("string"), F.col("key").cast("string")).alias("id"), "parent")
        g = Graph(metadata(nodes, "parent", role="parent", refersTo="node"), empty_edges(spark))
        at = Scratch(spark).path(format)
        sinks.document(g, format).repartitionByRange(1, "part", "at").sortWithinPartitions("part", "at").select("line").write.text(at)
        return formats.read(spark, f"{at}/part-*", format).graph.nodes.select("id", "parent")

    return run


for _f in sinks.NESTED:
    QUERIES[f"io_{_f}_nested"] = _nested(_f)
    SQL[f"io_{_f}_nested"] = f"WITH {CONTAINMENT} SELECT a.kind || ' ' || a.key AS id, b.kind || ' ' || b.key AS parent FROM T a LEFT JOIN T b ON b.idx = a.parent"


def _spelled(g: Graph) -> DataFrame:
    """Ids that a format can't hold as they are, beside some that look like their replacements."""
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a b ", "a_x20_b", "é?<", "_x", "", "_x_")]), (F.col("idx") % 6 + 1).cast("int")), F.col("idx").cast("string"))
    at = Scratch(g.spark).path("ids")
    sinks.save(sinks.document(g.with_(nodes=g.nodes.select("idx", text.alias("id"))), "graphml"), at)
    return _named(formats.read(g.spark, f"{at}/part-*", "graphml", parts=True, ids="string").graph)


_SPELL = "list_extract(['a b ', 'a_x20_b', 'é?<', '_x', '', '_x_'], ({x} % 6 + 1)::INT) || {x}"
_add("io_graphml_ids", _spelled, f"SELECT e, {_SPELL.format(x='src')} AS source, {_SPELL.format(x='dst')} AS target, w FROM E")


def _mixed(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Order lines as edges from supplier to part; those returned are undirected."""
        at = Scratch(spark).path("mixed")
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 1")
        text = F.concat_ws(",", F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey"), F.when(F.col("l_returnflag") == "R", "Undirected").otherwise("Directed"))
        rows = lines.select(F.lit(1).alias("part"), *order, text.alias("value"))
        head = spark.range(1).select(F.lit(0).alias("part"), F.lit("Source,Target,Type").alias("value"))
        rows.unionByName(head, allowMissingColumns=True).repartitionByRange(partitions(spark), "part", *order).sortWithinPartitions("part", *order).select("value").write.text(at)
        return _named(formats.read(spark, f"{at}/part-*", "csv", parts=True, on_mixed=how).graph).select("e", "source", "target")

    return run


_MIXED = "WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k, 'S' || l_suppkey AS s, 'P' || l_partkey AS d, l_returnflag = 'R' AS u FROM lineitem WHERE l_linenumber = 1)"
QUERIES["mixed_expand"] = _mixed("expand")
SQL["mixed_expand"] = f"{_MIXED}, h AS (SELECT k, 0 AS half, s AS source, d AS target FROM l UNION ALL SELECT k, 1, d, s FROM l WHERE u) SELECT row_number() OVER (ORDER BY k, half) - 1 AS e, source, target FROM h"
QUERIES["mixed_directed"] = _mixed("directed")
SQL["mixed_directed"] = f"{_MIXED} SELECT k - 1 AS e, s AS source, d AS target FROM l"


def _hyper(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """An order of three lines or more links its suppliers."""
        orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).filter(F.size("s") >= 3)  # a few lines an order

        def split(members: list) -> list:
            return [(str(x["s"]), str(x["t"])) for x in parsers.hyperedge([str(m) for m in members], how, 0, "hub", {}) if x["k"] == "e"]

        pairs = T.as_column(lambda m: [{"s": a, "t": b} for a, b in split(m)], "array<struct<s:string,t:string>>")
        return orders.select("l_orderkey", F.explode(pairs(F.col("s"))).alias("p")).select("l_orderkey", F.col("p.s").alias("s"), F.col("p.t").alias("t"))

    return run


QUERIES["hyperedge_clique"], QUERIES["hyperedge_star"] = _hyper("clique"), _hyper("star")
_HYPER = "WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY l_orderkey), h AS (SELECT l_orderkey, unnest(s) AS x, unnest(range(len(s))) AS i FROM o WHERE len(s) >= 3)"


SQL["hyperedge_clique"] = f"{_HYPER} SELECT a.l_orderkey, a.x::VARCHAR AS s, b.x::VARCHAR AS t FROM h a JOIN h b ON a.l_orderkey = b.l_orderkey AND a.i < b.i"
SQL["hyperedge_star"] = f"{_HYPER} SELECT l_orderkey, 'hub' AS s, x::VARCHAR AS t FROM h"


def _sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best guess for the first lines of each format's document."""
    g = transitions(spark, sf_dir)
    few = derive.induced_subgraph(g, F.col("idx") < 5).graph
    return spark.createDataFrame([(f, parsers.sniff(sinks.join_text(few, f).encode())[0][0]) for f in sinks.WRITERS], "written string, found string")


QUERIES["sniff"], SQL["sniff"] = _sniffed, "SELECT f AS written, f AS found FROM (SELECT unnest(['csv', 'json', 'gexf', 'graphml', 'gml', 'dot', 'pajek', 'neo4j']) AS f)"


def _split_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain edge list of many parts, read without gathering a file in one task."""
    at = Scratch(spark).path("edges")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.col("o_totalprice").alias("weight"))
    rows.repartitionByRange(5, "target").sortWithinPartitions("target").write.option("header", True).csv(at)
    g = formats.read_edge_list(spark, f"{at}/part-*", weight="weight").graph
    return _named(g)


QUERIES["io_edge_list"] = _split_edge_list
SQL["io_edge_list"] = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS e, o_custkey::VARCHAR AS source, o_orderkey::VARCHAR AS target, o_totalprice::FLOAT AS w FROM orders"

# look-ups, freeze, comparison

_add("edge_index_of", lambda g: query.edges_by_id(g.with_(edges=g.edges.withColumn("key", F.col("e") * 7 + 1)), g.edges.select((F.col("e") * 2).alias("id")), "key"), "SELECT b.e * 2 AS id, E.e FROM E b LEFT JOIN E ON E.e * 7 + 1 = b.e * 2")
_add("self_loops_at", lambda g: query.self_loops_at(g, g.nodes.filter("idx % 4 = 0")), "SELECT idx, count(e) AS loops FROM V LEFT JOIN E ON src = idx AND dst = idx WHERE idx % 4 = 0 GROUP BY idx")
_add("arc_sources", lambda g: query.arc_sources(g, views.arcs(g).filter("arc % 3 = 0")), f"SELECT * FROM (SELECT {_ARC} AS arc, src, dst, e FROM E) WHERE arc % 3 = 0")
_add("freeze_sum", lambda g: freeze(g, "drop", "sum")[0].edges.select("e", "src", "dst", F.round(F.col("w").cast("double"), 2).alias("w")), "SELECT row_number() OVER (ORDER BY e) - 1 AS e, src, dst, w FROM (SELECT min(e) AS e, src, dst, round(sum(w::DOUBLE)::FLOAT::DOUBLE, 2) AS w FROM E WHERE src <> dst GROUP BY src, dst)")
_add("freeze_keep", lambda g: freeze(g)[0].edges.select("e", "src", "dst", "w"), "SELECT e, src, dst, w FROM E")
_add("equal_topology", lambda g: g.spark.createDataFrame([("same", validate.equal_topology(g, derive.transpose(derive.transpose(g).graph).graph)), ("turned", validate.equal_topology(g, derive.transpose(g).graph)), ("lighter", validate.equal_topology(g, g.with_(edges=g.edges.withColumn("w", F.col("w") / 2)), weights=False))], "graph string, equal boolean"),
     "SELECT * FROM (VALUES ('same', true), ('turned', NOT EXISTS (SELECT e FROM E WHERE src <> dst)), ('lighter', true)) t(graph, equal)")
_add("with_columns", lambda g: derive.with_columns(g, nodes=g.nodes.select("idx", (F.col("idx") * 2).alias("twice"))).nodes.select("idx", "id", "twice"), "SELECT idx, id, idx * 2 AS twice FROM V")
_add("node_mass", lambda g: layout.node_mass(g.with_(nodes=metadata(g.nodes.withColumn("m", F.when(F.col("idx") % 3 == 0, F.col("idx") + 0.5)), "m", role="mass"))), "SELECT idx, CASE WHEN idx % 3 = 0 THEN idx + 0.5::DOUBLE ELSE n + 1 END AS mass FROM (SELECT idx, count(src)::DOUBLE AS n FROM V LEFT JOIN H ON src = idx GROUP BY idx)", False)
_add("sanitized_ids", lambda g: sinks.sanitized_ids(g.with_(nodes=g.nodes.withColumn("id", F.concat(F.lit("n "), F.col("idx").cast("string")))), "A-Za-z0-9_"), "SELECT idx, 'n_' || idx AS id FROM V")
_add("explicit_weights", lambda g: g.with_(weighted=False).edges.select("e", sinks.explicit_weight(g).alias("w"), sinks.explicit_weight(g.with_(weighted=False)).alias("none")), "SELECT e, w, NULL::FLOAT AS none FROM E")
_add("renumbered_ids", sinks.renumbered, "SELECT idx, idx + 1 AS number FROM V")
_add("export_losses", lambda g: g.spark.createDataFrame([(f, c) for f in sinks.WRITERS for c, _ in sinks.check(g.with_(nodes=g.nodes.withColumn("size", F.lit(1))), f)], "format string, code string"), "SELECT * FROM (VALUES ('csv', 'node-attributes'), ('pajek', 'attributes')) t(format, code)")

# the builder


def _assembled(g: Graph) -> DataFrame:
    """Two loads, declared and widened columns, values by row and by table."""
    b = GraphBuilder(g.spark, "long", weighted=True)
    b.add_nodes(g.nodes.select("idx", "id"), ["idx"])
    ids = g.nodes.select("idx", "id")
    rows = g.edges.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "dst")
    b.add_edges(rows.filter("e % 2 = 0").select("e", "source", "target", "w"), ["e"], "w")
    b.add_edges(rows.filter("e % 2 = 1").select("e", "source", "target", "w"), ["e"], "w")
    b.declare_column("node", "size", "i32")
    b.set_column("node", g.nodes.select(F.col("id").alias("key"), (F.col("idx") % 9).cast("int").alias("value")), "size")
    return b.freeze()[0].nodes.select("idx", "id", "size")


_add("builder_columns", _assembled, "SELECT idx, id, (idx % 9)::INT AS size FROM V")


def _merged(g: Graph) -> DataFrame:
    """A graph added to another by its ids."""
    b = GraphBuilder.from_graph(g)
    b.add_graph(derive.transpose(g).graph)
    return views.edge_list(b.freeze()[0])


_add("builder_add_graph", _merged, "SELECT e, src, dst, w FROM E UNION ALL SELECT e + (SELECT count(*) FROM E), dst, src, w FROM E")


def _around(g: Graph) -> DataFrame:
    b = GraphBuilder.from_graph(g)
    first = g.nodes.filter("idx = 0").first()["id"]
    tell = lambda way: b.edges_of(first, way).select("e", F.lit(way).alias("way"))
    return tell("out").unionByName(tell("in"))


_add("builder_edges_of", _around, "SELECT e, 'out' AS way FROM E WHERE src = 0 UNION ALL SELECT e, 'in' FROM E WHERE dst = 0")

# columns


def _defaulted(orders: DataFrame) -> DataFrame:
    df = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("c"))
    df = metadata(df, "c", default=-1)
    return df.select("o_orderkey", columns.value(df, "c").cast("long").alias("value"), columns.is_set(df, "c").alias("is_set")).join(columns.materialize_default(df, "c").select("o_orderkey", F.col("c").cast("long").alias("filled")), "o_orderkey")


_on("column_defaults", "orders", _defaulted, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE -1 END::BIGINT AS value, o_orderkey % 3 = 0 AS is_set, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE -1 END::BIGINT AS filled FROM orders")
_on("column_edits", "customer", lambda df: columns.slice_rows(columns.rename_column(columns.remove_column(columns.set_column(df.select("c_custkey", "c_acctbal", "c_name"), "twice", F.col("c_acctbal") * 2), "c_name"), "c_acctbal", "balance"), "c_custkey", 3, 900), "SELECT c_custkey, c_acctbal AS balance, c_acctbal * 2 AS twice FROM customer WHERE c_custkey >= 3 AND c_custkey < 900")
_on("with_components", "part", lambda df: df.select("p_partkey", F.array(F.col("p_size").cast("double"), F.lit(2.0)).alias("v")).select("p_partkey", F.array_join(columns.with_components("v", 3, 7.0).cast("array<int>"), ",").alias("three"), F.array_join(columns.with_components("v", 1).cast("array<int>"), ",").alias("one")), "SELECT p_partkey, p_size || ',2,7' AS three, p_size::VARCHAR AS one FROM part")
_add("remap", lambda g: columns.remap(g.nodes.select("idx", "id"), g.nodes.select(F.col("idx").alias("old"), F.when(F.col("idx") % 2 == 0, F.floor(F.col("idx") / 2)).alias("new"))), "SELECT idx // 2 AS idx, id FROM V WHERE idx % 2 = 0")
_add("scatter", lambda g: columns.scatter(g.nodes.select("idx", F.col("id").alias("value")), g.nodes.filter("idx < 20").select("idx", (F.col("idx") * 100).alias("value")), g.nodes.filter("idx < 20").select("idx", (F.col("idx") * 3).alias("old"))), "SELECT idx, CASE WHEN idx % 3 = 0 AND idx < 60 AND idx // 3 IN (SELECT idx FROM V) THEN idx // 3 * 100 ELSE id END AS value FROM V")
_add("mask_to_indices", lambda g: columns.mask_to_indices(g.nodes.select("idx", (F.col("id") % 3 == 1).alias("set"))), "SELECT idx FROM V WHERE id % 3 = 1")
_add("mask_count", lambda g: columns.mask_count(g.nodes.select("idx", (F.col("id") % 3 == 1).alias("set"))), "SELECT count(*) AS set FROM V WHERE id % 3 = 1")


def _parents(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(containment(spark, sf_dir))
    SQL[name] = f"WITH {CONTAINMENT}\n{sql}"


_parents("parent_count", tree.parent_count, "SELECT idx, (parent IS NOT NULL)::INT AS parents FROM T")

# texts and scalars

def _texts():
    return F.array(*[F.concat(F.lit(a), F.col("p_size").cast("string"), F.lit(b)) for a, b in (("", ""), ("0", ""), ("-", ""), ("+", ""), ("", ".50"), (" ", " "), ("x", ""), ("-0", ""), ("9007199254740", "999"), ("1e", ""))])


_LIST = "[p_size::VARCHAR, '0' || p_size, '-' || p_size, '+' || p_size, p_size || '.50', ' ' || p_size || ' ', 'x' || p_size, '-0' || p_size, '9007199254740' || p_size || '999', '1e' || p_size]"


def _scalar(name: str, of: Callable, sql: str) -> None:
    """A function over texts made from the sizes of parts."""
    _on(name, "part", lambda df: df.select(F.explode(_texts()).alias("text")).distinct().select("text", of(F.col("text")).alias("value")), f"SELECT DISTINCT text, {sql} AS value FROM (SELECT unnest({_LIST}) AS text FROM part)")


_scalar("canonical_id", T.canonical_id_col, "CASE WHEN regexp_full_match(text, '-?[1-9][0-9]*') AND abs(try_cast(text AS HUGEINT)) <= 9007199254740991 THEN try_cast(text AS BIGINT) END")
_scalar("canonical_id_text", T.as_column(lambda v: str(T.canonical_id(v)) + ("" if isinstance(T.canonical_id(v), str) else " n"), "string"), "text || CASE WHEN regexp_full_match(text, '-?[1-9][0-9]*') AND abs(try_cast(text AS HUGEINT)) <= 9007199254740991 THEN ' n' ELSE '' END")
_scalar("coerce_id", T.as_column(lambda v: T.number_text(float(x)) if (x := T.coerce_id(v, "number")) is not None else None, "string"),
        "CASE WHEN try_cast(trim(text) AS DOUBLE) % 1 = 0 AND abs(try_cast(trim(text) AS DOUBLE)) < 1e21 THEN try_cast(trim(text) AS DOUBLE)::HUGEINT::VARCHAR ELSE try_cast(trim(text) AS DOUBLE)::VARCHAR END")
_scalar("parse_weight", T.parse_weight_col, "try_cast(trim(text) AS DOUBLE)")
_scalar("parse_i32", lambda c: T.parse_as_col(c, "i32"), "CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN try_cast(text AS INT) END")
_scalar("parse_f64", lambda c: T.parse_as_col(c, "f64"), "CASE WHEN text NOT LIKE ' %' THEN try_cast(text AS DOUBLE) END")
_scalar("quote_csv", T.quote_csv_col, "CASE WHEN text LIKE ' %' THEN '\"' || text || '\"' ELSE text END")
_scalar("is_nmtoken", T.as_column(T.is_nmtoken, "boolean"), "regexp_full_match(text, '[A-Za-z0-9_:.-]+')")
_scalar("mangle_nmtoken", T.as_column(T.mangle_nmtoken, "string"), "replace(replace(text, ' ', '_x20_'), '+', '_x2B_')")
_scalar("quote_dot", T.as_column(T.quote_dot, "string"), "CASE WHEN regexp_full_match(text, '[A-Za-z_][A-Za-z0-9_]*|-?(\\.[0-9]+|[0-9]+(\\.[0-9]*)?)') THEN text ELSE '\"' || text || '\"' END")
_on("widen_dtype", "part", lambda df: df.select(F.col("p_size").alias("k"), F.explode(F.slice(_texts(), 1, 5)).alias("t")).groupBy("k").agg(T.widest_col(F.col("t")).alias("dtype")), "SELECT p_size AS k, 'string' AS dtype FROM part GROUP BY p_size")
_on("widen_numbers", "part", lambda df: df.select(F.col("p_size").alias("k"), F.explode(F.array(F.col("p_size").cast("string"), F.concat(F.col("p_size").cast("string"), F.lit(".5")))).alias("t")).groupBy("k").agg(T.widest_col(F.col("t")).alias("dtype")), "SELECT p_size AS k, 'f64' AS dtype FROM part GROUP BY p_size")
_on("parse_boolean", "orders", lambda df: df.select("o_orderkey", T.as_column(T.parse_boolean, "boolean")(F.element_at(F.array(*[F.lit(x) for x in ("true", "No", "1", "maybe", " YES ")]), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("value")), "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN true END AS value FROM orders")
_on("number_text", "lineitem", lambda df: df.select("l_extendedprice").distinct().select(F.col("l_extendedprice").cast("double").alias("x"), T.as_column(T.number_text, "string")(F.col("l_extendedprice").cast("double")).alias("text")), "SELECT DISTINCT l_extendedprice::DOUBLE AS x, CASE WHEN x % 1 = 0 THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS text FROM lineitem")
_on("f32_text", "customer", lambda df: df.select("c_custkey", T.as_column(T.f32_text, "string")(F.col("c_acctbal").cast("float")).alias("text")), "SELECT c_custkey, CASE WHEN c_acctbal::FLOAT % 1 = 0 THEN c_acctbal::FLOAT::BIGINT::VARCHAR ELSE c_acctbal::FLOAT::VARCHAR END AS text FROM customer")
_on("parse_times", "orders", lambda df: df.select("o_orderkey", F.explode(F.array(*[F.date_format("o_orderdate", p) for p in ("yyyy", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd'T'12:30:05'Z'", "yyyy-MM-dd'T'12:30:05.250+02:00", "'x'yyyy")])).alias("text")).select("o_orderkey", "text", T.as_column(T.parse_temporal, "double")(F.col("text")).alias("ms")),
    "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), t AS (SELECT o_orderkey, d, unnest(range(6)) AS k FROM o) SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m-%dT12:30:05Z') WHEN 4 THEN strftime(d, '%Y-%m-%dT12:30:05.250+02:00') ELSE 'x' || strftime(d, '%Y') END AS text, CASE k WHEN 0 THEN epoch_ms(date_trunc('year', d)::TIMESTAMP) WHEN 1 THEN epoch_ms(date_trunc('month', d)::TIMESTAMP) WHEN 2 THEN epoch_ms(d::TIMESTAMP) WHEN 3 THEN epoch_ms(d::TIMESTAMP) + 45005000 WHEN 4 THEN epoch_ms(d::TIMESTAMP) + 37805250 END::DOUBLE AS ms FROM t")
_on("parse_temporal_times", "orders", lambda df: df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'12:30:05.250+02:00").alias("text")).select("o_orderkey", T.parse_temporal_col(F.col("text")).alias("ms")), "SELECT o_orderkey, (epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) + 37805250)::DOUBLE AS ms FROM orders")
_on("format_temporal", "orders", lambda df: df.select("o_orderkey", T.as_column(T.format_temporal, "string")((F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.when(F.col("o_orderkey") % 2 == 0, 45005250).otherwise(0)).cast("double")).alias("text")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate::DATE, '%Y-%m-%dT12:30:05.250Z') ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') END AS text FROM orders")
_on("split_list", "part", lambda df: df.select("p_partkey", F.concat_ws(" | ", "p_name", "p_brand", F.lit("a,b")).alias("t")).select("p_partkey", F.array_join(T.split_list_col(F.col("t")), "/").alias("items"), F.size(T.as_column(T.split_list, "array<string>")(F.col("t"))).alias("n")), "SELECT p_partkey, p_name || '/' || p_brand || '/a,b' AS items, 3 AS n FROM part")
_on("join_list", "part", lambda df: df.select("p_partkey", T.as_column(T.join_list, "string")(F.array("p_brand", F.lit("a,b"), F.lit("plain"))).alias("text")), "SELECT p_partkey, '[' || p_brand || ', \"a,b\", plain]' AS text FROM part")
_on("parse_intervals", "part", lambda df: df.select("p_partkey", F.concat(F.lit("["), "p_size", F.lit("-"), F.col("p_size") + 5, F.lit(", "), F.col("p_size") + 9, F.lit("-*]")).alias("t")).select("p_partkey", F.explode(T.parse_intervals_col(F.col("t"))).alias("x")).select("p_partkey", F.col("x.start").alias("a"), F.when(F.col("x.end") == float("inf"), None).otherwise(F.col("x.end")).alias("b")), "SELECT p_partkey, p_size::DOUBLE AS a, p_size + 5.0::DOUBLE AS b FROM part UNION ALL SELECT p_partkey, p_size + 9.0::DOUBLE, NULL FROM part")
_on("format_intervals", "part", lambda df: df.select("p_partkey", T.as_column(lambda n: T.format_intervals([(n, n + 5), (n + 9, float("inf"))]), "string")(F.col("p_size").cast("double")).alias("text")), "SELECT p_partkey, '[' || p_size || '-' || (p_size + 5) || ',' || (p_size + 9) || '-*]' AS text FROM part")
_on("parse_point", "part", lambda df: df.select("p_partkey", F.explode(F.array(F.concat(F.lit("{x: "), "p_size", F.lit(", y: 2}")), F.concat(F.lit("POINT("), "p_size", F.lit(" 2)")), F.concat("p_size", F.lit(",2")))).alias("t")).select("p_partkey", F.array_join(T.as_column(T.parse_point, "array<double>")(F.col("t")).cast("array<int>"), ",").alias("point")), "SELECT p_partkey, p_size || ',2' AS point FROM part, range(3)")
_on("escape_xml", "customer", lambda df: df.select("c_custkey", F.concat(F.col("c_name"), F.lit("<&\">'")).alias("t")).select("c_custkey", T.as_column(T.escape_xml, "string")(F.col("t")).alias("text")), "SELECT c_custkey, c_name || '&lt;&amp;&quot;&gt;''' AS text FROM customer")
_on("quote_gml", "customer", lambda df: df.select("c_custkey", F.concat(F.col("c_name"), F.lit("é\"&")).alias("t")).select("c_custkey", T.as_column(T.quote_gml, "string")(F.col("t")).alias("text"), T.as_column(lambda x: T.decode_gml(T.quote_gml(x)[1:-1]), "string")(F.col("t")).alias("back")), "SELECT c_custkey, '\"' || c_name || '&#233;&quot;&amp;\"' AS text, c_name || 'é\"&' AS back FROM customer")
_on("quote_pajek", "customer", lambda df: df.select("c_custkey", T.as_column(T.quote_pajek, "string")(F.concat(F.col("c_name"), F.lit("\"\n"))).alias("text")), "SELECT c_custkey, '\"' || c_name || ''' \"' AS text FROM customer")
_M = "4294967295"
_on("lowbias32", "orders", lambda df: df.select("o_orderkey", T.lowbias32_col(F.col("o_orderkey").cast("long")).alias("hash")),
    f"WITH a AS (SELECT o_orderkey, o_orderkey::HUGEINT & {_M} AS x FROM orders), b AS (SELECT o_orderkey, (xor(x, x >> 16) * 2146121005) % 4294967296 AS x FROM a), c AS (SELECT o_orderkey, (xor(x, x >> 15) * 2221713035) % 4294967296 AS x FROM b) SELECT o_orderkey, xor(x, x >> 16)::BIGINT AS hash FROM c")


def _seeded(g: Graph) -> DataFrame:
    none = F.lit(None).cast("double")
    return layout.seed_positions(g.nodes.select("idx", none.alias("x"), none.alias("y"), none.alias("z"))).select("idx", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "z")


#: The generator run number by number.
_add("seed_positions", _seeded, "")
SQL["seed_positions"] = f"WITH RECURSIVE {TRANSITIONS}, s AS (SELECT 0 AS k, (185852::HUGEINT + 1) % 34359738337 AS v UNION ALL SELECT k + 1, (185852 * v + 1) % 34359738337 FROM s WHERE k < 2 * (SELECT count(*) FROM V)) SELECT idx, round(-1 + 2 * (a.v::DOUBLE / 34359738337), 9) AS x, round(-1 + 2 * (b.v::DOUBLE / 34359738337), 9) AS y, 0.0::DOUBLE AS z FROM V JOIN s a ON a.k = 2 * idx JOIN s b ON b.k = 2 * idx + 1"


def _placed(g: Graph) -> DataFrame:
    """Nodes on a grid, of mass 1 + idx % 3."""
    return g.nodes.select("idx", (F.col("idx") % 10).cast("double").alias("x"), F.floor(F.col("idx") / 10).cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("idx") % 3 + 1).cast("double").alias("mass"))


def _pulled(g: Graph) -> DataFrame:
    arcs = views.halves(g).select("src", "dst", F.col("w").cast("double").alias("w"))
    return layout._attraction(arcs, _placed(g), False, False).select("idx", F.round("ax", 3).alias("ax"), F.round("ay", 3).alias("ay"))


_add("layout_attraction", _pulled, "SELECT src AS idx, round(sum(w::DOUBLE * (dst % 10 - src % 10)), 3) AS ax, round(sum(w::DOUBLE * (dst // 10 - src // 10)), 3) AS ay FROM H GROUP BY src", False)


def _pushed(g: Graph) -> DataFrame:
    r = layout._exact(_placed(g), 2.0, g.node_count())
    return r.select("idx", F.round("rx", 6).alias("rx"), F.round("ry", 6).alias("ry"))


_add("layout_repulsion", _pushed, ", p AS (SELECT idx, (idx % 10)::DOUBLE AS x, (idx // 10)::DOUBLE AS y, idx % 3 + 1.0::DOUBLE AS m FROM V) SELECT a.idx, round(sum(2 * a.m * b.m * (a.x - b.x) / ((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)), 6) AS rx, round(sum(2 * a.m * b.m * (a.y - b.y) / ((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)), 6) AS ry FROM p a JOIN p b ON a.idx <> b.idx GROUP BY a.idx", False)
