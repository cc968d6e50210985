"""The registered graph queries and their SQL. Sums of weights are rounded, as their order differs between engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._tables import Scratch
from ..functions import text as T
from ..graph import Graph
from ..operators import algorithms, columns, components, derive, layout, query, tree, validate, views
from ..operators.freeze import freeze
from ..sources import formats, sinks
from .builder import GraphBuilder
from .graphs import CONTAINMENT, HALVES, TRADE, TRANSITIONS, containment, trade, transitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIRECTED, UNDIRECTED, LINES = f"WITH {TRANSITIONS}", f"WITH {TRANSITIONS}, {HALVES}", f"WITH {TRADE}"


def _add(name: str, run: Callable[[Graph], DataFrame], sql: str | None = None, graph: str = "directed") -> None:
    make = {"directed": transitions, "undirected": lambda s, d: transitions(s, d, False), "trade": trade}[graph]
    QUERIES[name] = lambda spark, sf_dir: run(make(spark, sf_dir))
    if sql:
        SQL[name] = {"directed": DIRECTED, "undirected": UNDIRECTED, "trade": LINES}[graph] + "\n" + sql


def _sum(c: str = "w") -> str:
    return f"round(sum(coalesce({c}::DOUBLE, 1)), 4)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


# sources and views

_add("nodes", lambda g: g.nodes.select("idx", "id"), "SELECT idx, id FROM V")
_add("edge_list", views.edge_list, "SELECT e, src, dst, w FROM E")
_add("coo", views.coo, "SELECT row_number() OVER (ORDER BY src, dst, e) - 1 AS arc, src, dst, w FROM E")
_add("arcs_undirected", lambda g: views.arcs(g).select("arc", "src", "dst", "e"), "SELECT row_number() OVER (ORDER BY src, dst, e, forward) - 1 AS arc, src, dst, e FROM H", "undirected")
_add("row_ptr", views.row_ptr, "SELECT idx, sum(n) OVER (ORDER BY idx) - n AS first, sum(n) OVER (ORDER BY idx) AS past FROM (SELECT idx, count(e) AS n FROM V LEFT JOIN E ON src = idx GROUP BY idx)")
_add("reverse", views.reverse, "SELECT row_number() OVER (ORDER BY dst, src, e) - 1 AS arc, dst AS src, src AS dst, e, w FROM E")
_add("out_degree", views.out_degree, "SELECT idx, count(e) AS out_degree FROM V LEFT JOIN E ON src = idx GROUP BY idx")
_add("in_degree", views.in_degree, "SELECT idx, count(e) AS in_degree FROM V LEFT JOIN E ON dst = idx GROUP BY idx")
_add("degree", views.degree, "SELECT idx, count(x) AS degree FROM V LEFT JOIN (SELECT src AS x FROM E UNION ALL SELECT dst FROM E) ON x = idx GROUP BY idx")
_add("degree_undirected", lambda g: views.out_degree(g).join(views.degree(g), "idx"), "SELECT idx, out_degree, out_degree + loops AS degree FROM (SELECT idx, count(e) AS out_degree, count(CASE WHEN src = dst THEN 1 END) AS loops FROM V LEFT JOIN H ON src = idx GROUP BY idx)", "undirected")
_add("weighted_out_degree", lambda g: _rounded(views.weighted_out_degree(g), "weight"), f"SELECT idx, coalesce({_sum()}, 0) AS weight FROM V LEFT JOIN E ON src = idx WHERE e IS NOT NULL GROUP BY idx UNION ALL SELECT idx, 0.0 FROM V WHERE idx NOT IN (SELECT src FROM E)")
_add("weighted_in_degree", lambda g: _rounded(views.weighted_in_degree(g), "weight"), f"SELECT idx, {_sum()} AS weight FROM V JOIN E ON dst = idx GROUP BY idx UNION ALL SELECT idx, 0.0 FROM V WHERE idx NOT IN (SELECT dst FROM E)")
_add("weighted_degree", lambda g: _rounded(views.weighted_degree(g), "weight"), f"SELECT idx, {_sum()} AS weight FROM V JOIN (SELECT src AS x, w FROM E UNION ALL SELECT dst, w FROM E) ON x = idx GROUP BY idx")
_add("self_loops", lambda g: _rounded(views.self_loops(g), "weight"), f"SELECT idx, count(e) AS loops, CASE WHEN count(e) = 0 THEN 0.0 ELSE {_sum()} END AS weight FROM V LEFT JOIN E ON src = idx AND dst = idx GROUP BY idx")
_add("self_loop_arcs", views.self_loop_arcs, "SELECT arc, src AS idx, e FROM (SELECT row_number() OVER (ORDER BY src, dst, e) - 1 AS arc, * FROM E) WHERE src = dst")
_add("total_weight", lambda g: _rounded(views.total_weight(g), "total_weight"), f"SELECT {_sum()} AS total_weight FROM E")
_add("mate", views.mate, "SELECT a.arc, b.arc AS mate FROM (SELECT row_number() OVER (ORDER BY src, dst, e, forward) - 1 AS arc, * FROM H) a JOIN (SELECT row_number() OVER (ORDER BY src, dst, e, forward) - 1 AS arc, * FROM H) b ON a.e = b.e AND (a.forward <> b.forward OR a.src = a.dst)", "undirected")
_add("degree_order", views.degree_order, "SELECT row_number() OVER (ORDER BY degree DESC, idx) - 1 AS place, idx, degree, CASE WHEN degree >= 1024 THEN 0 WHEN degree >= 32 THEN 1 WHEN degree >= 1 THEN 2 ELSE 3 END AS tier FROM (SELECT idx, count(e) AS degree FROM V LEFT JOIN E ON src = idx GROUP BY idx)")
_add("is_symmetric", views.is_symmetric, "SELECT NOT EXISTS (SELECT src, dst, w, count(*) FROM E GROUP BY ALL EXCEPT SELECT dst, src, w, count(*) FROM E GROUP BY ALL) AS symmetric")
_add("flags", views.flags, "SELECT (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM E GROUP BY src, dst)) AS multigraph, bool_or(src = dst) AS has_self_loops, bool_and(w = 1) AS all_weights_one, bool_and(w >= 0) AS non_negative_weights, bool_and(isfinite(w)) AS finite_weights, true AS weighted FROM E")
_add("fold_arcs", lambda g: views.fold_arcs(g, views.arcs(g).select("arc", F.col("dst").alias("value")), "sum"), "SELECT e, CASE WHEN src = dst THEN src ELSE src + dst END AS value FROM E", "undirected")
_add("expand_edges", lambda g: views.expand_edges(g, g.edges.select("e", (F.col("e") * 10).alias("value"))), "SELECT row_number() OVER (ORDER BY src, dst, e, forward) - 1 AS arc, e * 10 AS value FROM H", "undirected")

# look-ups

_add("out_arcs", lambda g: query.out_arcs(g, g.nodes.filter("id % 7 = 0")).drop("w"), "SELECT src AS idx, arc, dst, e FROM (SELECT row_number() OVER (ORDER BY src, dst, e) - 1 AS arc, * FROM E) JOIN V ON src = idx WHERE id % 7 = 0")
_add("find_arcs", lambda g: query.find_arcs(g, g.nodes.select(F.col("idx").alias("src"), ((F.col("idx") * 3) % 11).alias("dst"))), "SELECT v.idx AS src, v.idx * 3 % 11 AS dst, min(arc) AS arc, count(arc) AS multiplicity FROM V v LEFT JOIN (SELECT row_number() OVER (ORDER BY src, dst, e) - 1 AS arc, src, dst FROM E) a ON a.src = v.idx AND a.dst = v.idx * 3 % 11 GROUP BY v.idx")
_add("multiplicity", query.multiplicities, "SELECT src, dst, count(*) AS multiplicity FROM E GROUP BY src, dst")
_add("edge_ends", lambda g: query.edge_ends(g, g.edges.filter("e % 5 = 0")), "SELECT e, src, dst FROM E WHERE e % 5 = 0")
_add("index_of", lambda g: query.index_of(g, g.nodes.select((F.col("id") * 2).alias("id"))), "SELECT b.id * 2 AS id, V.idx FROM V b LEFT JOIN V ON V.id = b.id * 2")
_add("id_of", lambda g: query.id_of(g, g.nodes.filter("idx % 3 = 0")), "SELECT idx, id FROM V WHERE idx % 3 = 0")
_add("ids_slice", lambda g: query.ids_slice(g, 5, 25), "SELECT idx, id FROM V WHERE idx >= 5 AND idx < 25")
_add("keyed_by_id", lambda g: query.keyed_by_id(g, views.out_degree(g)), "SELECT id, count(e) AS out_degree FROM V LEFT JOIN E ON src = idx GROUP BY id")

# derived graphs

_E = "row_number() OVER (ORDER BY e) - 1 AS e"
_add("transpose", lambda g: derive.transpose(g).graph.edges.select("e", "src", "dst"), "SELECT e, dst AS src, src AS dst FROM E")
_add("without_self_loops", lambda g: derive.without_self_loops(g).graph.edges.select("e", "src", "dst", "w"), f"SELECT {_E}, src, dst, w FROM E WHERE src <> dst")
_add("filter_edges", lambda g: derive.filter_edges(g, F.col("w") > 50).edge_remap, "SELECT e AS old, CASE WHEN w > 50 THEN count(CASE WHEN w > 50 THEN 1 END) OVER (ORDER BY e) - 1 END AS new FROM E")
_add("induced_subgraph", lambda g: derive.induced_subgraph(g, F.col("idx") % 2 == 0).graph.edges.select("e", "src", "dst", "w"), f"SELECT {_E}, src // 2 AS src, dst // 2 AS dst, w FROM E WHERE src % 2 = 0 AND dst % 2 = 0")
_add("relabel", lambda g: derive.relabel(g, _reversed(g)).graph.edges.select("e", "src", "dst"), "SELECT e, (SELECT max(idx) FROM V) - src AS src, (SELECT max(idx) FROM V) - dst AS dst FROM E")


def _reversed(g: Graph) -> DataFrame:
    n = g.node_count()
    return g.nodes.select(F.col("idx").alias("old"), (F.lit(n - 1) - F.col("idx")).alias("new"))


_RANKED = ", k AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY e) AS k FROM E WHERE src <> dst), p AS (SELECT *, min(e) OVER q AS f, count(*) OVER q AS n, round(sum(w::DOUBLE) OVER q, 4) AS s FROM k WINDOW q AS (PARTITION BY least(src, dst), greatest(src, dst), k))"
_add("to_undirected", lambda g: derive.to_undirected(g, weights="sum").graph.edges.select("e", "src", "dst", F.round(F.col("w").cast("double"), 2).alias("w")), f"{_RANKED} SELECT {_E}, src, dst, w FROM (SELECT e, src, dst, round(s::FLOAT::DOUBLE, 2) AS w FROM p WHERE e = f UNION ALL SELECT e, src, dst, round(w::DOUBLE, 2) FROM E WHERE src = dst)")
_add("to_undirected_reciprocal", lambda g: derive.to_undirected(g, reciprocal=True).graph.edges.select("e", "src", "dst", "w"), f"{_RANKED} SELECT {_E}, src, dst, w FROM (SELECT e, src, dst, w FROM p WHERE e = f AND n = 2 UNION ALL SELECT e, src, dst, w FROM E WHERE src = dst)")
_add("to_undirected_remap", lambda g: derive.to_undirected(g).edge_remap, f"{_RANKED}, s AS (SELECT e, f FROM p UNION ALL SELECT e, e FROM E WHERE src = dst), a AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS new FROM (SELECT DISTINCT f FROM s)) SELECT e AS old, new FROM s JOIN a USING (f)")
for _how, _agg in {"first": "arg_min(w, e)", "last": "arg_max(w, e)", "sum": "round(sum(w::DOUBLE)::FLOAT::DOUBLE, 2)", "min": "min(w)", "max": "max(w)"}.items():
    _w = "round(CAST(w AS DOUBLE), 2) AS w" if _how == "sum" else "w"
    _add(f"simplified_{_how}", lambda g, h=_how, w=_w: derive.simplified(g, h).graph.edges.selectExpr("e", "src", "dst", w), f"SELECT {_E}, src, dst, w FROM (SELECT min(e) AS e, src, dst, {_agg} AS w FROM E GROUP BY src, dst)")
_add("simplified_undirected", lambda g: derive.simplified(g, "min", "drop").graph.edges.select("e", "src", "dst", "w"), f"SELECT {_E}, src, dst, w FROM (SELECT min(e) AS e, arg_min(src, e) AS src, arg_min(dst, e) AS dst, min(w) AS w FROM E WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst))", "undirected")
_add("simplified_columns", lambda g: _rounded(derive.simplified(g, "max", reducers={"price": "mean", "lines": "count"}).graph.edges.select("e", "src", "dst", "w", "price", "lines"), "price"), f"SELECT {_E}, src, dst, w, price, lines FROM (SELECT min(e) AS e, src, dst, max(w) AS w, round(avg(price), 4) AS price, count(*) AS lines FROM E GROUP BY src, dst)", "trade")


def _contracted(g: Graph) -> DataFrame:
    out, _ = derive.contract(g, g.nodes.select("idx", (F.col("idx") % 7).alias("label")), "sum")
    return out.graph.edges.select("e", "src", "dst", F.round(F.col("w").cast("double"), 1).alias("w"))


_add("contract", _contracted, f"SELECT {_E}, src, dst, w FROM (SELECT min(e) AS e, src % 7 AS src, dst % 7 AS dst, round(sum(w::DOUBLE)::FLOAT::DOUBLE, 1) AS w FROM E GROUP BY 2, 3)")
_add("contract_sizes", lambda g: derive.contract(g, g.nodes.select("idx", (F.col("idx") % 7).alias("label")))[1], "SELECT idx % 7 AS idx, count(*) AS size FROM V GROUP BY 1")
_add("renumber_partition", lambda g: derive.renumber_partition(g.nodes.select("idx", (F.col("id") % 13).alias("label"))), "SELECT idx, dense_rank() OVER (ORDER BY m) - 1 AS label FROM (SELECT idx, min(idx) OVER (PARTITION BY id % 13) AS m FROM V)")

# freeze and builder

for _how, _e, _agg in (("first", "min", "arg_min(w, e)"), ("last", "max", "arg_max(w, e)"), ("min", "min", "min(w)"), ("max", "min", "max(w)")):
    _add(f"freeze_{_how}", lambda g, h=_how: freeze(g, "drop", h)[0].edges.select("e", "src", "dst", "w"), f"SELECT {_E}, src, dst, w FROM (SELECT {_e}(e) AS e, src, dst, {_agg} AS w FROM E WHERE src <> dst GROUP BY src, dst)")
_add("freeze_remap", lambda g: freeze(g, "drop", "first")[1].edge_remap, "SELECT E.e AS old, new FROM E LEFT JOIN (SELECT f, src, dst, row_number() OVER (ORDER BY f) - 1 AS new FROM (SELECT min(e) AS f, src, dst FROM E WHERE src <> dst GROUP BY src, dst)) a ON a.src = E.src AND a.dst = E.dst")


def _built(g: Graph) -> DataFrame:
    """Nodes removed and edges weighed anew after a bulk load."""
    b = GraphBuilder(g.spark, "long", weighted=True)
    ids = g.nodes.select("idx", "id")
    named = g.edges.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "dst")
    b.add_edges(named.select("e", "source", "target", "w"), ["e"], "w")
    b.set_edge_weights(g.edges.filter("e % 4 = 0").select("e", F.lit(1.0).alias("w")))
    b.remove_nodes(g.nodes.filter("id % 5 = 0").select("id"))
    b.remove_edges(g.edges.filter("e % 3 = 0").select("e"))
    out = b.freeze()[0]
    return views.edge_list(out)


_add("builder", _built, ", n AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS i, idx FROM V WHERE id % 5 <> 0) SELECT row_number() OVER (ORDER BY E.e) - 1 AS e, a.i AS src, b.i AS dst, CASE WHEN E.e % 4 = 0 THEN 1.0::FLOAT ELSE w END AS w FROM E JOIN n a ON src = a.idx JOIN n b ON dst = b.idx WHERE E.e % 3 <> 0")

# columns

_add("reduce_columns", lambda g: _rounded(columns.reduce_columns(g.edges, "src", "e", {"price": "mean", "w": "max", "dst": "first", "lines": "count"}), "price"), "SELECT src, round(avg(price), 4) AS price, max(w) AS w, arg_min(dst, e) AS dst, count(*) AS lines FROM E GROUP BY src", "trade")
_add("remap_references", lambda g: columns.remap_references(g.edges.select("e", "dst"), "dst", _reversed(g).filter("new % 2 = 0"), "e"), "SELECT e, CASE WHEN (m - dst) % 2 = 0 THEN m - dst END AS dst FROM E, (SELECT max(idx) AS m FROM V)")
_add("gather", lambda g: columns.gather(views.out_degree(g), _reversed(g).select(F.col("new").alias("idx"), "old")), "SELECT (SELECT max(idx) FROM V) - idx AS idx, count(e) AS out_degree FROM V LEFT JOIN E ON src = idx GROUP BY idx")
_add("dictionary_codes", lambda g: columns.codes(g.edges.select("e", (F.col("dst") % 17).alias("v")), "e", "v"), "SELECT e, dense_rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT e, min(e) OVER (PARTITION BY dst % 17) AS f FROM E)")
_add("mask", lambda g: columns.make_mask(g.nodes, g.nodes.filter("idx % 3 = 1")), "SELECT idx, idx % 3 = 1 AS set FROM V")
_add("packed_mask", lambda g: columns.packed_mask(g.nodes.select("idx", (F.col("idx") % 3 == 1).alias("set"))), "SELECT idx // 32 AS word, sum(CASE WHEN idx % 3 = 1 THEN 1::BIGINT << (idx % 32)::INT ELSE 0 END)::BIGINT AS bits FROM V GROUP BY 1")

# reductions on arcs

_add("segmented_reduce", lambda g: algorithms.segmented_reduce(g, "nbr * 2 + 1", "max"), "SELECT idx, coalesce(max(dst * 2 + 1)::DOUBLE, -3.4028234663852886e38) AS value FROM V LEFT JOIN H ON src = idx GROUP BY idx", "undirected")
_add("reduce", lambda g: algorithms.reduce_vector(views.out_degree(g).select(F.col("out_degree").alias("value")), "max"), "SELECT max(n) AS value FROM (SELECT count(*) AS n FROM E GROUP BY src)")
_add("scan", lambda g: algorithms.scan(views.out_degree(g), "idx", "out_degree", "upto"), "SELECT idx, n AS out_degree, sum(n) OVER (ORDER BY idx)::BIGINT AS upto FROM (SELECT idx, count(e) AS n FROM V LEFT JOIN E ON src = idx GROUP BY idx)")
_add("histogram", lambda g: algorithms.histogram(views.out_degree(g), "out_degree"), "SELECT d AS out_degree, count(*) AS n FROM (SELECT count(e) AS d FROM V LEFT JOIN E ON src = idx GROUP BY idx) GROUP BY d")

# containment


def _tree(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(containment(spark, sf_dir))
    SQL[name] = f"WITH RECURSIVE {CONTAINMENT}\n{sql}"


_tree("children", tree.children, "SELECT parent, idx AS child, (row_number() OVER (PARTITION BY parent ORDER BY idx) - 1)::INT AS place FROM T WHERE parent IS NOT NULL")
_tree("child_count", tree.child_count, "SELECT a.idx, count(b.idx) AS children FROM T a LEFT JOIN T b ON b.parent = a.idx GROUP BY a.idx")
_tree("roots", tree.roots, "SELECT idx FROM T WHERE parent IS NULL")
_tree("depth_first", tree.depth_first, ", r AS (SELECT idx, [idx] AS path FROM T WHERE parent IS NULL UNION ALL SELECT T.idx, list_append(path, T.idx) FROM r JOIN T ON T.parent = r.idx) SELECT row_number() OVER (ORDER BY path) - 1 AS place, idx, len(path) - 1 AS depth FROM r")
_tree("reachable_count", tree.reachable_count, ", r AS (SELECT idx, idx AS below FROM T UNION ALL SELECT r.idx, T.idx FROM r JOIN T ON T.parent = r.below) SELECT idx, count(*) AS reachable FROM r GROUP BY idx")

# validation

_add("violations", lambda g: validate.violations(g.with_(edges=g.edges.withColumn("dst", F.when(F.col("e") % 100 == 0, F.lit(-1)).otherwise(F.col("dst"))))), "SELECT 'dst is no node' AS \"check\", e::VARCHAR AS key FROM E WHERE e % 100 = 0")

# algorithms

_PR = ", o AS (SELECT idx, coalesce(sum(w::DOUBLE), 0) AS o FROM V LEFT JOIN E ON src = idx GROUP BY idx), c AS (SELECT count(*)::DOUBLE AS n FROM V), r0 AS (SELECT idx, 1 / n AS x FROM V, c)" + "".join(
    f", r{k + 1} AS (SELECT o.idx, 0.15 / n + 0.85 * ((SELECT coalesce(sum(x), 0) FROM r{k} JOIN o USING (idx) WHERE o = 0) / n + coalesce(y, 0)) AS x FROM o CROSS JOIN c LEFT JOIN (SELECT dst AS idx, sum(w::DOUBLE * x / o) AS y FROM E JOIN r{k} ON src = r{k}.idx JOIN o ON o.idx = src GROUP BY dst) USING (idx))" for k in range(5)
)
_add("page_rank", lambda g: algorithms.page_rank(g, tol=0.0, max_iter=5).select("idx", F.round("rank", 8).alias("rank")), f"{_PR} SELECT idx, round(x, 8) AS rank FROM r5")
_add("katz", lambda g: algorithms.katz_centrality(g, 0.0001, 1.0, 0.0, 3, normalized=False).select("idx", F.round("score", 6).alias("score")), ", k0 AS (SELECT idx, 0.0::DOUBLE AS x FROM V)" + "".join(f", k{i + 1} AS (SELECT V.idx, 1 + 0.0001 * coalesce(sum(w::DOUBLE * x), 0) AS x FROM V LEFT JOIN E ON dst = V.idx LEFT JOIN k{i} ON src = k{i}.idx GROUP BY V.idx)" for i in range(3)) + " SELECT idx, round(x, 6) AS score FROM k3")
_add("hits", lambda g: algorithms.hits(g, 0.0, 2).select("idx", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority")), ", h0 AS (SELECT idx, 1.0::DOUBLE / (SELECT count(*) FROM V) AS h FROM V)" + "".join(f", a{i} AS (SELECT dst AS idx, sum(w::DOUBLE * h) AS a FROM E JOIN h{i} ON src = idx GROUP BY dst), b{i} AS (SELECT idx, a / (SELECT sum(a) FROM a{i}) AS a FROM a{i}), g{i} AS (SELECT src AS idx, sum(w::DOUBLE * a) AS h FROM E JOIN b{i} ON dst = idx GROUP BY src), h{i + 1} AS (SELECT idx, h / (SELECT sum(h) FROM g{i}) AS h FROM g{i})" for i in range(2)) + " SELECT V.idx, round(coalesce(h, 0), 8) AS hub, round(coalesce(a, 0), 8) AS authority FROM V LEFT JOIN h2 USING (idx) LEFT JOIN b1 USING (idx)")
def _recursive(name: str, run, sql: str, graph: str = "directed") -> None:
    _add(name, run, sql, graph)
    SQL[name] = SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


_recursive("breadth_first_search", lambda g: algorithms.breadth_first_search(g, g.nodes.filter("idx = 0").select("idx")).select("idx", "depth"), ", f AS (SELECT DISTINCT src, dst FROM E), r AS (SELECT 0::BIGINT AS idx, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN f ON src = idx WHERE depth < 6) SELECT idx, min(depth) AS depth FROM r GROUP BY idx")
_recursive("sssp", lambda g: algorithms.sssp(g.with_(edges=g.edges.withColumn("w", F.round("w").cast("float"))), 0).select("idx", "distance"), ", f AS (SELECT src, dst, min(round(w)::DOUBLE) AS w FROM E GROUP BY src, dst), r AS (SELECT 0::BIGINT AS idx, 0.0::DOUBLE AS d, 0 AS k UNION SELECT idx, min(d), k FROM (SELECT f.dst AS idx, r.d + f.w AS d, k + 1 AS k FROM r JOIN f ON f.src = r.idx WHERE k < 12) GROUP BY idx, k) SELECT idx, min(d) AS distance FROM r GROUP BY idx")
_add("triangle_count", algorithms.triangle_count, ", p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM E WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b) SELECT idx, count(n) AS triangles FROM V LEFT JOIN (SELECT a AS n FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) ON n = idx GROUP BY idx", "undirected")

def _steps(name: str, first: str, step: str, n: int) -> str:
    """Tables name0 .. name<n>, each made of the one before, which step calls {x}."""
    return f", {name}0 AS MATERIALIZED ({first})" + "".join(f", {name}{i + 1} AS MATERIALIZED ({step.format(x=f'{name}{i}')})" for i in range(n))


def _distances(arcs: str) -> str:
    """d6 (s, t, d): least distances over up to 64 arcs."""
    return _steps("d", f"SELECT s, t, min(d) AS d FROM (SELECT src AS s, dst AS t, w::DOUBLE AS d FROM {arcs} UNION ALL SELECT idx, idx, 0 FROM V) GROUP BY s, t", "SELECT a.s, b.t, min(a.d + b.d) AS d FROM {x} a JOIN {x} b ON a.t = b.s GROUP BY a.s, b.t", 6)


_add("eigenvector", lambda g: algorithms.eigenvector_centrality(g, tol=1e-12).select("idx", F.round("score", 6).alias("score")),
     _steps("x", "SELECT idx, 1.0::DOUBLE / (SELECT count(*) FROM V) AS v FROM V", "SELECT idx, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT idx, any_value({x}.v) + coalesce(sum(w::DOUBLE * o.v), 0) AS v FROM {x} LEFT JOIN (SELECT dst, w, v FROM H JOIN {x} ON src = idx) o ON dst = idx GROUP BY idx)", 40) + " SELECT idx, round(v, 6) AS score FROM x40", "undirected")
_add("personalized_page_rank", lambda g: algorithms.personalized_page_rank(g, g.nodes.filter("idx < 3").select("idx", F.lit(1.0).alias("p")), tol=1e-13).select("idx", F.round("rank", 8).alias("rank")),
     ", o AS (SELECT idx, coalesce(sum(w::DOUBLE), 0) AS o, CASE WHEN idx < 3 THEN 1.0::DOUBLE / 3 ELSE 0 END AS p FROM V LEFT JOIN E ON src = idx GROUP BY idx)"
     + _steps("r", "SELECT idx, 1.0::DOUBLE / (SELECT count(*) FROM V) AS x FROM V", "SELECT o.idx, 0.15 * p + 0.85 * ((SELECT coalesce(sum(x), 0) FROM {x} JOIN o USING (idx) WHERE o = 0) * p + coalesce(y, 0)) AS x FROM o LEFT JOIN (SELECT dst AS idx, sum(w::DOUBLE * x / o) AS y FROM E JOIN {x} ON src = {x}.idx JOIN o ON o.idx = src GROUP BY dst) USING (idx)", 60)
     + " SELECT idx, round(x, 8) AS rank FROM r60")
_add("connected_components", lambda g: components.connected_components(g.nodes, g.edges),
     _steps("c", "SELECT idx, idx AS c FROM V", "SELECT idx, min(c) AS c FROM (SELECT idx, c FROM {x} UNION ALL SELECT dst, c FROM H JOIN {x} ON src = idx) GROUP BY idx", 12) + " SELECT idx, dense_rank() OVER (ORDER BY c) - 1 AS component FROM c12", "undirected")
_add("k_core", algorithms.k_core,
     ", p AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM H WHERE src <> dst)"
     + _steps("h", "SELECT idx, count(b) AS c FROM V LEFT JOIN p ON a = idx GROUP BY idx", "SELECT V.idx, coalesce(x, 0) AS c FROM V LEFT JOIN (SELECT a, max(least(c, r)) AS x FROM (SELECT a, c, row_number() OVER (PARTITION BY a ORDER BY c DESC) AS r FROM p JOIN {x} ON b = idx) GROUP BY a) ON a = V.idx", 40)
     + " SELECT idx, c::INT AS core FROM h40", "undirected")
_add("minimum_spanning_tree", algorithms.minimum_spanning_tree,
     ", k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY coalesce(w::DOUBLE, 1), e) AS k FROM E WHERE src <> dst)"
     + _steps("m", "SELECT s, t, min(k) AS k FROM (SELECT src AS s, dst AS t, k FROM k UNION ALL SELECT dst, src, k FROM k UNION ALL SELECT idx, idx, 0 FROM V) GROUP BY s, t", "SELECT a.s, b.t, min(greatest(a.k, b.k)) AS k FROM {x} a JOIN {x} b ON a.t = b.s GROUP BY a.s, b.t", 8)
     + " SELECT e FROM k JOIN m8 ON s = src AND t = dst AND m8.k = k.k", "undirected")
_add("label_propagation", algorithms.label_propagation,
     ", p AS MATERIALIZED (SELECT src AS a, dst AS b, sum(w::DOUBLE) AS w FROM H WHERE src <> dst GROUP BY src, dst)"
     + _steps("l", "SELECT idx, idx AS label FROM V", "SELECT idx, coalesce(n, label) AS label FROM {x} LEFT JOIN (SELECT a, label AS n FROM (SELECT a, label, sum(w) AS v FROM p JOIN {x} ON b = idx GROUP BY a, label) QUALIFY row_number() OVER (PARTITION BY a ORDER BY v DESC, label) = 1) ON a = idx", 10)
     + " SELECT idx, dense_rank() OVER (ORDER BY f) - 1 AS label FROM (SELECT idx, min(idx) OVER (PARTITION BY label) AS f FROM l10)", "undirected")
_add("louvain", algorithms.louvain, graph="undirected")
_add("bellman_ford", lambda g: algorithms.bellman_ford(g, 0)[0].select("idx", F.round("distance", 4).alias("distance")), _distances("E") + " SELECT t AS idx, round(d, 4) AS distance FROM d6 WHERE s = 0")
_add("all_pairs", lambda g: algorithms.all_pairs_shortest_paths(g).select("src", "dst", F.round("distance", 4).alias("distance")), _distances("H") + " SELECT s AS src, t AS dst, round(d, 4) AS distance FROM d6", "undirected")
_add("closeness", lambda g: _rounded(algorithms.closeness_centrality(g), "closeness", "harmonic"),
     _distances("H") + " SELECT idx, round(coalesce(k / s * k / ((SELECT count(*) FROM V) - 1), 0), 4) AS closeness, round(coalesce(h, 0), 4) AS harmonic FROM V LEFT JOIN (SELECT s AS idx, count(*)::DOUBLE AS k, sum(d) AS s, sum(1 / nullif(d, 0)) AS h FROM d6 WHERE s <> t GROUP BY d6.s) USING (idx)", "undirected")
#: n (s, t, n): least paths, from those of each number of arcs.
_COUNTED = _distances("H") + ", a AS MATERIALIZED (SELECT x.s, h.src AS u, h.dst AS t, count(*) AS k FROM H h JOIN d6 x ON x.t = h.src JOIN d6 y ON y.s = x.s AND y.t = h.dst WHERE h.src <> h.dst AND abs(x.d + h.w - y.d) < 1e-9 GROUP BY ALL)" + _steps("q", "SELECT idx AS s, idx AS t, 1.0::DOUBLE AS n FROM V", "SELECT a.s, a.t, sum(k * n) AS n FROM a JOIN {x} ON {x}.s = a.s AND {x}.t = a.u GROUP BY a.s, a.t", 24) + ", n AS MATERIALIZED (SELECT s, t, sum(n) AS n, any_value(d) AS d FROM (" + " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(25)) + ") JOIN d6 USING (s, t) GROUP BY s, t)"
_add("betweenness", lambda g: _rounded(algorithms.betweenness_centrality(g), "betweenness"),
     _COUNTED + " SELECT idx, round(coalesce(sum(b), 0) / 2, 4) AS betweenness FROM V LEFT JOIN (SELECT x.t AS v, x.n * y.n / z.n AS b FROM n x JOIN n y ON x.t = y.s JOIN n z ON z.s = x.s AND z.t = y.t WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t AND abs(x.d + y.d - z.d) < 1e-9) ON v = idx GROUP BY idx", "undirected")
_add("edge_betweenness", lambda g: _rounded(algorithms.edge_betweenness(g), "betweenness"),
     _COUNTED + " SELECT E.e, round(coalesce(sum(b), 0) / 2, 4) AS betweenness FROM E LEFT JOIN (SELECT h.e, x.n * y.n / z.n AS b FROM H h JOIN n o ON o.s = h.src AND o.t = h.dst AND h.src <> h.dst AND abs(o.d - h.w) < 1e-9 JOIN n x ON x.t = h.src JOIN n y ON y.s = h.dst JOIN n z ON z.s = x.s AND z.t = y.t WHERE abs(x.d + h.w + y.d - z.d) < 1e-9) f ON f.e = E.e GROUP BY E.e", "undirected")
_add("force_atlas2", lambda g: layout.ForceAtlas2(iterations=3).load(g).run(), graph="undirected")
_add("fruchterman_reingold", lambda g: layout.fruchterman_reingold(g, iterations=3), graph="undirected")

# scalars


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("part").select(F.explode(F.array("p_name", "p_brand", F.col("p_size").cast("string"), F.concat(F.lit("0"), F.col("p_size").cast("string")), F.concat(F.col("p_size").cast("string"), F.lit(".50")), F.concat(F.lit("+"), F.col("p_size").cast("string")), (F.col("p_size") % 2 == 0).cast("string"))).alias("text"))
    return rows.groupBy("text").agg(F.count("*").alias("n")).select("text", "n", T.infer_dtype_col(F.col("text")).alias("dtype"))


QUERIES["infer_dtype"] = _inferred
SQL["infer_dtype"] = r"""
WITH x AS (SELECT unnest([p_name, p_brand, p_size::VARCHAR, '0' || p_size, p_size || '.50', '+' || p_size, (p_size % 2 = 0)::VARCHAR]) AS text FROM part)
SELECT text, count(*) AS n, CASE WHEN text IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(text, '-?(0|[1-9][0-9]*)') THEN 'i32'
  WHEN regexp_full_match(text, '[+-]?([1-9][0-9]*|0)(\.[0-9]+)?') THEN 'f64' ELSE 'string' END AS dtype FROM x GROUP BY text
"""
QUERIES["parse_temporal"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.parse_temporal_col(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ms"))
SQL["parse_temporal"] = "SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP)::DOUBLE AS ms FROM orders"

# formats


def _round_trip(format: str):
    def run(g: Graph) -> DataFrame:
        at = Scratch(g.spark).path(format)
        if format == "container":
            sinks.write_container(g, at)
            return views.edge_list(formats.read_container(g.spark, at, "full"))
        sinks.save(sinks.document(g, format), at)
        back = formats.read(g.spark, f"{at}/part-*", format, parts=True).graph
        ids = back.nodes.select("idx", F.col("id").cast("string").alias("id"))
        named = back.edges.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "dst")
        return named.select("e", "source", "target", "w")

    return run


_NAMED = "SELECT e, a.id::VARCHAR AS source, b.id::VARCHAR AS target, w FROM E JOIN V a ON src = a.idx JOIN V b ON dst = b.idx"
for _f in sinks.WRITERS:
    _add(f"io_{_f}", _round_trip(_f), "SELECT e, (src + 1)::VARCHAR AS source, (dst + 1)::VARCHAR AS target, w FROM E" if _f == "pajek" else _NAMED)
_add("io_container", _round_trip("container"), "SELECT e, src, dst, w FROM E")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank beside the degree and weighted degree of each user of the transition graph."""
    g = transitions(spark, sf_dir)
    return query.keyed_by_id(g, algorithms.page_rank(g, max_iter=10).join(views.degree(g), "idx").join(views.weighted_degree(g), "idx"))


__all__ = ["QUERIES", "SQL", "flagship"]
