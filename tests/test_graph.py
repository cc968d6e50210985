"""Graph operators on small graphs against plain Python, and every query against its SQL."""

import heapq
import json
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftgraph.errors import GraphError
from weftgraph.graph import Graph, by_role, metadata
from weftgraph.operators import algorithms, columns, derive, layout, query, tree, validate, views
from weftgraph.operators.freeze import freeze
from weftgraph.plans import further, queries
from weftgraph.plans.builder import GraphBuilder
from weftgraph.sources.tables import edgeless, from_csr, from_edge_arrays, from_edges, from_records


def graph(spark, edges, n=None, directed=True):
    rows = [(i, s, d, float(w)) for i, (s, d, w) in enumerate(edges)]
    return from_edge_arrays(spark.createDataFrame(rows, "e long, src long, dst long, w double"), n, directed, True)


@pytest.fixture(scope="module")
def edges():
    r = random.Random(7)
    return [(r.randrange(12), r.randrange(12), r.randint(1, 10)) for _ in range(50)]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_sources(spark):
    named = spark.createDataFrame([("b", "a", 1.5, 1), ("a", "c", None, 0)], "s string, t string, w double, o int")
    g = from_edges(named, "s", "t", ["o"], "w")
    assert rows(g.nodes, "idx", "id") == [(0, "a"), (1, "c"), (2, "b")]
    assert rows(g.edges.select("e", "src", "dst"), "e", "src", "dst") == [(0, 0, 1), (1, 2, 0)]
    listed = spark.createDataFrame([("z",), ("a",)], "id string")
    assert [r[1] for r in rows(from_edges(named, "s", "t", ["o"], nodes=listed).nodes, "idx", "id")] == ["a", "z", "c", "b"]
    for code, call in (("E_UNKNOWN_NODE", lambda: from_edges(named, "s", "t", ["o"], nodes=listed, strict=True)), ("E_INVALID_ID", lambda: from_edges(named.withColumn("t", F.lit(None).cast("string")), "s", "t", ["o"])), ("E_INDEX_RANGE", lambda: graph(spark, [(0, 5, 1)], 3)), ("E_INVALID_WEIGHT", lambda: graph(spark, [(0, 1, math.nan)]))):
        with pytest.raises(GraphError) as e:
            call()
        assert e.value.code == code
    ptr = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 3)], "row long, first long, past long")
    col = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "arc long, dst long")
    assert rows(from_csr(ptr, col).edges, "e", "src", "dst") == [(0, 0, 1), (1, 0, 2), (2, 2, 0)]
    with pytest.raises(GraphError):
        from_csr(ptr.limit(2), col)
    r = from_records(None, spark.createDataFrame([("x", "y", 0)], "from string, to string, o int"), ["o"])
    assert r.node_count() == 2 and edgeless(listed, "id", ["id"]).edge_count() == 0


def test_views(spark, edges):
    for directed in (True, False):
        g = graph(spark, edges, 13, directed)
        half = [(s, d, e, w) for e, (s, d, w) in enumerate(edges)]
        if not directed:
            half += [(d, s, e, w) for e, (s, d, w) in enumerate(edges) if s != d]
        assert rows(views.arcs(g), "arc", "src", "dst", "e") == [(i, *x[:3]) for i, x in enumerate(sorted(half))]
        ptr = rows(views.row_ptr(g), "idx", "first", "past")
        at = 0
        for i, a, b in ptr:
            n = sum(x[0] == i for x in half)
            assert (a, b) == (at, at + n)
            at += n
        ends = Counter(x for s, d, _ in edges for x in (s, d))
        assert rows(views.degree(g), "idx", "degree") == [(i, ends[i]) for i in range(13)]
        assert rows(views.weighted_degree(g), "idx", "weight") == [(i, float(sum(w * ((s == i) + (d == i)) for s, d, w in edges))) for i in range(13)]
        order = [r[1] for r in rows(views.degree_order(g), "place", "idx")]
        deg = Counter(x[0] for x in half)
        assert order == sorted(range(13), key=lambda i: (-deg[i], i))
    assert validate.violations(g).count() == 0
    with pytest.raises(GraphError):
        views.mate(graph(spark, edges))
    assert views.is_symmetric(graph(spark, [(0, 1, 2), (1, 0, 2), (2, 2, 1)])).first()[0]
    assert not views.is_symmetric(graph(spark, [(0, 1, 2), (1, 0, 3)])).first()[0]


def plain_undirected(edges, reciprocal):
    by, out, partner = defaultdict(list), [], {}
    for e, (s, d, _) in enumerate(edges):
        by[s, d].append(e)
    for (s, d), left in by.items():
        if s < d:
            for a, b in zip(left, by.get((d, s), []), strict=False):
                partner[a], partner[b] = b, a
    for e, (s, d, _) in enumerate(edges):
        if s == d or (e not in partner and not reciprocal) or (e in partner and e < partner[e]):
            out.append((s, d))
    return out


def test_derived(spark, edges):
    g = graph(spark, edges, 13)
    for reciprocal in (False, True):
        got = derive.to_undirected(g, reciprocal).graph
        assert [r[1:] for r in rows(got.edges, "e", "src", "dst")] == plain_undirected(edges, reciprocal)
    simple = derive.simplified(g, "last")
    first, last = {}, {}
    for e, (s, d, w) in enumerate(edges):
        first.setdefault((s, d), e)
        last[s, d] = w
    assert [r[1:] for r in rows(simple.graph.edges, "e", "src", "dst", "w")] == [(*k, float(last[k])) for k in first]
    remap = dict(rows(simple.edge_remap, "old", "new"))
    places = {k: i for i, k in enumerate(first)}
    assert remap == {e: places[s, d] for e, (s, d, _) in enumerate(edges)}
    chosen = spark.createDataFrame([(5, 0), (3, 1), (8, 2)], "idx long, place long")
    sub = derive.induced_subgraph(g, chosen).graph
    to = {5: 0, 3: 1, 8: 2}
    assert [r[1:] for r in rows(sub.edges, "e", "src", "dst")] == [(to[s], to[d]) for s, d, _ in edges if s in to and d in to]
    for bad in ([(5, 0), (5, 1)], [(99, 0)]):
        with pytest.raises(GraphError):
            derive.induced_subgraph(g, spark.createDataFrame(bad, "idx long, place long"))
    with pytest.raises(GraphError):
        derive.relabel(g, spark.createDataFrame([(0, 0)], "old long, new long"))
    out, sizes = derive.contract(g, g.nodes.select("idx", (F.col("idx") % 3 + 10).alias("label")), self_loops="drop")
    assert sum(r["size"] for r in sizes.collect()) == 13 and out.graph.node_count() == 3
    assert sum(r["w"] for r in out.graph.edges.collect()) == sum(w for s, d, w in edges if s % 3 != d % 3)
    kept = derive.contract(g, g.nodes.select("idx", (F.col("idx") % 3).alias("label")), parallel="keep")[0]
    assert kept.graph.edge_count() == len(edges)
    with pytest.raises(GraphError):
        derive.contract(g, g.nodes.filter("idx > 0").select("idx", F.lit(0).alias("label")))
    assert validate.equal_topology(derive.transpose(derive.transpose(g).graph).graph, g)
    validate.validate(derive.simplified(g).graph)


def test_freeze_and_policies(spark, edges):
    g = graph(spark, edges, 13)
    for how in ("first", "last", "sum", "min", "max"):
        out, report = freeze(g, "drop", how)
        by = defaultdict(list)
        for s, d, w in edges:
            if s != d:
                by[s, d].append(float(w))
        f = {"first": lambda x: x[0], "last": lambda x: x[-1], "sum": sum, "min": min, "max": max}[how]
        assert sorted((r["src"], r["dst"], r["w"]) for r in out.edges.collect()) == sorted((*k, f(v)) for k, v in by.items())
        assert report.dropped_loops == sum(s == d for s, d, _ in edges) and report.merged_edges == sum(len(v) - 1 for v in by.values())
    for policy, code in (({"self_loops": "error"}, "E_SELF_LOOP"), ({"duplicates": "error"}, "E_DUPLICATE_EDGE")):
        with pytest.raises(GraphError) as e:
            freeze(graph(spark, [(0, 0, 1), (1, 2, 1), (1, 2, 2)]), **policy)
        assert e.value.code == code


def test_builder(spark):
    b = GraphBuilder(spark, "string")
    b.add_node("x")
    assert b.add_edge("a", "b", 2.0) == 0 and b.add_edge("b", "c") == 1 and b.add_edge("c", "c") == 2
    b.set_edge_weights(spark.createDataFrame([(1, 5.0)], "e long, w double"))
    b.set_value("node", "a", "age", 3)
    b.set_value("node", "a", "age", 4)
    b.remove_node("c")
    assert b.node_count() == 3 and b.edge_count() == 1 and not b.has_node("c") and not b.has_edge(1) and b.find_edges("a", "b") == [0]
    b.add_node("c")
    g, _ = b.freeze()
    assert [r[1] for r in rows(g.nodes, "idx", "id")] == ["x", "a", "b", "c"] and dict(rows(g.nodes, "id", "age"))["a"] == 4
    b.add_edge("c", "a")
    later, _ = b.freeze()
    assert rows(later.nodes, "idx", "id")[:4] == rows(g.nodes, "idx", "id")
    other = GraphBuilder(spark, "string")
    other.add_edge("b", "q", 1.0)
    b.add_graph(other.freeze()[0])
    assert b.node_count() == 5 and b.edge_count() == 3
    u = GraphBuilder(spark, "long", directed=False)
    u.add_edge(1, 2)
    u.add_edge(3, 3)
    u.set_directed(True, expand=True)
    e = u.freeze()[0].edges.orderBy("e").collect()
    assert [(r["src"], r["dst"], r["pair"]) for r in e] == [(0, 1, 2), (2, 2, None), (1, 0, 0)]
    u.add_anonymous_nodes(2)
    assert u.node_count() == 5
    u.dispose()
    with pytest.raises(GraphError):
        u.add_node(1)


def test_columns(spark):
    df = metadata(spark.createDataFrame([(0, None), (1, 5)], "idx long, x int"), "x", default=7, role="mass")
    assert by_role(df, "mass") == "x" and rows(df.select(columns.value(df, "x").alias("v")), "v") == [(5,), (7,)]
    assert rows(columns.materialize_default(df, "x"), "x") == [(5,), (7,)]
    for call in (lambda: columns.require(df, "y"), lambda: columns.require(df, "x", "string"), lambda: columns.set_column(df, "x", F.lit(1)), lambda: columns.require_role(df, "label")):
        with pytest.raises(GraphError):
            call()
    remap = spark.createDataFrame([(0, 2), (1, None), (2, 0)], "old long, new long")
    lists = spark.createDataFrame([(0, [0, 1, 2]), (1, []), (2, None)], "idx long, r array<long>")
    assert {r["idx"]: r["r"] for r in columns.remap_references(lists, "r", remap, "idx").collect()} == {0: [2, 0], 1: [], 2: None}
    back = columns.scatter(spark.createDataFrame([(0, 1), (1, 1)], "idx long, value int"), spark.createDataFrame([(0, 9)], "idx long, value int"), spark.createDataFrame([(0, 1)], "idx long, old long"))
    assert rows(back, "idx", "value") == [(0, 1), (1, 9)]
    assert rows(lists.select(columns.with_components("r", 2, 0).alias("r")).filter("r is not null"), "r") == [([0, 0],), ([0, 1],)]


def test_tree(spark):
    nodes = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (4, 5), (5, 4), (6, 6), (7, 99)], "idx long, parent long")
    assert rows(tree.depth_first(nodes), "place", "idx", "depth") == [(0, 0, 0), (1, 1, 1), (2, 3, 2), (3, 2, 1), (4, 6, 0), (5, 7, 0), (6, 4, 0), (7, 5, 0)]
    assert dict(rows(tree.reachable_count(nodes), "idx", "reachable")) == {0: 4, 1: 2, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, 7: 1}
    assert dict(rows(tree.child_count(nodes), "idx", "children"))[0] == 2 and dict(rows(tree.parent_count(nodes), "idx", "parents"))[7] == 0


def dijkstra(n, half, s):
    dist = {s: 0.0}
    heap = [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for a, b, w in half:
            if a == u and d + w < dist.get(b, math.inf):
                dist[b] = d + w
                heapq.heappush(heap, (dist[b], b))
    return dist


def test_paths_and_structure(spark, edges):
    g = graph(spark, edges, 13, False)
    half = [(s, d, w) for s, d, w in edges] + [(d, s, w) for s, d, w in edges]
    want = dijkstra(13, half, 0)
    assert dict(rows(algorithms.sssp(g, 0), "idx", "distance")) == want
    assert dict(rows(algorithms.bellman_ford(g, 0)[0], "idx", "distance")) == want
    assert algorithms.bellman_ford(graph(spark, [(0, 1, 1), (1, 0, -2)]), 0)[1]
    with pytest.raises(GraphError):
        algorithms.sssp(graph(spark, [(0, 1, -1)]), 0)
    assert {(r["src"], r["dst"]): r["distance"] for r in algorithms.all_pairs_shortest_paths(g).collect()} == {(s, t): d for s in range(13) for t, d in dijkstra(13, half, s).items()}
    with pytest.raises(GraphError):
        algorithms.all_pairs_shortest_paths(g, limit=5)
    chosen = {r["e"] for r in algorithms.minimum_spanning_tree(g).collect()}
    parent, best = list(range(13)), set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, e, s, d in sorted((w, e, s, d) for e, (s, d, w) in enumerate(edges)):
        if find(s) != find(d):
            parent[find(s)] = find(d)
            best.add(e)
    assert chosen == best
    neighbours = defaultdict(set)
    for s, d, _ in edges:
        if s != d:
            neighbours[s].add(d), neighbours[d].add(s)
    assert dict(rows(algorithms.triangle_count(g), "idx", "triangles")) == {i: sum(b in neighbours[a] for a in neighbours[i] for b in neighbours[i] if a < b) for i in range(13)}
    core = dict(rows(algorithms.k_core(g), "idx", "core"))
    for k in range(1, 1 + max(core.values())):
        left = {i for i in core if core[i] >= k}
        assert all(len(neighbours[i] & left) >= k for i in left)


def test_centrality(spark):
    path = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)], 6, False)
    assert [r[1] for r in rows(algorithms.betweenness_centrality(path), "idx", "betweenness")] == [0, 3, 4, 3, 0, 0]
    assert [r[1] for r in rows(algorithms.edge_betweenness(path), "e", "betweenness")] == [4, 6, 6, 4]
    close = dict(rows(algorithms.closeness_centrality(path), "idx", "closeness"))
    assert abs(close[2] - 4 / 6 * 4 / 5) < 1e-12 and close[5] == 0
    rank = dict(rows(algorithms.page_rank(path, tol=1e-10), "idx", "rank"))
    assert abs(sum(rank.values()) - 1) < 1e-9 and abs(rank[0] - rank[4]) < 1e-9
    two = graph(spark, [(a, b, 1) for k in (0, 5) for a in range(k, k + 5) for b in range(k, a)] + [(0, 5, 1)], 10, False)
    for f in (algorithms.louvain, algorithms.label_propagation):
        label = dict(rows(f(two), "idx", "label"))
        assert len({label[i] for i in range(5)}) == 1 and len({label[i] for i in range(5, 10)}) == 1
    assert algorithms.modularity(two, two.nodes.select("idx", F.floor(F.col("idx") / 5).alias("label"))) > 0.4
    score = dict(rows(algorithms.eigenvector_centrality(two), "idx", "score"))
    a = np.zeros((10, 10))
    for r in two.edges.collect():
        a[r["src"], r["dst"]] = a[r["dst"], r["src"]] = 1
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert max(abs(score[i] - v[i]) for i in range(10)) < 1e-2


def plain_forces(pos, mass, half, k, gravity):
    n = len(pos)
    out = np.zeros_like(pos)
    for s, d, w in half:
        out[s] += w * (pos[d] - pos[s])
    for i in range(n):
        for j in range(n):
            if i != j:
                d = pos[i] - pos[j]
                out[i] += k * mass[i] * mass[j] * d / (d @ d)
        out[i] -= gravity * mass[i] * pos[i] / np.linalg.norm(pos[i])
    return out


def test_force_atlas(spark):
    edges = [(0, 1, 1), (1, 2, 2), (2, 0, 1), (2, 3, 1)]
    g = graph(spark, edges, 5, False)
    start = np.array([[0.1, 0.9], [-0.7, 0.2], [0.4, -0.3], [0.8, 0.6], [-0.5, -0.9]])
    given = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(start)], "idx long, x double, y double")
    sim = layout.ForceAtlas2(mode="networkx", iterations=4).load(g, given)
    half = [(s, d, w) for s, d, w in edges] + [(d, s, w) for s, d, w in edges]
    mass = np.array([3, 3, 4, 2, 1.0])
    pos, swing, traction, speed, efficiency = start.copy(), 1.0, 1.0, 1.0, 1.0
    for _ in range(4):
        f = plain_forces(pos, mass, half, 2.0, 1.0)
        swing += (mass * np.linalg.norm(pos - f, axis=1)).sum()
        traction += (0.5 * mass * np.linalg.norm(pos + f, axis=1)).sum()
        speed, efficiency = layout.estimate_speed(5, swing, traction, speed, efficiency, 1.0)
        pos += f * (speed / (1 + np.sqrt(speed * mass * np.linalg.norm(f, axis=1))))[:, None]
    got = np.array([r[1:] for r in rows(sim.run(), "idx", "x", "y")])
    assert np.abs(got - pos).max() < 1e-9
    with pytest.raises(GraphError) as e:
        layout.ForceAtlas2().load(graph(spark, edges))
    assert e.value.code == "E_SNAPSHOT"
    sim.reheat()
    sim.set_fixed(spark.createDataFrame([(2, True)], "idx long, fixed boolean"))
    before = dict(rows(sim.positions(), "idx", "x"))
    assert dict(rows(sim.step(), "idx", "x"))[2] == before[2]
    sim.dispose()
    with pytest.raises(GraphError):
        sim.step()
    s, want = 1, []
    for _ in range(5):
        s = (185852 * s + 1) % (2**35 - 31)
        want.append(s / (2**35 - 31))
    assert np.allclose(layout.seed_numbers(np.arange(5)), want, atol=0)


def test_grid_repulsion_is_near_the_exact_one(spark):
    r = np.random.default_rng(1)
    state = spark.createDataFrame([(i, *map(float, p), 0.0, 1.0) for i, p in enumerate(r.uniform(-10, 10, (300, 2)))], "idx long, x double, y double, z double, mass double")
    a, b = (np.array([x[1:] for x in rows(f, "idx", "rx", "ry")]) for f in (layout._exact(state, 1.0, 300), layout._grid(state, 1.0)))
    assert np.linalg.norm(a - b) < 0.02 * np.linalg.norm(a)


def test_validation(spark, edges):
    g = graph(spark, edges, 13)
    with pytest.raises(GraphError) as e:
        validate.validate(g.with_(edges=g.edges.withColumn("dst", F.lit(50))))
    assert e.value.code == "E_INVALID_SNAPSHOT"
    assert validate.content_hash(g).first() == validate.content_hash(g.with_(edges=g.edges.repartition(3))).first()
    assert not validate.equal_topology(g, derive.transpose(g).graph)
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    validate.validate(empty)
    assert views.degree(empty).count() == 0 and algorithms.page_rank(empty).count() == 0 and algorithms.connected_components(empty).count() == 0


def test_lookups(spark, edges):
    g = graph(spark, edges, 13)
    pairs = spark.createDataFrame([(s, d) for s, d, _ in edges[:3]] + [(12, 12)], "src long, dst long")
    found = {(r["src"], r["dst"]): r["multiplicity"] for r in query.find_arcs(g, pairs).collect()}
    c = Counter((s, d) for s, d, _ in edges)
    assert found == {**{(s, d): c[s, d] for s, d, _ in edges[:3]}, (12, 12): 0}
    with pytest.raises(GraphError):
        query.index_of(g, spark.createDataFrame([(99,)], "id long"), strict=True)
    with pytest.raises(GraphError):
        query.check_unique(g.edges, "src")


def _normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "" if v is None or v != v else f"{float(v):.5g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL | further.SQL))
def test_query_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(sf):
        pytest.skip("no sample tables")
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    got, want = (queries.QUERIES | further.QUERIES)[name](spark, sf).toPandas(), c.sql((queries.SQL | further.SQL)[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert _normal(got).equals(_normal(want))


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql
    from __spark_entry__ import queries as listed

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(listed())
    assert json.dumps(sorted(listed()))


def test_metadata_patches():
    from weftgraph.graph import resolve_meta

    assert resolve_meta({"name": "a", "extra": {"x": 1}}, None, {"name": "b", "own": 2}, {"name": None}) == {"extra": {"x": 1, "own": 2}}
    with pytest.raises(GraphError):
        resolve_meta({"name": 1})


def test_queries_over_whole_graphs(spark, sf):
    """Components over every edge against union-find, betweenness against the sum over all sources."""
    from weftgraph.operators import algorithms
    from weftgraph.plans.graphs import transitions

    g = transitions(spark, sf)
    label = {r[0]: r[0] for r in g.nodes.select("idx").collect()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in g.edges.select("src", "dst").collect():
        a, b = sorted((root(a), root(b)))
        label[b] = a
    first = {x: i for i, x in enumerate(sorted({root(x) for x in label}))}
    assert dict(queries.QUERIES["connected_components"](spark, sf).select("idx", "component").collect()) == {x: first[root(x)] for x in label}
    larger = sf.replace("0.001", "0.01")  # of more than 64 nodes
    u = transitions(spark, larger, False)
    assert u.nodes.count() > 64
    rounded = lambda rows: sorted((r[0], round(r[1], 3)) for r in rows)
    for name, run in (("betweenness", algorithms.betweenness_centrality), ("edge_betweenness", algorithms.edge_betweenness)):
        assert rounded(queries.QUERIES[name](spark, larger).collect()) == rounded(run(u, u.nodes).collect())


def test_builder_records(spark):
    b = GraphBuilder(spark, "string", weighted=True)
    b.add_node_record({"id": "a", "size": 3, "name": "first"})
    b.add_node_record({"key": "b", "size": 4}, "key")
    e = b.add_edge_record({"source": "a", "target": "c", "weight": 2.5, "kind": "x"})
    assert b.edge_endpoints(e) == ("a", "c") and b.edge_weight(e) == 2.5
    with pytest.raises(GraphError, match="E_INVALID_ID"):
        b.add_node_record({"size": 3})
    with pytest.raises(GraphError, match="E_INDEX_RANGE"):
        b.edge_weight(7)
    g = b.freeze()[0]
    assert sorted(map(tuple, g.nodes.select("id", "size", "name").collect()), key=str) == [("a", 3, "first"), ("b", 4, None), ("c", None, None)]
    assert g.edges.select("kind").first()[0] == "x"


def test_scratch_of_iterated_algorithms_stays_small(spark, tmp_path_factory):
    """k_core, BFS and shortest paths of a path graph, one round a node, keep no superseded tables."""
    import weftgraph._tables as tables_

    made = []
    first = tables_.Scratch.__init__

    def noted(self, s):
        first(self, s)
        made.append(self)

    tables_.Scratch.__init__ = noted
    try:
        n = 12
        edges = spark.range(n - 1).select(F.col("id").alias("e"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        g = from_edge_arrays(edges, n, directed=False)
        for run in (lambda: algorithms.k_core(g), lambda: algorithms.breadth_first_search(g, spark.range(1).select(F.col("id").alias("idx"))), lambda: algorithms.sssp(g, 0)):
            made.clear()
            assert run().count() == n
            import os

            assert sum(len(os.listdir(s.root)) for s in made if os.path.isdir(s.root)) <= 6
    finally:
        tables_.Scratch.__init__ = first


def test_work_by_source_takes_many_arcs(spark):
    """More arcs than 64 for each of 5,000 nodes, most of them heavier than a way round; few are held."""
    n = 40
    every = spark.range(330_000).select(F.col("id").alias("e"), (F.col("id") % n).alias("src"), ((F.col("id") + 1 + F.col("id") % 3 * 7) % n).alias("dst"), (F.col("id") % 997 + 1).cast("float").alias("w"))
    g = from_edge_arrays(every, n, directed=False, weighted=True)
    half = {}
    for s, d, w in every.groupBy("src", "dst").agg(F.min("w")).collect():
        for a, b in ((s, d), (d, s)):
            half[a, b] = min(w, half.get((a, b), math.inf))
    want = {(s, t): d for s in range(n) for t, d in dijkstra(n, [(a, b, w) for (a, b), w in half.items()], s).items()}
    assert {(r["src"], r["dst"]): r["distance"] for r in algorithms.all_pairs_shortest_paths(g).collect()} == want
    assert len(algorithms._kept(g, None)[1]) < 2_000
    harmonic = dict(rows(algorithms.closeness_centrality(g), "idx", "harmonic"))
    assert all(abs(harmonic[s] - sum(1 / want[s, t] for t in range(n) if t != s)) < 1e-9 for s in range(n))


def test_repulsion_holds_a_tile():
    """What a task holds for its bodies doesn't grow with the number of the others."""
    import tracemalloc

    n = 100_000
    i = np.arange(n)
    q, m = np.stack([i % 10, i // 10, 0 * i], 1).astype(float), i % 3 + 1.0
    tracemalloc.start()
    try:
        got = layout._pairwise(q[:3], m[:3], q, m, 2.0, i[:3])
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
    for a in range(3):
        d = np.delete(q[a] - q, a, 0)
        assert np.allclose(got[a], (2.0 * m[a] * np.delete(m, a) / (d * d).sum(1))[:, None].T @ d)
