"""Graph algorithms as iterated DataFrame programs.

Each round joins node state to arcs and aggregates by node, with partial sums before the shuffle. State is written to
the shared folder every round, so lineage stays one round long and survives lost executors; only scalars (a norm, a
count) reach the driver. Arcs of the graph are written once, partitioned by the side they are joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._tables import Scratch, running_sum
from ..errors import GraphError
from ..graph import Graph, weight
from . import views
from .components import connected_components as _components

INF = float("inf")


def _arcs(g: Graph, scratch: Scratch) -> DataFrame:
    return scratch.table(views.halves(g).select("src", "dst", "e", weight().alias("w")), "arcs")


def pull(arcs: DataFrame, x: DataFrame, value: Column, name: str = "y") -> DataFrame:
    """(idx, y): for each node the sum over its in-arcs of value, an expression in w and the columns of x (idx, ...) of
    the arc's source."""
    return arcs.join(x.withColumnRenamed("idx", "src"), "src").groupBy(F.col("dst").alias("idx")).agg(F.sum(value).alias(name))


def page_rank(g: Graph, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100, personalization: DataFrame | None = None) -> DataFrame:
    """(idx, rank): (1 - alpha) p + alpha (dangling mass * p + the weighted sum over in-arcs), with p = 1 / n or the
    normalised personalization (idx, p). Stops when the L1 change is below tol * n. A node whose out-weights sum to 0
    is dangling."""
    scratch = Scratch(g.spark)
    n = g.node_count()
    if not n:
        return g.nodes.select("idx", F.lit(0.0).alias("rank"))
    a = _arcs(g, scratch)
    out = a.groupBy(F.col("src").alias("idx")).agg(F.sum("w").alias("out"))
    start = g.nodes.select("idx").join(out, "idx", "left").select("idx", F.coalesce("out", F.lit(0.0)).alias("out"))
    if personalization is None:
        start = start.withColumn("p", F.lit(1.0 / n))
    else:
        total = personalization.agg(F.sum("p")).first()[0]
        if not total:
            raise GraphError("E_INVALID_ARGUMENT", "personalization sums to 0")
        start = start.join(personalization.select("idx", (F.col("p") / total).alias("p")), "idx", "left").na.fill({"p": 0.0})
    state = scratch.table(start.withColumn("rank", F.lit(1.0 / n)).withColumn("prev", F.lit(INF)), "rank")
    for _ in range(max_iter):
        dangling = state.agg(F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0))).first()[0]
        y = pull(a, state.filter("out <> 0").select("idx", (F.col("rank") / F.col("out")).alias("x")), F.col("w") * F.col("x"))
        new = state.join(y, "idx", "left").select("idx", "out", "p", ((1 - alpha) * F.col("p") + alpha * (F.lit(dangling) * F.col("p") + F.coalesce("y", F.lit(0.0)))).alias("rank"), F.col("rank").alias("prev"))
        then = scratch.table(new, "rank")
        scratch.drop(state)
        state = then
        if state.agg(F.sum(F.abs(F.col("rank") - F.col("prev")))).first()[0] < tol * n:
            break
    return state.select("idx", "rank")


def personalized_page_rank(g: Graph, personalization: DataFrame, **options) -> DataFrame:
    return page_rank(g, personalization=personalization, **options)


def hits(g: Graph, tol: float = 1e-8, max_iter: int = 100) -> DataFrame:
    """(idx, hub, authority), each summing to 1: authorities from hubs along arcs, hubs from authorities against them."""
    scratch = Scratch(g.spark)
    a = _arcs(g, scratch)
    back = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    n = max(g.node_count(), 1)
    state = scratch.table(g.nodes.select("idx", F.lit(1.0 / n).alias("hub"), F.lit(0.0).alias("authority")), "hits")
    for _ in range(max_iter):
        auth = scratch.table(pull(a, state.select("idx", "hub"), F.col("w") * F.col("hub"), "authority"), "authority")
        parts = [auth]
        s = auth.agg(F.sum("authority")).first()[0] or 1.0
        auth = auth.withColumn("authority", F.col("authority") / s)
        hub = scratch.table(pull(back, auth, F.col("w") * F.col("authority"), "hub"), "hub")
        parts.append(hub)
        s = hub.agg(F.sum("hub")).first()[0] or 1.0
        hub = hub.withColumn("hub", F.col("hub") / s)
        then = scratch.table(g.nodes.select("idx").join(hub, "idx", "left").join(auth, "idx", "left").na.fill(0.0), "hits")
        moved = then.join(state.select("idx", F.col("hub").alias("__h")), "idx").agg(F.sum(F.abs(F.col("hub") - F.col("__h")))).first()[0] or 0.0
        scratch.drop(state, *parts)
        state = then
        if moved < tol:
            break
    return state.select("idx", "hub", "authority")


def _power(g: Graph, step, start: float, tol: float, max_iter: int, normalise: bool) -> DataFrame:
    scratch = Scratch(g.spark)
    a = _arcs(g, scratch)
    n = max(g.node_count(), 1)
    state = held = scratch.table(g.nodes.select("idx", F.lit(start).alias("score")), "score")
    for _ in range(max_iter):
        y = pull(a, state, F.col("w") * F.col("score"))
        new = scratch.table(state.join(y, "idx", "left").select("idx", step(F.col("score"), F.coalesce("y", F.lit(0.0))).alias("score"), F.col("score").alias("prev")), "score")
        if normalise:
            norm = (new.agg(F.sum(F.col("score") * F.col("score"))).first()[0] or 0.0) ** 0.5 or 1.0
            raw = new
            new = scratch.table(new.withColumn("score", F.col("score") / norm), "score")
            scratch.drop(raw)
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("prev")))).first()[0] or 0.0
        scratch.drop(held)
        state, held = new.select("idx", "score"), new
        if moved < n * tol:
            break
    return state


def eigenvector_centrality(g: Graph, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(idx, score), of length 1: power iteration of the in-adjacency plus the identity, which leaves the leading
    vector and ends oscillation on bipartite graphs."""
    n = max(g.node_count(), 1)
    return _power(g, lambda x, y: x + y, 1.0 / n, tol, max_iter, True)


def katz_centrality(g: Graph, alpha: float = 0.1, beta: float = 1.0, tol: float = 1e-6, max_iter: int = 1000, normalized: bool = True) -> DataFrame:
    """(idx, score): alpha times the in-sum of scores, plus beta; of length 1 if normalized."""
    out = _power(g, lambda x, y: alpha * y + beta, 0.0, tol, max_iter, False)
    if not normalized:
        return out
    norm = (out.agg(F.sum(F.col("score") * F.col("score"))).first()[0] or 0.0) ** 0.5 or 1.0
    return out.withColumn("score", F.col("score") / norm)


def connected_components(g: Graph) -> DataFrame:
    """(idx, component): weak components numbered by first appearance."""
    return _components(g.nodes, g.edges)


weakly_connected_components = connected_components


def breadth_first_search(g: Graph, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(idx, depth, parent) of the nodes reached from sources (idx); the parent is the least node of the level before,
    null for a source."""
    scratch = Scratch(g.spark)
    a = scratch.table(views.halves(g).filter("src <> dst").select("src", "dst").distinct(), "arcs")
    front = scratch.table(sources.select("idx").distinct().select("idx", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")), "front")
    at, depth = scratch.path("seen"), 0
    seen = scratch.append(front, at)
    while max_depth is None or depth < max_depth:
        depth += 1
        before = front
        step = a.join(front.select(F.col("idx").alias("src")), "src").groupBy(F.col("dst").alias("idx")).agg(F.min("src").alias("parent"))
        front = scratch.table(step.join(seen.select("idx"), "idx", "left_anti").select("idx", F.lit(depth).alias("depth"), "parent"), "front")
        scratch.drop(before)
        if not front.limit(1).count():
            break
        seen = scratch.append(front, at)
    return seen


def _relax(g: Graph, source: int, rounds: int) -> tuple[DataFrame, bool]:
    """(idx, distance, parent) and whether the last round still changed something."""
    scratch = Scratch(g.spark)
    a = scratch.table(views.halves(g).groupBy("src", "dst").agg(F.min(weight()).alias("w")), "arcs")
    state = scratch.table(g.spark.range(1).select(F.lit(source).cast("long").alias("idx"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("parent")), "distance")
    fresh = state
    for _ in range(rounds):
        step = a.join(fresh.select(F.col("idx").alias("src"), "distance"), "src").groupBy(F.col("dst").alias("idx")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("src").alias("p"))).alias("b"))
        both = step.join(state, "idx", "left").filter(F.col("distance").isNull() | (F.col("b.d") < F.col("distance")))
        late = scratch.table(both.select("idx", F.col("b.d").alias("distance"), F.col("b.p").alias("parent")), "fresh")
        if not late.limit(1).count():
            return state, False
        then = scratch.table(state.join(late.select("idx"), "idx", "left_anti").unionByName(late), "distance")
        scratch.drop(*({id(x): x for x in (state, fresh)}.values()))
        state, fresh = then, late
    return state, True


def sssp(g: Graph, source: int) -> DataFrame:
    """(idx, distance, parent) of the nodes reached; a negative weight is E_UNSUPPORTED."""
    if g.edges.filter(weight() < 0).limit(1).count():
        raise GraphError("E_UNSUPPORTED", "negative weights need bellman_ford")
    return _relax(g, source, max(g.node_count(), 1))[0]


def bellman_ford(g: Graph, source: int) -> tuple[DataFrame, bool]:
    """(idx, distance, parent), and whether a negative cycle can be reached."""
    return _relax(g, source, max(g.node_count(), 1))


def k_core(g: Graph) -> DataFrame:
    """(idx, core): the largest k of a subgraph in which the node keeps k neighbours; loops and parallels don't count."""
    scratch = Scratch(g.spark)
    pairs = scratch.table(g.edges.filter("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.a", "x.b").distinct(), "pairs")
    alive = scratch.table(g.nodes.select("idx"), "alive")
    at, k = scratch.path("core"), 0
    done = scratch.append(alive.limit(0).select("idx", F.lit(0).alias("core")), at)
    while alive.limit(1).count():
        by = pairs.groupBy(F.col("a").alias("idx")).agg(F.count("*").alias("n"))
        degree = scratch.table(alive.join(by, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n")), "degree")
        k = max(k, degree.agg(F.min("n")).first()[0])
        gone = degree.filter(F.col("n") <= k).select("idx")
        done = scratch.append(gone.select("idx", F.lit(k).alias("core")), at)
        before = (alive, pairs, degree)
        alive = scratch.table(degree.filter(F.col("n") > k).select("idx"), "alive")
        inside = pairs.join(alive.withColumnRenamed("idx", "a"), "a", "left_semi").join(alive.withColumnRenamed("idx", "b"), "b", "left_semi")
        pairs = scratch.table(inside.select("a", "b"), "pairs")
        scratch.drop(*before)
    return done


def triangle_count(g: Graph) -> DataFrame:
    """(idx, triangles) of distinct neighbours. Edges lead from lower to higher degree, so hubs start few wedges."""
    scratch = Scratch(g.spark)
    pairs = g.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs")
    d = pairs.select(F.explode(F.array("a", "b")).alias("idx")).groupBy("idx").agg(F.count("*").alias("d"))
    both = pairs.join(d.select(F.col("idx").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("idx").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = scratch.table(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented")
    wedge = o.join(o.select("u", F.col("v").alias("w")), "u").filter("v < w")
    closed = wedge.join(o.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")), (F.col("v") == F.col("x")) & (F.col("w") == F.col("y")))
    by = closed.select(F.explode(F.array("u", "v", "w")).alias("idx")).groupBy("idx").agg(F.count("*").alias("triangles"))
    return g.nodes.select("idx").join(by, "idx", "left").na.fill({"triangles": 0})


def minimum_spanning_tree(g: Graph) -> DataFrame:
    """(e) of a minimum spanning forest, orientation aside; ties go to the lower e, so the forest is unique (Boruvka)."""
    scratch = Scratch(g.spark)
    edges = scratch.table(g.edges.filter("src <> dst").select("e", F.col("src").alias("a"), F.col("dst").alias("b"), weight().alias("w")), "edges")
    chosen = scratch.table(edges.select("e").limit(0), "chosen")
    while edges.limit(1).count():
        ends = edges.select("e", "w", F.explode(F.array("a", "b")).alias("c"))
        best = scratch.table(ends.groupBy("c").agg(F.min(F.struct("w", "e")).alias("m")).select(F.col("m.e").alias("e")).distinct(), "best")
        chosen = scratch.table(chosen.unionByName(best), "chosen")
        from .components import components

        comp = components(edges.join(best, "e", "left_semi").select("a", "b"), scratch)
        to = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select("e", "w", F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b")).filter("a <> b")
        # of parallel edges between components only the best can be chosen
        lean = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "e")).alias("m")).select("m.e", "a", "b", "m.w")
        edges = scratch.table(lean, "edges")
    return chosen.distinct()


def label_propagation(g: Graph, max_iter: int = 10) -> DataFrame:
    """(idx, label): every node takes the label of most weight among its neighbours, the least of equals; all at once.
    Labels are renumbered by first appearance."""
    from .derive import renumber_partition

    scratch = Scratch(g.spark)
    both = scratch.table(g.edges.filter("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x"), weight().alias("w")).groupBy("x.a", "x.b").agg(F.sum("w").alias("w")), "pairs")
    state = held = scratch.table(g.nodes.select("idx", F.col("idx").alias("label")), "labels")
    for _ in range(max_iter):
        votes = both.join(state.withColumnRenamed("idx", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("a").alias("idx")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("__new"))
        new = scratch.table(state.join(best, "idx", "left").select("idx", F.coalesce("__new", "label").alias("label"), (F.coalesce("__new", "label") != F.col("label")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(held)
        state, held = new.select("idx", "label"), new
        if not moved:
            break
    return renumber_partition(state)


def modularity(g: Graph, partition: DataFrame) -> float:
    """Newman's modularity of (idx, label), direction aside."""
    e = g.edges.select("src", "dst", weight().alias("w")).join(partition.select(F.col("idx").alias("src"), F.col("label").alias("ls")), "src").join(partition.select(F.col("idx").alias("dst"), F.col("label").alias("ld")), "dst")
    m, inside = e.agg(F.sum("w"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0))).first()
    if not m:
        return 0.0
    d = e.select(F.explode(F.array("ls", "ld")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("d"))
    return inside / m - (d.agg(F.sum(F.col("d") * F.col("d"))).first()[0]) / (4 * m * m)


def louvain(g: Graph, max_levels: int = 10, max_passes: int = 20, resolution: float = 1.0) -> DataFrame:
    """(idx, label): levels of local moves and contraction while modularity rises.

    In a pass each node that would gain moves to its best neighbouring community, but only nodes of one parity of a
    hash, so that neighbours rarely swap; a pass that doesn't raise modularity is undone and ends the level.
    """
    from .derive import contract, renumber_partition

    scratch = Scratch(g.spark)
    whole = g.nodes.select("idx", F.col("idx").alias("label"))
    now = g.with_(directed=False)
    best = modularity(g, whole)
    for _ in range(max_levels):
        m = now.edges.agg(F.sum(weight())).first()[0]
        if not m:
            break
        both = scratch.table(now.edges.filter("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x"), weight().alias("w")).groupBy("x.a", "x.b").agg(F.sum("w").alias("w")), "pairs")
        k = scratch.table(views.weighted_degree(now).select("idx", F.col("weight").alias("k")), "degree")
        part = scratch.table(now.nodes.select("idx", F.col("idx").alias("label")), "part")
        top = modularity(now, part)
        raised = False
        still = 0
        for step in range(max_passes):
            total = part.join(k, "idx").groupBy("label").agg(F.sum("k").alias("t"))
            own = part.join(k, "idx").join(total, "label").select(F.col("idx").alias("a"), F.col("label").alias("own"), "k", F.col("t").alias("t_own"))
            links = both.join(part.withColumnRenamed("idx", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("l"))
            gain = links.join(total, "label").join(own, "a").withColumn("g", F.when(F.col("label") == F.col("own"), F.col("l") - resolution * F.col("k") * (F.col("t_own") - F.col("k")) / (2 * m)).otherwise(F.col("l") - resolution * F.col("k") * F.col("t") / (2 * m)))
            stay = gain.filter("label = own").select("a", F.col("g").alias("g_own"))
            pick = gain.filter("label <> own").groupBy("a", "k", "t_own").agg(F.max(F.struct("g", (-F.col("label")).alias("n"))).alias("b")).join(stay, "a", "left")
            alone = -resolution * F.col("k") * (F.col("t_own") - F.col("k")) / (2 * m)
            move = pick.filter(F.col("b.g") > F.coalesce("g_own", alone) + 1e-12).filter(F.pmod(F.xxhash64("a"), F.lit(2)) == step % 2).select(F.col("a").alias("idx"), (-F.col("b.n")).alias("__new"))
            new = scratch.table(part.join(move, "idx", "left").select("idx", F.coalesce("__new", "label").alias("label")), "part")
            q = modularity(now, new)
            if q <= top + 1e-9:
                still += 1
                if still == 2:
                    break
                continue
            part, top, raised, still = new, q, True, 0
        if not raised or top <= best + 1e-9:
            break
        best = top
        part = scratch.table(renumber_partition(part), "part")
        whole = scratch.table(whole.withColumnRenamed("label", "__at").join(part.select(F.col("idx").alias("__at"), F.col("label")), "__at").select("idx", "label"), "whole")
        now = contract(now, part, "sum")[0].graph.with_(weighted=True)
    return renumber_partition(whole)


#: Arcs at most that work by source holds in each task, once those on no shortest path are left out.
ARCS = 1 << 25
#: Arcs a node of the sample that the bounds on distances come from.
SAMPLED = 16
#: Candidates for distances that a task works out at once (they stay in its cache), and distances that it holds.
CELLS, HELD = 1 << 16, 1 << 22


def _lightest(arcs: DataFrame, n: int, m: int) -> DataFrame | None:
    """(idx, to, away), bounds on the distances to and from a node of many light arcs, over the lightest arcs of the graph;
    nodes that these don't link to it are missing."""
    import numpy as np
    import pandas as pd

    light = arcs if m <= SAMPLED * n else arcs.filter(F.col("w") <= arcs.approxQuantile("w", [SAMPLED * n / m], 0.001)[0])
    rows = light.select("src", "dst", "w").limit(4 * SAMPLED * n).toPandas()  # any arcs give bounds
    if rows.empty:
        return None
    src, dst, w = (rows[c].to_numpy() for c in ("src", "dst", "w"))
    c = np.bincount(src).argmax()[None]
    away, to = _distances((n, src, dst, w, None), c)[:, 0], _distances((n, dst, src, w, None), c)[:, 0]
    hit = np.flatnonzero(np.isfinite(to) & np.isfinite(away))
    return arcs.sparkSession.createDataFrame(pd.DataFrame({"idx": hit, "to": to[hit], "away": away[hit]}))


def _kept(g: Graph, limit: int | None):
    """(n, src, dst, w, e) for work by source: the arcs that can lie on a shortest path, by dst.

    An arc u -> v does not if a parallel one is lighter, or if the way by a node c is: w > d(u, c) + d(c, v).
    """
    import numpy as np

    n = g.node_count()
    if limit is not None and n > limit:
        raise GraphError("E_TOO_LARGE", f"{n} nodes; all-pairs work is bounded to {limit}")
    if g.edges.filter(weight() < 0).limit(1).count():
        raise GraphError("E_UNSUPPORTED", "negative weights need bellman_ford")
    scratch = Scratch(g.spark)
    every = views.halves(g).filter("src <> dst").select("src", "dst", "e", weight().alias("w"))
    least = every.groupBy("src", "dst").agg(F.min("w").alias("least"))
    arcs = scratch.table(every.join(least, ["src", "dst"]).filter(F.col("w") <= F.col("least") + 1e-12).select("src", "dst", "e", "w"), "arcs")
    bounds = _lightest(arcs, n, arcs.count())
    if bounds is not None:
        of = lambda end, x: bounds.select(F.col("idx").alias(end), x)
        both = arcs.join(of("src", "to"), "src", "left").join(of("dst", "away"), "dst", "left")
        arcs = scratch.table(both.filter(F.coalesce(F.col("w") <= F.col("to") + F.col("away") + 1e-9, F.lit(True))).select("src", "dst", "e", "w"), "kept")
    m = arcs.count()
    if m > ARCS:
        raise GraphError("E_TOO_LARGE", f"{m} arcs can lie on shortest paths; work by source holds {ARCS}")
    rows = arcs.toPandas().sort_values(["dst", "src", "e"])
    scratch.keep_only()
    return n, rows["src"].to_numpy().astype(np.int32), rows["dst"].to_numpy().astype(np.int32), rows["w"].to_numpy(), rows["e"].to_numpy()


def _distances(graph, sources):
    """Least distances (n, sources), by rounds over the arcs from nodes that the round before brought nearer."""
    import numpy as np

    n, src, dst, w, _ = graph
    if len(dst) and (np.diff(dst) < 0).any():
        by = np.argsort(dst, kind="stable")
        src, dst, w = src[by], dst[by], w[by]
    out = np.full((n, len(sources)), INF)
    out[sources, np.arange(len(sources))] = 0.0
    near, size = np.zeros(n, bool), max(1, CELLS // len(sources))
    near[sources] = True
    while near.any():
        at, near = np.flatnonzero(near[src]), np.zeros(n, bool)
        for a in range(0, len(at), size):  # an end's arcs can be in two slices
            k = at[a : a + size]
            heads = dst[k]
            first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            found = np.minimum.reduceat(out[src[k]] + w[k, None], first, axis=0)
            heads = heads[first]
            held = out[heads]
            nearer = (found < held).any(axis=1)
            if nearer.any():
                out[heads[nearer]] = np.minimum(found[nearer], held[nearer])
                near[heads[nearer]] = True
    return out


def _blocks(graph, sources):
    """(source, its distances) of each source, worked out by blocks of sources."""
    import numpy as np
    from itertools import islice

    size = max(1, min(64, HELD // max(graph[0], 1)))
    while block := list(islice(sources, size)):
        found = np.ascontiguousarray(_distances(graph, np.array(block)).T)
        yield from zip(block, found, strict=True)


def _by_source(g: Graph, sources: DataFrame, work, schema: str, limit: int | None) -> DataFrame:
    """The rows of work(graph, sources), an iterator of tuples of columns, over a broadcast graph of bounded size; sources
    is an iterator of those of a task."""
    from .._ship import ship
    from .._tables import partitions

    ship(g.spark)
    shared = g.spark.sparkContext.broadcast(_kept(g, limit))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for columns in work(shared.value, (int(s) for batch in batches for s in batch["idx"])):
            yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    return sources.select("idx").distinct().repartition(partitions(g.spark), "idx").mapInPandas(run, schema)


def all_pairs_shortest_paths(g: Graph, limit: int | None = None) -> DataFrame:
    """(src, dst, distance) of all pairs that are connected; more nodes than a limit are E_TOO_LARGE."""

    def work(graph, sources):
        import numpy as np

        for s, dist in _blocks(graph, sources):
            hit = np.flatnonzero(np.isfinite(dist))
            yield np.full(len(hit), s), hit, dist[hit]

    return _by_source(g, g.nodes, work, "src long, dst long, distance double", limit)


def closeness_centrality(g: Graph, limit: int | None = None) -> DataFrame:
    """(idx, closeness, harmonic) from the distances of each node to those it reaches, scaled by the share it reaches."""

    def work(graph, sources):
        import numpy as np

        n = graph[0]
        for s, dist in _blocks(graph, sources):
            d = np.delete(dist, s)
            d = d[np.isfinite(d)]
            total = d.sum()
            yield [s], [len(d) / total * len(d) / (n - 1) if total > 0 and n > 1 else 0.0], [float((1 / d[d > 0]).sum())]

    return _by_source(g, g.nodes, work, "idx long, closeness double, harmonic double", limit)


def betweenness_centrality(g: Graph, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(idx, betweenness) by Brandes's accumulation from all nodes, or from the given sources (idx)."""

    def work(graph, sources):
        import numpy as np

        total = np.zeros(graph[0])  # of a task's sources
        for s, dist in _blocks(graph, sources):
            delta = _dependencies(graph, s, dist)[0]
            delta[s] = 0.0
            total += delta
        hit = np.flatnonzero(total)
        yield hit, total[hit]

    by = _by_source(g, g.nodes if sources is None else sources, work, "idx long, d double", limit).groupBy("idx").agg(F.sum("d").alias("d"))
    half = 1.0 if g.directed else 0.5
    return g.nodes.select("idx").join(by, "idx", "left").select("idx", (F.coalesce("d", F.lit(0.0)) * half).alias("betweenness"))


def edge_betweenness(g: Graph, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(e, betweenness)"""

    def work(graph, sources):
        import numpy as np

        total = np.zeros(len(graph[1]))
        for s, dist in _blocks(graph, sources):
            at, by = _dependencies(graph, s, dist)[1]
            total[at] += by
        hit = np.flatnonzero(total)
        yield graph[4][hit], total[hit]

    by = _by_source(g, g.nodes if sources is None else sources, work, "e long, d double", limit).groupBy("e").agg(F.sum("d").alias("d"))
    half = 1.0 if g.directed else 0.5
    return g.edges.select("e").join(by, "e", "left").select("e", (F.coalesce("d", F.lit(0.0)) * half).alias("betweenness"))


def _dependencies(graph, s, dist):
    """From s: that of each node; and the arcs on shortest paths, with that of each. Nodes are settled by distance, those
    at an equal one as they are met, the least first."""
    import heapq

    import numpy as np

    n, src, dst, w, _ = graph
    on = np.flatnonzero(np.abs(dist[src] + w - dist[dst]) <= 1e-12)
    on = on[np.argsort(src[on], kind="stable")]
    ptr = np.searchsorted(src[on], np.arange(n + 1)).tolist()
    tail, head, at = src[on].tolist(), dst[on].tolist(), dist.tolist()
    sigma, met, done = [0.0] * n, bytearray(n), bytearray(n)
    sigma[s], met[s] = 1.0, 1
    heap, used = [(0.0, s)], []
    while heap:
        u = heapq.heappop(heap)[1]
        done[u] = 1
        for k in range(ptr[u], ptr[u + 1]):
            v = head[k]
            if done[v]:
                continue
            used.append(k)
            sigma[v] += sigma[u]
            if not met[v]:
                met[v] = 1
                heapq.heappush(heap, (at[v], v))
    delta, by = [0.0] * n, []
    for k in reversed(used):
        u, v = tail[k], head[k]
        c = sigma[u] / sigma[v] * (1 + delta[v])
        by.append(c)
        delta[u] += c
    return np.array(delta), (on[np.array(used[::-1], dtype=np.int64)], np.array(by))


def segmented_reduce(g: Graph, value: str, how: str = "sum") -> DataFrame:
    """(idx, value): sum, min or max over each node's arcs of a SQL expression in row, arc, nbr and weight; a node
    without arcs has the identity (0, the largest or the least FLOAT)."""
    identity = {"sum": 0.0, "min": 3.4028234663852886e38, "max": -3.4028234663852886e38}
    if how not in identity:
        raise GraphError("E_UNSUPPORTED", how)
    a = views.arcs(g).select(F.col("src").alias("row"), "arc", F.col("dst").alias("nbr"), weight().alias("weight"))
    by = a.select(F.col("row").alias("idx"), F.expr(value).cast("double").alias("x")).groupBy("idx").agg({"sum": F.sum, "min": F.min, "max": F.max}[how]("x").alias("value"))
    return g.nodes.select("idx").join(by, "idx", "left").select("idx", F.coalesce("value", F.lit(identity[how])).alias("value"))


def reduce_vector(values: DataFrame, how: str = "sum") -> DataFrame:
    """One row: the sum, min or max of a column `value`, elementwise for arrays of one length."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    if values.schema["value"].dataType.typeName() != "array":
        return values.agg(f("value").alias("value"))
    by = values.select(F.posexplode("value").alias("i", "x")).groupBy("i").agg(f("x").alias("x"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("value"))  # a row a component


def scan(values: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """values with the sum of `value` over the rows up to each in the order of a LONG key that is 0 .. n - 1."""
    return running_sum(values, key, value, name)


def histogram(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(column).agg(F.count("*").alias("n"))
