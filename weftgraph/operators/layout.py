"""Force-directed layouts: ForceAtlas2, Fruchterman-Reingold, and a spring-electrical model.

An iteration is a join of arcs to positions (attraction), repulsion of every node by all others, and one aggregate
whose few numbers drive the speed on the driver. Up to EXACT nodes, repulsion is exact: positions of that bounded size
are broadcast and each task works out its own nodes in blocks. Beyond, it is by grid: nodes of the same and the
adjoining cells are met through a join on the cell, all further cells as single bodies from a table of at most
CELLS * CELLS rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from .._tables import Scratch, partitions
from ..errors import GraphError
from ..graph import Graph, by_role, weight
from . import views

EXACT, CELLS = 32_768, 64
STATE = "idx long, x double, y double, z double, mass double, fixed boolean, px double, py double, pz double"


@dataclass(frozen=True)
class Options:
    iterations: int = 100
    scaling: float = 2.0
    gravity: float = 1.0
    strong_gravity: bool = False
    linlog: bool = False
    distributed: bool = False
    jitter_tolerance: float = 1.0
    mode: str = "paper"  # or "networkx": swing and traction add up, gravity pulls to the origin
    weights: str = "arcs"  # an edge column's name, or "none"
    dim: int = 2
    settle: float = 0.0  # mean displacement under which an iteration counts as still
    settle_count: int = 3

    def __post_init__(self):
        if self.dim not in (2, 3) or self.mode not in ("paper", "networkx") or self.iterations < 0 or self.scaling <= 0 or self.jitter_tolerance <= 0 or self.gravity < 0:
            raise GraphError("E_INVALID_ARGUMENT", str(self))


def seed_numbers(k: np.ndarray) -> np.ndarray:
    """The k-th numbers (from 0) of the generator s -> (185852 s + 1) mod (2^35 - 31), s_0 = 1, as shares of its modulus.

    The k-th state is found by itself, from powers of the multiplier, so tasks draw independently.
    """
    m, a = 2**35 - 31, 185_852
    inverse = pow(a - 1, -1, m)
    out = np.empty(len(k))
    for i, n in enumerate(k):
        p = pow(a, int(n) + 1, m)
        out[i] = (p + (p - 1) * inverse) % m / m
    return out


def seed_positions(nodes: DataFrame, dim: int = 2, box: tuple = (-1.0, -1.0, -1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """nodes (idx, x, y, z) with missing or NaN coordinates drawn in the box of the finite ones (or the given one), the
    k-th node by idx taking numbers dim * k onward; z of a plane is the box's centre."""
    ship(nodes.sparkSession)
    ok = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c))
    clean = nodes.select("idx", *[ok(c).alias(c) for c in "xyz"])
    found = clean.agg(*[f(c) for f in (F.min, F.max) for c in "xyz"]).first()
    low = [found[i] if found[i] is not None else box[i] for i in range(3)]
    high = [found[3 + i] if found[3 + i] is not None else box[3 + i] for i in range(3)]

    def run(batches):
        for b in batches:
            for i, c in enumerate("xyz"):
                if i == 2 and dim == 2:
                    b[c] = b[c].fillna((low[2] + high[2]) / 2)
                else:
                    draw = low[i] + (high[i] - low[i]) * seed_numbers(dim * b["idx"].to_numpy() + i)
                    b[c] = b[c].where(b[c].notna(), draw)
            yield b

    return clean.mapInPandas(run, "idx long, x double, y double, z double")


def node_mass(g: Graph) -> DataFrame:
    """(idx, mass): the column of role `mass`, else out-degree + 1. Not finite or not positive: E_INVALID_ARGUMENT."""
    name = by_role(g.nodes, "mass")
    if name is None:
        return views.out_degree(g).select("idx", (F.col("out_degree") + 1).cast("double").alias("mass"))
    bad = g.nodes.filter(F.col(name).isNotNull() & ~((F.col(name) > 0) & (F.col(name) < float("inf")))).limit(1).count()
    if bad:
        raise GraphError("E_INVALID_ARGUMENT", "a mass is not finite and positive")
    by = views.out_degree(g).join(g.nodes.select("idx", F.col(name).alias("__m")), "idx")
    return by.select("idx", F.coalesce(F.col("__m").cast("double"), (F.col("out_degree") + 1).cast("double")).alias("mass"))


def _attraction(arcs: DataFrame, state: DataFrame, linlog: bool, distributed: bool) -> DataFrame:
    """(idx, ax, ay, az)"""
    at = lambda p: state.select(F.col("idx").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in "xyz"], F.col("mass").alias(f"mass_{p}"))
    j = arcs.join(at("src"), "src").join(at("dst"), "dst")
    d = [F.col(f"{c}_dst") - F.col(f"{c}_src") for c in "xyz"]
    r = F.greatest(F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0])), F.lit(0.01))
    f = F.col("w") * (F.log(1 + r) / r if linlog else F.lit(1.0)) / (F.col("mass_src") if distributed else F.lit(1.0))
    return j.groupBy(F.col("src").alias("idx")).agg(*[F.sum(f * x).alias(f"a{c}") for c, x in zip("xyz", d, strict=True)])


#: Bodies that are met at once, by bodies: what a task holds doesn't grow with their number, and stays in its cache.
TILE = 64, 1024


def _pairwise(p: np.ndarray, m: np.ndarray, q: np.ndarray, mq: np.ndarray, k: float, same: np.ndarray | None) -> np.ndarray:
    """Repulsion of bodies p by bodies q; same[i] is the column that is p's own, -1 for none."""
    out = np.zeros_like(p)
    flat = not len(q) or not len(p) or (np.ptp(np.r_[p[:, 2], q[:, 2]]) == 0)
    for a in range(0, len(p), TILE[0]):
        own = None if same is None else same[a : a + TILE[0]]
        for b in range(0, len(q), TILE[1]):
            d = [p[a : a + TILE[0], c, None] - q[None, b : b + TILE[1], c] for c in range(2 if flat else 3)]
            d2 = d[0] * d[0]
            for x in d[1:]:
                d2 += x * x
            close = d2 < 1e-8
            if close.any():  # coincident bodies are pushed apart along opposite directions
                i, j = np.nonzero(close)
                at, to = i + a, j + b
                sign = np.where(at < to, 1.0, -1.0)
                angle = ((at + 1) * (to + 1)).astype(float)
                d[0][i, j], d[1][i, j] = sign * np.cos(angle) * 1e-2, sign * np.sin(angle) * 1e-2
                d2[i, j] = np.maximum(sum(x[i, j] * x[i, j] for x in d), 1e-8)
            f = np.divide(mq[None, b : b + TILE[1]], d2, out=d2)
            if own is not None:
                i = np.flatnonzero((own >= b) & (own < b + TILE[1]))
                f[i, own[i] - b] = 0.0
            for c, x in enumerate(d):
                out[a : a + TILE[0], c] += np.einsum("ij,ij->i", f, x)
    return out * (k * m)[:, None]


def _exact(state: DataFrame, k: float, n: int) -> DataFrame:
    """(idx, rx, ry, rz) from all pairs; n is at most EXACT."""
    every = state.select("idx", "x", "y", "z", "mass").orderBy("idx").toPandas()  # at most EXACT rows
    shared = state.sparkSession.sparkContext.broadcast((every[["x", "y", "z"]].to_numpy(), every["mass"].to_numpy()))

    def run(batches):
        q, mq = shared.value
        for b in batches:
            i = b["idx"].to_numpy()
            r = _pairwise(q[i], mq[i], q, mq, k, i)
            yield pd.DataFrame({"idx": i, "rx": r[:, 0], "ry": r[:, 1], "rz": r[:, 2]})

    return state.select("idx").repartition(min(partitions(state.sparkSession), n // 256 + 1), "idx").mapInPandas(run, "idx long, rx double, ry double, rz double")


def _grid(state: DataFrame, k: float) -> DataFrame:
    """(idx, rx, ry, rz): near cells node by node, far cells as bodies."""
    lx, hx, ly, hy = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    size = max((hx - lx) / CELLS, (hy - ly) / CELLS, 1e-9)
    cell = state.withColumn("cx", F.least(F.lit(CELLS - 1), F.floor((F.col("x") - lx) / size))).withColumn("cy", F.least(F.lit(CELLS - 1), F.floor((F.col("y") - ly) / size)))
    bodies = cell.groupBy("cx", "cy").agg(F.sum("mass").alias("m"), *[(F.sum(F.col(c) * F.col("mass")) / F.sum("mass")).alias(f"b{c}") for c in "xyz"]).toPandas()  # CELLS * CELLS rows at most
    shared = state.sparkSession.sparkContext.broadcast((bodies[["bx", "by", "bz"]].to_numpy(), bodies["m"].to_numpy(), bodies[["cx", "cy"]].to_numpy()))

    def far(batches):
        q, m, at = shared.value
        for b in batches:
            p, own = b[["x", "y", "z"]].to_numpy(), b[["cx", "cy"]].to_numpy()
            out = np.zeros_like(p)
            for a in range(0, len(p), 512):
                d = p[a : a + 512, None, :] - q[None]
                away = (np.abs(own[a : a + 512, None, :] - at[None]) > 1).any(axis=2)
                f = np.where(away, k * b["mass"].to_numpy()[a : a + 512, None] * m[None] / np.maximum((d * d).sum(axis=2), 1e-8), 0.0)
                out[a : a + 512] = (f[..., None] * d).sum(axis=1)
            yield pd.DataFrame({"idx": b["idx"], "rx": out[:, 0], "ry": out[:, 1], "rz": out[:, 2]})

    distant = cell.select("idx", "x", "y", "z", "mass", "cx", "cy").mapInPandas(far, "idx long, rx double, ry double, rz double")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    halo = cell.select(F.col("idx").alias("n"), *[F.col(c).alias(f"n{c}") for c in "xyz"], F.col("mass").alias("nm"), "cx", "cy", around).select("n", "nx", "ny", "nz", "nm", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    d = [F.col(c) - F.col(f"n{c}") for c in "xyz"]
    d2 = F.greatest(sum((v * v for v in d[1:]), d[0] * d[0]), F.lit(1e-8))
    near = cell.join(halo, ["cx", "cy"]).filter("n <> idx").groupBy("idx").agg(*[F.sum(F.lit(k) * F.col("mass") * F.col("nm") / d2 * v).alias(f"r{c}") for c, v in zip("xyz", d, strict=True)])
    return distant.unionByName(near).groupBy("idx").agg(*[F.sum(f"r{c}").alias(f"r{c}") for c in "xyz"])


def estimate_speed(n: int, swing: float, traction: float, speed: float, efficiency: float, tolerance: float) -> tuple[float, float]:
    """The next speed and its efficiency (Jacomy et al., 2014)."""
    optimal = 0.05 * n**0.5
    jitter = tolerance * max(optimal**0.5, min(10.0, optimal * traction / n**2))
    if swing > 2 * traction:
        if efficiency > 0.05:
            efficiency *= 0.5
        jitter = max(jitter, tolerance)
    target = float("inf") if swing == 0 else jitter * efficiency * traction / swing
    if swing > jitter * traction:
        if efficiency > 0.05:
            efficiency *= 0.7
    elif speed < 1000:
        efficiency *= 1.3
    return speed + min(target - speed, 0.5 * speed), efficiency


class ForceAtlas2:
    """A simulation that holds its state as a table (idx, x, y, z, ...); step it, move or fix nodes, run to rest."""

    def __init__(self, **options):
        self.options = Options(**options)
        self.state: DataFrame | None = None
        self.disposed = False

    def load(self, g: Graph, positions: DataFrame | None = None) -> ForceAtlas2:
        """Start from positions (idx, x, y[, z]), drawn where missing. A directed graph is E_SNAPSHOT."""
        if g.directed:
            raise GraphError("E_SNAPSHOT", "layouts take undirected graphs")
        self.g, self.scratch = g, Scratch(g.spark)
        self.n = g.node_count()
        base = g.nodes.select("idx")
        given = base.select("idx", *[F.lit(None).cast("double").alias(c) for c in "xyz"]) if positions is None else base.join(positions.select("idx", "x", "y", F.col("z") if "z" in positions.columns else F.lit(None).cast("double").alias("z")), "idx", "left")
        flags = by_role(g.nodes, "fixed")
        fixed = g.nodes.select("idx", (F.coalesce(F.col(flags), F.lit(False)) if flags else F.lit(False)).alias("fixed"))
        rows = seed_positions(given, self.options.dim, (-1.0, -1.0, 0.0 if self.options.dim == 2 else -1.0, 1.0, 1.0, 0.0 if self.options.dim == 2 else 1.0)).join(node_mass(g), "idx").join(fixed, "idx")
        self.state = self.scratch.table(rows.select("*", *[F.lit(0.0).alias(f"p{c}") for c in "xyz"]), "state")
        w = F.lit(1.0) if self.options.weights == "none" else weight() if self.options.weights == "arcs" else F.coalesce(F.col(self.options.weights).cast("double"), F.lit(1.0))
        one = g.edges.filter("src <> dst").select("src", "dst", w.alias("w"))
        self.arcs = self.scratch.table(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "arcs")
        self._start()
        return self

    def _start(self) -> None:
        self.speed = self.efficiency = 1.0
        networkx = self.options.mode == "networkx"
        self.swing = self.traction = 1.0 if networkx else 0.0
        self.iteration = self.still = 0
        self.settled = self.n == 0

    def _forces(self) -> DataFrame:
        o, s = self.options, self.state
        rep = _exact(s, o.scaling, self.n) if self.n <= EXACT else _grid(s, o.scaling)
        out = s.join(_attraction(self.arcs, s, o.linlog, o.distributed), "idx", "left").join(rep, "idx", "left")
        centre = [0.0, 0.0, 0.0] if o.mode == "networkx" else list(s.agg(*[F.avg(c) for c in "xyz"]).first())
        d = [F.col(c) - F.lit(m) for c, m in zip("xyz", centre, strict=True)]
        r = F.sqrt(sum((v * v for v in d[1:]), d[0] * d[0]))
        pull = F.lit(o.gravity) * F.col("mass") * (F.lit(1.0) if o.strong_gravity else F.when(r > 0, 1 / r).otherwise(0.0))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        flat = {"z": 0.0 if o.dim == 2 else 1.0}
        return out.select(*s.columns, *[((zero(f"a{c}") + zero(f"r{c}") - pull * v) * flat.get(c, 1.0)).alias(f"f{c}") for c, v in zip("xyz", d, strict=True)])

    def step(self, count: int = 1) -> DataFrame:
        """Iterate and return (idx, x, y, z)."""
        self._loaded()
        o = self.options
        for _ in range(count):
            if self.settled:
                break
            moved = self.scratch.table(self._forces(), "forces")
            length = lambda cs: F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0]))
            f = [F.col(f"f{c}") for c in "xyz"]
            before = [F.col(c if o.mode == "networkx" else f"p{c}") for c in "xyz"]
            swing, traction = moved.agg(F.sum(F.col("mass") * length([a - b for a, b in zip(before, f, strict=True)])), F.sum(0.5 * F.col("mass") * length([a + b for a, b in zip(before, f, strict=True)]))).first()
            keep = o.mode == "networkx"
            self.swing, self.traction = (self.swing if keep else 0.0) + swing, (self.traction if keep else 0.0) + traction
            self.speed, self.efficiency = estimate_speed(self.n, self.swing, self.traction, self.speed, self.efficiency, o.jitter_tolerance)
            own = F.col("mass") * length(f if o.mode == "networkx" else [a - b for a, b in zip(f, before, strict=True)])
            k = F.when(F.col("fixed"), 0.0).otherwise(F.lit(self.speed) / (1 + F.sqrt(F.lit(self.speed) * own)))
            new = moved.select("idx", *[(F.col(c) + F.col(f"f{c}") * k).alias(c) for c in "xyz"], "mass", "fixed", *[F.col(f"f{c}").alias(f"p{c}") for c in "xyz"], (length(f) * k).alias("__d"))
            then = self.scratch.table(new, "state")
            displacement = then.agg(F.avg("__d")).first()[0] or 0.0
            self.scratch.drop(moved)
            self.state = then.drop("__d")
            self.iteration += 1
            self.still = self.still + 1 if displacement <= o.settle else 0
            self.settled = self.iteration >= o.iterations or (o.settle > 0 and self.still >= o.settle_count)
        return self.positions()

    def run(self) -> DataFrame:
        while not self.settled:
            self.step()
        return self.positions()

    def positions(self) -> DataFrame:
        self._loaded()
        return self.state.select("idx", "x", "y", "z")

    def to_scene(self, scale: float = 1.0, centre: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
        return self.positions().select("idx", *[(F.col(c) * scale + m).alias(c) for c, m in zip("xyz", centre, strict=True)])

    def stats(self) -> DataFrame:
        """One row: centroid, box, and the root mean square and largest distance from the centroid."""
        s = self.positions()
        m = s.agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"]).first()
        r2 = sum(((F.col(c) - F.lit(m[f"mean_{c}"])) * (F.col(c) - F.lit(m[f"mean_{c}"])) for c in "yz"), (F.col("x") - F.lit(m["mean_x"])) * (F.col("x") - F.lit(m["mean_x"])))
        return s.agg(*[F.lit(m[f"mean_{c}"]).alias(f"mean_{c}") for c in "xyz"], *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"], F.sqrt(F.avg(r2)).alias("rms_radius"), F.sqrt(F.max(r2)).alias("max_radius"))

    def _change(self, rows: DataFrame, **columns) -> None:
        self._loaded()
        hit = rows.select("idx", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
        self.state = self.scratch.table(self.state.join(hit, "idx", "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in self.state.columns]), "state")

    def set_fixed(self, rows: DataFrame) -> None:
        """(idx, fixed)"""
        self._change(rows, fixed=True)

    def set_position(self, rows: DataFrame) -> None:
        """(idx, x, y, z)"""
        self._change(rows, x=True, y=True, z=True)

    def set_params(self, **options) -> None:
        self.options = replace(self.options, **options)

    def reheat(self) -> None:
        """Speed and counters as at the start; positions stay."""
        self._loaded()
        self._start()

    def dispose(self) -> None:
        self.state, self.disposed = None, True

    def _loaded(self) -> None:
        if self.disposed:
            raise GraphError("E_DISPOSED", "the simulation is disposed")
        if self.state is None:
            raise GraphError("E_NOT_LOADED", "load a graph first")


def force_directed(g: Graph, iterations: int = 50, k: float | None = None, positions: DataFrame | None = None, power: int = 2) -> DataFrame:
    """(idx, x, y, z) by Fruchterman-Reingold: attraction d^power / k (2), or springs d - k beside charges (1); the
    step is bounded by a temperature that falls to 0."""
    sim = ForceAtlas2(iterations=iterations).load(g, positions)
    n = max(sim.n, 1)
    k = k or (1.0 / n) ** 0.5
    state = sim.state
    for i in range(iterations):
        sim.state = state.withColumn("mass", F.lit(1.0))
        rep = (_exact(sim.state, k * k, sim.n) if sim.n <= EXACT else _grid(sim.state, k * k)) if sim.n else None
        if rep is None:
            break
        at = lambda p: state.select(F.col("idx").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in "xyz"])  # noqa: B023, E731
        j = sim.arcs.join(at("src"), "src").join(at("dst"), "dst")
        d = [F.col(f"{c}_dst") - F.col(f"{c}_src") for c in "xyz"]
        r = F.greatest(F.sqrt(sum((v * v for v in d[1:]), d[0] * d[0])), F.lit(0.01))
        f = F.col("w") * (r / k if power == 2 else (r - k) / r)
        att = j.groupBy(F.col("src").alias("idx")).agg(*[F.sum(f * v).alias(f"a{c}") for c, v in zip("xyz", d, strict=True)])
        both = state.join(att, "idx", "left").join(rep, "idx", "left").na.fill(0.0)
        t = 0.1 * (1 - i / iterations)
        move = [F.col(f"a{c}") + F.col(f"r{c}") for c in "xyz"]
        length = F.greatest(F.sqrt(sum((v * v for v in move[1:]), move[0] * move[0])), F.lit(0.01))
        s = F.when(F.col("fixed"), 0.0).otherwise(F.least(length, F.lit(t)) / length)
        state = sim.scratch.table(both.select("idx", *[(F.col(c) + v * s).alias(c) for c, v in zip("xyz", move, strict=True)], "mass", "fixed", "px", "py", "pz"), "state")
    return state.select("idx", "x", "y", "z")


def fruchterman_reingold(g: Graph, **options) -> DataFrame:
    return force_directed(g, power=2, **options)


def spring_electrical(g: Graph, **options) -> DataFrame:
    return force_directed(g, power=1, **options)
