"""A mutable graph as an ordered log of operations, folded to its latest state.

Bulk operations append DataFrames; nothing is executed before a read. State is five tables: nodes (id, at, alive),
edges (e, src id, dst id, w, alive) and cell writes (kind, key, column, value, at). Every write has an order number, and
reads take the latest by `max_by`, so the fold is a grouped aggregate however long the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._tables import Scratch, numbered
from ..errors import GraphError
from ..functions import text
from ..graph import Graph
from ..operators.freeze import Report, freeze

CAST = {"f32": "float", "f64": "double", "i32": "int", "u32": "long", "u8": "short", "bool": "boolean", "dict": "string", "string": "string", "json": "string"}
#: Widening goes to the right only.
WIDENING = ("bool", "i32", "f64", "string", "json")


class GraphBuilder:
    """Ids of one type (LONG or STRING). Node order is that of first addition, edge order that of addition."""

    def __init__(self, spark: SparkSession, id_type: str = "long", directed: bool = True, weighted: bool = False):
        self.spark, self.id_type, self.directed, self.weighted = spark, id_type, directed, weighted
        self.at = 0  # operations so far
        self.edge_bound = 0
        self.locked = self.disposed = False
        self.node_log: list[DataFrame] = []
        self.edge_log: list[DataFrame] = []
        self.weights: list[DataFrame] = []
        self.cells: dict[str, list[DataFrame]] = {"node": [], "edge": []}
        self.columns: dict[str, dict[str, str]] = {"node": {}, "edge": {}}
        self.graph_values: dict = {}
        self.meta: dict = {}
        self.extensions: dict[str, DataFrame] = {}
        self._anonymous = 0

    @classmethod
    def from_graph(cls, g: Graph) -> GraphBuilder:
        """A builder that starts with a graph's nodes and edges, and its attributes as written cells."""
        b = cls(g.spark, g.nodes.schema["id"].dataType.simpleString(), g.directed, g.weighted)
        b.add_nodes(g.nodes.select("id", "idx"), order=["idx"])
        ids = g.nodes.select("idx", "id")
        named = g.edges.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "dst")
        b.add_edges(named.select("source", "target", "w", "e"), order=["e"], weight="w" if g.weighted else None)
        for kind, df, key in (("node", g.nodes, "id"), ("edge", g.edges, "e")):
            for c in g.node_attributes() if kind == "node" else g.edge_attributes():
                b.declare_column(kind, c, {"float": "f32", "double": "f64", "int": "i32", "bigint": "u32", "boolean": "bool"}.get(df.schema[c].dataType.simpleString(), "string"))
                b.set_column(kind, df.select(F.col(key).alias("key"), F.col(c).alias("value")), c)
        b.meta, b.extensions, b.graph_values = dict(g.meta), dict(g.extensions), dict(g.attrs)
        return b

    # writes

    def _next(self) -> int:
        if self.disposed:
            raise GraphError("E_BUILDER_DISPOSED", "the builder is disposed")
        self.at += 1
        return self.at

    def _ids(self, ids: list) -> DataFrame:
        return self.spark.createDataFrame([(v, i) for i, v in enumerate(ids)], T.StructType([T.StructField("id", T._parse_datatype_string(self.id_type)), T.StructField("__i", T.LongType())]))

    def add_node(self, id_) -> None:
        if id_ is None or (isinstance(id_, float) and id_ != id_):
            raise GraphError("E_INVALID_ID", str(id_))
        self.add_nodes(self._ids([id_]), order=["__i"])

    def add_nodes(self, nodes: DataFrame, order: list[str]) -> None:
        """Nodes of (id, ...); known ids stay, removed ones live again at their old place."""
        k = self._next()
        placed = numbered(nodes.select(F.col("id").cast(self.id_type).alias("id"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]), [f"__o{i}" for i in range(len(order))], "key", Scratch(self.spark))
        self.node_log.append(self._log(placed.select("id", "key"), k))

    @staticmethod
    def _log(rows: DataFrame, k: int, alive: bool = True) -> DataFrame:
        return rows.select("id", F.lit(k).alias("op"), F.lit(alive).alias("alive"), F.col("key").cast("long").alias("key"))

    def add_anonymous_nodes(self, count: int) -> None:
        """Nodes whose LONG ids follow the largest so far."""
        if self.id_type not in ("long", "bigint"):
            raise GraphError("E_UNSUPPORTED", "anonymous nodes have LONG ids")
        top = self._nodes().agg(F.max("id")).first()[0]
        base = -1 if top is None else top
        self.add_nodes(self.spark.range(count).select((F.col("id") + base + 1).alias("id"), F.col("id").alias("__i")), order=["__i"])

    def add_edge(self, source, target, weight: float | None = None) -> int:
        if weight is not None and weight != weight:
            raise GraphError("E_INVALID_WEIGHT", "NaN")
        rows = self.spark.createDataFrame([(source, target, weight, 0)], f"source {self.id_type}, target {self.id_type}, w double, __i long")
        self.add_edges(rows, order=["__i"], weight="w" if weight is not None else None)
        return self.edge_bound - 1

    def add_edges(self, edges: DataFrame, order: list[str], weight: str | None = None, create: bool = True) -> None:
        """Edges of (source, target, ...); unknown ends become nodes, or are E_UNKNOWN_NODE if not create."""
        k = self._next()
        rows = numbered(edges.select(F.col("source").cast(self.id_type).alias("source"), F.col("target").cast(self.id_type).alias("target"), (F.col(weight).cast("float") if weight else F.lit(None).cast("float")).alias("w"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]), [f"__o{i}" for i in range(len(order))], "e", Scratch(self.spark), start=self.edge_bound)
        both = rows.select(F.explode(F.array(F.struct(F.col("source").alias("id"), (2 * F.col("e")).alias("n")), F.struct(F.col("target").alias("id"), (2 * F.col("e") + 1).alias("n")))).alias("x")).select("x.id", "x.n")
        if create:
            self.node_log.append(self._log(both.select("id", F.col("n").alias("key")), k))
        elif both.join(self._nodes(), "id", "left_anti").limit(1).count():
            raise GraphError("E_UNKNOWN_NODE", "an end is not a node")
        self.weighted = self.weighted or weight is not None
        self.edge_log.append(rows.select("e", "source", "target", "w", F.lit(k).alias("op"), F.lit(True).alias("alive")))
        self.edge_bound += rows.count()

    def _record(self, kind: str, key, cells: dict) -> None:
        """Values of a row by name; a column that isn't declared yet is, with the type of its first value."""
        for name, value in cells.items():
            if value is None:
                continue
            if name not in self.columns[kind]:
                self.declare_column(kind, name, text.infer_value(value))
            self.set_value(kind, key, name, value)

    def add_node_record(self, record: dict, id_key: str = "id") -> None:
        """A node of a record: its id and, by name, its values."""
        if record.get(id_key) is None:
            raise GraphError("E_INVALID_ID", f"no {id_key}")
        self.add_node(record[id_key])
        self._record("node", record[id_key], {k: v for k, v in record.items() if k != id_key})

    def add_edge_record(self, record: dict, source: str = "source", target: str = "target", weight: str = "weight") -> int:
        """An edge of a record: its ends, its weight if it has one and, by name, its values. The edge's number."""
        if record.get(source) is None or record.get(target) is None:
            raise GraphError("E_INVALID_ID", f"no {source} or {target}")
        e = self.add_edge(record[source], record[target], record.get(weight))
        self._record("edge", e, {k: v for k, v in record.items() if k not in (source, target, weight)})
        return e

    def edge_endpoints(self, e: int) -> tuple:
        """(source, target) of a live edge; another is E_INDEX_RANGE."""
        found = self._edges().filter(F.col("e") == e).first()
        if found is None:
            raise GraphError("E_INDEX_RANGE", f"no edge {e}")
        return found["source"], found["target"]

    def edge_weight(self, e: int) -> float | None:
        """The weight of a live edge, None where none was given; another edge is E_INDEX_RANGE."""
        found = self._edges().filter(F.col("e") == e).first()
        if found is None:
            raise GraphError("E_INDEX_RANGE", f"no edge {e}")
        return found["w"]

    def remove_nodes(self, ids: DataFrame) -> None:
        """Nodes (id) and the edges at them go."""
        k = self._next()
        gone = ids.select(F.col("id").cast(self.id_type).alias("id")).distinct()
        self.node_log.append(self._log(gone.select("id", F.lit(0).alias("key")), k, alive=False))
        if self.edge_log:
            e = self._edges()
            at = e.join(gone.withColumnRenamed("id", "source"), "source", "left_semi").select("e").union(e.join(gone.withColumnRenamed("id", "target"), "target", "left_semi").select("e"))
            self._remove(at, k)

    def remove_node(self, id_) -> None:
        self.remove_nodes(self._ids([id_]))

    def _remove(self, edges: DataFrame, k: int) -> None:
        none = F.lit(None).cast(self.id_type)
        self.edge_log.append(edges.select("e", none.alias("source"), none.alias("target"), F.lit(None).cast("float").alias("w"), F.lit(k).alias("op"), F.lit(False).alias("alive")).distinct())

    def remove_edges(self, edges: DataFrame) -> None:
        """Edges (e) go; their numbers aren't used again."""
        self._remove(edges.select(F.col("e").cast("long").alias("e")), self._next())

    def set_edge_weights(self, weights: DataFrame) -> None:
        """(e, w); NaN is E_INVALID_WEIGHT."""
        if weights.filter(F.isnan("w")).limit(1).count():
            raise GraphError("E_INVALID_WEIGHT", "NaN")
        self.weights.append(weights.select("e", F.col("w").cast("float").alias("w"), F.lit(self._next()).alias("op")))
        self.weighted = True

    def declare_column(self, kind: str, name: str, dtype: str) -> None:
        """The same declaration again is no change; another type is E_COLUMN_TYPE."""
        if self.columns[kind].setdefault(name, dtype) != dtype:
            raise GraphError("E_COLUMN_TYPE", f"{name} is {self.columns[kind][name]}")

    def widen_column(self, kind: str, name: str, dtype: str) -> None:
        old = self.columns[kind].get(name)
        if old is None:
            raise GraphError("E_UNKNOWN_COLUMN", name)
        if old not in WIDENING or dtype not in WIDENING or WIDENING.index(dtype) < WIDENING.index(old):
            raise GraphError("E_COLUMN_TYPE", f"{old} doesn't widen to {dtype}")
        self.columns[kind][name] = dtype

    def set_column(self, kind: str, values: DataFrame, name: str) -> None:
        """Cells of (key, value): key is a node's id or an edge's e. The last write of a cell counts."""
        if name not in self.columns[kind]:
            self.declare_column(kind, name, {"boolean": "bool", "int": "i32", "bigint": "f64", "double": "f64", "float": "f64"}.get(values.schema["value"].dataType.simpleString(), "string"))
        key = self.id_type if kind == "node" else "long"
        self.cells[kind].append(values.select(F.col("key").cast(key).alias("key"), F.lit(name).alias("column"), F.col("value").cast("string").alias("value"), F.lit(self._next()).alias("op")))

    def set_value(self, kind: str, key, name: str, value) -> None:
        t = self.id_type if kind == "node" else "long"
        typed = {bool: "boolean", int: "int", float: "double"}.get(type(value), "string")
        self.set_column(kind, self.spark.createDataFrame([(key, value)], f"key {t}, value {typed}"), name)

    def set_graph_value(self, name: str, value) -> None:
        self._next()
        self.graph_values[name] = value

    def set_meta(self, **values) -> None:
        self._next()
        self.meta |= values

    def add_extension_table(self, name: str, rows: DataFrame) -> None:
        if name in self.extensions:
            raise GraphError("E_COLUMN_EXISTS", name)
        self._next()
        self.extensions[name] = rows

    def add_extension_rows(self, name: str, rows: DataFrame) -> None:
        if name not in self.extensions:
            raise GraphError("E_UNKNOWN_COLUMN", name)
        self._next()
        self.extensions[name] = self.extensions[name].unionByName(rows, allowMissingColumns=True)

    def lock_directed(self) -> None:
        self.locked = True

    def set_directed(self, directed: bool, expand: bool = False) -> None:
        """expand: undirected edges but loops get a mirror edge after all others; both know each other by `pair`, and
        `directed` is false on them."""
        if self.locked and directed != self.directed:
            raise GraphError("E_DIRECTED", "the direction is locked")
        if directed and not self.directed and expand and self.edge_log:
            live = self._edges().filter("source <> target")
            twin = numbered(live.select(F.col("target").alias("source"), F.col("source").alias("target"), "w", F.col("e").alias("pair")), ["pair"], "e", Scratch(self.spark), start=self.edge_bound)
            self.edge_bound += twin.count()
            self.edge_log.append(twin.select("e", "source", "target", "w", F.lit(self._next()).alias("op"), F.lit(True).alias("alive")))
            pairs = twin.select(F.col("e").alias("key"), F.col("pair").alias("value")).union(twin.select("pair", "e"))
            self.declare_column("edge", "pair", "u32"), self.declare_column("edge", "directed", "bool")
            self.set_column("edge", pairs, "pair")
            self.set_column("edge", pairs.select("key", F.lit(False).alias("value")), "directed")
        self.directed = directed

    def add_graph(self, g: Graph) -> None:
        """Nodes merge by id, edges follow, columns widen to text where types differ."""
        other = GraphBuilder.from_graph(g)
        base, k = self.edge_bound, self.at
        shift = lambda df: df.withColumn("op", F.col("op") + k)
        for n in other.node_log:
            self.node_log.append(shift(n))
        self.edge_log += [shift(e.withColumn("e", F.col("e") + base)) for e in other.edge_log]
        for kind in ("node", "edge"):
            for name, dtype in other.columns[kind].items():
                if self.columns[kind].setdefault(name, dtype) != dtype:
                    self.columns[kind][name] = "string"
            self.cells[kind] += [shift(c if kind == "node" else c.withColumn("key", F.col("key") + base)) for c in other.cells[kind]]
        self.edge_bound, self.at = base + other.edge_bound, k + other.at
        self.weighted = self.weighted or g.weighted

    def clear(self) -> None:
        self._next()
        self.node_log, self.edge_log, self.weights = [], [], []
        self.cells, self.edge_bound = {"node": [], "edge": []}, 0

    def dispose(self) -> None:
        self.clear()
        self.disposed = True

    # reads

    def _nodes(self) -> DataFrame:
        """(id, op, key): live nodes, with the order of their first addition."""
        if not self.node_log:
            return self.spark.createDataFrame([], f"id {self.id_type}, op int, key long")
        log = reduce(DataFrame.unionByName, self.node_log)
        by = log.groupBy("id").agg(F.max_by("alive", F.struct("op", "alive")).alias("alive"), F.min(F.when(F.col("alive"), F.struct("op", "key"))).alias("first"))
        return by.filter("alive").select("id", F.col("first.op").alias("op"), F.col("first.key").alias("key"))

    def _edges(self) -> DataFrame:
        """(e, source, target, w): live edges with their latest weights."""
        if not self.edge_log:
            return self.spark.createDataFrame([], f"e long, source {self.id_type}, target {self.id_type}, w float")
        log = reduce(DataFrame.unionByName, self.edge_log)
        by = log.groupBy("e").agg(F.min("alive").alias("alive"), *[F.max(c).alias(c) for c in ("source", "target", "w")]).filter("alive").drop("alive")
        if self.weights:
            late = reduce(DataFrame.unionByName, self.weights).groupBy("e").agg(F.max_by("w", "op").alias("__w"))
            by = by.join(late, "e", "left").withColumn("w", F.coalesce("__w", "w")).drop("__w")
        return by

    def node_count(self) -> int:
        return self._nodes().count()

    def edge_count(self) -> int:
        return self._edges().count()

    def has_node(self, id_) -> bool:
        return bool(self._nodes().filter(F.col("id") == F.lit(id_)).limit(1).count())

    def has_edge(self, e: int) -> bool:
        return bool(self._edges().filter(F.col("e") == e).limit(1).count())

    def find_edges(self, source, target) -> list[int]:
        """Live edges from one node to another, ascending; in either orientation if undirected."""
        one = (F.col("source") == F.lit(source)) & (F.col("target") == F.lit(target))
        two = (F.col("source") == F.lit(target)) & (F.col("target") == F.lit(source))
        return [r["e"] for r in self._edges().filter(one if self.directed else one | two).orderBy("e").select("e").collect()]

    def edges_of(self, id_, way: str = "out") -> DataFrame:
        """(e, source, target, w) at a node: out, in, or both if undirected."""
        out, into = F.col("source") == F.lit(id_), F.col("target") == F.lit(id_)
        return self._edges().filter(out | into if not self.directed else out if way == "out" else into)

    def _cells(self, kind: str) -> DataFrame | None:
        names = self.columns[kind]
        if not self.cells[kind]:
            return None
        log = reduce(DataFrame.unionByName, self.cells[kind])
        late = log.groupBy("key", "column").agg(F.max_by("value", "op").alias("value"))
        wide = late.groupBy("key").agg(*[F.max(F.when(F.col("column") == n, F.col("value"))).alias(n) for n in names])
        return wide.select("key", *[F.col(n).try_cast(CAST.get(t, "string")).alias(n) for n, t in names.items()])

    def freeze(self, self_loops: str = "keep", duplicates: str = "keep") -> tuple[Graph, Report]:
        """The graph of the live nodes and edges; the builder goes on, and numbers of a later freeze keep this order."""
        scratch = Scratch(self.spark)
        nodes = numbered(self._nodes(), ["op", "key", "id"], "idx", scratch).select("idx", "id")
        of = lambda c, n: nodes.select(F.col("id").alias(c), F.col("idx").alias(n))
        edges = self._edges().join(of("source", "src"), "source").join(of("target", "dst"), "target").select("e", "src", "dst", "w")
        n, e = self._cells("node"), self._cells("edge")
        if n is not None:
            nodes = nodes.join(n.withColumnRenamed("key", "id"), "id", "left").select("idx", "id", *self.columns["node"])
        if e is not None:
            edges = edges.join(e.withColumnRenamed("key", "e"), "e", "left")
        g = Graph(nodes, edges, self.directed, self.weighted, dict(self.graph_values), dict(self.extensions), dict(self.meta))
        return freeze(g, self_loops, duplicates)
