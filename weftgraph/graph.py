"""The graph model: two DataFrames and driver-side metadata.

nodes: `idx` LONG (0 .. n - 1 in order of first appearance), `id`, one column for each attribute.
edges: `e` LONG (0 .. m - 1 in order of insertion), `src` LONG, `dst` LONG, `w` FLOAT (null where the graph is
unweighted or the weight was omitted; then it counts as 1), one column for each attribute. Edges are logical: an
undirected edge is one row, in its declared orientation. Arcs are derived from them (`operators.views.arcs`).

Order is always explicit, in idx and e. Column metadata carries `role`, `default`, `refersTo` and `origin`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import GraphError

NODE_KEYS, EDGE_KEYS = ("idx", "id"), ("e", "src", "dst", "w")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    weighted: bool = False
    attrs: dict = field(default_factory=dict)
    extensions: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def node_attributes(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in NODE_KEYS]

    def edge_attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_KEYS]

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def persist(self) -> Graph:
        """Keep both tables in memory and on disk; `unpersist` lets go of them."""
        return self.with_(nodes=self.nodes.persist(), edges=self.edges.persist())

    def unpersist(self) -> None:
        self.nodes.unpersist(), self.edges.unpersist()


def weight() -> Column:
    """An edge's weight as a DOUBLE: 1 where none is given."""
    return F.coalesce(F.col("w").cast("double"), F.lit(1.0))


def metadata(df: DataFrame, column: str, **values) -> DataFrame:
    """df with these values in the metadata of a column (role, default, refersTo, origin)."""
    if column not in df.columns:
        raise GraphError("E_UNKNOWN_COLUMN", column)
    if "role" in values and any(f.metadata.get("role") == values["role"] for f in df.schema.fields if f.name != column):
        raise GraphError("E_DUPLICATE_ROLE", values["role"])
    return df.withMetadata(column, df.schema[column].metadata | values)


def by_role(df: DataFrame, role: str) -> str | None:
    """The name of the column of a role."""
    return next((f.name for f in df.schema.fields if f.metadata.get("role") == role), None)


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("e", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", T.FloatType())]))


#: Metadata fields that a graph can carry, with the type of each.
META = {"name": str, "description": str, "creator": str, "created": (int, float, str), "modified": (int, float, str), "format": str, "version": str, "source": str, "license": str, "keywords": list, "weight_name": str, "time_format": str, "mode": str, "extra": dict}


def resolve_meta(*patches: dict | None) -> dict:
    """Metadata patches merged in order: a later field counts, None takes a field away, `extra` merges by key, and
    fields that META doesn't list go into `extra`. A field of a wrong type is E_COLUMN_TYPE."""
    out: dict = {}
    for patch in patches:
        for k, v in (patch or {}).items():
            if k not in META:
                out.setdefault("extra", {})[k] = v
            elif v is None:
                out.pop(k, None)
            elif not isinstance(v, META[k]):
                raise GraphError("E_COLUMN_TYPE", f"{k} is {type(v).__name__}")
            elif k == "extra":
                out["extra"] = out.get("extra", {}) | v
            else:
                out[k] = v
    return out
