"""Reading graph files: whole files parsed on the executors, then built into a graph by DataFrame operations.

A text format that can't be split is one task a file; plain edge lists also have `read_edge_list`, which splits files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from .._tables import Scratch
from ..errors import GraphError
from ..functions import text as T
from ..graph import Graph
from . import parsers, split
from .tables import from_edges

ELEMENT = "file string, seq long, kind string, id string, target string, weight double, directed boolean, attrs string, code string"
#: Formats by name; `register` adds to them.
_registry: dict[str, Callable] = dict(parsers.PARSERS)


def register(name: str, parser: Callable) -> None:
    """A format's parser: bytes to element dicts (see `parsers`)."""
    _registry[name] = parser


def formats() -> list[str]:
    return sorted(_registry)


@dataclass(frozen=True)
class Import:
    """A graph with its issues (file, at, code, why) and the format read."""

    graph: Graph
    issues: DataFrame
    format: str


def _tagger(ids: str) -> Callable:
    def tagged(v) -> str | None:
        v = T.coerce_id(v, ids)
        return None if v is None else f"s:{v}" if isinstance(v, str) else f"n:{T.number_text(float(v))}"

    return tagged


def _row(name: str, seq: int, x: dict, tagged: Callable) -> tuple:
    """An element as a row of ELEMENT."""
    k = x["k"]
    if k == "i":
        return (name, seq, k, x["at"], x["why"], None, None, None, x["code"])
    if k == "g":
        return (name, seq, k, None, None, None, bool(x["directed"]), json.dumps(x["a"], default=str), None)
    s, t = tagged(x["id"] if k == "n" else x["s"]), tagged(x.get("t"))
    if s is None or (k == "e" and t is None):
        return (name, seq, "i", str(seq), "not an id", None, None, None, "bad-id")
    return (name, seq, k, s, t, x.get("w"), x.get("d"), json.dumps(x["a"], default=str), None)


def elements(spark: SparkSession, path: str, format: str, parts: bool = False, **options) -> DataFrame:
    """The elements of the files at a path, in rows of ELEMENT; ids are texts tagged n: for numbers or s: for strings.
    parts: the files are one document, in the order of their names."""
    ship(spark)
    parse = _registry[format]
    tagged = _tagger(options.get("ids", "keep"))
    own = {k: v for k, v in options.items() if k != "ids"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if parts:
            every = sorted(contents)
            contents = [(every[0][0], b"".join(c for _, c in every))] if every else []
        for name, content in contents:
            rows = []
            try:
                for seq, x in enumerate(parse(content, **own)):
                    rows.append(_row(name, seq, x, tagged))
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
            except GraphError as e:
                rows.append((name, 1 << 40, "x", None, str(e), None, None, None, e.code))
            if rows:
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return (files.coalesce(1) if parts else files).mapInArrow(run, ELEMENT)


#: Bytes from which a document is read in pieces.
WHOLE = 4 << 20


def _in_pieces(spark: SparkSession, path: str, format: str, parts: bool, scratch: Scratch, **options) -> DataFrame:
    """The elements of one document, read in pieces by many tasks and written; Unfit where that can't be done."""
    own = {k: v for k, v in options.items() if k != "ids"}
    found = sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())
    offsets, total = {}, 0
    for name, size in found:
        offsets[name.rsplit("/", 1)[1]] = total
        total += size
    known = parsers.PARSERS.get(format) is _registry[format] and (format == "csv" or format in split.PLANS)
    if total < WHOLE or not known or len(offsets) != len(found) or len(found) > 1 and not parts:
        raise split.Unfit("small, or of several documents")
    ship(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    raw = text.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    if format == "csv":
        first = [n for n, size in found if size][0]
        head = [r["line"] for r in raw.filter((F.col("file") == first.rsplit("/", 1)[1]) & (F.col("start") == 0)).select("line").limit(64).collect()]
        plan = split.csv_plan("\n".join(head).removeprefix("\ufeff"), own)
    else:
        skeleton = raw.mapInArrow(split.skeleton_of(format, offsets), "at long, line binary").limit(split.LINES + 1)
        plan = split.plan(format, sorted((r["at"], bytes(r["line"])) for r in skeleton.collect()), own)
    tagged, name, fixed_nodes, skeleton, parse = _tagger(options.get("ids", "keep")), found[0][0], plan.nodes is not None, plan.skeleton, plan.parse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            rows = []
            try:
                for at, lines in split.segments(batch, state, offsets):
                    for run_, place, piece in split.pieces(skeleton, at, lines):
                        for i, x in enumerate(parse(run_, place, piece)):
                            rows.append(_row(name, int(x["id"]) if fixed_nodes and x["k"] == "n" else place * split.ROOM + i, x, tagged))
                            if rows[-1][2] == "i":
                                raise split.Unfit(str(rows[-1]))  # an issue's place is counted over the whole document
            except (split.Unfit, GraphError) as e:
                yield _batch([(name, 0, "u", None, str(e), None, None, None, None)])
                return
            if rows:
                yield _batch(rows)

    rows = scratch.table(raw.mapInArrow(run, ELEMENT), "pieces")
    fixed = [_row(name, -1, plan.graph, tagged), *(_row(name, seq, x, tagged) for seq, x in plan.fixed)]
    if any(r[2] == "i" for r in fixed):
        raise split.Unfit("an issue")
    told = rows.agg(*[F.max(F.when(F.col("kind") == "u", F.col("target"))).alias("unfit"), F.max(F.when(F.col("kind") == "n", F.col("seq"))).alias("last"), F.min(F.when(F.col("kind") == "e", F.col("seq"))).alias("first")]).first()
    if told["unfit"] is not None:
        raise split.Unfit(told["unfit"])
    if plan.apart and told["last"] is not None and told["first"] is not None and told["last"] > told["first"]:
        raise split.Unfit("nodes after edges")
    nodes = rows.filter("kind = 'n'")
    if plan.once and nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or fixed_nodes and nodes.count() != plan.nodes:
        raise split.Unfit("nodes listed twice, or missing")
    return rows.unionByName(spark.createDataFrame(fixed, ELEMENT))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string())
    names = [x.split()[0] for x in ELEMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _typed(rows: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """rows with one column for each attribute instead of attrs, of the widest type its values have; and their names."""
    cells = rows.select(key, F.explode(F.from_json("attrs", "map<string,string>")).alias("name", "value")).filter("value is not null")
    names = [(r["name"], r["type"]) for r in cells.groupBy("name").agg(T.widest_col(F.col("value")).alias("type")).orderBy("name").collect()]  # one row a column
    if not names:
        return rows.drop("attrs"), []
    cast = {"bool": "boolean", "i32": "int", "f64": "double"}
    taken = {"idx", "id", "e", "src", "dst", "w", "pair", "directed", "file", "seq"}
    out = [T.unique_name(n, taken) for n, _ in names]
    held = F.from_json("attrs", "map<string,string>")
    return rows.select(*[c for c in rows.columns if c != "attrs"], *[held[n].try_cast(cast.get(t, "string")).alias(o) for (n, t), o in zip(names, out, strict=True)]), out


def read(spark: SparkSession, path: str, format: str | None = None, on_mixed: str = "expand", duplicates: str = "keep", parts: bool = False, **options) -> Import:
    """Read the graph files at a path as one graph. Without a format, the first file's is found by `sniff`.

    parts: the files are one document, in the order of their names, as `sinks.write` makes it. A large document whose
    lines are whole elements is read in pieces (see `split`).

    on_mixed, for undirected edges in a directed graph: `expand` adds a mirror edge for each but loops, told by `pair`;
    `directed` and `undirected` treat all alike; `error` is E_DIRECTED. A file that can't be parsed is E_IMPORT.
    """
    if format is None:
        head = spark.read.format("binaryFile").load(path).orderBy("path").select("path", F.substring("content", 1, 8192).alias("head")).first()
        ranked = parsers.sniff(bytes(head["head"]), head["path"]) if head else []
        if not ranked:
            raise GraphError("E_IMPORT", "no known format")
        format = ranked[0][0]
    if format not in _registry:
        raise GraphError("E_IMPORT", f"no format {format}")
    scratch = Scratch(spark)
    try:
        rows = _in_pieces(spark, path, format, parts, scratch, **options)
    except split.Unfit:
        rows = scratch.table(elements(spark, path, format, parts, **options), "elements")
    bad = rows.filter("kind = 'x'").limit(1).collect()
    if bad:
        raise GraphError("E_IMPORT", f"{bad[0]['file']}: {bad[0]['target']}")
    graph = rows.filter("kind = 'g'").orderBy("file").first()
    directed = True if graph is None else graph["directed"]
    edges = rows.filter("kind = 'e'")
    own = F.coalesce("directed", F.lit(directed))
    kinds = {r[0] for r in edges.select(own.alias("d")).distinct().collect()}
    if kinds == {True} or kinds == {False}:
        directed = kinds.pop()
    elif len(kinds) == 2:
        if on_mixed == "error":
            raise GraphError("E_DIRECTED", "directed and undirected edges")
        directed = on_mixed != "undirected"
    mixed = len(kinds) == 2 and on_mixed == "expand"
    edges = edges.withColumn("__own", own)
    if mixed:
        turn = F.explode(F.when(~F.col("__own") & (F.col("id") != F.col("target")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__half")
        edges = edges.select("*", turn).select("file", "seq", "__half", "__own", "weight", "attrs", F.when(F.col("__half") == 0, F.col("id")).otherwise(F.col("target")).alias("id"), F.when(F.col("__half") == 0, F.col("target")).otherwise(F.col("id")).alias("target"))
    else:
        edges = edges.withColumn("__half", F.lit(0))
    nodes = rows.filter("kind = 'n'").groupBy("id").agg(F.min(F.struct("file", "seq")).alias("at"), F.max_by("attrs", F.struct("file", "seq")).alias("attrs"))
    listed = nodes.select("id", "attrs", F.col("at.file").alias("file"), F.col("at.seq").alias("seq"))
    weighted = bool(edges.filter("weight is not null").limit(1).count())
    g = from_edges(edges, "id", "target", ["file", "seq", "__half"], "weight", directed, listed, "id", ["file", "seq"], ["attrs", "__own", "__half", "file", "seq"]).with_(weighted=weighted)
    numeric = not g.nodes.filter(~F.startswith(F.col("id"), F.lit("n:"))).limit(1).count()
    plain = F.substring("id", 3, 1 << 30)
    cells, names = _typed(g.nodes, "idx")
    whole = numeric and not g.nodes.filter(plain.try_cast("bigint").isNull()).limit(1).count()
    # ids of both kinds keep their tags, as 1 and "1" are different nodes
    both = not numeric and bool(g.nodes.filter(F.startswith(F.col("id"), F.lit("n:"))).limit(1).count())
    id_ = plain.cast("bigint") if whole else plain.cast("double") if numeric else F.col("id") if both else plain
    node_table = cells.select("idx", id_.alias("id"), *[F.col(f"`{n}`") for n in names])
    edge_table, enames = _typed(g.edges, "e")
    if mixed:
        twin = edge_table.select("file", "seq", F.col("e").alias("__e"), F.col("__half").alias("__h"))
        edge_table = edge_table.join(twin, (edge_table["file"] == twin["file"]) & (edge_table["seq"] == twin["seq"]) & (edge_table["__half"] != twin["__h"]), "left").drop(twin["file"]).drop(twin["seq"]).withColumn("pair", F.col("__e")).withColumn("directed", F.col("__own"))
        enames = [*enames, "pair", "directed"]
    edge_table = edge_table.select("e", "src", "dst", "w", *[F.col(f"`{n}`") for n in enames])
    out = Graph(scratch.table(node_table, "nodes"), scratch.table(edge_table, "edges"), directed, weighted, json.loads(graph["attrs"]) if graph else {}, meta={"format": format})
    if duplicates != "keep":
        from ..operators.freeze import freeze

        out = freeze(out, duplicates=duplicates)[0]
    return Import(out, rows.filter("kind = 'i'").select("file", F.col("id").alias("at"), "code", F.col("target").alias("why")), format)


def read_edge_list(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, source: str = "source", target: str = "target", weight: str | None = None, directed: bool = True) -> Import:
    """A plain edge list, its files split among tasks: one edge a line, no quoted line feeds.

    Edges are numbered by file and place in it. Blank ends and bad weights become issues.
    """
    scratch = Scratch(spark)
    raw = spark.read.option("header", header).option("sep", delimiter).option("inferSchema", False).csv(path)
    if not header:
        raw = raw.toDF(*[source, target, *([weight] if weight else []), *[f"column{i}" for i in range(len(raw.columns) - 2 - bool(weight))]])
    w = T.parse_weight_col(F.col(weight)) if weight else F.lit(None).cast("double")
    s, t = F.trim(source), F.trim(target)
    why = F.when(F.coalesce(s, F.lit("")) == "", "blank-endpoint").when(F.coalesce(t, F.lit("")) == "", "blank-endpoint")
    if weight:
        why = why.when((F.coalesce(F.trim(weight), F.lit("")) != "") & w.isNull(), "bad-weight")
    # a file's splits are read in order, and its rows within a split too
    rows = scratch.table(raw.select(s.alias("source"), t.alias("target"), w.alias("w"), why.alias("code"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")), "lines")
    issues = rows.filter("code is not null").select("file", F.col("at").cast("string").alias("at"), "code", F.lit("").alias("why"))
    return Import(from_edges(rows.filter("code is null"), "source", "target", ["file", "at"], "w" if weight else None, directed), issues, "csv")


def read_container(spark: SparkSession, path: str, level: str = "structure") -> Graph:
    """A graph written by `sinks.write_container`. level: none, structure (the manifest's counts) or full (validate)."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    except ValueError:
        raise GraphError("E_BAD_SERIALIZATION", "the manifest is no JSON") from None
    if manifest.get("version") != 1:
        raise GraphError("E_UNSUPPORTED_VERSION", str(manifest.get("version")))
    table = lambda n: spark.read.parquet(f"{path}/{n}")
    g = Graph(table("nodes"), table("edges"), manifest["directed"], manifest["weighted"], manifest["attrs"], {n: table(f"extension-{n}") for n in manifest["extensions"]}, manifest["meta"])
    if level != "none" and (g.node_count() != manifest["nodes"] or g.edge_count() != manifest["edges"]):
        raise GraphError("E_BAD_SERIALIZATION", "counts differ from the manifest's")
    if level == "full":
        from ..operators.validate import validate

        validate(g)
    return g

