"""Writing graphs: text formats, a check of what they'd lose, and a container of tables.

A text document is one ordered stream, so its lines are made on the executors, in order, and written as a text table
with one part for a range of the order; `join_text` puts small graphs into one string on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from .._tables import partitions
from ..errors import GraphError
from ..functions import text as T
from ..graph import Graph, by_role
from ..operators.tree import depth_first
from .parsers import MANGLED

#: What each format can hold.
CAPABILITIES = {
    "csv": {"nodes": False, "mixed": True, "attributes": True, "nested": False, "parallel": True, "ids": "any"},
    "json": {"nodes": True, "mixed": False, "attributes": True, "nested": False, "parallel": True, "ids": "any"},
    "gexf": {"nodes": True, "mixed": True, "attributes": True, "nested": True, "parallel": True, "ids": "any"},
    "graphml": {"nodes": True, "mixed": True, "attributes": True, "nested": True, "parallel": True, "ids": "nmtoken"},
    "gml": {"nodes": True, "mixed": False, "attributes": True, "nested": False, "parallel": True, "ids": "integer"},
    "dot": {"nodes": True, "mixed": False, "attributes": True, "nested": False, "parallel": True, "ids": "any"},
    "pajek": {"nodes": True, "mixed": True, "attributes": False, "nested": False, "parallel": True, "ids": "renumbered"},
    "neo4j": {"nodes": True, "mixed": False, "attributes": True, "nested": False, "parallel": True, "ids": "any"},
}


def check(g: Graph, format: str) -> list[tuple[str, str]]:
    """(code, detail) of what a format would lose of a graph, from its schema and a few counts."""
    if format not in CAPABILITIES and format not in DIALECTS:
        raise GraphError("E_UNSUPPORTED", format)
    format = "json" if format in DIALECTS else format
    can, notes = CAPABILITIES[format], []
    attributes = g.node_attributes()
    if not can["nodes"]:
        if attributes:
            notes.append(("node-attributes", ", ".join(attributes)))
        ends = g.edges.select(F.explode(F.array("src", "dst")).alias("idx"))
        alone = g.nodes.join(ends, "idx", "left_anti").count()
        if alone:
            notes.append(("isolated-nodes", str(alone)))
    if not can["attributes"]:
        lost = [c for c in (*attributes, *g.edge_attributes()) if c not in ("label", "position", "spells")]
        if lost:
            notes.append(("attributes", ", ".join(lost)))
    if not can["nested"] and by_role(g.nodes, "parent"):
        notes.append(("nesting", by_role(g.nodes, "parent")))
    if g.directed and "directed" in g.edges.columns and not can["mixed"]:
        n = g.edges.filter(~F.col("directed")).count()
        if n:
            notes.append(("mixed-direction", str(n)))
    if can["ids"] == "nmtoken":  # written changed; our reader changes them back
        bad = g.nodes.filter(~F.col("id").cast("string").rlike(r"\A[A-Za-z0-9_:.\-]+\z")).count()
        if bad:
            notes.append(("ids", str(bad)))
    if can["ids"] in ("integer", "renumbered") and g.nodes.schema["id"].dataType.simpleString() not in ("bigint", "int"):
        notes.append(("ids", "renumbered"))
    if format in ("gml", "json") and g.weighted and g.edges.filter(F.abs("w") == float("inf")).limit(1).count():
        notes.append(("infinite-weights", "written as null"))
    return notes


def sanitized_ids(g: Graph, pattern: str, mangle: bool = True) -> DataFrame:
    """(idx, id): ids as texts of the characters of a class; others are replaced by _ and made unique by a suffix, or
    are E_INVALID_ID."""
    text = F.col("id").cast("string")
    clean = F.regexp_replace(text, f"[^{pattern}]", "_")
    if not mangle:
        if g.nodes.filter(text != clean).limit(1).count():
            raise GraphError("E_INVALID_ID", f"an id has characters outside [{pattern}]")
        return g.nodes.select("idx", text.alias("id"))
    from pyspark.sql import Window

    told = g.nodes.select("idx", clean.alias("id"), (text != clean).alias("__changed"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("__changed", "idx"))
    return told.withColumn("__k", k).select("idx", F.when(F.col("__k") > 1, F.concat("id", F.lit("_"), F.col("__k").cast("string"))).otherwise(F.col("id")).alias("id"))


def folded(edges: DataFrame) -> DataFrame:
    """edges without the mirror halves of expanded undirected ones: of each pair, the lower e."""
    if "pair" not in edges.columns:
        return edges
    return edges.filter(F.col("pair").isNull() | (F.col("pair") > F.col("e")))


def explicit_weight(g: Graph) -> Column:
    """The weight where one was given, else null."""
    return F.col("w") if g.weighted else F.lit(None).cast("float")


def _rows(g: Graph, nested: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as (at, id or source and target, w, undirected, attrs JSON). nested, with a column of role parent:
    nodes in preorder, with their depth and that of the next node."""
    pack = lambda names: F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in names])) if names else F.lit("{}")
    kept = [c for c in g.edge_attributes() if c not in ("pair", "directed", "w64")]
    parent = by_role(g.nodes, "parent") if nested else None
    nodes = g.nodes.select(F.col("idx").alias("at"), "id", pack([c for c in g.node_attributes() if c != parent]).alias("attrs"))
    if parent:
        order = depth_first(g.nodes, parent)
        after = order.select((F.col("place") - 1).alias("place"), F.col("depth").alias("next"))
        order = order.join(after, "place", "left").select("place", F.col("idx").alias("at"), "depth", F.coalesce("next", F.lit(0)).alias("next"))
        nodes = nodes.join(order, "at").select(F.col("place").alias("at"), "id", "attrs", "depth", "next")
    e = folded(g.edges)
    un = ~F.coalesce(F.col("directed"), F.lit(True)) if "directed" in e.columns else F.lit(not g.directed)
    ids = g.nodes.select("idx", "id")
    e = e.select("e", "src", "dst", explicit_weight(g).alias("w"), un.alias("undirected"), pack(kept).alias("attrs"))
    e = e.join(ids.select(F.col("idx").alias("src"), F.col("id").alias("source")), "src").join(ids.select(F.col("idx").alias("dst"), F.col("id").alias("target")), "dst")
    return nodes, e.select(F.col("e").alias("at"), "src", "dst", "source", "target", "w", "undirected", "attrs")


def _value(v) -> str:
    return T.coerce_to_text(v)


def _xml_attrs(names: dict, a: dict, element: str) -> str:
    if element == "data":
        return "".join(f'<data key="{k}">{T.escape_xml(_value(a[n]))}</data>' for n, k in names.items() if a.get(n) is not None)
    inner = "".join(f'<attvalue for="{k}" value="{T.escape_xml(_value(a[n]))}"/>' for n, k in names.items() if a.get(n) is not None)
    return f"<attvalues>{inner}</attvalues>" if inner else ""


XML_TYPES = {"int": ("int", "integer"), "bigint": ("long", "long"), "double": ("double", "double"), "float": ("float", "float"), "boolean": ("boolean", "boolean")}


def document(g: Graph, format: str) -> DataFrame:
    """(at, line): a graph as the lines of a document, numbered in order."""
    if format not in WRITERS and format not in DIALECTS:
        raise GraphError("E_UNSUPPORTED", format)
    ship(g.spark)
    nested = format in NESTED
    nodes, edges = _rows(g, nested)
    held = by_role(g.nodes, "parent") if nested else None
    kinds = {"n": {c: g.nodes.schema[c].dataType.simpleString() for c in g.node_attributes() if c != held}, "e": {c: g.edges.schema[c].dataType.simpleString() for c in g.edge_attributes() if c not in ("pair", "directed", "w64")}}
    head, node_line, middle, edge_line, tail = (WRITERS | DIALECTS)[format](g, kinds)

    def lines(make, mark):
        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for b in batches:
                yield pd.DataFrame({"part": mark, "at": b["at"], "line": [make(r) for r in b.to_dict("records")]})

        return run

    fixed = lambda part, text: g.spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(text).alias("line"))
    parts = [fixed(0, head)] if head else []
    if node_line:
        parts.append(nodes.mapInPandas(lines(node_line, 1), "part int, at long, line string"))
    if middle:
        parts.append(fixed(2, middle))
    if edge_line:
        parts.append(edges.mapInPandas(lines(edge_line, 3), "part int, at long, line string"))
    if tail:
        parts.append(fixed(4, tail))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.filter("line is not null").select(F.col("part").cast("int").alias("part"), "at", "line")


#: Formats whose writers nest nodes.
NESTED = ("gexf", "graphml")


def _closed(r, opened: str, leaf: str, close: str) -> str:
    """What follows a node's own content: `opened` before its first child, else `leaf`, and an end for each level left."""
    if r.get("depth") is None:
        return leaf
    return opened if r["next"] > r["depth"] else leaf + close * int(r["depth"] - r["next"])


def _w(r) -> float | None:
    return None if r["w"] is None or r["w"] != r["w"] else float(r["w"])


def _csv(g, kinds):
    names = list(kinds["e"])
    head = ",".join(["Source", "Target", "Type", "Weight", *(T.quote_csv(n) for n in names)])

    def line(r):
        a, w = json.loads(r["attrs"]), _w(r)
        cells = [str(r["source"]), str(r["target"]), "Undirected" if r["undirected"] else "Directed", "" if w is None else T.f32_text(w), *("" if a.get(n) is None else _value(a[n]) for n in names)]
        return ",".join(map(T.quote_csv, cells))

    return head, None, None, line, None


def _json(g, kinds):
    dumps = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    clean = lambda w: None if w is None or w in (float("inf"), float("-inf")) else w
    head = f'{{"directed":{dumps(g.directed)},"multigraph":true,"graph":{dumps(g.attrs)},"nodes":['
    node = lambda r: ("" if r["at"] == 0 else ",") + dumps({"id": r["id"], **json.loads(r["attrs"])})
    edge = lambda r: ("" if r["at"] == 0 else ",") + dumps({"source": r["source"], "target": r["target"], **({"weight": clean(_w(r))} if _w(r) is not None else {}), **json.loads(r["attrs"])})
    return head, node, '],"links":[', edge, "]}"


def _dumps(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _with_weight(r) -> dict:
    """An edge's attributes and its weight, if it has a finite one."""
    w = _w(r)
    return {**({"weight": w} if w is not None and abs(w) != float("inf") else {}), **json.loads(r["attrs"])}


def _comma(r) -> str:
    return "" if r["at"] == 0 else ","


def _vis(g, kinds):
    arrows = {"arrows": "to"} if g.directed else {}
    node = lambda r: _comma(r) + _dumps({"id": r["id"], **json.loads(r["attrs"])})
    return '{"nodes":[', node, '],"edges":[', lambda r: _comma(r) + _dumps({"from": r["source"], "to": r["target"], **arrows, **_with_weight(r)}), "]}"


def _graphology(g, kinds):
    options = {"type": "directed" if g.directed else "undirected", "multi": True, "allowSelfLoops": True}
    node = lambda r: _comma(r) + _dumps({"key": r["id"], "attributes": json.loads(r["attrs"])})
    return f'{{"attributes":{_dumps(g.attrs)},"options":{_dumps(options)},"nodes":[', node, '],"edges":[', lambda r: _comma(r) + _dumps({"source": r["source"], "target": r["target"], "attributes": _with_weight(r)}), "]}"


def _jgf(g, kinds):
    node = lambda r: f"{_comma(r)}{_dumps(str(r['id']))}:{_dumps({'metadata': json.loads(r['attrs'])})}"
    edge = lambda r: _comma(r) + _dumps({"source": str(r["source"]), "target": str(r["target"]), "metadata": _with_weight(r)})
    return f'{{"graph":{{"directed":{_dumps(g.directed)},"metadata":{_dumps(g.attrs)},"nodes":{{', node, '},"edges":[', edge, "]}}"


def _cytoscape(g, kinds):
    node = lambda r: _comma(r) + _dumps({"data": {"id": str(r["id"]), **json.loads(r["attrs"])}})
    edge = lambda r: _comma(r) + _dumps({"data": {"source": str(r["source"]), "target": str(r["target"]), **_with_weight(r)}})
    return f'{{"data":{_dumps({**g.attrs, "directed": g.directed})},"elements":{{"nodes":[', node, '],"edges":[', edge, "]}}"


def _gexf(g, kinds):
    keys = {k: {n: str(i) for i, n in enumerate(kinds[k]) if n != "label"} for k in "ne"}
    block = lambda k, cls: f'<attributes class="{cls}">' + "".join(f'<attribute id="{i}" title="{T.escape_xml(n)}" type="{XML_TYPES.get(kinds[k][n], ("", "string"))[1]}"/>' for n, i in keys[k].items()) + "</attributes>" if keys[k] else ""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="{"directed" if g.directed else "undirected"}">{block("n", "node")}{block("e", "edge")}<nodes>'

    def node(r):
        a = json.loads(r["attrs"])
        label = f' label="{T.escape_xml(_value(a["label"]))}"' if a.get("label") is not None else ""
        return f'<node id="{T.escape_xml(str(r["id"]))}"{label}>{_xml_attrs(keys["n"], a, "gexf")}' + _closed(r, "<nodes>", "</node>", "</nodes></node>")

    def edge(r):
        w = _w(r)
        kind = "undirected" if r["undirected"] else "directed"
        return f'<edge id="{r["at"]}" source="{T.escape_xml(str(r["source"]))}" target="{T.escape_xml(str(r["target"]))}" type="{kind}"' + (f' weight="{T.f32_text(w)}"' if w is not None else "") + f'>{_xml_attrs(keys["e"], json.loads(r["attrs"]), "gexf")}</edge>'

    return head, node, "</nodes><edges>", edge, "</edges></graph></gexf>"


def _graphml(g, kinds):
    keys = {k: {n: f"{k}{i}" for i, n in enumerate(kinds[k])} for k in "ne"}
    decl = "".join(f'<key id="{i}" for="{"node" if k == "n" else "edge"}" attr.name="{T.escape_xml(n)}" attr.type="{XML_TYPES.get(kinds[k][n], ("string",))[0]}"/>' for k in "ne" for n, i in keys[k].items())
    if g.weighted:
        decl += '<key id="w" for="edge" attr.name="weight" attr.type="double"/>'
    decl += f'<key id="m" for="graph" attr.name="{MANGLED}" attr.type="boolean"/>'
    edges = f'edgedefault="{"directed" if g.directed else "undirected"}"'
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{decl}<graph {edges}><data key="m">true</data>'
    name = lambda v: T.mangle_nmtoken(str(v))
    directed = g.directed
    node = lambda r: f'<node id="{name(r["id"])}">{_xml_attrs(keys["n"], json.loads(r["attrs"]), "data")}' + _closed(r, f'<graph id="{name(r["id"])}:" {edges}>', "</node>", "</graph></node>")

    def edge(r):
        w = f'<data key="w">{T.f32_text(_w(r))}</data>' if _w(r) is not None else ""
        own = f' directed="{"false" if r["undirected"] else "true"}"' if r["undirected"] == directed else ""
        return f'<edge source="{name(r["source"])}" target="{name(r["target"])}"{own}>{w}{_xml_attrs(keys["e"], json.loads(r["attrs"]), "data")}</edge>'

    return head, node, None, edge, "</graph></graphml>"


def _gml(g, kinds):
    integer = g.nodes.schema["id"].dataType.simpleString() in ("bigint", "int")

    def cell(k, v):
        if isinstance(v, list):
            return "".join(cell(k, x) for x in v)
        if isinstance(v, bool):
            return f" {k} {int(v)}"
        return f" {k} {T.number_text(float(v)) if isinstance(v, int) else repr(float(v))}" if isinstance(v, (int, float)) else f" {k} {T.quote_gml(_value(v))}"

    attrs = lambda r: "".join(cell("".join(c for c in k if c.isalnum()) or "x", v) for k, v in json.loads(r["attrs"]).items() if v is not None)

    def node(r):
        own = "" if integer or "label" in kinds["n"] else cell("label", str(r["id"]))
        return f"node [ id {r['id'] if integer else r['at']}{own}{attrs(r)} ]"

    def edge(r):
        s, t = (r["source"], r["target"]) if integer else (r["src"], r["dst"])
        w = _w(r)
        return f"edge [ source {s} target {t}" + (f" weight {w!r}" if w is not None and abs(w) != float("inf") else "") + f"{attrs(r)} ]"

    return f"graph [ directed {int(g.directed)} multigraph 1", node, None, edge, "]"


def _dot(g, kinds):
    def attrs(r, w=None):
        a = {k: _value(v) for k, v in json.loads(r["attrs"]).items() if v is not None}
        if w is not None:
            a["weight"] = T.f32_text(w)
        return " [" + ", ".join(f"{T.quote_dot(k)}={T.quote_dot(v)}" for k, v in a.items()) + "]" if a else ""

    op = "->" if g.directed else "--"
    return f"{'digraph' if g.directed else 'graph'} {{", lambda r: f"{T.quote_dot(str(r['id']))}{attrs(r)};", None, lambda r: f"{T.quote_dot(str(r['source']))} {op} {T.quote_dot(str(r['target']))}{attrs(r, _w(r))};", "}"


def _pajek(g, kinds):
    head = f"*Vertices {g.node_count()}"

    def node(r):
        a = json.loads(r["attrs"])
        p = a.get("position")
        return f"{r['at'] + 1} {T.quote_pajek(_value(a.get('label', r['id'])))}" + (" " + " ".join(T.number_text(float(x)) for x in p) if isinstance(p, list) else "")

    edge = lambda r: f"{r['src'] + 1} {r['dst'] + 1}" + (f" {T.f32_text(_w(r))}" if _w(r) is not None else "")
    return head, node, "*Arcs" if g.directed else "*Edges", edge, None


def _neo4j(g, kinds):
    types = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}
    col = lambda k: [T.quote_csv(f"{n}:{types.get(t, 'string')}") for n, t in kinds[k].items()]
    own = lambda k, a: ["" if a.get(n) is None else T.quote_csv(_value(a[n])) for n in kinds[k]]
    head, middle = ",".join(["id:ID", *col("n")]), ",".join([":START_ID", ":END_ID", ":TYPE", "weight:double", *col("e")])
    node = lambda r: ",".join([T.quote_csv(str(r["id"])), *own("n", json.loads(r["attrs"]))])

    def edge(r):
        a = json.loads(r["attrs"])  # a `type` attribute is the relationship's type
        return ",".join([T.quote_csv(str(r["source"])), T.quote_csv(str(r["target"])), T.quote_csv(str(a.get("type") or "EDGE")), "" if _w(r) is None else T.f32_text(_w(r)), *own("e", a)])

    return head, node, middle, edge, None


#: Further JSON dialects, besides node-link, which d3 reads too.
DIALECTS = {"json-vis": _vis, "json-graphology": _graphology, "json-jgf": _jgf, "json-cytoscape": _cytoscape}
WRITERS = {"csv": _csv, "json": _json, "gexf": _gexf, "graphml": _graphml, "gml": _gml, "dot": _dot, "pajek": _pajek, "neo4j": _neo4j}


def register(name: str, make, capabilities: dict) -> None:
    """A further writer: make(g, kinds) gives head, node line, middle, edge line and tail, as those above; capabilities
    are those of CAPABILITIES, for `check`."""
    if set(capabilities) != set(CAPABILITIES["csv"]):
        raise GraphError("E_INVALID_ARGUMENT", f"capabilities are {sorted(CAPABILITIES['csv'])}")
    WRITERS[name], CAPABILITIES[name] = make, dict(capabilities)


def formats() -> list[str]:
    return sorted(WRITERS | DIALECTS)


def write(g: Graph, path: str, format: str) -> list[tuple[str, str]]:
    """Write a graph as a folder of text parts that, in the order of their names, are the document; also what was lost."""
    notes = check(g, format)
    save(document(g, format), path)
    return notes


def save(lines: DataFrame, path: str) -> None:
    """Write the lines of a document as text parts, which `formats.read` takes with `parts`."""
    lines.repartitionByRange(partitions(lines.sparkSession), "part", "at").sortWithinPartitions("part", "at").select("line").write.text(path)


#: Lines that one string may have.
LINES = 1_000_000


def join_text(g: Graph, format: str) -> str:
    """A small graph's document as one string; more than LINES nodes and edges are E_TOO_LARGE."""
    if g.node_count() + g.edge_count() > LINES:
        raise GraphError("E_TOO_LARGE", f"more than {LINES} lines; write() makes a folder of parts")
    return "\n".join(r["line"] for r in document(g, format).orderBy("part", "at").collect()) + "\n"


def write_container(g: Graph, path: str) -> None:
    """The tables of a graph as Parquet, edges sorted by (src, dst, e) within parts, and a manifest."""
    g.nodes.write.parquet(f"{path}/nodes")
    g.edges.repartitionByRange(partitions(g.spark), "src", "dst", "e").sortWithinPartitions("src", "dst", "e").write.parquet(f"{path}/edges")
    for n, t in g.extensions.items():
        t.write.parquet(f"{path}/extension-{n}")
    manifest = {"version": 1, "directed": g.directed, "weighted": g.weighted, "nodes": g.node_count(), "edges": g.edge_count(), "attrs": g.attrs, "extensions": list(g.extensions), "meta": g.meta}
    g.spark.createDataFrame([(json.dumps(manifest),)], "line string").coalesce(1).write.text(f"{path}/manifest")


def renumbered(g: Graph) -> DataFrame:
    """(idx, number): nodes from 1, as formats with integer ids write them."""
    return g.nodes.select("idx", (F.col("idx") + 1).alias("number"))
