"""Parsers of graph files: bytes to a stream of element dicts, in file order, without Spark.

An element is {"k": kind, ...}: "g" the graph (directed, a), "n" a node (id, a), "e" an edge (s, t, w, d, a), "i" an
issue (code, at, why). `a` holds attributes as JSON values, `w` a weight or None for an omitted one, `d` the edge's own
direction or None for the graph's. A row that can't be used becomes an issue, and the rest of the file goes on.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
from collections.abc import Callable, Iterator
from itertools import chain
from xml.etree import ElementTree

from ..errors import GraphError
from ..functions import text as T

Elements = Iterator[dict]


def decode(data: bytes) -> str:
    """UTF-8, a byte order mark aside; anything else is E_IMPORT."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise GraphError("E_IMPORT", f"not UTF-8 at byte {e.start}") from None


def issue(code: str, at, why: str) -> dict:
    return {"k": "i", "code": code, "at": str(at), "why": why}


def node(id_, /, **a) -> dict:
    return {"k": "n", "id": id_, "a": {k: v for k, v in a.items() if v is not None}}


def edge(s, t, w=None, d=None, /, **a) -> dict:
    return {"k": "e", "s": s, "t": t, "w": w, "d": d, "a": {k: v for k, v in a.items() if v is not None}}


def _weight(v, at) -> tuple:
    """(weight, issue or None) of a JSON value or text."""
    if v is None:
        return None, None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return (float(v), None) if v == v else (None, issue("bad-weight", at, "NaN"))
    w, ok = T.parse_weight(v) if isinstance(v, str) else (None, False)
    return (w, None) if ok else (None, issue("bad-weight", at, str(v)))


# CSV

#: Header names by meaning, in lower case.
CSV_NAMES = {"source": "source", "src": "source", "from": "source", "target": "target", "dst": "target", "to": "target", "weight": "weight", "type": "type", "id": "id", "label": "label"}


def csv_delimiter(text: str) -> str:
    """Of , tab ; | and blank, the one with the most even field count of two or more over the first rows."""
    rows = [r for r in text.splitlines()[:32] if r.strip() and r[0] not in "#%"]
    best = (0.0, 0, ",")
    for k, d in enumerate(",\t;| "):
        counts = [len(r) for r in csv.reader(rows, delimiter=d, skipinitialspace=d == " ")]
        top = max(set(counts), key=counts.count, default=1)
        if top > 1:
            best = max(best, (counts.count(top) / len(counts), -k, d))
    return best[2]


def csv_direction(text: str, directed: bool | None) -> bool:
    """The direction given, or else that of the comments at the start."""
    head = "\n".join(r for r in text.splitlines()[:16] if r[:1] in ("#", "%")).lower()
    return not ("undirected" in head or re.search(r"^%\s*sym", head, re.M)) if directed is None else directed


def csv_names(first: list[str], second: list[str] | None, nodes: bool) -> tuple[list[str], bool]:
    """(column names, whether the first row is a header), from the first two rows."""
    names = [CSV_NAMES.get(c.strip().lower(), c.strip()) for c in first]
    known = any(c.strip().lower() in CSV_NAMES for c in first)
    textual = all(T.infer_dtype(c.strip()) == "string" for c in first) and second is not None and any(T.infer_dtype(c.strip()) != "string" for c in second)
    if not (known or textual):
        names = ["id"] if nodes else ["source", "target", "weight"][: len(first)]
        return names + [f"column{i + 1}" for i in range(len(names), len(first))], False
    if not nodes and "source" not in names:
        names[: min(2, len(names))] = ["source", "target"][: len(names)]
    return names, True


def csv_row(names: list[str], at: int, row: list[str], nodes: bool) -> list[dict]:
    """The elements of a row."""
    cells = {n: c.strip() for n, c in zip(names, row, strict=False)}
    extra = {n: T.parse_as(c, T.infer_dtype(c)) for n, c in cells.items() if c and n not in ("source", "target", "weight", "type", "id" if nodes else "")}
    if nodes:
        return [node(cells["id"], **extra) if cells.get("id") else issue("blank-id", at, "no id")]
    if not cells.get("source") or not cells.get("target"):
        return [issue("blank-endpoint", at, "no source or target")]
    w, bad = _weight(cells.get("weight") or None, at)
    kind = cells.get("type", "").lower()
    if bad or kind not in ("", "directed", "undirected", "mutual"):
        return [bad or issue("bad-type", at, kind)]
    own = None if not kind else kind != "undirected"
    out = [edge(cells["source"], cells["target"], w, own, **extra)]
    return [*out, edge(cells["target"], cells["source"], w, own, **extra)] if kind == "mutual" else out


def parse_csv(data: bytes, nodes: bool = False, directed: bool | None = None) -> Elements:
    """An edge list, or a node table. Comments start with # or %; they may tell the direction."""
    text = decode(data)
    directed = csv_direction(text, directed)
    delimiter = csv_delimiter(text)
    lines = (r for r in io.StringIO(text, newline="") if r[:1] not in ("#", "%"))
    rows = enumerate((r for r in csv.reader(lines, delimiter=delimiter, skipinitialspace=delimiter == " ") if any(c.strip() for c in r)), 1)
    first = next(rows, None)
    if first is None:
        yield {"k": "g", "directed": directed, "a": {}}
        return
    second = next(rows, None)
    names, titled = csv_names(first[1], second and second[1], nodes)
    pending = [*([] if titled else [first]), *([second] if second else [])]
    out = [x for at, row in chain(pending, rows) for x in csv_row(names, at, row, nodes)]
    if {x["d"] for x in out if x["k"] == "e"} == {False}:
        directed = False
    yield {"k": "g", "directed": directed, "a": {}}
    yield from out


# JSON


def json_dialect(doc) -> str:
    """node-link, d3, jgf, cytoscape, graphology or vis, by shape."""
    if isinstance(doc, list):
        return "cytoscape"
    if "elements" in doc:
        return "cytoscape"
    if "graph" in doc and isinstance(doc["graph"], dict) and ("nodes" in doc["graph"] or "edges" in doc["graph"]) or "graphs" in doc:
        return "jgf"
    nodes, edges = doc.get("nodes"), doc.get("edges")
    if isinstance(nodes, list) and any(isinstance(n, dict) and "key" in n for n in nodes) or isinstance(doc.get("options"), dict) and "multi" in doc["options"]:
        return "graphology"
    if isinstance(edges, list) and any(isinstance(x, dict) and "from" in x for x in edges):
        return "vis"
    if "multigraph" in doc or "directed" in doc:
        return "node-link"
    return "d3"


def parse_json(data: bytes, hyperedges: str = "star") -> Elements:
    try:
        doc = json.loads(decode(data))
    except ValueError as e:
        raise GraphError("E_IMPORT", f"not JSON: {e}") from None
    if not isinstance(doc, (dict, list)):
        raise GraphError("E_IMPORT", "not a graph")
    yield from {"node-link": _node_link, "d3": _node_link, "jgf": _jgf, "cytoscape": _cytoscape, "graphology": _graphology, "vis": _vis}[json_dialect(doc)](doc, hyperedges)


def _link(x: dict, at, s, t, drop=(), d: bool | None = None) -> Elements:
    if s is None or t is None:
        yield issue("blank-endpoint", at, "no source or target")
        return
    w, bad = _weight(x.get("weight"), at)
    yield bad or edge(s, t, w, d, **{k: v for k, v in x.items() if k not in ("weight", *drop)})


def _node_link(doc, _) -> Elements:
    graph = doc.get("graph") if isinstance(doc.get("graph"), dict) else {}
    directed = bool(doc.get("directed", False))
    yield {"k": "g", "directed": directed, "a": graph}
    nodes = doc.get("nodes") or []
    ids = []
    for i, n in enumerate(nodes):
        n = n if isinstance(n, dict) else {"id": n}
        id_ = n.get("id", n.get("name", i))
        ids.append(id_)
        yield node(id_, **{k: v for k, v in n.items() if k != "id"})
    links = doc.get("links") if doc.get("links") is not None else doc.get("edges") or []
    ends = lambda x: (next((x[k] for k in ("source", "src", "from") if k in x), None), next((x[k] for k in ("target", "dst", "to") if k in x), None))
    flat = lambda v: v.get("id") if isinstance(v, dict) else v
    all_ends = [flat(v) for x in links if isinstance(x, dict) for v in ends(x)]
    is_index = lambda v: isinstance(v, int) and not isinstance(v, bool) and 0 <= v < len(ids)
    positional = bool(ids) and not any(isinstance(i, (int, float)) for i in ids) and bool(all_ends) and all(is_index(v) for v in all_ends)
    for i, x in enumerate(links):
        if not isinstance(x, dict):
            yield issue("bad-edge", i, "not an object")
            continue
        s, t = (flat(v) for v in ends(x))
        if positional:
            s, t = ids[s], ids[t]
        yield from _link(x, i, s, t, ("source", "src", "from", "target", "dst", "to"))


def _vis(doc, _) -> Elements:
    yield {"k": "g", "directed": any("arrows" in x for x in doc.get("edges") or []), "a": {}}
    for i, n in enumerate(doc.get("nodes") or []):
        yield node(n.get("id", i), **{k: v for k, v in n.items() if k != "id"})
    for i, x in enumerate(doc.get("edges") or []):
        yield from _link({"weight": x.get("weight", x.get("value")), **x}, i, x.get("from"), x.get("to"), ("from", "to", "value"))


def _graphology(doc, _) -> Elements:
    kind = (doc.get("options") or {}).get("type", "directed" if any(not x.get("undirected") for x in doc.get("edges") or []) else "undirected")
    yield {"k": "g", "directed": kind != "undirected", "a": doc.get("attributes") or {}}
    for n in doc.get("nodes") or []:
        yield node(n.get("key"), **(n.get("attributes") or {}))
    for i, x in enumerate(doc.get("edges") or []):
        a = dict(x.get("attributes") or {})
        if "key" in x:
            a.setdefault("key", x["key"])
        yield from _link(a, i, x.get("source"), x.get("target"), d=False if x.get("undirected") else None)


def _cytoscape(doc, _) -> Elements:
    data = doc if isinstance(doc, list) else doc["elements"]
    pairs = [("nodes" if "source" not in (x.get("data") or {}) else "edges", x) for x in data] if isinstance(data, list) else [(k, x) for k in ("nodes", "edges") for x in data.get(k) or []]
    yield {"k": "g", "directed": bool(isinstance(doc, dict) and (doc.get("data") or {}).get("directed", False)), "a": (doc.get("data") or {}) if isinstance(doc, dict) else {}}
    for i, (k, x) in enumerate(pairs):
        d = x.get("data") or {}
        if k == "nodes":
            p = x.get("position")
            yield node(d.get("id"), **{**{c: v for c, v in d.items() if c != "id"}, **({"position": [p.get("x", 0.0), p.get("y", 0.0), 0.0]} if p else {})})
        else:
            yield from _link(d, i, d.get("source"), d.get("target"), ("source", "target"))


def _jgf(doc, hyperedges) -> Elements:
    g = doc["graph"] if "graph" in doc else (doc["graphs"] or [{}])[0]
    yield {"k": "g", "directed": g.get("directed", True), "a": g.get("metadata") or {}}
    nodes = g.get("nodes") or {}
    for id_, n in nodes.items() if isinstance(nodes, dict) else ((n.get("id"), n) for n in nodes):
        yield node(id_, **{"label": n.get("label"), **(n.get("metadata") or {})})
    for i, x in enumerate(g.get("edges") or []):
        a = {**(x.get("metadata") or {}), **{k: x[k] for k in ("id", "label", "relation") if k in x}}
        yield from _link(a, i, x.get("source"), x.get("target"), d=x.get("directed"))
    for i, x in enumerate(g.get("hyperedges") or []):
        members = list(x.get("nodes") or [*x.get("source", []), *x.get("target", [])])
        yield from hyperedge(members, hyperedges, i, None, x.get("metadata") or {})


def hyperedge(members: list, how: str, at, hub, a: dict) -> Elements:
    """star: from a hub node, or else from the first member; clique: every pair; skip; error."""
    if how == "error":
        raise GraphError("E_IMPORT", f"hyperedge {at}")
    if how == "skip":
        yield issue("hyperedge", at, "skipped")
    elif how == "clique":
        yield from (edge(members[i], members[j], None, False, **a) for i in range(len(members)) for j in range(i + 1, len(members)))
    elif hub is not None:
        yield node(hub, **{"kind": "hyperedge", **a})
        yield from (edge(hub, m, None, False) for m in members)
    else:
        yield from (edge(members[0], m, None, False, **a) for m in members[1:])


# XML


def _tag(x) -> str:
    return x.tag.rpartition("}")[2]


def _xml(data: bytes):
    decode(data)
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise GraphError("E_IMPORT", f"not XML: {e}") from None


#: Declared types of the XML formats and of Neo4j headers.
DECLARED = {"integer": "i32", "int": "i32", "short": "i32", "byte": "i32", "long": "f64", "float": "f64", "double": "f64", "boolean": "bool", "string": "string", "char": "string", "anyuri": "string", "biginteger": "string", "bigdecimal": "string", "duration": "string"}


def declared(text: str, kind: str, at=None):
    """(value, issue or None) of text under a declared type; a list type splits it."""
    k = kind.lower()
    if k.startswith("list") or k.endswith("[]"):
        inner = k[4:] if k.startswith("list") else k[:-2]
        items = [declared(x, inner) for x in T.split_list(text, "semicolon" if k.endswith("[]") else "auto")]
        return [v for v, _ in items], next((b for _, b in items if b), None)
    if k in ("date", "datetime", "localdatetime", "timestamp"):
        v = T.parse_temporal(text)
    elif k in ("time", "localtime"):
        v = T.parse_time(text)
    elif k == "point":
        v = T.parse_point(text)
    elif DECLARED.get(k, "string") == "bool":
        v = T.parse_boolean(text)
    else:
        v = T.parse_as(text.strip() if DECLARED.get(k, "string") != "string" else text, DECLARED.get(k, "string"))
    return (v, None) if v is not None else (None, issue("bad-value", at, f"{text!r} is no {kind}"))


def parse_gexf(data: bytes) -> Elements:
    root = _xml(data)
    graph = next((x for x in root.iter() if _tag(x) == "graph"), None)
    if _tag(root) != "gexf" or graph is None:
        raise GraphError("E_IMPORT", "no gexf graph")
    base = graph.get("defaultedgetype", "undirected")
    meta = {_tag(x): x.text for m in root if _tag(m) == "meta" for x in m if x.text}
    yield {"k": "g", "directed": base != "undirected", "a": {**meta, **({"mode": graph.get("mode")} if graph.get("mode") else {})}}
    columns = {}
    for block in (x for x in graph if _tag(x) == "attributes"):
        for x in (y for y in block if _tag(y) == "attribute"):
            default = next((d.text for d in x if _tag(d) == "default"), None)
            columns[block.get("class", "node"), x.get("id")] = (x.get("title") or x.get("id"), x.get("type", "string"), default)

    def values(x, kind):
        a, bad, timed = {}, [], []
        for v in (v for holder in x if _tag(holder) == "attvalues" for v in holder):
            key = v.get("for") or v.get("id")
            name, typ, _ = columns.get((kind, key), (key, "string", None))
            got, why = declared(v.get("value") or "", typ, x.get("id"))
            if why:
                bad.append(why)
            elif v.get("start") or v.get("end") or v.get("timestamp"):
                timed.append({"name": name, "value": got, "start": v.get("start") or v.get("timestamp"), "end": v.get("end") or v.get("timestamp")})
            else:
                a[name] = got
        for (k, _), (name, typ, default) in columns.items():
            if k == kind and name not in a and default is not None:
                a[name] = declared(default, typ)[0]
        for y in x:
            t = _tag(y)
            if t == "color":
                a["color"] = [int(y.get(c, 0)) / 255 for c in "rgb"] + [float(y.get("a", 1))]
            elif t == "position":
                a["position"] = [float(y.get(c, 0)) for c in "xyz"]
            elif t in ("size", "thickness"):
                a[t] = float(y.get("value", 1))
            elif t == "shape":
                a["shape"] = y.get("value")
            elif t == "spells":
                a["spells"] = [[T.parse_temporal(s.get("start", "")) if s.get("start") else -math.inf, T.parse_temporal(s.get("end", "")) if s.get("end") else math.inf] for s in y]
        for c in ("label", "start", "end", "kind"):
            if x.get(c) is not None:
                a[c] = x.get(c)
        if timed:
            a["temporal"] = timed
        return a, bad

    def walk(holder, parent):
        for x in (y for y in holder if _tag(y) == "node"):
            a, bad = values(x, "node")
            p = x.get("pid") or parent
            yield from bad
            yield node(x.get("id"), **{**a, **({"parent": p} if p else {})}) if x.get("id") else issue("blank-id", "node", "no id")
            for inner in (y for y in x if _tag(y) == "nodes"):
                yield from walk(inner, x.get("id"))

    for holder in (x for x in graph if _tag(x) == "nodes"):
        yield from walk(holder, None)
    for i, x in enumerate(y for holder in graph if _tag(holder) == "edges" for y in holder if _tag(y) == "edge"):
        a, bad = values(x, "edge")
        w, why = _weight(x.get("weight"), i)
        if why or not x.get("source") or not x.get("target"):
            yield why or issue("blank-endpoint", i, "no source or target")
            continue
        yield from bad
        kind = x.get("type")
        both = edge(x.get("source"), x.get("target"), w, None if kind is None else kind != "undirected", **{"id": x.get("id"), **a})
        yield both
        if kind == "mutual":
            yield {**both, "s": both["t"], "t": both["s"]}


#: The graph attribute by which the writer says that ids are mangled.
MANGLED = "mangled ids"


def parse_graphml(data: bytes, hyperedges: str = "star") -> Elements:
    root = _xml(data)
    graph = next((x for x in root if _tag(x) == "graph"), None)
    if _tag(root) != "graphml" or graph is None:
        raise GraphError("E_IMPORT", "no graphml graph")
    keys = {}
    for x in (y for y in root if _tag(y) == "key"):
        default = next((d.text for d in x if _tag(d) == "default"), None)
        kind = x.get("attr.type") or ("yfiles" if x.get("yfiles.type") else "string")
        keys[x.get("id")] = (x.get("attr.name") or x.get("id"), kind, x.get("for", "all"), default)

    def values(x, domain):
        a, bad = {}, []
        for d in (y for y in x if _tag(y) == "data"):
            name, kind, _, _ = keys.get(d.get("key"), (d.get("key"), "string", "all", None))
            if len(d):
                a[name] = ElementTree.tostring(d[0], encoding="unicode")
                continue
            got, why = declared(d.text or "", kind, x.get("id"))
            bad += [why] if why else []
            if not why:
                a[name] = got
        for name, kind, on, default in keys.values():
            if default is not None and on in (domain, "all") and name not in a:
                a[name] = declared(default, kind)[0]
        return a, bad

    a, bad = values(graph, "graph")
    id_of = T.restore_nmtoken if a.pop(MANGLED, False) else lambda x: x  # ids that the writer had to change
    yield {"k": "g", "directed": graph.get("edgedefault", "directed") != "undirected", "a": a}
    yield from bad

    def walk(g, parent):
        later = []
        for x in g:
            t = _tag(x)
            if t == "node":
                a, bad = values(x, "node")
                yield from bad
                yield node(id_of(x.get("id")), **{**a, **({"parent": parent} if parent else {})}) if x.get("id") else issue("blank-id", "node", "no id")
                for inner in (y for y in x if _tag(y) == "graph"):
                    yield from walk(inner, x.get("id") and id_of(x.get("id")))
            elif t in ("edge", "hyperedge"):
                later.append(x)
        for i, x in enumerate(later):
            a, bad = values(x, "edge")
            yield from bad
            if _tag(x) == "hyperedge":
                ends = [p.get("node") and id_of(p.get("node")) for p in x if _tag(p) == "endpoint"]
                yield from hyperedge(ends, hyperedges, i, x.get("id") or f"hyperedge{i}", a)
                continue
            w, why = _weight(a.pop("weight", None), i)
            if why or not x.get("source") or not x.get("target"):
                yield why or issue("blank-endpoint", i, "no source or target")
                continue
            ports = {"sourcePort": x.get("sourceport"), "targetPort": x.get("targetport"), "id": x.get("id")}
            yield edge(id_of(x.get("source")), id_of(x.get("target")), w, None if x.get("directed") is None else x.get("directed") == "true", **{**a, **ports})

    yield from walk(graph, None)


# GML

_GML = re.compile(r'\s*(?:#[^\n]*\n\s*)*(?:(\[)|(\])|"([^"]*)"|([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:INF|NAN))(?![\w.])|([A-Za-z_][\w.]*))')


def _gml_list(text: str, at: int, top: bool):
    out = []
    while True:
        m = _GML.match(text, at)
        if not m or m.end() == at:
            if top and not text[at:].strip():
                return out, at
            raise GraphError("E_IMPORT", f"GML at character {at}")
        at = m.end()
        if m[2]:
            if top:
                raise GraphError("E_IMPORT", "GML: ] without [")
            return out, at
        if not m[5]:
            raise GraphError("E_IMPORT", f"GML: no key at character {at}")
        v = _GML.match(text, at)
        if not v or v[2] or (v[5] and not v[5]):
            raise GraphError("E_IMPORT", f"GML: no value at character {at}")
        at = v.end()
        if v[1]:
            inner, at = _gml_list(text, at, False)
            out.append((m[5], inner))
        elif v[3] is not None:
            out.append((m[5], T.decode_gml(v[3])))
        elif v[4]:
            n = v[4]
            out.append((m[5], int(n) if re.fullmatch(r"[+-]?\d+", n) else float(n.replace("INF", "inf").replace("NAN", "nan"))))
        else:
            out.append((m[5], v[5]))


def _gml_attrs(pairs) -> dict:
    a: dict = {}
    for k, v in pairs:
        v = _gml_attrs(v) if isinstance(v, list) else v
        if k in a:
            a[k] = [*(a[k] if isinstance(a[k], list) else [a[k]]), v]
        else:
            a[k] = v
    return a


def parse_gml(data: bytes) -> Elements:
    pairs, _ = _gml_list(decode(data), 0, True)
    graph = next((v for k, v in pairs if k == "graph" and isinstance(v, list)), None)
    if graph is None:
        raise GraphError("E_IMPORT", "no GML graph")
    a = _gml_attrs([(k, v) for k, v in graph if k not in ("node", "edge", "directed")])
    yield {"k": "g", "directed": dict((k, v) for k, v in graph if k == "directed").get("directed", 0) == 1, "a": a}
    for i, (k, v) in enumerate(graph):
        if k not in ("node", "edge") or not isinstance(v, list):
            continue
        a = _gml_attrs(v)
        if k == "node":
            g = a.pop("graphics", None)
            if isinstance(g, dict) and "x" in g:
                a["position"] = [float(g.pop("x", 0)), float(g.pop("y", 0)), float(g.pop("z", 0))]
            if g:
                a["graphics"] = g
            id_ = a.pop("id", None)
            yield node(id_, **a) if id_ is not None else issue("blank-id", i, "no id")
        else:
            s, t = a.pop("source", None), a.pop("target", None)
            w, why = _weight(a.pop("weight", None), i)
            yield why or (edge(s, t, w, None, **a) if s is not None and t is not None else issue("blank-endpoint", i, "no source or target"))


# DOT

_DOT = re.compile(r'(?:\s|//[^\n]*|/\*.*?\*/|^#[^\n]*)*(?:("(?:[^"\\]|\\.)*")|(--|->)|([{}\[\];,=:+])|(<(?:[^<>]|<[^<>]*>)*>)|([A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*|-?(?:\.\d+|\d+(?:\.\d*)?)))', re.S | re.M)


class _Dot:
    def __init__(self, text: str):
        self.toks, at = [], 0
        while True:
            m = _DOT.match(text, at)
            if not m:
                rest = re.sub(r"//[^\n]*|/\*.*?\*/|^#[^\n]*", "", text[at:], flags=re.S | re.M)
                if rest.strip():
                    raise GraphError("E_IMPORT", f"DOT at character {at}")
                break
            at = m.end()
            if m[1]:
                self.toks.append(("id", re.sub(r'\\(["\\])', r"\1", m[1][1:-1].replace("\\\n", "")).replace("\\n", "\n")))
            elif m[2]:
                self.toks.append(("op", m[2]))
            elif m[3]:
                self.toks.append(("p", m[3]))
            elif m[4]:
                self.toks.append(("id", m[4]))
            else:
                self.toks.append(("word", m[5]))
        self.i = 0
        self.out: list[dict] = []
        self.seen: dict[str, dict] = {}
        self.merged: dict[tuple, dict] = {}
        self.clusters: list[str] = []
        self.anonymous = 0

    def peek(self, k=0):
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def take(self, *want):
        t = self.peek()
        if want and t[1] not in want:
            raise GraphError("E_IMPORT", f"DOT: {t[1]!r} where {want} is expected")
        self.i += 1
        return t

    def word(self):
        t = self.take()
        if t[0] not in ("id", "word"):
            raise GraphError("E_IMPORT", f"DOT: {t[1]!r} is no name")
        out = t[1]
        while self.peek()[1] == "+":
            self.take()
            out += self.take()[1]
        return out

    def parse(self):
        self.strict = self.peek()[1].lower() == "strict" and bool(self.take())
        kind = self.take()[1].lower()
        if kind not in ("graph", "digraph"):
            raise GraphError("E_IMPORT", "DOT: no graph")
        self.directed = kind == "digraph"
        name = self.word() if self.peek()[1] != "{" else None
        self.attrs = {"name": name} if name else {}
        self.block({}, {}, None, self.attrs)
        return self

    def attributes(self) -> dict:
        a = {}
        while self.peek()[1] == "[":
            self.take()
            while self.peek()[1] != "]":
                k = self.word()
                a[k] = "true"
                if self.peek()[1] == "=":
                    self.take()
                    a[k] = self.word()
                if self.peek()[1] in (",", ";"):
                    self.take()
            self.take("]")
        return a

    def add(self, id_, defaults, parent):
        if id_ not in self.seen:
            self.seen[id_] = node(id_, **{**defaults, **({"parent": parent} if parent else {})})
            self.out.append(self.seen[id_])
        elif parent and "parent" not in self.seen[id_]["a"]:
            self.seen[id_]["a"]["parent"] = parent
        return id_

    def block(self, nd, ed, parent, attrs) -> list:
        """Reads { ... } and returns the nodes named in it, with defaults of its own scope."""
        nd, ed, inside = dict(nd), dict(ed), []
        self.take("{")
        while self.peek()[1] != "}" or self.peek()[0] == "id":
            if self.peek()[0] == "end":
                raise GraphError("E_IMPORT", "DOT: } is missing")
            if self.peek() == ("p", ";"):
                self.take()
                continue
            low = self.peek()[1].lower() if self.peek()[0] == "word" else ""
            if low in ("node", "edge", "graph") and self.peek(1)[1] == "[":
                self.take()
                {"node": nd, "edge": ed, "graph": attrs}[low].update(self.attributes())
                continue
            if self.peek()[0] in ("word", "id") and self.peek(1) == ("p", "="):
                k = self.word()
                self.take()
                attrs[k] = self.word()
                continue
            chain = [self.operand(nd, ed, parent)]
            while self.peek()[0] == "op":
                op = self.take()[1]
                if (op == "->") != self.directed:
                    raise GraphError("E_IMPORT", f"DOT: {op} in this kind of graph")
                chain.append(self.operand(nd, ed, parent))
            a = self.attributes()
            if len(chain) == 1 and chain[0][1]:
                self.seen[chain[0][0][0][0]]["a"].update(a)
            for (left, _), (right, _) in zip(chain[:-1], chain[1:], strict=True):
                for s, sp in left:
                    for t, tp in right:
                        self.edge(s, t, {**ed, **a, **({"sourcePort": sp} if sp else {}), **({"targetPort": tp} if tp else {})})
            inside += [x for ends, _ in chain for x in ends]
        self.take("}")
        return inside

    def edge(self, s, t, a):
        w, ok = T.parse_weight(a.pop("weight", None))
        if not ok:
            self.out.append(issue("bad-weight", f"{s} {t}", "weight"))
            return
        key = (s, t) if self.directed else tuple(sorted((s, t)))
        if self.strict and key in self.merged:
            old = self.merged[key]
            old["a"].update(a)
            old["w"] = w if w is not None else old["w"]
            self.out.append(issue("strict-merge", f"{s} {t}", "repeated edge"))
            return
        self.merged[key] = edge(s, t, w, None, **a)
        self.out.append(self.merged[key])

    def operand(self, nd, ed, parent):
        """(ends, whether it is a single node); an end is (id, port)."""
        if self.peek() == ("p", "{") or self.peek()[0] == "word" and self.peek()[1].lower() == "subgraph":
            name = None
            if self.peek()[1] != "{":
                self.take()
                name = self.word() if self.peek()[1] != "{" else None
            own, inner = {}, parent
            if name and name.startswith("cluster"):
                self.add(name, {"kind": "cluster"}, parent)
                inner = name
            ends = self.block(nd, ed, inner, own)
            if inner is name and name:
                self.seen[name]["a"].update(own)
            return list(dict.fromkeys((i, None) for i, _ in ends)), False
        id_ = self.word()
        port = None
        while self.peek() == ("p", ":"):
            self.take()
            port = f"{port}:{self.word()}" if port else self.word()
        self.add(id_, nd, parent)
        return [(id_, port)], True


def parse_dot(data: bytes) -> Elements:
    d = _Dot(decode(data)).parse()
    yield {"k": "g", "directed": d.directed, "a": d.attrs}
    for x in d.out:
        if x["k"] == "n":
            x["a"] = {k: T.parse_as(v, T.infer_dtype(v)) if isinstance(v, str) and k != "parent" else v for k, v in x["a"].items()}
        yield x


# Pajek


def pajek_cells(line: str) -> list[str]:
    return [a if a is not None and a != "" or q else b for q, a, b in ((m[0].startswith('"'), m[1], m[2]) for m in re.finditer(r'"([^"]*)"|(\[[^\]]*\]|\S+)', line))]


def pajek_node(i: int, label: str, c: list[str]) -> dict:
    a: dict = {"label": label}
    numbers = [float(x) for x in c[2:5] if re.fullmatch(T.NUMBER, x)]
    if len(numbers) >= 2:
        a["position"] = (numbers + [0.0])[:3]
    spells = next((T.parse_intervals(x) for x in c[2:] if x.startswith("[")), None)
    if spells:
        a["spells"] = [list(s) for s in spells]
    params = c[2 + len(numbers) :]
    a |= {params[k]: params[k + 1] for k in range(0, len(params) - 1, 2) if re.fullmatch("[A-Za-z_]+", params[k])}
    return node(i, **a)


def pajek_edge(section: str, at: int, c: list[str], ok: Callable[[str], bool]) -> dict:
    """The edge of a row of *arcs or *edges; ok tells whether a text is a vertex."""
    if len(c) < 2 or not ok(c[0]) or not ok(c[1]):
        return issue("bad-row", at, " ".join(c)[:40])
    w, why = _weight(c[2], at) if len(c) > 2 and not c[2].startswith("[") else (None, None)
    spells = next((T.parse_intervals(x) for x in c[2:] if x.startswith("[")), None)
    rest = c[3:]
    a = {rest[k]: rest[k + 1] for k in range(0, len(rest) - 1, 2) if re.fullmatch("[A-Za-z_]+", rest[k])}
    return why or edge(int(c[0]), int(c[1]), w, section == "*arcs", **{**a, **({"spells": [list(s) for s in spells]} if spells else {})})


def parse_pajek(data: bytes) -> Elements:
    lines = [x.strip() for x in decode(data).splitlines()]
    kinds = {x.split()[0].lower() for x in lines if x.startswith("*")}
    directed = bool(kinds & {"*arcs", "*arcslist", "*matrix"}) or not kinds & {"*edges", "*edgeslist"}
    yield {"k": "g", "directed": directed, "a": {"network": next((x.split(None, 1)[1] for x in lines if x.lower().startswith("*network ")), None)}}
    section, names, row, count, base = "", {}, 0, 0, 1
    later: list[tuple] = []

    for at, line in enumerate(lines, 1):
        if not line or line.startswith("%"):
            continue
        if line.startswith("*"):
            section, row = line.split()[0].lower(), 0
            if section == "*vertices":
                count = int(line.split()[1]) if len(line.split()) > 1 and line.split()[1].isdigit() else 0
            continue
        c = pajek_cells(line)
        if section == "*vertices":
            if not re.fullmatch(r"\d+", c[0]):
                yield issue("bad-row", at, line[:40])
                continue
            names[int(c[0])] = (c[1] if len(c) > 1 else c[0], at, c)
        else:
            later.append((section, at, c, row))
            row += 1
    if 0 in names:
        base = 0
    for i in range(base, max(count + base, max(names, default=base - 1) + 1)):
        label, _, c = names.get(i, (str(i), 0, []))
        yield pajek_node(i, label, c)
    top = max(count + base - 1, max(names, default=0))
    ok = lambda x: re.fullmatch(r"-?\d+", x) and base <= abs(int(x)) <= top
    for section, at, c, row in later:
        if section in ("*arcs", "*edges"):
            yield pajek_edge(section, at, c, ok)
        elif section in ("*arcslist", "*edgeslist"):
            for x in c[1:]:
                yield edge(int(c[0]), int(x), None, section == "*arcslist") if ok(c[0]) and ok(x) else issue("bad-row", at, x)
        elif section == "*matrix":
            for j, x in enumerate(c):
                w, why = _weight(x, at)
                if why or w:
                    yield why or edge(row + base, j + base, w, True)


# Neo4j admin CSV

_HEADER = re.compile(r"^([^:]*)(?::([A-Za-z_]+(?:\[\])?)(?:\(([^)]*)\))?)?(?:\{[^}]*\})?$")


def neo4j_delimiter(first: str) -> str:
    return max(",;\t|", key=first.count)


def neo4j_head(row: list[str]) -> list[tuple] | None:
    """(name, type, id space) of each column, if the row is a header."""
    parts = [_HEADER.match(c.strip()) for c in row]
    marks = {m[2].upper() for m in parts if m and m[2]}
    return [(m[1], (m[2] or "string"), m[3]) for m in parts if m] if "ID" in marks or {"START_ID", "END_ID"} <= marks else None


def neo4j_row(head: list[tuple], at: int, row: list[str]) -> Elements:
    """The elements of a row; a node's id may have been listed before."""
    a, id_, ends, labels, kind, bad = {}, None, {}, None, None, None
    for (name, typ, space), cell in zip(head, row, strict=False):
        up = typ.upper()
        if up == "ID":
            id_ = (cell, space)
            if name and name != "id":
                a[name] = cell
        elif up in ("START_ID", "END_ID"):
            ends[up] = (cell, space)
        elif up == "LABEL":
            labels = [x for x in cell.split(";") if x]
        elif up == "TYPE":
            kind = cell
        elif up != "IGNORE" and cell != "":
            v, why = declared(cell, typ, at)
            bad = bad or why
            if why is None:
                a[name] = v
    if bad:
        yield bad
    if ends:
        if not ends.get("START_ID", ("",))[0] or not ends.get("END_ID", ("",))[0]:
            yield issue("blank-endpoint", at, "no :START_ID or :END_ID")
            return
        w, why = _weight(a.pop("weight", None), at)
        yield why or edge(ends["START_ID"][0], ends["END_ID"][0], w, True, **{"type": kind, **a})
    elif not id_ or not id_[0]:
        yield issue("blank-id", at, "no :ID")
    else:
        yield node(id_[0], **{"labels": labels, "idSpace": id_[1], **a})


def parse_neo4j(data: bytes) -> Elements:
    """Sections of nodes and relationships, each from a header row on. Ids are unique within their id space."""
    text = decode(data)
    delimiter = neo4j_delimiter(text.splitlines()[0] if text.splitlines() else "")
    head: list | None = None
    seen: set = set()
    spaces: dict = {}
    yield {"k": "g", "directed": True, "a": {}}
    for at, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
        if not any(c.strip() for c in row):
            continue
        found = neo4j_head(row)
        if found:
            head = found
            continue
        if head is None:
            raise GraphError("E_IMPORT", "no header with :ID or :START_ID and :END_ID")
        for x in neo4j_row(head, at, row):
            if x["k"] == "n":
                id_ = (x["id"], next(space for _, typ, space in head if typ.upper() == "ID"))
                if id_ in seen:
                    yield issue("duplicate-id", at, id_[0])
                    continue
                if spaces.setdefault(id_[0], id_[1]) != id_[1]:
                    yield issue("id-collision", at, id_[0])
                seen.add(id_)
            yield x


PARSERS = {"csv": parse_csv, "json": parse_json, "gexf": parse_gexf, "graphml": parse_graphml, "gml": parse_gml, "dot": parse_dot, "pajek": parse_pajek, "neo4j": parse_neo4j}

#: File name endings by format.
ENDINGS = {"csv": (".csv", ".tsv", ".edges", ".txt"), "json": (".json",), "gexf": (".gexf",), "graphml": (".graphml", ".xml"), "gml": (".gml",), "dot": (".dot", ".gv"), "pajek": (".net", ".paj"), "neo4j": (".csv",)}


def sniff(data: bytes, name: str = "") -> list[tuple[str, float]]:
    """(format, score) by descending score, from the first 8 KiB and the name. The name alone gives 0.4 at most."""
    text = data[:8192].decode("utf-8", "ignore").lstrip("﻿ \t\r\n")
    low = text[:2048].lower()
    first = text.splitlines()[0] if text else ""
    content = {
        "gexf": 1.0 if "<gexf" in low else 0.0,
        "graphml": 1.0 if "<graphml" in low else 0.0,
        "json": 0.9 if text[:1] in ("{", "[") and '"' in low else 0.0,
        "gml": 0.9 if re.search(r"^\s*graph\s*\[", low, re.M) else 0.0,
        "dot": 0.9 if re.match(r"(?:\s|//[^\n]*|/\*.*?\*/|#[^\n]*)*(strict\s+)?(di)?graph\b[^\[]*\{", low, re.S) else 0.0,
        "pajek": 0.9 if re.search(r"^\*(vertices|network|arcs|edges)\b", low, re.M) else 0.0,
        "neo4j": 0.95 if re.search(r":(id|start_id)\b", first, re.I) else 0.0,
        "csv": 0.5 if text and any(d in first for d in ",\t;| ") and text[:1] not in ("<", "{", "[", "*") else 0.0,
    }
    out = []
    for f, c in content.items():
        by_name = name.lower().endswith(ENDINGS[f])
        score = 0.5 + 0.35 * c + 0.1 * by_name if c else 0.4 * by_name
        if score:
            out.append((f, round(score, 4)))
    return sorted(out, key=lambda x: (-x[1], x[0]))
