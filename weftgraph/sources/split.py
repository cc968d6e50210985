"""Reading large documents in pieces: lines that are whole elements are parsed apart from the rest, by the same parsers.

A document's lines are of two kinds. Element lines hold whole nodes or edges, and can be taken away without breaking
what is left: the skeleton, of a few lines, which goes to the driver. It tells where a run of element lines stands, and so
the text to put around any piece of it for the parser. What doesn't fit (elements over several lines, nesting, state that
reaches from line to line) raises Unfit, and the document is parsed as a whole, as small ones are.
"""

from __future__ import annotations

import bisect
import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc

from ..errors import GraphError
from . import parsers

#: Skeleton lines and bytes at most; more and the document is parsed as a whole.
LINES, BYTES = 2_000, 1 << 22
#: Numbers of elements that a line has room for.
ROOM = 1 << 20
MARK = "__weft_mark"


class Unfit(Exception):
    """The document can't be read in pieces."""


@dataclass
class Plan:
    """The graph's own element, and how the executors make elements of a piece of lines."""

    graph: dict
    skeleton: list[int]  # positions of the lines that aren't elements
    parse: Callable[[int, int, bytes], list[dict]]  # (run, position, text) -> elements, without the graph's
    fixed: list[tuple[int, dict]] = field(default_factory=list)  # (seq, element) of the skeleton
    once: bool = False  # a node listed twice is Unfit
    apart: bool = False  # so is one listed after an edge
    nodes: int | None = None  # nodes there have to be, numbered from 1


#: Element lines by format, as RE2 and on bytes.
_QUOTED = r'"(?:[^"\\]|\\.)*"'
_NAME = rf"(?:{_QUOTED}|[A-Za-z_\x{{80}}-\x{{10FFFF}}][A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]*|-?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?))"
_ATTRS = rf"(?: \[{_NAME}={_NAME}(?:, {_NAME}={_NAME})*\])?"
ELEMENT_LINE = {
    "json": r'^,[{"].*\}\r?$',
    "gexf": r"^<(?:node|edge) (?:[^\r]*</(?:node|edge)>|[^<>]*/>)\r?$",
    "graphml": r"^<(?:node|edge) (?:[^\r]*</(?:node|edge)>|[^<>]*/>)\r?$",
    "gml": r'^(?:node|edge) \[(?:[^\[\]"]|"[^"]*")*\]\r?$',
    "dot": rf"^{_NAME}(?: (?:->|--) {_NAME})?{_ATTRS};\r?$",
    "pajek": r"^[0-9]",
    "neo4j": "",
}
#: What an element line of these formats must not hold besides: nested graphs, comments, words that aren't names.
NOT_ELEMENT = {"gexf": r"<!|<nodes|</nodes>|<\?", "graphml": r"<!|<graph|</graph>|<\?|<hyperedge", "neo4j": r"(?i):(?:ID|START_ID|END_ID)\b", "dot": r"(?i)^(?:node|edge|graph|digraph|subgraph|strict)\b"}


def segments(batch: pa.RecordBatch, state: dict, offsets: dict[str, int]) -> Iterator[tuple[int, pa.Array]]:
    """(position of the first line, lines) of the stretches of a batch (file, start, line) that are of one block. A line's
    position is its block's first byte in the document plus its place among the block's lines: less than the next
    block's first."""
    import numpy as np

    files, starts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    coded = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (coded[1:] != coded[:-1])) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
        if a == z:
            continue
        key = files[a].as_py(), int(starts[a])
        if state.get("key") != key:
            state["key"], state["next"] = key, offsets[key[0]] + key[1]
        yield state["next"], batch.column(2).slice(a, z - a)
        state["next"] += z - a


def is_element(lines: pa.Array, format: str) -> pa.Array:
    ok = pc.match_substring_regex(lines, ELEMENT_LINE[format])
    if format in NOT_ELEMENT:
        ok = pc.and_(ok, pc.invert(pc.match_substring_regex(lines, NOT_ELEMENT[format])))
    return ok


def skeleton_of(format: str, offsets: dict[str, int]) -> Callable:
    """A mapInArrow function: (at, line) of the lines that aren't elements; of a task, LINES and one more at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = {}, 0
        for batch in batches:
            for at, lines in segments(batch, state, offsets):
                rest = pc.indices_nonzero(pc.invert(is_element(lines, format)))
                if len(rest) and out <= LINES:
                    rest = rest[: LINES + 1 - out]
                    out += len(rest)
                    yield pa.RecordBatch.from_arrays([pa.array([at + i for i in rest.to_pylist()], pa.int64()), lines.take(rest).cast(pa.binary())], ["at", "line"])

    return run


def pieces(known: list[int], at: int, lines: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(run, position, text) of the runs of element lines among lines from a position on."""
    run, i, n = bisect.bisect_left(known, at), 0, len(lines)
    while i < n:
        stop = min(n, known[run] - at) if run < len(known) else n
        if stop > i:
            yield run, at + i, b"\n".join(lines.slice(i, stop - i).cast(pa.binary()).to_pylist())
        if stop < n:
            run += 1
        i = stop + 1


def _whole(format: str, opener: dict[int, bytes], closer: dict[int, bytes], options: dict):
    def parse(run: int, at: int, text: bytes) -> list[dict]:
        try:
            return [x for x in parsers.PARSERS[format](opener[run] + text + closer[run], **options) if x["k"] != "g"]
        except GraphError as e:
            raise Unfit(str(e)) from None

    return parse


def _framed(format: str, lines: list[tuple[int, bytes]], options: dict, mark: bytes) -> Plan:
    """XML and GML: the skeleton has no elements of its own, and a mark in place of each run is read as one node and one
    edge or, where only one kind may stand, one of these."""
    texts = [t for _, t in lines]
    open_, close = {}, {}
    for k in range(len(texts) + 1):
        open_[k], close[k] = b"\n".join([*texts[:k], b""]), b"\n".join([b"", *texts[k:]])
    fits, graph = set(), None
    for k in range(len(texts) + 1):
        try:
            g, *found = parsers.PARSERS[format](open_[k] + mark + close[k], **options)
        except (GraphError, ValueError):
            continue
        if {(x["k"], x.get("id"), x.get("s")) for x in found} <= {("n", MARK, None), ("e", None, MARK)} and len(found) in (1, 2) and not any(x["a"].get("parent") for x in found):
            fits.add(k)
        graph = g
    if not fits:
        raise Unfit("no place for elements")
    own = _whole(format, open_, close, options)

    def parse(run: int, at: int, text: bytes) -> list[dict]:
        if run not in fits:
            raise Unfit("elements where none may stand")
        return own(run, at, text)

    return Plan(graph, [a for a, _ in lines], parse)


def _xml(format: str, lines: list, options: dict) -> Plan:
    if any(b"<!DOCTYPE" in t or b"<![CDATA" in t or b"<!--" in t or b"encoding=" in t and b"utf-8" not in t.lower() for _, t in lines):
        raise Unfit("comments, sections or a document type")
    return _framed(format, lines, options, f'<node id="{MARK}"/><edge source="{MARK}" target="{MARK}"/>'.encode())


def _gml(format: str, lines: list, options: dict) -> Plan:
    if any(t.count(b'"') % 2 for _, t in lines):
        raise Unfit("texts over several lines")
    return _framed(format, lines, options, f'node [ id "{MARK}" ]\nedge [ source "{MARK}" target "{MARK}" ]'.encode())


def _dot(format: str, lines: list, options: dict) -> Plan:
    text = [t.strip() for _, t in lines if t.strip()]
    if len(text) != 2 or not re.fullmatch(rb"(?:di)?graph(?: [A-Za-z_]\w*)? \{", text[0]) or text[1] != b"}":
        raise Unfit("more than a head and an end")
    opener = text[0] + b"\n"
    g = next(iter(parsers.parse_dot(opener + b"}")))
    link = re.compile(rb'(?:"(?:[^"\\]|\\.)*"|[^"\s]+) (?:->|--) ')

    def parse(run: int, at: int, text: bytes) -> list[dict]:
        if run != 1:
            raise Unfit("elements outside")
        rows = text.split(b"\n")
        links = [r for r in rows if link.match(r)]
        try:
            listed = parsers.parse_dot(opener + b"\n".join(r for r in rows if not link.match(r)) + b"\n}")
            # nodes that only edges name follow the others, and come from the edges
            return [x for x in listed if x["k"] != "g"] + [x for x in parsers.parse_dot(opener + b"\n".join(links) + b"\n}") if x["k"] not in "gn"]
        except GraphError as e:
            raise Unfit(str(e)) from None

    return Plan(g, [a for a, _ in lines], parse, once=True, apart=True)


def _json(format: str, lines: list, options: dict) -> Plan:
    """Element lines begin with a comma, so the first of a run is in the skeleton."""
    texts = [t for _, t in lines]
    at = [a for a, _ in lines]
    marked = {}
    for k in range(1, len(texts)):
        if at[k] == at[k - 1] + 1:
            continue  # no line between these, unless a block ends there
        marked[k] = None
    try:
        plain = json.loads(parsers.decode(b"\n".join(texts)))
    except (ValueError, GraphError):
        raise Unfit("not JSON without its element lines") from None
    if not isinstance(plain, (dict, list)):
        raise Unfit("not a graph")
    dialect = parsers.json_dialect(plain)
    if dialect == "jgf" and "graph" not in plain or isinstance(plain, list):
        raise Unfit("several graphs, or a list")
    paths = {"node-link": [("nodes",), ("links",), ("edges",)], "d3": [("nodes",), ("links",), ("edges",)], "vis": [("nodes",), ("edges",)], "graphology": [("nodes",), ("edges",)], "jgf": [("graph", "nodes"), ("graph", "edges")], "cytoscape": [("elements", "nodes"), ("elements", "edges")]}[dialect]

    def reach(doc, path):
        for p in path:
            doc = doc.get(p) if isinstance(doc, dict) else None
        return doc

    for k in list(marked):  # a mark is an item of a list, or a member of an object
        for m in (f',{{"{MARK}":{k}}}', f',"{MARK}{k}":{{}}'):
            marked[k] = m.encode()
            try:
                json.loads(b"\n".join([*texts[:k], marked[k], *texts[k:]]))
                break
            except ValueError:
                marked[k] = None
        if marked[k] is None:
            del marked[k]
    doc = json.loads(b"\n".join(x for k, t in enumerate(texts) for x in ((marked[k], t) if k in marked else (t,))))
    holder, fixed, shell = {}, [], json.loads(b"\n".join(texts))
    generator = {"node-link": parsers._node_link, "d3": parsers._node_link, "jgf": parsers._jgf, "cytoscape": parsers._cytoscape, "graphology": parsers._graphology, "vis": parsers._vis}[dialect]
    own: dict = {}
    for path in paths:
        items = reach(doc, path)
        if items is None:
            continue
        if not isinstance(items, (list, dict)):
            raise Unfit("no list")
        named, before = isinstance(items, dict), []
        pairs = list(items.items()) if named else [(None, x) for x in items]
        for name, x in pairs:
            k = int(name[len(MARK) :]) if named and name.startswith(MARK) else x[MARK] if isinstance(x, dict) and MARK in x else None
            if k is None:
                before.append((name, x))
                continue
            holder[k] = path, named
            own.setdefault(path, []).append((at[k - 1], before))
            before = []
        own.setdefault(path, []).append(((1 << 42), before))
        reach(shell, path[:-1])[path[-1]] = {} if named else []
    if len(holder) != len(marked):
        raise Unfit("element lines outside the lists of nodes and edges")

    def made(path, named, items) -> list[dict]:
        """The elements of some items of a list, which need nothing of the others."""
        nodes = path[-1] == "nodes"
        for name, x in items:
            if not isinstance(x, dict):
                raise Unfit("an item that is no object")
            d = x.get("data") or {} if dialect == "cytoscape" else x
            if nodes and not named and d.get({"graphology": "key"}.get(dialect, "id")) is None:
                raise Unfit("a node without an id")
            if dialect in ("node-link", "d3", "vis") and (nodes and "key" in x or not nodes and dialect != "vis" and "from" in x and path[-1] == "edges"):
                raise Unfit("a further dialect")
            if dialect in ("node-link", "d3") and not nodes and not numeric and all(isinstance(v, int) for v in (x.get("source", x.get("src", x.get("from"))), x.get("target", x.get("dst", x.get("to"))))):
                raise Unfit("ends that may be places")
            if dialect == "vis" and not nodes and not arrows and "arrows" in x:
                raise Unfit("arrows on some edges")
        own_shell = json.loads(json.dumps(shell))
        reach(own_shell, path[:-1])[path[-1]] = dict(items) if named else [x for _, x in items]
        return [x for x in generator(own_shell, options.get("hyperedges", "star")) if x["k"] != "g"]

    listed = reach(plain, paths[0]) or []
    numeric = dialect in ("node-link", "d3") and any(isinstance(n, dict) and isinstance(n.get("id"), (int, float)) for n in (listed if isinstance(listed, list) else []))
    arrows = dialect == "vis" and any("arrows" in x for x in plain.get("edges") or [])
    if dialect == "graphology" and (plain.get("options") or {}).get("type") is None or dialect == "jgf" and plain["graph"].get("hyperedges"):
        raise Unfit("direction or hyperedges")
    g = next(iter(generator(plain, "star")))
    for path, stretches in own.items():
        for place, items in stretches:
            if items:
                named = items[0][0] is not None
                for i, x in enumerate(made(path, named, items)):
                    fixed.append((place * ROOM + i, x))

    def parse(run: int, at: int, text: bytes) -> list[dict]:
        if run not in holder:
            raise Unfit("element lines outside the lists of nodes and edges")
        path, named = holder[run]
        rows = parsers.decode(text).split("\n")
        try:
            items = [next(iter(json.loads("{" + r[1:] + "}").items())) if named else (None, json.loads(r[1:])) for r in rows]
            if named and any(len(json.loads("{" + r[1:] + "}")) != 1 for r in rows):
                raise Unfit("two members in a line")
        except ValueError:
            raise Unfit("a line that is no whole item") from None
        return made(path, named, items)

    return Plan(g, at, parse, fixed)


def _pajek(format: str, lines: list, options: dict) -> Plan:
    sections = {}
    count = None
    for k, (_, t) in enumerate(lines, 1):
        s = parsers.decode(t).strip()
        if not s or s.startswith("%"):
            sections[k] = sections.get(k - 1)
            continue
        name = s.split()[0].lower()
        if not s.startswith("*") or name not in ("*vertices", "*arcs", "*edges", "*network"):
            raise Unfit("sections of other kinds")
        if name == "*vertices":
            if count is not None or len(s.split()) < 2 or not s.split()[1].isdigit():
                raise Unfit("vertices without a count, or twice")
            count = int(s.split()[1])
        sections[k] = name
    if count is None:
        raise Unfit("no vertices")
    g = next(iter(parsers.parse_pajek(b"\n".join(t for _, t in lines if not t.strip().lower().startswith(b"*vertices")))))

    def parse(run: int, at: int, text: bytes) -> list[dict]:
        rows = [x.strip() for x in parsers.decode(text).splitlines()]
        if len(rows) != text.count(b"\n") + 1 or sections.get(run) not in ("*vertices", "*arcs", "*edges"):
            raise Unfit("lines of other kinds")
        out = []
        for at, row in enumerate(rows, 1):
            c = parsers.pajek_cells(row)
            if sections[run] == "*vertices":
                if not re.fullmatch(r"\d+", c[0]) or not 1 <= int(c[0]) <= count:
                    raise Unfit("a vertex outside the count")
                out.append(parsers.pajek_node(int(c[0]), c[1] if len(c) > 1 else c[0], c))
            else:
                out.append(parsers.pajek_edge(sections[run], at, c, lambda x: bool(re.fullmatch(r"-?\d+", x)) and 1 <= abs(int(x)) <= count))
        return out

    return Plan(g, [a for a, _ in lines], parse, once=True, nodes=count)


def _neo4j(format: str, lines: list, options: dict) -> Plan:
    """The lines that look like headers are the skeleton."""
    if not lines or lines[0][0] != 0:
        raise Unfit("no header in the first line")
    first = parsers.decode(lines[0][1])
    delimiter = parsers.neo4j_delimiter(first)
    heads = [parsers.neo4j_head(next(csv.reader([parsers.decode(t)], delimiter=delimiter), [])) for _, t in lines]
    if not all(heads):
        raise Unfit("a line that looks like a header")

    def parse(run: int, at: int, text: bytes) -> list[dict]:
        out = []
        for k, row in enumerate(csv_rows(parsers.decode(text), delimiter), 1):
            if any(c.strip() for c in row):
                if parsers.neo4j_head(row):
                    raise Unfit("a header over several lines")
                out += parsers.neo4j_row(heads[run - 1], k, row)
        return out

    return Plan({"k": "g", "directed": True, "a": {}}, [a for a, _ in lines], parse, once=True)


def csv_plan(head: str, options: dict) -> Plan:
    """The plan for a CSV document, from its first 64 lines or more."""
    if any(k not in ("nodes", "directed") for k in options):
        raise Unfit("options")
    nodes = options.get("nodes", False)
    directed, delimiter = parsers.csv_direction(head, options.get("directed")), parsers.csv_delimiter(head)
    told = [r for r in csv_rows(head, delimiter, delimiter == " ", True) if any(c.strip() for c in r)]
    if len(told) < 2:
        raise Unfit("less than two rows at the start")
    names, titled = parsers.csv_names(told[0], told[1], nodes)

    def parse(run: int, at: int, text: bytes) -> list[dict]:
        rows = [r for r in csv_rows(parsers.decode(text), delimiter, delimiter == " ", True) if any(c.strip() for c in r)]
        if at == 0 and titled:
            if not rows or rows[0] != told[0]:
                raise Unfit("no header in the first piece")
            rows = rows[1:]
        return [x for k, r in enumerate(rows, 1) for x in parsers.csv_row(names, k, r, nodes)]

    return Plan({"k": "g", "directed": directed, "a": {}}, [], parse)


PLANS = {"neo4j": _neo4j, "json": _json, "gexf": _xml, "graphml": _xml, "gml": _gml, "dot": _dot, "pajek": _pajek}


def plan(format: str, lines: list[tuple[int, bytes]], options: dict) -> Plan:
    """The plan for a document whose lines other than elements are given, in order, with their positions."""
    if len(lines) > LINES or sum(len(t) for _, t in lines) > BYTES:
        raise Unfit("too many lines that aren't elements")
    if lines and lines[0][1].startswith(b"\xef\xbb\xbf"):
        raise Unfit("a byte order mark")
    return PLANS[format](format, lines, options)


# CSV: every line is data; only a quoted line feed ties lines together


def csv_rows(text: str, delimiter: str, blank: bool = False, comments: bool = False) -> list[list[str]]:
    """The rows of a piece; one that ends within quotes is Unfit."""
    over = False

    def lines():
        nonlocal over
        for r in io.StringIO(text, newline=""):
            if not (comments and r[:1] in ("#", "%")):
                yield r
        over = True

    out = []
    reader = csv.reader(lines(), delimiter=delimiter, skipinitialspace=blank)
    try:
        for row in reader:
            if over:
                raise Unfit("quotes over the end of a piece")
            out.append(row)
    except csv.Error as e:
        raise Unfit(str(e)) from None
    return out
