"""Parsers, writers and scalar functions."""

import json
import math

import pytest
from pyspark.sql import functions as F
from weftgraph.errors import GraphError
from weftgraph.functions import text as T
from weftgraph.graph import Graph
from weftgraph._tables import Scratch
from weftgraph.sources import formats, parsers, sinks, split

FILES = {
    "csv": ("a.csv", "Source,Target,Weight,Type,Label\na,b,1.5,Directed,x\nb,c,,Undirected,\n,c,1,Directed,\nc,d,x,Directed,\nc,d,Infinity,Directed,y\n"),
    "json": ("a.json", json.dumps({"directed": True, "multigraph": False, "graph": {}, "nodes": [{"id": 1, "name": "n"}, {"id": 2}], "links": [{"source": 1, "target": 2, "weight": 2}]})),
    "gexf": ("a.gexf", '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="age" type="integer"><default>4</default></attribute></attributes><nodes><node id="a" label="A"><attvalues><attvalue for="0" value="7"/></attvalues></node><node id="b"/></nodes><edges><edge id="0" source="a" target="b" weight="2.5"/></edges></graph></gexf>'),
    "graphml": ("a.graphml", '<graphml><key id="k" for="node" attr.name="age" attr.type="int"/><graph edgedefault="undirected"><node id="a"><data key="k">3</data><graph><node id="in"/></graph></node><node id="b"/><edge source="a" target="b"/><hyperedge id="h"><endpoint node="a"/><endpoint node="b"/><endpoint node="in"/></hyperedge></graph></graphml>'),
    "gml": ("a.gml", 'graph [ directed 0 node [ id 1 label "a &amp; b" graphics [ x 1 y 2 ] ] node [ id 2 ] edge [ source 1 target 2 weight 1.5 ] ]'),
    "dot": ("a.dot", 'strict digraph { node [color=red] a -> {b c}; a -> b [weight=2]; subgraph cluster_1 { d } d:p -> a /* x */ }'),
    "pajek": ("a.net", '*Vertices 3\n1 "a b" 0.1 0.2\n2 "b" [1-5,7-*]\n*Arcs\n1 2 3\n*Edges\n2 3\n*Arcslist\n1 2 3\n*Matrix\n0 1 0\n0 0 2\n0 0 0\n'),
    "neo4j": ("a.csv", "userId:ID(User),:LABEL,age:int,joined:date,tags:string[]\nu1,A;B,3,2020-01-02,x;y\nu2,A,bad,,\n:START_ID(User),:END_ID(User),:TYPE,since:int\nu1,u2,KNOWS,2001\n"),
}


def kinds(format):
    out = list(parsers.PARSERS[format](FILES[format][1].encode()))
    return [[x for x in out if x["k"] == k] for k in "gnei"]


def test_parsers():
    g, n, e, i = kinds("csv")
    assert g[0]["directed"] and [(x["s"], x["t"], x["w"], x["d"]) for x in e] == [("a", "b", 1.5, True), ("b", "c", None, False), ("c", "d", math.inf, True)] and [x["code"] for x in i] == ["blank-endpoint", "bad-weight"]
    g, n, e, i = kinds("json")
    assert n[0] == {"k": "n", "id": 1, "a": {"name": "n"}} and e[0]["w"] == 2.0
    g, n, e, i = kinds("gexf")
    assert [x["a"].get("age") for x in n] == [7, 4] and e[0]["w"] == 2.5
    g, n, e, i = kinds("graphml")
    assert not g[0]["directed"] and {x["id"]: x["a"].get("parent") for x in n} == {"a": None, "in": "a", "b": None, "h": None} and len(e) == 4
    g, n, e, i = kinds("gml")
    assert n[0]["a"] == {"label": "a & b", "position": [1.0, 2.0, 0.0]} and e[0]["w"] == 1.5
    g, n, e, i = kinds("dot")
    assert [x["id"] for x in n] == ["a", "b", "c", "cluster_1", "d"] and n[0]["a"]["color"] == "red" and n[4]["a"]["parent"] == "cluster_1"
    assert [(x["s"], x["t"], x["w"]) for x in e] == [("a", "b", 2.0), ("a", "c", None), ("d", "a", None)] and e[2]["a"]["sourcePort"] == "p" and i[0]["code"] == "strict-merge"
    g, n, e, i = kinds("pajek")
    assert n[0]["a"]["position"] == [0.1, 0.2, 0.0] and n[1]["a"]["spells"] == [[1.0, 5.0], [7.0, math.inf]]
    assert [(x["s"], x["t"], x["w"], x["d"]) for x in e] == [(1, 2, 3.0, True), (2, 3, None, False), (1, 2, None, True), (1, 3, None, True), (1, 2, 1.0, True), (2, 3, 2.0, True)]
    g, n, e, i = kinds("neo4j")
    assert n[0]["a"]["labels"] == ["A", "B"] and n[0]["a"]["tags"] == ["x", "y"] and n[0]["a"]["age"] == 3 and e[0]["a"]["since"] == 2001 and i[0]["code"] == "bad-value"


@pytest.mark.parametrize(("doc", "dialect", "edges"), [
    ({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": 0, "target": 1}]}, "d3", [("a", "b")]),
    ({"graph": {"nodes": {"a": {"label": "A"}, "b": {}}, "edges": [{"source": "a", "target": "b"}]}}, "jgf", [("a", "b")]),
    ({"elements": [{"data": {"id": "a"}}, {"data": {"id": "b"}}, {"data": {"id": "e", "source": "a", "target": "b"}}]}, "cytoscape", [("a", "b")]),
    ({"nodes": [{"key": "a", "attributes": {"x": 1}}, {"key": "b"}], "edges": [{"key": "e", "source": "a", "target": "b"}]}, "graphology", [("a", "b")]),
    ({"nodes": [{"id": 1}, {"id": 2}], "edges": [{"from": 1, "to": 2}]}, "vis", [(1, 2)]),
    ({"directed": False, "multigraph": False, "nodes": [{"id": 1}], "links": []}, "node-link", []),
])
def test_json_dialects(doc, dialect, edges):
    assert parsers.json_dialect(doc) == dialect
    assert [(x["s"], x["t"]) for x in parsers.parse_json(json.dumps(doc).encode()) if x["k"] == "e"] == edges


@pytest.mark.parametrize(("format", "data"), [("json", b"{"), ("json", b"\xff"), ("gexf", b"<a/>"), ("gexf", b"<gexf"), ("graphml", b"<graphml/>"), ("gml", b"graph [ node [ id 1 "), ("gml", b"x"), ("dot", b"digraph { a -- b }"), ("dot", b"digraph { a "), ("dot", b"hello"), ("neo4j", b"a,b\n1,2\n"), ("csv", b"\xff\xfe")])
def test_malformed(format, data):
    with pytest.raises(GraphError) as e:
        list(parsers.PARSERS[format](data))
    assert e.value.code == "E_IMPORT"


@pytest.mark.parametrize("format", sorted(FILES))
def test_sniff_and_read(spark, tmp_path, format):
    name, text = FILES[format]
    (tmp_path / name).write_text(text)
    assert parsers.sniff(text.encode(), name)[0][0] == format
    found = formats.read(spark, str(tmp_path / name))
    _, n, e, i = kinds(format)
    assert found.format == format and found.issues.count() == len(i)
    ends = {x["id"] for x in n} | {v for x in e for v in (x["s"], x["t"])}
    assert found.graph.node_count() == len(ends)
    mixed = {x["d"] for x in e} == {True, False}
    assert found.graph.edge_count() == len(e) + (sum(x["d"] is False and x["s"] != x["t"] for x in e) if mixed else 0)


@pytest.fixture(scope="module")
def sample(spark):
    nodes = spark.createDataFrame([(0, 'a "q"', "x<y", 1.5), (1, "b, c", None, None), (2, "d", "z", 2.0)], "idx long, id string, label string, score double")
    edges = spark.createDataFrame([(0, 0, 1, 1.5, 3), (1, 1, 0, None, None), (2, 1, 1, 2.0, 4), (3, 0, 1, 0.1, 5)], "e long, src long, dst long, w float, n int")
    return Graph(nodes, edges, True, True)


@pytest.mark.parametrize("format", ["csv", "json", "gexf", "graphml", "gml", "dot", "neo4j", *sinks.DIALECTS])
def test_round_trip(spark, tmp_path, sample, format):
    (tmp_path / "x").write_text(sinks.join_text(sample, format))
    g = formats.read(spark, str(tmp_path / "x"), format.split("-")[0]).graph
    assert g.directed
    got = [(r["src"], r["dst"], r["w"], r["n"]) for r in g.edges.orderBy("e").collect()]
    assert got == [(r["src"], r["dst"], r["w"], r["n"]) for r in sample.edges.orderBy("e").collect()]
    if format != "csv":
        assert g.node_count() == 3 and [r["score"] for r in g.nodes.orderBy("idx").collect()] == [1.5, None, 2.0]
    if format not in ("graphml", "gml"):
        assert [r["id"] for r in g.nodes.orderBy("idx").limit(2).collect()] == ['a "q"', "b, c"]


def test_attributes_of_any_name():
    names = ("id", "id_", "s", "t", "w", "d", "k", "a", "label", "parent", "kind", "type")
    doc = {"nodes": [{"key": "a", "attributes": dict.fromkeys(names, "x")}], "edges": [{"source": "a", "target": "a", "attributes": dict.fromkeys(names, "x")}]}
    n, e = (next(x for x in parsers.parse_json(json.dumps(doc).encode()) if x["k"] == k) for k in "ne")
    assert set(n["a"]) == set(e["a"]) == set(names)
    jgf = {"graph": {"nodes": {"a": {"metadata": {"label": "x"}}}, "edges": []}}
    assert [x["a"] for x in parsers.parse_json(json.dumps(jgf).encode()) if x["k"] == "n"] == [{"label": "x"}]


def test_loss_checks(spark, sample):
    codes = lambda f: {c for c, _ in sinks.check(sample, f)}
    assert codes("csv") == {"node-attributes", "isolated-nodes"} and codes("graphml") == {"ids"} and codes("pajek") == {"attributes", "ids"} and codes("gexf") == set()
    assert [r["id"] for r in sinks.sanitized_ids(sample, "a-z_").orderBy("idx").collect()] == ["a__q_", "b__c", "d"]
    with pytest.raises(GraphError):
        sinks.sanitized_ids(sample, "a-z", mangle=False)
    with pytest.raises(GraphError):
        sinks.check(sample, "none")


def test_container(spark, tmp_path, sample):
    sinks.write_container(sample, f"{tmp_path}/c")
    g = formats.read_container(spark, f"{tmp_path}/c", "full")
    assert sorted(map(str, g.edges.collect())) == sorted(map(str, sample.edges.collect()))
    for p in (tmp_path / "c" / "manifest").glob("part-*"):
        p.write_text(p.read_text().replace('"edges": 4', '"edges": 5'))
    for p in (tmp_path / "c" / "manifest").glob(".*.crc"):
        p.unlink()
    with pytest.raises(GraphError) as e:
        formats.read_container(spark, f"{tmp_path}/c")
    assert e.value.code == "E_BAD_SERIALIZATION"


def test_edge_list_and_registry(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,w\n1,2,3\n2,,1\n2,3,x\n2,3,\n")
    got = formats.read_edge_list(spark, str(tmp_path / "e.csv"), weight="w")
    assert got.graph.edge_count() == 2 and sorted(r["code"] for r in got.issues.collect()) == ["bad-weight", "blank-endpoint"]
    formats.register("pairs", lambda data: iter([{"k": "e", "s": a, "t": b, "w": None, "d": None, "a": {}} for a, b in (x.split() for x in data.decode().splitlines())]))
    (tmp_path / "p").write_text("a b\nb c\n")
    assert "pairs" in formats.formats() and formats.read(spark, str(tmp_path / "p"), "pairs").graph.edge_count() == 2
    with pytest.raises(GraphError):
        formats.read(spark, str(tmp_path / "p"), "nothing")


def test_text_functions(spark):
    cases = {"1": "i32", "01": "string", "-0": "f64", "+1": "f64", "1e400": "string", "1.0": "f64", "true": "bool", "2147483648": "f64", "1\n": "string", "": "string", "00.5": "string", ".5": "f64"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(T.infer_dtype(k) == v for k, v in cases.items())
    assert df.filter(T.infer_dtype_col(F.col("t")) != F.col("want")).count() == 0
    assert T.widen("bool", "f64") == "f64" and df.select(T.widest_col(F.col("t"))).first()[0] == "string"
    assert [T.canonical_id(x) for x in ("12", "-0", "012", "9007199254740992")] == [12, "-0", "012", "9007199254740992"]
    assert T.coerce_id(True) is None and T.coerce_id(2.0) == 2 and T.coerce_id("x", "number") is None and T.coerce_id(1.5, "string") == "1.5"
    assert T.parse_weight(" ") == (None, True) and T.parse_weight("NaN") == (None, False) and T.parse_weight("-inf") == (-math.inf, True)
    assert [T.number_text(x) for x in (1.0, 1e21, 1.5e-7, 0.1, 1e-6, 123456.5)] == ["1", "1e+21", "1.5e-7", "0.1", "0.000001", "123456.5"]
    assert T.f32_text(0.1) == "0.1" and T.f32_text(3.0) == "3"
    for t in ("2020-02-29", "1969-12-31T23:59:59.5Z", "0001-01-01"):
        assert T.parse_temporal(T.format_temporal(T.parse_temporal(t))) == T.parse_temporal(t)
    assert T.parse_temporal("2021-02-29") is None and T.parse_temporal("2020-01-01T24:00:00Z") == T.parse_temporal("2020-01-02") and T.parse_time("24:00:01") is None
    times = spark.createDataFrame([("2020-02-29",), ("1969-12-31T23:59:59Z",), ("12.5",), ("x",)], "t string")
    assert [r[0] for r in times.select(T.parse_temporal_col(F.col("t"))).collect()] == [T.parse_temporal("2020-02-29"), -1000.0, 12.5, None]
    for items in (["a", "b"], ["a, b", 'q"x'], [" x "], []):
        assert T.split_list(T.join_list(items)) == items
    assert T.parse_intervals("[1-5,7-*]") == [(1, 5), (7, math.inf)] and T.format_intervals([(1, 5), (7, math.inf), (3, 3)]) == "[1-5,7-*,3]" and T.parse_intervals("[5-1]") is None
    got = spark.createDataFrame([("[1-5,7-*]",)], "t string").select(T.parse_intervals_col(F.col("t"))).first()[0]
    assert [tuple(x) for x in got] == [(1, 5), (7, math.inf)]
    assert T.quote_csv('a"b') == '"a""b"' and T.escape_xml("a<&\x00") == "a&lt;&amp;" and T.quote_dot("node") == '"node"' and T.decode_gml(T.quote_gml("é<&")[1:-1]) == "é<&"
    assert T.mangle_nmtoken("a b") == "a_x20_b" and T.is_nmtoken("a.b") and T.unique_name("x", {"x", "x#2"}) == "x#3" and T.parse_point("POINT(1 2)") == [1.0, 2.0]

    def mix(x):
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        return x ^ x >> 16

    values = [0, 1, 12345, 2**32 - 1]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(T.lowbias32_col(F.col("v"))).collect()] == [mix(v) for v in values]


def _listed(rows):
    """What a graph is made of: nodes and edges in their order, and the graph's own element."""
    return [[(r["id"], r["target"], r["weight"], r["directed"], r["attrs"]) for r in rows.filter(F.col("kind") == k).orderBy("seq").collect()] for k in "gne"]


@pytest.fixture(scope="module")
def many(spark):
    """300 nodes with odd labels, 900 edges with an attribute and some weights left out."""
    nodes = spark.range(300).select(F.col("id").alias("idx"), F.concat(F.lit('n "'), F.col("id")).alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("x<y", "a, b", "c;", "[d]", "{e},", "é")]), (F.col("id") % 6 + 1).cast("int")).alias("label"))
    edges = spark.range(900).select(F.col("id").alias("e"), (F.col("id") % 300).alias("src"), (F.col("id") * 7 % 300).alias("dst"), F.when(F.col("id") % 5 != 0, F.col("id") / 4).cast("float").alias("w"), (F.col("id") % 11).cast("int").alias("n"))
    return Graph(nodes, edges, True, True)


@pytest.mark.parametrize("format", [*sinks.WRITERS, *sinks.DIALECTS])
def test_pieces_are_the_whole(spark, tmp_path, many, monkeypatch, format, directed=True):
    """A document of several parts, in blocks that cut it anywhere, gives what its text gives as a whole."""
    sinks.write(many.with_(directed=directed), f"{tmp_path}/x", format)
    monkeypatch.setattr(formats, "WHOLE", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        kind = format.split("-")[0]
        got = formats._in_pieces(spark, f"{tmp_path}/x/part-*", kind, True, Scratch(spark))
        whole = _listed(formats.elements(spark, f"{tmp_path}/x/part-*", kind, True))
        found = _listed(got)
        if kind == "csv":  # the direction follows from the edges' own
            whole, found = whole[1:], found[1:]
        assert found == whole and len(whole[-1]) == 900
        assert formats.read(spark, f"{tmp_path}/x/part-*", kind, parts=True).graph.directed == directed or kind == "neo4j"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("format", "text"), [
    ("csv", 'source,target,note\na,b,"x\ny"\n' + "a,b,c\n" * 40), ("json", json.dumps({"nodes": [{"id": 1}], "links": []}, indent=1)), ("json", '{"nodes":[\n{"id":"a"}\n,{"id":"b"}\n],"links":[\n{"source":0,"target":1}\n,{"source":1,"target":0}\n]}'),
    ("gexf", "<gexf><graph><nodes>\n<node id='a'>\n<nodes>\n<node id='b'/>\n</nodes></node></nodes></graph></gexf>"), ("graphml", '<graphml><graph><!--\n<node id="a"/>\n--><node id="b"/></graph></graphml>'),
    ("gml", 'graph [ comment "\nnode [ id 1 ]\n" node [ id 2 ] ]'), ("dot", 'digraph {\n"a" -> "b";\n"a" [x=1];\n}'), ("dot", 'digraph {\n"a" [x=1];\n"a" [y=1];\n}'), ("pajek", '*Vertices 3\n1 "a"\n*Arcs\n1 3\n'), ("neo4j", ":ID\na\na\n"),
])
def test_unfit_documents_are_read_whole(spark, tmp_path, monkeypatch, format, text):
    (tmp_path / "x").write_text(text)
    monkeypatch.setattr(formats, "WHOLE", 0)

    def tell():
        g = formats.read(spark, str(tmp_path / "x"), format, parts=True).graph
        return [sorted(map(str, t.collect())) for t in (g.nodes, g.edges)]

    got = tell()
    monkeypatch.setattr(formats, "WHOLE", 1 << 40)
    assert got == tell()
