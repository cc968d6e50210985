"""Streams of edge events, run to the end of what is there."""

import datetime as dt
import os

from weftgraph.plans.builder import GraphBuilder
from weftgraph.streaming import edges

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in os.listdir(f"{tmp_path}/in/{i}"):  # batches follow the files' times
            os.utime(f"{tmp_path}/in/{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def finish(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_windows_and_late_rows(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [[(1, "a", at(0)), (1, "a", at(0)), (2, "a", at(30))], [(3, "b", at(200))], [(7, "b", at(210))], [(4, "a", at(5)), (5, "b", at(400))], [(6, "b", at(800))]]
    s = stream(spark, tmp_path, rows, "k long, node string, ts timestamp")
    once = {(r["k"]) for r in finish(edges.distinct_edges(s, "k", "ts").select("k"), tmp_path, "once")}
    assert {1, 2, 3, 5, 6} <= once
    got = {(r["start"], r["node"]): r["degree"] for r in finish(edges.degree_over_time(s, "node", "ts"), tmp_path, "degrees")}
    assert got[(T0, "a")] == 3 and got[(at(180), "b")] == 2


def test_transitions(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [[("u", "x", at(0)), ("u", "y", at(1)), ("v", "x", at(1))], [("u", "x", at(2))]]
    s = stream(spark, tmp_path, rows, "node string, page string, ts timestamp")
    got = sorted((r["node"], r["source"], r["target"]) for r in finish(edges.transitions(s, "node", "page", "ts"), tmp_path, "moves"))
    assert got == [("u", "x", "y"), ("u", "y", "x")]


def test_growing_graph(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", "b", 0)], [("b", "c", 1)]], "s string, t string, o int")
    b, counts = GraphBuilder(spark, "string"), []
    run = edges.grow(b, "s", "t", ["o"], then=lambda g, _: counts.append((g.node_count(), g.edge_count())))
    s.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert counts == [(2, 1), (3, 2)]
