"""Edge-event streams with Structured Streaming (an extension: files and batches are the model's own input).

Everything here takes a streaming or a batch DataFrame. Late rows beyond the watermark are dropped by Spark, which is
the meaning of a watermark; state is bounded by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.builder import GraphBuilder


def distinct_edges(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Each edge event once by its key, within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def degree_over_time(events: DataFrame, node: str, time: str, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, end, node, degree): edge events of each node in tumbling or sliding windows."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    by = events.withWatermark(time, delay).groupBy(w.alias("w"), F.col(node).alias("node")).agg(F.count("*").alias("degree"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "node", "degree")


def sessions(events: DataFrame, node: str, time: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, end, node, events): runs of a node's events with no gap as long."""
    by = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), F.col(node).alias("node")).agg(F.count("*").alias("events"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "node", "events")


TRANSITION = "node string, source string, target string, time timestamp"


def transitions(events: DataFrame, node: str, state: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """(node, source, target, time): an edge for each change from a node's state to its next one, in order of time.

    A node's last state is kept for an hour of event time beyond the watermark, then forgotten.
    """
    rows = events.select(F.col(node).cast("string").alias("node"), F.col(state).cast("string").alias("state"), F.col(time).alias("time"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last = held.get[0] if held.exists else None
        found = pd.concat(list(frames)).sort_values("time", kind="stable")
        out = []
        for s, t in zip(found["state"], found["time"], strict=True):
            if last is not None:
                out.append((key[0], last, s, t))
            last = s
        held.update((last,))
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), int(found["time"].max().timestamp() * 1000)) + 3_600_000)
        yield pd.DataFrame(out, columns=["node", "source", "target", "time"])

    return rows.withWatermark("time", delay).groupBy("node").applyInPandasWithState(step, TRANSITION, "last string", "append", "EventTimeTimeout")


def grow(builder: GraphBuilder, source: str, target: str, order: list[str], weight: str | None = None, then: Callable[[Graph, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for `foreachBatch`: it adds each batch's edges to a builder and hands the frozen graph on.

    Numbers of nodes and edges of earlier batches stay, as a freeze keeps the order of addition. A batch that is
    delivered again is skipped.
    """
    seen: set[int] = set()

    def run(batch: DataFrame, number: int) -> None:
        if number in seen:
            return
        builder.add_edges(batch.select(F.col(source).alias("source"), F.col(target).alias("target"), *[c for c in dict.fromkeys([*order, *([weight] if weight else [])])]), order, weight)
        seen.add(number)
        if then:
            then(builder.freeze()[0], number)

    return run
