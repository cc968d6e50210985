"""Containment: children, roots, depth and preorder from a parent column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._tables import Scratch, numbered


def parent_edges(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """(idx, parent) of valid references: an index of the table, other than the row's own. An array column names
    several parents."""
    many = nodes.schema[parent].dataType.typeName() == "array"
    flat = nodes.select("idx", (F.explode(parent) if many else F.col(parent)).alias("parent")).filter("parent is not null and parent <> idx").distinct()
    return flat.join(nodes.select(F.col("idx").alias("parent")), "parent", "left_semi").select("idx", "parent")


def children(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """(parent, child, place): children of each parent, ascending."""
    return parent_edges(nodes, parent).select("parent", F.col("idx").alias("child"), (F.row_number().over(Window.partitionBy("parent").orderBy("idx")) - 1).alias("place"))


def child_count(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    by = parent_edges(nodes, parent).groupBy(F.col("parent").alias("idx")).agg(F.count("*").alias("children"))
    return nodes.select("idx").join(by, "idx", "left").na.fill({"children": 0})


def parent_count(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    by = parent_edges(nodes, parent).groupBy("idx").agg(F.count("*").alias("parents"))
    return nodes.select("idx").join(by, "idx", "left").na.fill({"parents": 0})


def roots(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """(idx) without a valid parent."""
    return nodes.select("idx").join(parent_edges(nodes, parent).select("idx").distinct(), "idx", "left_anti")


def depth_first(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """(place, idx, depth): preorder from the roots by index, children ascending; each node once, at the first of its
    paths; nodes that no root reaches come last, by index, at depth 0.

    A level at a time: a node's path is its parent's with its own index. Preorder is the order of paths.
    """
    scratch = Scratch(nodes.sparkSession)
    e = scratch.table(parent_edges(nodes, parent), "parents")
    level = scratch.table(roots(nodes, parent).select("idx", F.array("idx").alias("path")), "level")
    levels = [level]
    while True:
        below = e.join(level.withColumnRenamed("idx", "parent"), "parent").filter(~F.array_contains("path", F.col("idx")))
        level = scratch.table(below.groupBy("idx").agg(F.min(F.concat("path", F.array("idx"))).alias("path")), "level")
        if not level.limit(1).count():
            break
        levels.append(level)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    best = every.groupBy("idx").agg(F.min("path").alias("path"))
    rest = nodes.select("idx").join(best, "idx", "left_anti").select("idx", F.lit(None).cast("array<long>").alias("path"))
    ranked = best.unionByName(rest).withColumn("__late", F.col("path").isNull())
    placed = numbered(ranked, ["__late", "path", "idx"], "place", scratch)
    return placed.select("place", "idx", F.coalesce(F.size("path") - 1, F.lit(0)).alias("depth"))


def reachable_count(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    """(idx, reachable): the nodes below each, itself included, each once."""
    scratch = Scratch(nodes.sparkSession)
    e = scratch.table(parent_edges(nodes, parent), "parents")
    found = scratch.table(nodes.select("idx", F.col("idx").alias("below")), "reach")
    fresh = found
    while True:
        step = fresh.join(e.select(F.col("parent").alias("below"), F.col("idx").alias("next")), "below").select("idx", F.col("next").alias("below")).distinct()
        fresh = scratch.table(step.join(found, ["idx", "below"], "left_anti"), "fresh")
        if not fresh.limit(1).count():
            break
        found = scratch.table(found.unionByName(fresh), "reach")
    return found.groupBy("idx").agg(F.count("*").alias("reachable"))
