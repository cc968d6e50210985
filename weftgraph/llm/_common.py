"""What the training-data operators share: table access, tables in the cluster's shared folder, column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._tables import Scratch, partitions, shared_dir

__all__ = ["Scratch", "free_name", "let", "partitions", "read", "running", "shared_dir", "word_count"]

#: A word is a run of anything but these blanks, in every operator.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: a lambda's body would compute it anew at each use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(lengths: Column, chunk: int = 128) -> Column:
    """For each of an array of ints, the sum of those before it. Sums are taken within chunks, and over chunks, so that
    long arrays take no square of their length."""
    none = F.array().cast("array<int>")
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def within(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda k: F.slice(x, k * chunk + 1, chunk))

        def shifted(c: Column) -> Column:
            before = let(F.transform(c, total), lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, 1, k))))
            inner = lambda part, base: F.transform(part, lambda _, i: base + total(F.slice(part, 1, i)))
            return F.flatten(F.zip_with(c, before, inner))

        return let(chunks, shifted)

    return let(lengths, lambda x: F.when(F.size(x) > 0, within(x)).otherwise(none))
