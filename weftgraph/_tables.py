"""Tables in the cluster's shared folder, and dense row numbers without a global window."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import GraphError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a session in one process has a local folder; on a cluster
    that would lose data, and is E_INVALID_ARGUMENT."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise GraphError("E_INVALID_ARGUMENT", "spark.checkpoint.dir names no folder that all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


class Scratch:
    """Tables in the shared folder that cut the lineage of a query.

    A table survives the loss of any executor. `drop` frees one as soon as what was derived from it has been
    written; the rest goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def append(self, df: DataFrame, at: str) -> DataFrame:
        """Add rows to the table at a path of this scratch, and read it: for state that only grows."""
        df.write.mode("append").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            self._delete(x._scratch_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Drop all other tables, and have the driver's JVM let go of shuffles that no plan refers to any more."""
        kept = {x._scratch_path.rsplit("/", 1)[1] for x in tables}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM has gone first; the folder is the cluster's to clean
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str, scratch: Scratch, start: int = 0) -> DataFrame:
    """df with a dense LONG column: the place of each row in the given order, from start.

    Rows are range-partitioned by the order, sorted within tasks and written to the shared folder; a row's number is
    its place in its file plus the rows of the files before. Only one count a file reaches the driver. The order has
    to be total for reruns to agree. Written files don't change, so a lost executor renumbers nothing.
    """
    at = scratch.path(name)
    df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    part = F.regexp_extract("__file", "part-([0-9]+)", 1).cast("int")
    counts = {r["part"]: r["n"] for r in back.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    offsets, total = [], start
    for i in range(max(counts) + 1):
        offsets.append(total)
        total += counts.get(i, 0)
    return back.select(*df.columns, (F.lit(offsets).cast("array<long>")[part] + F.col("__row")).cast("long").alias(name))


def running_sum(values: DataFrame, key: str, value: str, name: str, cells: int = 4096) -> DataFrame:
    """values with the sum of `value` over the rows up to each, in the order of a LONG key that is 0 .. n - 1.

    Sums are taken within cells of the key, and shifted by a table of one row a cell.
    """
    size = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(values.count()) / cells))
    cell = values.withColumn("__cell", F.floor(F.col(key) / size))
    sums = cell.groupBy("__cell").agg(F.sum(value).alias("__s"))
    shift = sums.select("__cell", F.coalesce(F.sum("__s").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    run = F.sum(value).over(Window.partitionBy("__cell").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return cell.join(shift, "__cell").withColumn(name, run + F.col("__shift")).drop("__cell", "__shift")
