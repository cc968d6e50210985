"""Mixing sources to target weights by weighted fair queueing.

Every document is queued, in an order shuffled by a hash, behind the earlier documents of its own source. It
finishes at the virtual time (words of its source up to and including it) / (target of its source). The queue is
replayed once for each permitted repeat. Sorting all entries by virtual finish time and cutting the sequence at
the total budget gives each source its target, short of a document.

Nothing here needs all rows of a source in one task. Running sums are taken within (source, hash bucket), and a
table of at most BUCKETS rows a source shifts them. The cut is found by two histograms of the finish time, each of
at most BUCKETS + 1 rows, and only the entries of one cell of the second are ordered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, free_name, word_count

#: Cells of the shuffle order and of each histogram.
BUCKETS = 4096
#: Weights by the rank of a source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def row_key(doc_id: Column, text: Column) -> Column:
    """The place in the shuffled order: the same on every run, whatever the partitioning."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, ratio: float, repeats: int, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, size) per document -> (source, rank, source_size, target).

    The budget is ratio * all sizes, shared by weight; no target passes repeats * source_size, and what is cut off
    is shared again by weight. That is filling to a level: sources sorted by cap / weight meet it in this order.
    One row a source from here on.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    w = ranked.withColumn("weight", F.element_at(listed, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = w.select("*", ((F.sum("source_size").over(whole).cast("double") * ratio - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"))
    met = level.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    return met.select("source", "rank", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), "cap").alias("target"))


def mix(docs: DataFrame, ratio: float = 1.5, repeats: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, row_key, source, size, source_size, target, copies, taken), a row for each row of docs.

    docs has doc_id, text and source. A null or empty text has size 0 and is never taken. A null source is a
    source of its own, last in rank. Rows that are alike in doc_id, text and source are separate documents; which
    of them is taken is immaterial, as their results differ in nothing else. No rows: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("row_key")), "sizes")
    targets = scratch.table(source_targets(rows, ratio, repeats, weights), "targets")
    cell = F.conv(F.substring("row_key", 1, 3), 16, 10).cast("int")
    rows = rows.withColumn("cell", cell % BUCKETS)
    by_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_cell.select(F.col("source").alias("s_"), F.col("cell").alias("c_"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("source", "cell").orderBy("row_key").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("run", F.sum("size").over(within))
    queued = queued.join(shift, F.col("source").eqNullSafe(F.col("s_")) & (F.col("cell") == F.col("c_"))).withColumn("at", F.col("run") + F.col("shift"))
    t = targets.select(F.col("source").alias("t_"), "rank", "source_size", "target")
    queued = queued.join(t, F.col("source").eqNullSafe(F.col("t_"))).select("doc_id", "row_key", "source", "rank", "size", "source_size", "target", "at")
    queued = scratch.table(queued, "queued")

    turns = F.explode(F.array(*[F.lit(k) for k in range(repeats)]))
    entry = queued.filter("size > 0").select("rank", "row_key", "size", "at", "target", "source_size", turns.alias("turn"))
    entry = entry.select("rank", "row_key", "size", "turn", finish(F.col("turn")).alias("finish"))
    budget = float(targets.agg(F.sum("source_size")).first()[0] or 0) * ratio
    scratch.keep_only(queued)
    low, width, left = 0.0, 1.0 / BUCKETS, budget
    for _ in range(2):
        bin_ = F.least(F.lit(BUCKETS * 2), F.floor((F.col("finish") - F.lit(low)) / F.lit(width))).cast("int")
        hist = entry.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("bin")))
        over = hist.filter(F.col("upto") > F.lit(left)).orderBy("bin").select("bin", "words", "upto").limit(1).collect()
        if not over:
            low, entry = None, entry.limit(0)
            break
        k, words, upto = over[0]
        entry, left = entry.filter(bin_ == k), left - (upto - words)
        below, low, width = low + k * width, low + k * width, width / BUCKETS
        if k == BUCKETS * 2:  # the last cell is open above
            width = None
            break
    if low is None:
        cut = None
    else:
        last = Window.orderBy("finish", "rank", "row_key", "turn").rowsBetween(Window.unboundedPreceding, 0)
        cut = entry.withColumn("run", F.sum("size").over(last)).filter(F.col("run") > F.lit(left)).orderBy("run", "finish", "rank", "row_key", "turn").select("finish", "rank", "row_key", "turn").limit(1).collect()
        cut = cut[0] if cut else None
    place = [(finish(F.lit(k)), k) for k in range(repeats)]
    first_out = None if cut is None else F.struct(F.lit(cut[0]).alias("a"), F.lit(cut[1]).alias("b"), F.lit(cut[2]).alias("c"), F.lit(cut[3]).alias("d"))
    taken = [F.lit(1) if first_out is None else (F.struct(f.alias("a"), F.col("rank").alias("b"), F.col("row_key").alias("c"), F.lit(k).alias("d")) < first_out).cast("int") for f, k in place]
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(sum(taken[1:], taken[0]))
    return queued.select("doc_id", "row_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def finish(turn: Column) -> Column:
    """Virtual finish time of a queued document in its source's given turn."""
    return (F.col("at") + turn * F.col("source_size")).cast("double") / F.col("target")


def mix_documents(docs: DataFrame, ratio: float = 1.5, repeats: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it (0 to repeats times), with its turn.

    Texts are shuffled once, to meet the result of `mix` by row_key and source. Rows alike in doc_id, text and source
    share the copies of all of them evenly, the remainder going to the first by a hash of all their columns; they meet
    in one task, which sorts them.
    """
    key, src, many, rows, n = (free_name(docs, x) for x in ("mix_key", "mix_source", "mix_copies", "mix_rows", "mix_n"))
    turn = free_name(docs, "mix_turn")
    plan = mix(docs, ratio, repeats, weights).groupBy(F.col("row_key").alias("k_"), F.col("source").alias("s_")).agg(F.sum("copies").alias("copies_"), F.count("*").alias("rows_")).filter("copies_ > 0")
    own = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).withColumn(src, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    plan = plan.select(F.col("k_").alias(key), F.coalesce(F.concat(F.lit("="), "s_"), F.lit("")).alias(src), F.col("copies_").alias(many), F.col("rows_").alias(rows))
    hit = own.join(plan, [key, src]).withColumn(n, F.row_number().over(Window.partitionBy(key, src).orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]))))
    share = F.floor(F.col(many) / F.col(rows)) + (F.col(n) <= F.col(many) % F.col(rows)).cast("int")
    return hit.withColumn(many, share).filter(F.col(many) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*docs.columns, turn)
