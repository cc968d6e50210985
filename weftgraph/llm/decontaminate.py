"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

Texts are compared by words: runs of letters and digits, the letters A-Z in one case. Every pair of neighbouring words
of an item is a seed. Only places with too few seeds to reach the score are left out: an alignment of LEAST or more of
an item of n words holds (4 LEAST - 1) n / 3 - 1 of its pairs or more, within (2 - LEAST) n words of the text (each gap
between runs of equal words costs a mismatch or a gap, and a run of k words holds k - 1 pairs). So nothing that scores
LEAST is lost, but for items of three words of which only the middle one differs. Seeds that are so close open windows,
wide enough for the item; windows of one item that touch are one. The item is aligned with the window locally
(MATCH, MISMATCH, GAP); the score is divided by that of the item with itself. Edited and shortened copies score lower,
and a score of LEAST or more is a leak.

A benchmark of up to BLOCKS blocks of BLOCK bytes of text is sent to all tasks, a block at a time; documents are read
once for each block, and never shuffled. A larger one stays a table. Its seeds are counted in the documents and each
item keeps its rarest ones: an alignment holds so many of an item's pairs that it holds one of these. They are joined to
the documents' pairs (those that a Bloom filter of all seeds lets through), and each candidate, a document and an item,
is aligned as above. Nothing of such a benchmark reaches the driver but that filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .._ship import ship
from . import _shingles as S
from ._common import Scratch, free_name

U = np.uint64
#: Words of a seed, and of the shortest item.
SEED, SHORTEST, LEAST = 2, 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -2
#: Bytes of benchmark text in a block; a benchmark of more blocks is joined as a table.
BLOCK, BLOCKS = 8 << 20, 4
#: Bits of the filter of seeds, a power of two. Beyond some 10^8 seeds it lets more through, never less.
FILTER = 1 << 29
#: Seeds of texts (times the items they stand in) handled at once.
HITS = 1 << 20


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and its end in the window (exclusive); the first such end of equals."""
    row = np.zeros(len(window) + 1, np.int64)
    slope = -GAP * np.arange(len(window) + 1)
    best, end = 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(window == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def span(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """(score of 0 to 1, start, end): the start is that of the shortest alignment with this end and score."""
    best, end = align(item, window)
    if not best:
        return 0.0, 0, 0
    back, length = align(item[::-1], window[:end][::-1])
    return best / (MATCH * len(item)), end - length, end


@dataclass
class Index:
    """The items of a block: their word hashes, and the sorted seeds. Places first[k] .. first[k + 1] of seed k are the
    items, and the words in them, that it stands at."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def leaks(self, w: S.Words, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, last word + 1) of each leak in a block of texts, words from 0 in the text."""
        if not len(self.seeds):
            return
        g = S.grams(w, SEED)
        at = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
        hits = np.flatnonzero((self.seeds[at] == g) & (g != 0))
        at, text = at[hits], np.searchsorted(w.first, hits, "right") - 1
        total = np.cumsum(self.first[at + 1] - self.first[at])
        a = 0
        while a < len(hits):  # texts whole, as many as have HITS places
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right"))
            b = int(np.searchsorted(text, text[b], "left")) if b < len(hits) else b
            b = b if b > a else int(np.searchsorted(text, text[a], "right"))
            yield from self._aligned(w, hits[a:b], at[a:b], text[a:b], least)
            a = b

    def _aligned(self, w: S.Words, hits: np.ndarray, at: np.ndarray, text: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        count = self.first[at + 1] - self.first[at]
        start = np.cumsum(count) - count
        of = np.arange(count.sum()) - np.repeat(start - self.first[at], count)
        item, place, k, t = self.item[of], self.place[of], np.repeat(hits, count), np.repeat(text, count)
        order = np.lexsort((k, item, t))
        item, place, k, t = item[order], place[order], k[order], t[order]
        # one row for each word of a text that starts a seed of the item; a stretch of `need` rows that is short enough counts
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (item[1:] != item[:-1])
        no, one = np.cumsum(new) - 1, np.flatnonzero(new)
        n = self.lengths[item[one]]
        need = np.maximum(1, np.ceil((4 * least - 1) * n / 3 - 1 - 1e-9).astype(np.int64))
        last = np.minimum(np.arange(len(one)) + need - 1, len(one) - 1)
        fits = (np.arange(len(one)) + need <= len(one)) & (item[one][last] == item[one]) & (t[one][last] == t[one]) & (k[one][last] - k[one] <= np.ceil((2 - least) * n))
        cover = np.zeros(len(one) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(fits), 1)
        np.add.at(cover, last[fits] + 1, -1)
        kept = np.flatnonzero((np.cumsum(cover[:-1]) > 0)[no])
        if not len(kept):
            return
        item, place, k, t = item[kept], place[kept], k[kept], t[kept]
        n = self.lengths[item]
        slack = np.ceil((1 - min(least, 0.5)) * n).astype(np.int64) + 2
        lo, hi = np.maximum(w.first[t], k - place - slack), np.minimum(w.first[t + 1], k - place + n + slack)
        order = np.lexsort((lo, item, t))
        windows: dict[tuple[int, int], list[list[int]]] = {}
        for x, i, a, b in zip(t[order].tolist(), item[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
            own = windows.setdefault((x, i), [])
            if own and own[-1][1] >= a:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        for (x, i), own in windows.items():
            found = max((span(self.items[i], w.hash[a:b]) + (a,) for a, b in own), key=lambda y: (y[0], -y[3]))
            if found[0] >= least:
                base = found[3] - int(w.first[x])
                yield x, i, found[0], base + found[1], base + found[2]

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.items], np.int64)


def _items(rows: list) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
    w = S.words(pa.array([r["text"] for r in rows], pa.large_string()), blank=S.PUNCTUATION)
    g = S.grams(w, SEED)
    cut = lambda x: [x[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return [r["item_id"] for r in rows], cut(w.hash), [x[: len(x) - SEED + 1] if len(x) >= SHORTEST else x[:0] for x in cut(g)]


def index_of(rows: list) -> Index:
    ids, hashes, grams = _items(rows)
    seed = np.concatenate([np.zeros(0, U), *grams])
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(seed, kind="stable")
    seeds, first = np.unique(seed[order], return_index=True)
    return Index(ids, hashes, seeds, np.append(first, len(seed)), item[order], place[order])


def _sized(benchmark: DataFrame, block: int) -> tuple[DataFrame, int]:
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return items, (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block + 1


def indexes(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> Iterator[Index]:
    """An index for each block of the benchmark (item_id, text), one at a time. Items of fewer than SHORTEST words
    can't be found. Null texts are empty, null ids an item of no id; equal items are found each."""
    ship(docs.sparkSession)
    items, blocks = _sized(benchmark, block)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # about BLOCK bytes
        yield index_of(rows)


def _found(x: Index, column: pa.Array, a: int, b: int, least: float) -> Iterator[tuple]:
    """(row, item, score, start, end) of the leaks in rows a .. b of a column, in code points."""
    w = S.words(column, a, b, blank=S.PUNCTUATION)
    for t, item, score, first, last in x.leaks(w, least):
        base, k = int(w.offsets[t]), int(w.first[t])
        points = lambda end: len(w.data[base:end].tobytes().decode())  # noqa: B023, E731
        yield a + t, item, score, points(int(w.start[k + first])), points(int(w.end[k + last - 1]))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, score, start, end): the best alignment of each leaked item in each document, in code points.

    docs has doc_id and text, benchmark item_id and text; ids are of any type. A null text holds no leak. Rows alike
    have leaks alike. A benchmark of more than so many blocks is joined as a table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if _sized(benchmark, block)[1] > blocks:
        out = _joined(docs, benchmark, least)
        return docs.select("doc_id", _key(F.col("text")).alias("key")).join(out, "key").select("doc_id", "item_id", "score", "start", "end")
    kinds = [to_arrow_type(f.dataType) for f in (docs.schema["doc_id"], benchmark.schema["item_id"])] + [pa.float64(), pa.int64(), pa.int64()]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double, start long, end long"
    found = None
    for index in indexes(docs, benchmark, block):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for batch in batches:
                ids, column = batch.column(0), batch.column(1)
                for a, b in S.blocks(column):
                    rows = [(ids[t].as_py(), x.ids[item], *at) for t, item, *at in _found(x, column, a, b, least)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "score", "start", "end"])

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _key(text: Column) -> Column:
    """128 bits of a text."""
    return F.md5(text.cast("binary"))


def _gram_rows(with_places: bool):
    """(key, seed) of the distinct pairs of each text; (key, seed, c, n) for items: places of the pair, words of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for a, b in S.blocks(column):
                w = S.words(column, a, b, blank=S.PUNCTUATION)
                g = S.grams(w, SEED)
                at = np.flatnonzero(g)
                row = np.searchsorted(w.first, at, "right") - 1
                n = np.diff(w.first)[row]
                pair, c = np.unique(np.stack([row.astype(U), g[at]])[:, n >= SHORTEST if with_places else slice(None)], axis=1, return_counts=True)
                of = pair[0].astype(np.int64)
                columns = [keys.take(pa.array(a + of)), pa.array(pair[1].view(np.int64))]
                more = [pa.array(c, pa.int64()), pa.array(np.diff(w.first)[of], pa.int64())] if with_places else []
                yield pa.RecordBatch.from_arrays(columns + more, ["key", "seed", "c", "n"][: 2 + len(more)])

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """(key, item_id, score, start, end) by a join of rare seeds, for each text by its key."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", _key(F.concat(F.to_json(F.struct("item_id")), "text")))
    texts = docs.select(_key(F.col("text")).alias("key"), "text").filter("text is not null").dropDuplicates(["key"])
    seeds = scratch.table(items.select(F.col("item").alias("key"), "text").dropDuplicates(["key"]).mapInArrow(_gram_rows(True), "key string, seed long, c long, n long"), "seeds")
    bits = seeds.select(F.pmod("seed", F.lit(FILTER)).alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 65536).alias("part")).agg(F.collect_list(F.pmod("bit", F.lit(65536)).cast("int")).alias("bits"))
    field = np.zeros(FILTER // 8, np.uint8)
    for row in bits.toLocalIterator():  # 64 MB in all, whatever the benchmark's size
        at = int(row["part"]) * 65536 + np.array(row["bits"], np.int64)
        np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(field)
    rows_of = _gram_rows(False)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in rows_of(batches):
            bit = np.mod(batch.column(1).to_numpy(), FILTER)
            yield batch.filter(pa.array((field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))

    held = scratch.table(texts.mapInArrow(known, "key string, seed long").join(seeds.select("seed").distinct(), "seed", "left_semi"), "held")
    df = held.groupBy("seed").agg(F.count("*").alias("df"))
    # an alignment holds `need` places of pairs of the item: it can do without the rarest as long as the others have so many
    others = F.sum("c").over(Window.partitionBy("key").orderBy(F.desc(F.coalesce("df", F.lit(0))), F.desc("seed")).rowsBetween(Window.unboundedPreceding, 0))
    need = F.greatest(F.lit(1), F.ceil((4 * least - 1) * F.col("n") / 3 - 1 - 1e-9))
    rare = seeds.join(df, "seed", "left").withColumn("others", others).filter((F.col("others") >= need) & (F.col("df") > 0)).select("seed", F.col("key").alias("item"))
    candidates = scratch.table(held.join(rare, "seed").select("key", "item").distinct(), "candidates")
    both = candidates.join(texts, "key").join(items.withColumnRenamed("text", "item_text"), "item").select("key", "item_id", "item_text", "text")
    kind = items.schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x = index_of([{"item_id": batch.column(1)[i].as_py(), "text": batch.column(2)[i].as_py()}])
                rows += [(batch.column(0)[i].as_py(), x.ids[0], *at) for _, _, *at in _found(x, batch.column(3), i, i + 1, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), to_arrow_type(kind), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["key", "item_id", "score", "start", "end"])

    return both.mapInArrow(run, f"key string, item_id {kind.simpleString()}, score double, start long, end long")


def _flags(shared, least: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = np.zeros(len(column), bool)
            for a, b in S.blocks(column):
                for t, *_ in shared.value.leaks(S.words(column, a, b, blank=S.PUNCTUATION), least):
                    out[a + t] = True
            yield pa.array(out)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """The rows of docs (text and any other columns) that hold no leak; a null text holds none."""
    name = free_name(docs, "leaked")
    if _sized(benchmark, block)[1] > blocks:
        gone = _joined(docs, benchmark, least).select(F.col("key").alias(name)).distinct()
        return docs.join(gone, _key(F.col("text")) == F.col(name), "left_anti")
    for index in indexes(docs, benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.withColumn(name, F.arrow_udf(_flags(shared, least), "boolean")(F.col("text"))).filter(~F.col(name)).drop(name)
    return docs
