"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A fingerprint is the sum of wide vectors hashed from a text's paragraphs (its lines, empty ones too; an empty text has
none), each lane modulo a power of two. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its
vector: `combine`. Two parts:

* EXACT lanes of 64 bits, uniform, for equality: a BLAKE2b digest of each paragraph.
* NEAR lanes of 32 bits, for likeness: a paragraph's vector is the sum of +1/-1 vectors of its pieces. A piece ends
  after a word whose hash is 0 modulo CUT, so pieces follow the content, not the position. The mean square of a lane
  estimates the number of pieces, that of a difference the pieces by which two texts differ (an AMS sketch).

The likeness of two fingerprints is 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0: near 1 for small edits, about a half
if half of the pieces are shared, near 0 for texts with nothing in common; exactly 1 for equal ones. A lane wraps around
after 2^31 repetitions of a piece, so for a text of some 10 GB.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _shingles as S
from ._common import partitions

U = np.uint64
EXACT, NEAR, CUT = 8, 128, 4
#: Bytes of text for each range of ids at most, about; a task sorts what falls into its ranges, spilling if need be.
RANGE = 1 << 30
#: Ids sampled for each range, to place its bounds. The driver holds 16 bytes for each (32 MB for 100 TB of text).
SAMPLES = 20


class Fingerprint:
    """Vectors of the texts of a column: exact (uint64), near (uint16)."""

    def __init__(self, texts: list[bytes]):
        column = pa.array([t.decode() for t in texts], pa.large_string())
        self.exact = np.zeros((len(texts), EXACT), U)
        self.near = np.zeros((len(texts), NEAR), np.uint32)
        for i, t in enumerate(texts):
            for line in t.split(b"\n") if t else []:
                self.exact[i] += _exact(line)
        for a, b in S.blocks(column):
            self.near[a:b] = _near_lanes(S.words(column, a, b, lower=False))

    def text(self, i: int) -> str:
        return base64.b64encode(self.exact[i].tobytes() + self.near[i].tobytes()).decode()


def _exact(line: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(line, digest_size=8 * EXACT).digest(), U)


def _near_lanes(w: S.Words) -> np.ndarray:
    out = np.zeros((len(w), NEAR), np.uint32)
    if not len(w.hash):
        return out
    line = np.concatenate([[0], np.cumsum(w.data == 10)])[w.start]
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.hash[:-1] % U(CUT) == 0) | (line[1:] != line[:-1])
    new[w.first[:-1][np.diff(w.first) > 0]] = True
    at = np.flatnonzero(new)
    place = np.arange(len(w.hash)) - np.repeat(at, np.diff(np.append(at, len(w.hash))))
    step = S.mixed(place.astype(U) + U(1)) | U(1)
    piece = S.mixed(np.add.reduceat(w.hash * step, at))
    doc = np.searchsorted(w.first, at, "right") - 1
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for k in range(NEAR // 64):
        bits = np.unpackbits(S.mixed(piece + U(k * 0x1234567)).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        count = np.diff(np.append(starts, len(doc)))
        out[doc[starts], 64 * k : 64 * k + 64] = (2 * ones.astype(np.int64) - count[:, None]).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of near lanes, row by row."""
    square = lambda x: (x.astype(np.int32).astype(np.float64) ** 2).sum(axis=1)
    apart, whole = square(a - b), square(a) + square(b)
    return np.where(apart == 0, 1.0, np.clip(1 - apart / np.maximum(whole, 1), 0, 1))


def combine(fingerprint: str, paragraph: str, sign: int = 1) -> str:
    """The fingerprint after a paragraph is inserted (sign 1) or deleted (-1)."""
    raw = base64.b64decode(fingerprint)
    line, lanes = _exact(paragraph.encode()), Fingerprint([paragraph.encode()]).near[0]
    exact, near = np.frombuffer(raw[: 8 * EXACT], U), np.frombuffer(raw[8 * EXACT :], np.uint32)
    exact, near = (exact + line, near + lanes) if sign > 0 else (exact - line, near - lanes)
    return base64.b64encode(exact.tobytes() + near.tobytes()).decode()


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with a column of the fingerprints of its texts (null: that of an empty text, all zero)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [(x or "").encode() for x in column.to_pylist()]
            f = Fingerprint(texts)
            yield pa.array([f.text(i) for i in range(len(texts))], pa.string())

    return docs.withColumn(into, F.arrow_udf(run, "string")(F.col(text)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, a range's halo last; each but a halo with the next one of its range."""
    held: dict | None = None
    for batch in batches:
        ids, buckets, halo = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        column = batch.column(3)
        for a, b in S.blocks(column) if len(column) else []:
            rows = [] if held is None else [held]
            texts = column.slice(a, b - a).to_pylist()
            rows += [{"id": i, "bucket": k, "halo": h, "text": t or ""} for i, k, h, t in zip(ids[a:b], buckets[a:b], halo[a:b], texts, strict=True)]
            yield from _edited(rows)
            held = rows[-1]


def _edited(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x["halo"] and x["bucket"] == y["bucket"]]
    if not pairs:
        return
    texts = [x["text"].encode() for x in rows]
    own = Fingerprint(texts)
    at = {id(x): i for i, x in enumerate(rows)}
    edited = []
    for x, y in pairs:
        n = len(x["text"])
        edited.append((x["text"][: n - n // 2] + y["text"][: n // 2]).encode())
    e = Fingerprint(edited)
    i, j = np.array([at[id(x)] for x, _ in pairs]), np.array([at[id(y)] for _, y in pairs])
    near_e, near_n = likeness(own.near[i], e.near), likeness(own.near[i], own.near[j])
    same = (own.exact[i] == e.exact).all(axis=1), (own.exact[i] == own.exact[j]).all(axis=1)
    yield pa.RecordBatch.from_arrays(
        [pa.array([x["id"] for x, _ in pairs], pa.int64()), pa.array([len(x["text"]) for x, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array([own.text(k) for k in i]), pa.array([e.text(k) for k in range(len(pairs))])]
        + [pa.array(np.where(s, 1.0, np.minimum(v, np.nextafter(1, 0)))) for s, v in zip(same, (near_e, near_n), strict=True)],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def against_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document, descending doc_id.

    docs has doc_id and text; other columns are left aside. The edited text has its last floor(n / 2) code points
    replaced by the first as many of the next document's; the last document's next is the first. A null id comes
    last; rows of equal id are ordered by a hash of the text. A single row is next to itself. No rows: no rows.

    Rows are cut into ranges by id and then text, at quantiles of a sample taken by hash (SAMPLES for a range of RANGE
    bytes); each range is sorted within a task, and the first row of the following range is sent along as its halo. So
    each text is shuffled once, and no task sees more than its ranges. Rows alike in id and text are in one range.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumns({"low": F.coalesce("doc_id", F.lit(-(1 << 63))), "mark": F.xxhash64("text")})
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(4 * partitions(spark), (size or 0) // RANGE + 1)
    every = max(1, rows // (SAMPLES * n))
    sample = keyed.filter(F.pmod(F.xxhash64("low", "mark"), F.lit(every)) == 0).select("low", "mark").toArrow()
    low, mark = sample["low"].to_numpy(), sample["mark"].to_numpy()
    order = np.lexsort((mark, low))[::-1]
    at = order[np.unique(np.arange(1, n) * len(order) // n)] if len(order) else order
    cuts = list(dict.fromkeys(zip(low[at].tolist(), mark[at].tolist(), strict=True)))
    # how many cuts lie above a row: first among every `step`-th, then among the next `step`
    step = max(1, math.isqrt(len(cuts)))
    key = F.struct(F.col("low").alias("i"), F.col("mark").alias("t"))
    above = lambda c: F.size(F.filter(c, lambda x: key < x))
    coarse = above(_table(cuts[step - 1 :: step]))
    fine = F.get(_tables([cuts[a : a + step] for a in range(0, len(cuts) + 1, step)]), coarse)
    rows = keyed.withColumn("bucket", (coarse * step + F.coalesce(above(fine), F.lit(0))).cast("int"))
    # the first row of each range that has any, by id and then text
    heads = rows.groupBy("bucket").agg(F.max(key).alias("head")).orderBy("bucket").toArrow().to_pylist()
    first: list = [(0, 0)] * (len(cuts) + 1)
    before: list = [-1] * (len(cuts) + 1)
    for k, h in enumerate(heads):
        first[h["bucket"]] = (h["head"]["i"], h["head"]["t"])
        before[h["bucket"]] = heads[k - 1]["bucket"]
    is_head = key == F.get(_table(first), F.col("bucket"))
    halo = F.when(is_head, F.get(F.from_json(F.lit(json.dumps(before)), "array<int>"), F.col("bucket")))
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("halo")), F.when(halo >= 0, F.struct(halo.alias("b"), F.lit(True).alias("halo")))))
    dealt = rows.select("doc_id", "text", "low", "mark", F.explode(places).alias("p")).select("doc_id", F.col("p.b").alias("bucket"), F.col("p.halo").alias("halo"), "text", "low", "mark")
    # within a range the head's halo comes after all its rows
    dealt = dealt.repartition(max(partitions(spark), (size or 0) // RANGE + 1), "bucket").sortWithinPartitions("bucket", "halo", F.desc("low"), F.desc("mark"))
    return dealt.select("doc_id", "bucket", "halo", "text").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _table(cuts: list) -> Column:
    """Keys as a constant array, by way of a text: one literal however many there are."""
    return F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, t in cuts])), "array<struct<i:bigint,t:bigint>>")


def _tables(cuts: list) -> Column:
    return F.from_json(F.lit(json.dumps([[{"i": i, "t": t} for i, t in x] for x in cuts])), "array<array<struct<i:bigint,t:bigint>>>")
