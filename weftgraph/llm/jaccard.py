"""Documents whose word-shingle sets have a Jaccard similarity of 0.75 or more: an exact join, and its components.

Method: universe-partition pigeonhole. Sets are put into size bands. In a band the universe of shingle hashes is cut
into m segments, and the part of a set in a segment (its segment subset) is one signature. Two sets of sizes x, y
that link differ in at most (x + y) / 7 shingles, so in at most x / 3 segments of the one and of the other.

* Allocation. Every set orders its non-empty segment subsets alike: subsets that are rare in the corpus first, then
  larger ones, then by hash; and takes the x // 3 + 1 cheapest. Were all of the smaller selection's segments
  different, the sets would differ in more than x / 3 shingles; so a linked pair shares a taken signature. Costs are
  counted over all documents (a signature met twice within a task's stretch of documents is counted, the counts
  summed), and the list of frequent signatures has at most FREQUENT entries, the most frequent first. An incomplete
  list makes buckets larger, never loses a link, as both sides use the same one.
* Sets of up to 6 shingles have one segment of value 2: its subset and its one-deletion neighbourhood, as linked sets
  of these sizes differ in one shingle at most. Larger bands use value 1 only, as a deletion neighbourhood of a
  segment multiplies its rows.
* A set also takes part in the next band, if a set there could link with it.
* Verification. Candidates are tested by parity sketches first (each shingle flips one bit; the bits that differ
  can't exceed the shingles that differ, so no link fails), then exactly, on the sets of 64-bit hashes.

What is shuffled for a signature is a row of its hash and a document, so of a text's length; sketches and sets are
joined to distinct candidate pairs. Buckets of up to SMALL documents are paired in full. In a larger one each document
is paired with the least one, and once these pairs are verified, most of the bucket is one component. Buckets that hold
several are gone through again, exactly, in tiles of PIECE documents by PIECE, so a task never holds a whole bucket: each
document against those of the other components. Within a tile one document stands for its component: another is apart
from all of it if their sketches differ by more than a link allows and the component's radius together (differing bits
are a metric). What that costs is the product of documents and components of a bucket; documents are compared one by
one only where components stay near, and only pairs whose sketches are near leave the task.

Signatures that are known to be frequent are dealt by document from the start; exact copies stand for each other.
Components come from star contraction.

Null or empty texts have an empty set and link with nothing. Rows with equal ids are separate rows; if their texts
differ, a link of either counts for the id. Rows without an id link with nothing; one that is an exact copy of a row
with an id has its component, any other none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _shingles as S
from ._common import Scratch, free_name, partitions
from ..operators.components import components

U = np.uint64
#: A signature of more documents than this counts as frequent; at most so many are kept apart (8 bytes each).
OFTEN, FREQUENT = 32, 500_000
#: Buckets up to this size are paired in full; documents or components of a bucket in a tile; shuffled bytes for a task.
SMALL, PIECE, TASK = 8, 1024, 24 << 20
#: Words of the short sketches that the rows of large buckets carry.
SHORT = 16


def _edge(band: np.ndarray) -> np.ndarray:
    """The least size of a band: 1, 7, 16, 32, 64, ..."""
    return np.where(band == 0, 1, np.where(band == 1, 7, 1 << np.minimum(band + 2, 60)))


def _band(size: np.ndarray) -> np.ndarray:
    return np.where(size < 7, 0, np.where(size < 16, 1, np.frexp(np.maximum(size, 1))[1] - 3))


def _segments(band: np.ndarray) -> np.ndarray:
    """Segments of a band, so many that a set has more non-empty ones than it takes (but for one in 10^13)."""
    return np.select([band == 2, band <= 4], [256, 128], 3 << np.maximum(band + 1, 0)).astype(U)


class Sets:
    """Distinct shingle sets of a block of texts."""

    def __init__(self, column: pa.Array, a: int, b: int, size: int):
        self.hash, self.first = S.shingles(S.words(column, a, b), size)
        self.n = np.diff(self.first)
        total = lambda x: np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
        one, two = total(S.mixed(self.hash ^ U(0x5851F42D4C957F2D))), total(S.mixed(self.hash ^ U(0x14057B7EF767814F)))
        self.d1, self.d2 = one[self.first[1:]] - one[self.first[:-1]], two[self.first[1:]] - two[self.first[:-1]]

    def sketch(self, i: int) -> bytes:
        h = self.hash[self.first[i] : self.first[i + 1]]
        bits = 2 << max(5, int(len(h)).bit_length())
        return np.packbits((np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()

    @staticmethod
    def short(sketch: bytes) -> bytes:
        x = np.frombuffer(sketch, U)
        while len(x) > SHORT:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x.tobytes()

    def signatures(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of each signature, signature, size of the subset) for the sets in rows, by turn for own and next band."""
        own = _band(self.n[rows])
        for band, of in ((own, rows), (own + 1, rows)):
            fits = (self.n[of] > 0) & ((band == own) | (4 * self.n[of] >= 3 * _edge(band)))
            of, band = of[fits], band[fits]
            tiny = of[band == 0]
            if len(tiny):
                yield self._neighbourhoods(tiny)
            of, band = of[band > 0], band[band > 0]
            if not len(of):
                continue
            n = self.n[of]
            start = np.concatenate([[0], np.cumsum(n)])
            h = self.hash[np.arange(start[-1]) + np.repeat(self.first[of] - start[:-1], n)]
            segment = np.where(np.repeat(band == 1, n), h, ((h >> U(32)) * np.repeat(_segments(band), n)) >> U(32))
            new = np.ones(len(h), bool)
            new[1:] = segment[1:] != segment[:-1]
            new[start[:-1]] = True
            at = np.flatnonzero(new)
            row = np.searchsorted(start, at, "right") - 1
            sums = np.add.reduceat(S.mixed(h ^ U(0x2545F4914F6CDD1D)), at)
            sig = S.mixed(sums + segment[at] * U(0x9E3779B97F4A7C15) + S.mixed(band[row].astype(U)))
            yield of[row], sig, np.diff(np.append(at, len(h)))

    def _neighbourhoods(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, own = [], []
        for i in rows:
            h = S.mixed(self.hash[self.first[i] : self.first[i + 1]] ^ U(0x2545F4914F6CDD1D))
            sums = np.concatenate([[h.sum(dtype=U)], h.sum(dtype=U) - h])
            out.append(sums[: 1 if len(h) == 1 else None])
            own.append(np.full(len(out[-1]), i))
        own, out = np.concatenate(own), S.mixed(np.concatenate(out))
        return own, out, np.full(len(out), 7)

    def taken(self, rows: np.ndarray, often: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, signature) of the cheapest signatures, as many as each set takes."""
        for row, sig, size in self.signatures(rows):
            rare = ~_within(often, sig)
            cost = np.where(rare, U(0), U(1 << 63)) | ((U(15) - np.minimum(size, 15).astype(U)) << U(59)) | (sig >> U(5))
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            keep = np.zeros(len(row), bool)
            for a, b in zip(starts, np.append(starts[1:], len(row)), strict=True):
                n = int(self.n[row[a]])
                k = n // 3 + 1 if size[a] < 7 or n > 6 else b - a
                if k >= b - a:
                    keep[a:b] = True
                else:
                    keep[a + np.argpartition(cost[a:b], k - 1)[:k]] = True
            yield row[keep], sig[keep]


def _within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fresh(sets: Sets, seen: set) -> np.ndarray:
    """Rows whose set is not in seen, which gets them: exact copies of a task's earlier rows stand back."""
    out = []
    for i in range(len(sets.n)):
        if sets.n[i] and (key := (int(sets.d1[i]), int(sets.d2[i]))) not in seen:
            seen.add(key)
            out.append(i)
    return np.array(out, np.int64)


def _least(sets: Sets, doc: np.ndarray, least: dict) -> np.ndarray:
    """Rows whose id is less than that of every earlier copy of their set in the task: of the copies in a block the one
    of least id. The least id of all copies is so among them, whatever the order and the split of the rows."""
    best: dict = {}
    for i in np.flatnonzero(sets.n):
        key = (int(sets.d1[i]), int(sets.d2[i]))
        if doc[i] < least.get(key, np.inf):
            least[key] = int(doc[i])
            best[key] = i
    return np.array(sorted(best.values()), np.int64)


def _describe(size: int):
    """doc_id, n, digest, sketches; the last row of each stretch also carries the signatures met twice in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        stretch: list[np.ndarray] = []

        def counted() -> list:
            sig, c = np.unique(np.concatenate(stretch), return_counts=True) if stretch else (np.zeros(0, U), np.zeros(0, int))
            stretch.clear()
            return [(int(s), int(k)) for s, k in zip(sig[c > 1].view(np.int64), c[c > 1], strict=True)]

        def rows(ids: pa.Array, sets: Sets, often: list) -> pa.RecordBatch:
            sketch = [sets.sketch(i) if sets.n[i] else b"" for i in range(len(sets.n))]
            last = [None] * (len(ids) - 1) + [[{"sig": a, "c": b} for a, b in often] or None]
            return pa.RecordBatch.from_arrays([ids, pa.array(sets.n, pa.int64()), _signed(sets.d1), _signed(sets.d2), pa.array(sketch, pa.binary()), pa.array([Sets.short(x) for x in sketch], pa.binary()), pa.array(last, pa.list_(pa.struct([("sig", pa.int64()), ("c", pa.int64())])))], ["doc_id", "n", "d1", "d2", "sketch", "short", "often"])

        held = None
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in S.blocks(column):
                sets = Sets(column, a, b, size)
                if held:
                    yield rows(*held, counted() if sum(map(len, stretch)) > 2_000_000 else [])
                stretch += [sig for _, sig, _ in sets.signatures(_fresh(sets, seen))]
                held = (ids.slice(a, b - a), sets)
        if held:
            yield rows(*held, counted())

    return run


def _sign(size: int, often):
    """(key, sig, doc, twin): taken signatures. A signature's first document in a block goes to its bucket by the
    signature; the others of the block, and all of frequent ones, have a twin for certain and are dealt out by document. Of exact copies
    those that come down to the least id are signed; the rows of any but the least are dropped later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, least = often.value, {}
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in S.blocks(column):
                sets = Sets(column, a, b, size)
                got = list(sets.taken(_least(sets, ids[a:b], least), rare))
                if not got:
                    continue
                row, sig = (np.concatenate(x) for x in zip(*got, strict=True))
                _, first, back, count = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
                direct = np.ones(len(sig), bool)
                direct[first] = False
                direct |= _within(rare, sig)
                doc = ids[a:b][row]
                key = np.where(direct, S.mixed(doc.astype(np.int64).view(U) + sig), sig)
                out = pa.RecordBatch.from_arrays([_signed(key), _signed(sig), pa.array(doc, pa.int64()), pa.array(direct | (count[back] > 1))], ["key", "sig", "doc", "twin"])
                for at in range(0, len(sig), 100_000):
                    yield out.slice(at, 100_000)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose signature has a twin: told by the flag, or met again in this partition."""
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        key, twin = t["key"].to_numpy(), t["twin"].to_numpy()
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.concatenate([[False], k[1:] == k[:-1]])
        met = np.zeros(len(k), bool)
        met[order] = same | np.concatenate([same[1:], [False]])
        out = t.filter(pa.array(met | twin)).select(["sig", "doc"])
        yield from out.to_batches(100_000)


class Sketches:
    """The sketches and sizes of a table's rows; a sketch's length is a power of two words."""

    def __init__(self, column: pa.ChunkedArray, n: np.ndarray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.start, self.words = at[:-1] // 8, np.diff(at) // 8
        self.data = np.frombuffer(data, U, count=int(at[-1]) // 8)
        self.n = n

    def folded(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        """Rows whose sketches have so many words, folded on themselves until they have `to`."""
        x = self.data[self.start[rows][:, None] + np.arange(words)]
        while words > to:
            words //= 2
            x = x[:, :words] ^ x[:, words:]
        return x

    def differ(self, other: Sketches) -> np.ndarray:
        """Bits that differ, row by row, at the length of the shorter sketch."""
        out = np.zeros(len(self.n), np.int64)
        kind = self.words * 1_000_000 + other.words
        for k in np.unique(kind):
            wi, wj = divmod(int(k), 1_000_000)
            rows, to = np.flatnonzero(kind == k), min(wi, wj)
            step = max(1, 200_000 // max(wi, wj))
            for a in range(0, len(rows), step):
                r = rows[a : a + step]
                out[r] = np.bitwise_count(self.folded(r, wi, to) ^ other.folded(r, wj, to)).sum(axis=1, dtype=np.int64)
        return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of rows that can still link, by size and by the bits that differ."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        x, y = (Sketches(t[f"sketch_{k}"], t[f"n_{k}"].to_numpy()) for k in "ab")
        ok = 4 * np.minimum(x.n, y.n) >= 3 * np.maximum(x.n, y.n)
        ok &= 7 * x.differ(y) <= x.n + y.n
        yield batch.select(["a", "b"]).filter(pa.array(ok))


class Pairs:
    """Distinct pairs (a, b), a < b, gathered by a task."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            p = np.sort(np.stack([a, b]), axis=0)
            self.parts.append(p[:, p[0] != p[1]])
            self.size += p.shape[1]
            if self.size > 500_000:
                self.parts, self.size = [self.distinct()], 0

    def distinct(self) -> np.ndarray:
        p = np.concatenate(self.parts, axis=1)
        order = np.lexsort(p[::-1])
        p = p[:, order]
        return p[:, np.concatenate([[True], (p[:, 1:] != p[:, :-1]).any(axis=0)])] if p.shape[1] else p

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            p = self.distinct()
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])


def _runs(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    k = np.stack([t[c].to_numpy() for c in keys])
    return np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [t.num_rows]])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each bucket, from rows sorted by bucket."""
    found = Pairs()
    held: pa.Table | None = None

    def runs(t: pa.Table, cuts: np.ndarray) -> None:
        doc, size = t["doc"].to_numpy(), np.diff(cuts)
        for k in np.unique(size[size > 1]):
            at = cuts[:-1][size == k]
            i, j = np.triu_indices(int(k), 1)
            found.add(doc[(at[:, None] + i).ravel()], doc[(at[:, None] + j).ravel()])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        cuts = _runs(t, ["leader", "sig"])
        runs(t, cuts[:-1])
        held = t.slice(int(cuts[-2])).combine_chunks()
    if held is not None and held.num_rows:
        runs(held, np.array([0, held.num_rows]))
    yield from found.batches()


def _close(x: Sketches, p: np.ndarray, q: np.ndarray, more: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in p and q of the rows that can link, where row q stands for rows of sizes least to most that differ
    from it by `more` bits at most."""
    out = []
    for w in np.unique(x.words[p]):
        own = np.flatnonzero(x.words[p] == w)
        for v in np.unique(x.words[q]):
            to = min(int(w), int(v))
            other = np.flatnonzero(x.words[q] == v)
            far = x.folded(q[other], int(v), to)
            step = max(1, 500_000 // (len(other) * to))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                n = x.n[p[part]][:, None]
                apart = np.bitwise_count(x.folded(p[part], int(w), to)[:, None, :] ^ far[None, :, :]).sum(axis=2, dtype=np.int32)
                ok = 7 * (apart - more[other]) <= n + np.minimum(most[other], n * 4 // 3)
                i, j = np.nonzero(ok & (3 * n <= 4 * most[other]) & (3 * least[other] <= 4 * n))
                out.append((part[i], other[j]))
    return tuple(np.concatenate(k) for k in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _tile(x: Sketches, doc: np.ndarray, component: np.ndarray, c: np.ndarray, targets: np.ndarray, probes: np.ndarray, found: Pairs) -> None:
    """The near pairs of a tile's probes with its targets of other components, of which the larger one is the target's."""
    if not len(targets) or not len(probes):
        return
    # members with sketches of one length, as only these have distances to each other that hold at any length
    targets = targets[np.lexsort((doc[targets], x.words[targets], component[targets]))]
    kind = np.stack([component[targets], x.words[targets]])
    first = np.concatenate([[0], np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1])
    size = np.diff(np.append(first, len(targets)))
    pivot = targets[first]
    apart = np.zeros(len(targets), np.int64)
    for w in np.unique(x.words[targets]):
        at = np.flatnonzero(x.words[targets] == w)
        stands = np.repeat(pivot, size)[at]
        apart[at] = np.bitwise_count(x.folded(targets[at], int(w), int(w)) ^ x.folded(stands, int(w), int(w))).sum(axis=1, dtype=np.int64)
    radius, least, most = np.maximum.reduceat(apart, first), np.minimum.reduceat(x.n[targets], first), np.maximum.reduceat(x.n[targets], first)
    i, j = _close(x, probes, pivot, radius, least, most)
    p, q = probes[i], pivot[j]
    turn = (component[p] != component[q]) & ((c[p] < c[q]) | ((c[p] == c[q]) & (component[p] < component[q])))
    i, j = i[turn], j[turn]
    for k in np.unique(j):
        rows, own = targets[first[k] : first[k] + size[k]], probes[i[j == k]]
        a, b = _close(x, own, rows, np.zeros(len(rows), np.int64), x.n[rows], x.n[rows])
        found.add(doc[own[a]], doc[rows[b]])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_tile for rows sorted by tile."""
    held: pa.Table | None = None
    found = Pairs()

    def runs(t: pa.Table) -> None:
        x = Sketches(t["short"], t["n"].to_numpy())
        target, doc, component, c = (t[k].to_numpy(zero_copy_only=False) for k in ("target", "doc", "component", "c"))
        cuts = _runs(t, ["sig", "pt", "tt"])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            _tile(x, doc, component, c, lo + np.flatnonzero(target[lo:hi]), lo + np.flatnonzero(~target[lo:hi]), found)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        last = int(_runs(t, ["sig", "pt", "tt"])[-2])
        if last:
            runs(t.slice(0, last).combine_chunks())
        held = t.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        runs(held)
    yield from found.batches()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in S.blocks(column):
                s = Sets(column, a, b, size)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([s.hash[s.first[i] : s.first[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["doc", "set"])

    return run


def _verify(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = int(_within(q, p).sum())
                keep.append(100 * both >= similarity * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have the similarity, counted exactly."""
    ids = pairs.select(F.col("a").alias("id_")).union(pairs.select("b")).distinct()
    sets = docs.join(ids, docs["doc_id"] == ids["id_"], "left_semi").mapInArrow(_sets(size), "doc long, set binary")
    one, two = sets.select(F.col("doc").alias("a"), F.col("set").alias("s")), sets.select(F.col("doc").alias("b"), F.col("set").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(_verify(similarity), "a long, b long").distinct()


def _sketched(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the sketches."""
    of = lambda c: reps.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id long, text; others are left aside)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ship(spark)
    similarity = 75
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = scratch.table(docs.mapInArrow(_describe(size), "doc_id long, n long, d1 long, d2 long, sketch binary, short binary, often array<struct<sig:long,c:long>>"), "sets")
    listed = told.filter("often is not null").select(F.explode("often").alias("o")).groupBy("o.sig").agg(F.sum("o.c").alias("c")).filter(F.col("c") > OFTEN).orderBy(F.desc("c"), "sig").limit(FREQUENT)
    often = np.sort(np.array([r[0] for r in listed.select("sig").collect()], np.int64).view(U))
    copies = told.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = scratch.table(told.select("doc_id", "n", "d1", "d2").join(copies, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep"), "classes")
    ids = classes.filter("doc_id = rep").select("doc_id").distinct()
    reps = scratch.table(told.join(ids, "doc_id", "left_semi").filter("n > 0").select(F.col("doc_id").alias("doc"), "n", "sketch", "short").dropDuplicates(["doc", "n"]), "reps")

    total = told.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(spark), int(total * 0.45 * 33) // TASK + 1)
    shared = spark.sparkContext.broadcast(often)
    signed = docs.filter("doc_id is not null").mapInArrow(_sign(size, shared), "key long, sig long, doc long, twin boolean")
    rows = scratch.table(signed.repartition(parts, "key").mapInArrow(_shared, "sig long, doc long"), "shared")
    scratch.keep_only(reps, classes, rows)
    rows = rows.join(reps.select("doc").distinct(), "doc", "left_semi")
    by = rows.groupBy("sig").agg(F.min("doc").alias("leader"), F.count("*").alias("k")).filter("k > 1")
    rows = scratch.table(rows.join(by, "sig"), "buckets")
    scratch.keep_only(reps, classes, rows)

    # a leader's small buckets meet in one task, no more of them than it has signatures
    many = max(partitions(spark), rows.count() * 40 // TASK + 1)
    dealt = rows.filter(F.col("k") <= SMALL).repartition(many, "leader").sortWithinPartitions("leader", "sig", "doc")
    stars = rows.filter((F.col("k") > SMALL) & (F.col("doc") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    pairs = dealt.select("leader", "sig", "doc").mapInArrow(_small, "a long, b long").unionByName(stars).distinct()
    pairs = scratch.table(_sketched(pairs, reps), "pairs")

    # a forest first: one pair a document at most, which joins most near copies
    forest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.table(verified(docs, forest, size, similarity), "links")
    where = components(links, scratch)
    rest = _between(pairs.join(forest, ["a", "b"], "left_anti"), where)
    more = scratch.table(verified(docs, rest, size, similarity), "links")
    links = links.unionByName(more)
    where = scratch.table(components(links, scratch), "components")

    crossed = _crossing(rows.filter(F.col("k") > SMALL), where, reps, many, scratch)
    if crossed is not None:
        crossed = scratch.table(_sketched(crossed.join(pairs, ["a", "b"], "left_anti"), reps), "crossed")
        more = scratch.table(verified(docs, crossed, size, similarity), "links")
        if more.limit(1).count():
            where = scratch.table(components(links.unionByName(more), scratch), "components")
    out = classes.join(where.withColumnRenamed("node", "rep"), "rep", "left")
    out = scratch.table(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")), "result")
    scratch.keep_only(out)
    return out


def _crossing(large: DataFrame, where: DataFrame, reps: DataFrame, many: int, scratch: Scratch) -> DataFrame | None:
    """Candidate pairs (a, b) of large buckets (sig, doc, k) that hold several components; None if no bucket does."""
    large = large.join(where.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = large.groupBy("sig", "component").agg(F.count("*").alias("c"))
    several = sizes.groupBy("sig").agg(F.count("*").alias("parts")).filter("parts > 1")
    mixed = scratch.table(large.join(several, "sig").select("sig", "doc", "k", "component"), "mixed")
    if not mixed.limit(1).count():
        return None
    counts = mixed.groupBy("sig", "component").agg(F.count("*").alias("c"))
    rows = mixed.join(counts, ["sig", "component"]).join(reps.select("doc", "n", "short"), "doc")
    tiles = F.floor(F.col("k") / PIECE)
    place = F.pmod(F.xxhash64("doc"), tiles + 1)
    every = F.explode(F.sequence(F.lit(0).cast("long"), tiles))
    columns = ["sig", "pt", "tt", "target", "doc", "component", "c", "n", "short"]
    targets = rows.withColumns({"tt": place, "pt": every, "target": F.lit(True)}).select(columns)
    probes = rows.withColumns({"pt": place, "tt": every, "target": F.lit(False)}).select(columns)
    dealt = targets.unionByName(probes).repartition(many, "sig", "pt", "tt").sortWithinPartitions("sig", "pt", "tt")
    return dealt.mapInArrow(_cross, "a long, b long").distinct()


def _between(pairs: DataFrame, where: DataFrame) -> DataFrame:
    """The pairs of different components."""
    of = lambda c: where.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) but near duplicates: of each component the document of
    least id stays, once if its row is repeated. Rows without an id or without words all stay."""
    found = near_duplicates(docs, size).filter("doc_id is not null and n_shingles > 0")
    told = found.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n")).filter("gone or n > 1")
    id_ = free_name(docs, "id_")
    told = told.select(F.col("doc_id").alias(id_), "gone")
    left = docs.join(told.filter("gone").select(id_), docs["doc_id"] == F.col(id_), "left_anti")
    again = told.filter("not gone").select(id_)
    if not again.limit(1).count():
        return left
    once = left.join(again, left["doc_id"] == F.col(id_), "left_anti")
    more = left.join(again, left["doc_id"] == F.col(id_), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more)
