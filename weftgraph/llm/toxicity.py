"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: letters lose case and accents (accented letters of a word that is not otherwise disguised keep their base
letter), Cyrillic and Greek look-alikes become Latin, and digits or signs that stand for letters within a word become
these. Lexicon entries are words, and beginnings and ends of words, marked by a blank at their outer side; a text is
folded to its words with blanks between, so one automaton finds them all. A word counts once, by its heaviest entry,
and not at all within an exception phrase.

The lexicon's entries and weights are learned: an entry's weight is the log of how much more often it occurs in toxic
than in other training texts, and it must be significant after correction for the number of candidates. A text's score
is a logistic function of two sums over its words, one as it is and one for a thousand words (the normalisation by
length); its three coefficients are fitted on the same rows.

Training uses at most TRAINING_ROWS labelled rows (a stated bound: those of least hash), and the lexicon has at most
LEXICON entries. Scoring covers every text as a whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _shingles as S

TRAINING_ROWS, LEXICON = 20_000, 5_000
#: Lengths of beginnings and ends of words that can be entries; least support of an entry.
AFFIXES, SUPPORT = (4, 5, 6), 5
#: Least share of toxic texts among those with an entry.
PRECISION = 0.85
THRESHOLD = 0.7
#: Cyrillic and Greek letters and the Latin ones they look like.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡӏαβεικνορτυχ", "abekmhopctyxijsdgiabeikvoptux")
#: Digits and signs that stand for letters within a word.
LEET = str.maketrans("013457@$!", "oieastasi")
#: Phrases in which a word of the lexicon isn't meant.
EXCEPTIONS = ("trash can", "trash bin", "recycle bin trash", "clown fish", "class clown", "pond scum", "sore loser", "stupid question", "oxymoron")
_WORD = re.compile(r"[^\W_](?:[\w@$!]*[^\W_])?")
_DISGUISED = re.compile(r"(?<=[^\W\d_])[0-9@$!]|[0-9@$!](?=[^\W\d_])")


def folded_words(text: str) -> list[str]:
    """The folded words of a text, in order. Bare numbers stay as they are."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)
    return [w.translate(LEET) if _DISGUISED.search(w) else w for w in _WORD.findall(text)]


def units(word: str) -> list[str]:
    """The possible entries that a word holds."""
    out = [f" {word} "]
    for n in AFFIXES:
        if len(word) > n:
            out += [f" {word[:n]}", f"{word[-n:]} "]
    return out


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for e, w in model.entries.items():
            self.automaton.add_word(e, (0, len(e), w, e[0] == " ", e[-1] == " "))
        for p in model.exceptions:
            e = " " + " ".join(folded_words(p)) + " "
            held = self.automaton.get(e, None)
            self.automaton.add_word(e, (1, len(e), held[2] if held else 0.0, True, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weight(self, text: str | None) -> tuple[float, int]:
        """The summed weights of a text's words, and the number of its words."""
        words = folded_words(text or "")
        if not words or not len(self.automaton):
            return 0.0, len(words)
        line = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (kind, n, w, head, _) in self.automaton.iter(line):
            start = end - n + 1
            if kind:
                spared.append((start, end))
            if w:
                at = start if head else line.rfind(" ", 0, start)  # a word is known by the blank before it
                best[at] = max(best.get(at, 0.0), w)
        if spared:  # both by place, so one sweep finds the words that start within a phrase
            spared.sort()
            k, reach, kept = 0, -1, 0.0
            for at in sorted(best):
                while k < len(spared) and spared[k][0] <= at:
                    reach = max(reach, spared[k][1])
                    k += 1
                kept += 0.0 if at < reach else best[at]
            return kept, len(words)
        return sum(best.values()), len(words)

    def score(self, text: str | None) -> float:
        return float(logistic(np.array([features(*self.weight(text))]), self.model.coefficients)[0])


def features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / max(words, 50))


def logistic(x: np.ndarray, c: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-(c[0] + x @ np.array(c[1:]))))


def held_out(doc_id) -> F.Column:
    """Whether a row's label is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in S.blocks(batch.column(1)):
            out = [sorted({u for w in set(folded_words(t or "")) for u in units(w)}) for t in batch.column(1).slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.list_(pa.string()))], ["toxic", "units"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, entries: int = LEXICON, exceptions: tuple = EXCEPTIONS) -> Model:
    """A model from labelled texts: docs (doc_id, text) and labels (doc_id, toxic; null: no label).

    Rows of the held-out third are never used. Of equal texts with one label, one is used; likewise of texts alike in
    the least hash of their words, so that a group of near copies is one text. Without texts of both labels, the
    lexicon is empty and the score is that of the share of toxic ones.
    """
    ship(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    least = F.array_min(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").withColumn("alike", least)
    texts = texts.groupBy("alike", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("toxic", "text").persist()
    try:
        counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = counts.get(1, 0), counts.get(0, 0)
        if not n1 or not n0:
            return Model({}, (math.log((n1 + 0.5) / (n0 + 0.5)), 0.0, 0.0), exceptions)
        per = texts.mapInArrow(_folding, "toxic int, units array<string>").select("toxic", F.explode("units").alias("unit"))
        df = per.groupBy("unit").agg(F.sum("toxic").alias("c1"), F.count("*").alias("c")).filter(F.col("c1") >= min(SUPPORT, max(2, n1 // 4))).cache()
        tried = df.count()
        p1, p0 = (F.col("c1") + 0.5) / (n1 + 1), (F.col("c") - F.col("c1") + 0.5) / (n0 + 1)
        # likelihood ratio of the toxic share among the texts with the entry, against the share among all
        share, base = F.col("c1") / F.col("c"), n1 / (n1 + n0)
        g = F.col("c1") * F.log(share / base) + F.when(F.col("c") > F.col("c1"), (F.col("c") - F.col("c1")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        need = math.log(max(tried, 1) / 0.01)
        chosen = df.withColumn("w", F.log(p1 / p0)).filter((share > PRECISION) & (g > need) & (F.col("w") > 1)).orderBy(F.desc(g), "unit").select("unit", "w").limit(entries).collect()
        df.unpersist()
        model = Model({r["unit"]: float(r["w"]) for r in chosen}, exceptions=exceptions)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.matcher()
            for batch in batches:
                found = [features(*m.weight(t)) for a, b in S.blocks(batch.column(1)) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], ["toxic", "x1", "x2"])

        got = texts.mapInArrow(weigh, "toxic int, x1 double, x2 double").toPandas()  # two numbers for each training row
    finally:
        texts.unpersist()
    model.coefficients = _fit(got[["x1", "x2"]].to_numpy(), got["toxic"].to_numpy().astype(float))
    return model


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the ridge leaves the constant free. Slopes don't go below 0."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))  # the same sums whatever the order of rows
    x, y = x[order], y[order]
    active = [0, 1]
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, active]])
        c = np.zeros(a.shape[1])
        penalty = np.diag([1e-6] + [ridge] * len(active))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ c)
            c += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-10:
                break
        bad = [k for k, s in zip(active, c[1:], strict=True) if s < 0]
        if not bad:
            slopes = dict(zip(active, c[1:], strict=True))
            return float(c[0]), float(slopes.get(0, 0.0)), float(slopes.get(1, 0.0))
        active = [k for k in active if k not in bad]


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with the score of each text, 0 to 1 (a null text is an empty one). Every row and column stays."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.matcher()
        for column in batches:
            out = [features(*m.weight(t)) for a, b in S.blocks(column) for t in column.slice(a, b - a).to_pylist()]
            yield pa.array(logistic(np.array(out).reshape(-1, 2), model.coefficients), pa.float64())

    return docs.withColumn(into, F.arrow_udf(run, "double")(F.col(text)))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they were."""
    from ._common import free_name

    name = free_name(docs, "toxicity")
    return score(docs, model, into=name).filter(F.col(name) < threshold).drop(name)
