"""Licence scans: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory above.

Templates are the texts of short licences, whole and by paragraph, the notices by which long ones are applied, their
titles, and SPDX tags. A file's units are its lines and sentences and its paragraphs (stretches between blank lines, so
headers that are wrapped or set in comments are one unit). Every unit is a sparse TF-IDF vector without function words;
the best template of cosine LEAST or more is its licence, and the best unit's licence is the file's own.

Cosines are computed for units that can reach LEAST, and no unit that can is left out: by Cauchy and Schwarz a unit's
cosine with a template is at most the length of the template's part that the unit holds. So a unit must hold a token of
each template's heaviest part (what is left has a length below LEAST), and the squares of the greatest weights of the
tokens it holds must add up to LEAST squared; and so must that sum (1 at most) times the share of the unit's squared
length that lies in tokens of templates. All are tested where the text lies; only units that pass are shuffled. They are joined to the template weights (tables of fixed size), products summed, and divided by the norms.

A file is the licence file of its directory if its name says so, or if its licence units hold at least SHARE of its
words. A file with no licence of its own takes that of the nearest directory above it with a licence file, found by
joining directories to directories on their paths, once for each directory and not for each file.

All of it is DataFrame operations. The full texts aren't shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, Scratch, let
from ._licence_texts import FUNCTION_WORDS, TEMPLATES, TEXTS

LEAST, SHARE = 0.5, 0.2

#: A token; in the JVM the group is possessive, as repeated groups are matched by recursion otherwise.
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
JVM_TOKEN = TOKEN + "+"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments end after a line feed, or at blanks after a full stop.
BREAK = r"\n|\. +"
#: Paragraphs end at a line that is blank but for comment signs.
BLANK_LINE = r"\n[\x20\t\r#*/;%-]*\n"
FILE_NAME = r"(?:^|/)(?:LICEN[CS]E|COPYING|UNLICENSE)(?:\.[A-Za-z0-9]+)?$"


def texts() -> dict[str, tuple[str, ...]]:
    """The paragraphs of the licences whose texts are templates."""
    return dict(TEXTS)


def tokens(text: str) -> list[str]:
    return [t for t in re.findall(TOKEN, text.lower()) if t not in FUNCTION_WORDS]


def weights() -> tuple[list[tuple[int, str, str, float]], float]:
    """(template, licence, token, unit weight) rows, and the weight of a token that no template has."""
    counted = [Counter(tokens(t)) for _, t in TEMPLATES]
    idf = dict(idf_rows())
    rows = []
    for i, ((name, _), c) in enumerate(zip(TEMPLATES, counted, strict=True)):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(i, name, t, round(k * idf[t] / norm, 12)) for t, k in sorted(c.items())]
    return rows, round(math.log(1 + len(TEMPLATES)) + 1, 12)


def idf_rows() -> list[tuple[str, float]]:
    df = Counter(t for _, text in TEMPLATES for t in set(tokens(text)))
    return [(t, round(math.log((1 + len(TEMPLATES)) / (1 + k)) + 1, 12)) for t, k in sorted(df.items())]


def lowest(least: float) -> float:
    """The square of the lowest cosine that is least when it is rounded to four places, with room for rounding."""
    return (least - 5.1e-5) ** 2


def gate(least: float = LEAST) -> list[str]:
    """Tokens of which every unit with a cosine of least or more holds one: of each template the heaviest, until the
    squares of the others add up to less than least squared."""
    out: set[str] = set()
    by: dict[int, list[tuple[float, str]]] = {}
    for i, _, t, w in weights()[0]:
        by.setdefault(i, []).append((w, t))
    for row in by.values():
        left = sum(w * w for w, _ in row)
        for w, t in sorted(row, reverse=True):
            if left < lowest(least):
                break
            out.add(t)
            left -= w * w
    return sorted(out)


def _trie(words: list[str]) -> str:
    """A pattern of these words that shares their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = []
    for c, rest in sorted(heads.items(), reverse=True):
        if c:
            more = sorted(set(rest))
            parts.append(re.escape(c) + ("" if more == [""] else _trie(more)))
    inner = "|".join(parts)
    return f"(?:{inner})?" if "" in heads else f"(?:{inner})"


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed size, in the plan itself."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({schema})")


def units(text: Column) -> Column:
    """array<struct<sort, unit>>: lines and sentences (0), and paragraphs of several of them (1)."""
    told = lambda parts, sort: F.transform(parts, lambda u: F.struct(F.lit(sort).alias("sort"), u.alias("unit")))
    whole = F.filter(F.split(text, BLANK_LINE, -1), lambda p: p.rlike(BREAK))
    return F.concat(told(F.split(text, BREAK, -1), 0), told(whole, 1))


def _looked_up(table: dict[str, float], token: Column, buckets: int = 64) -> Column:
    """table[token], or null: a map's keys are gone through one by one, so each bucket of a hash has a map."""
    by: list[list[str]] = [[] for _ in range(buckets)]
    for t in sorted(table):
        by[zlib.crc32(t.encode()) % buckets].append(t)
    maps = F.array(*[F.create_map(*[F.lit(x) for t in part for x in (t, table[t])]) if part else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")) for part in by])
    return F.element_at(F.element_at(maps, (F.crc32(token.cast("binary")) % buckets + 1).cast("int")), token)


def classified(files: DataFrame, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(path, digest, licence, cosine, words): the best template of each file that has one, and the words of its
    units of that cosine or more (of its lines and sentences, or of a larger paragraph). files: path, text."""
    spark = files.sparkSession
    rows, unknown = weights()
    least_square = lowest(least)
    heavy = f"(?i)(?<![a-z0-9])(?:{_trie(gate(least))})(?![a-z0-9])"
    most: dict[str, float] = {}
    for _, _, t, w in rows:
        most[t] = max(most.get(t, 0.0), w * w)
    lower = lambda c: F.translate(c, CAPITALS, SMALLS)
    listed = lambda c: F.regexp_extract_all(lower(c), F.lit(JVM_TOKEN), F.lit(0))
    known, idf2 = sorted(most), {t: w * w for t, w in idf_rows()}
    square = lambda t: F.when(t.isin(known), _looked_up(idf2, t)).otherwise(F.lit(unknown * unknown))
    mass = lambda ts: F.aggregate(F.array_distinct(F.filter(ts, lambda t: t.isin(known))), F.lit(0.0), lambda s, t: s + _looked_up(most, t))

    def share(ts: Column) -> Column:
        """The part of a unit's squared length that lies in tokens of templates: an odd number for each repeat of a token
        makes the square of their count."""
        def step(s: Column, t: Column) -> Column:
            run = F.when(s["t"] == t, s["run"] + 2).otherwise(F.lit(1.0))
            return let(run * square(t), lambda v: F.struct(t.alias("t"), run.alias("run"), (s["all"] + v).alias("all"), (s["known"] + F.when(t.isin(known), v).otherwise(0.0)).alias("known")))

        start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("run"), F.lit(0.0).alias("all"), F.lit(0.0).alias("known"))
        return F.aggregate(F.sort_array(F.filter(ts, lambda t: ~t.isin(sorted(FUNCTION_WORDS)))), start, step, lambda s: s["known"] / s["all"])

    held = lambda ts, m: F.when(m >= least_square, F.least(m, F.lit(1.0)) * share(ts) >= least_square).otherwise(False)
    able = lambda x: F.when(x["unit"].rlike(heavy), let(listed(x["unit"]), lambda ts: let(mass(ts), lambda m: held(ts, m)))).otherwise(False)
    # what is beside a generator in its select would be computed for each row that it makes
    some = files.filter(F.col("text").rlike(heavy)).select("path", F.xxhash64("text").alias("digest"), "text")
    some = some.select("path", "digest", F.posexplode(F.filter(units(F.col("text")), able)).alias("no", "u")).distinct()
    some = some.select("path", "digest", "no", F.col("u.sort").alias("sort"), F.col("u.unit").alias("unit"), F.regexp_count("u.unit", F.lit(WORD)).alias("words"))
    tf = some.select("path", "digest", "no", "sort", "words", F.explode(F.filter(listed(F.col("unit")), lambda t: ~t.isin(sorted(FUNCTION_WORDS)))).alias("token"))
    key = ["path", "digest", "no"]
    tf = tf.groupBy(*key, "token").agg(F.count("*").alias("tf"), F.first("words").alias("words"), F.first("sort").alias("sort"))
    idf = F.broadcast(_values(spark, idf_rows(), "token, idf"))  # fixed size
    templates = F.broadcast(_values(spark, rows, "template, licence, token, weight"))  # fixed size
    tf = tf.join(idf, "token", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    tf = (scratch or Scratch(spark)).table(tf.select(*key, "token", "v", "words", "sort"), "tf")  # read for norms and for products
    norms = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.first("words").alias("words"), F.first("sort").alias("sort"))
    dots = tf.join(templates, "token").groupBy(*key, "template", "licence").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    scored = dots.alias("d").join(norms.alias("n"), same).select(*[F.col(f"d.{c}") for c in key], "licence", "words", "sort", F.round(F.col("dot") / F.col("norm"), 4).alias("cosine")).filter(F.col("cosine") >= least)
    by = scored.groupBy(*key).agg(F.min(F.struct(-F.col("cosine"), "licence")).alias("best"), F.first("words").alias("words"), F.first("sort").alias("sort"))
    held = F.greatest(F.coalesce(F.sum(F.when(F.col("sort") == 0, F.col("words"))), F.lit(0)), F.coalesce(F.max(F.when(F.col("sort") == 1, F.col("words"))), F.lit(0)))
    return by.groupBy("path", "digest").agg(F.min("best").alias("best"), held.alias("words")).select("path", "digest", F.col("best.licence").alias("licence"), (-F.col("best.col1")).alias("cosine"), "words")


def directory(path: Column) -> Column:
    """All before the last slash; the root is empty. Null for a null path."""
    return F.when(path.isNull(), None).when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def scan(files: DataFrame, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """files (path, text and others) with licence, cosine, via and from_directory; input columns of these names give
    way.

    via: `file` for a licence file, `header` for a licence of its own, `inherited`, or `none`. from_directory: the
    directory of the licence file a licence is inherited from. A null text has no licence of its own; a null path
    is in no directory. Rows alike in path and text have like results. Of several licence files of a directory,
    the one of the highest cosine counts, then the first licence by name.
    """
    scratch = Scratch(files.sparkSession)
    given = [c for c in files.columns if c.lower() not in ("licence", "cosine", "via", "from_directory")]
    files = files.select("path", "text", F.struct(*[F.col(f"`{c}`") for c in given]).alias("row_"))
    own = classified(files, least, scratch).select(F.col("path").alias("p_"), F.col("digest").alias("d_"), F.col("licence").alias("own_"), F.col("cosine").alias("cosine_"), F.col("words").alias("words_"))
    own = scratch.table(own, "own")
    told = files.withColumn("digest_", F.xxhash64("text")).withColumn("dir_", directory(F.col("path")))
    is_own = F.col("path").eqNullSafe(F.col("p_")) & (F.col("digest_") == F.col("d_"))
    # the words of a text are counted where it has a licence of its own, before it meets that
    narrow = files.select("path", F.xxhash64("text").alias("digest_"), F.when(F.col("path").rlike(FILE_NAME), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).alias("total_")).distinct()
    marked = scratch.table(own.join(narrow, is_own).withColumn("file_", F.col("path").isNotNull() & F.coalesce(F.col("path").rlike(FILE_NAME) | (F.col("words_") >= share * F.col("total_")), F.lit(False))).drop("path", "digest_", "total_"), "marked")
    told = told.join(marked, is_own, "left").withColumn("file_", F.coalesce("file_", F.lit(False)))
    # directories, and the nearest licensed one at or above each
    licensed = marked.filter("file_").groupBy(directory(F.col("p_")).alias("above")).agg(F.min(F.struct(-F.col("cosine_"), "own_")).alias("b")).select("above", F.col("b.own_").alias("given_"))
    parts = F.split("dir_", "/")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("above")
    dirs = files.select(directory(F.col("path")).alias("dir_")).filter("dir_ is not null").distinct().select("dir_", above).distinct()
    nearest = dirs.join(licensed, "above").groupBy("dir_").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given_")).alias("g")).select(F.col("dir_").alias("n_"), F.col("g.above").alias("above_"), F.col("g.given_").alias("given_"))
    told = told.join(nearest, F.col("dir_") == F.col("n_"), "left")
    via = F.when(F.col("file_"), "file").when(F.col("own_").isNotNull(), "header").when(F.col("given_").isNotNull(), "inherited").otherwise("none")
    return told.select("row_.*", F.coalesce("own_", "given_").alias("licence"), F.col("cosine_").alias("cosine"), via.alias("via"), F.when(via == "inherited", F.col("above_")).alias("from_directory"))
