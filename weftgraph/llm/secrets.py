"""Secrets in texts, with the parts of multipart credentials linked by an interval join.

Strong kinds stand alone: an assignment to a secret-like name (`assign`), an access key identifier (`access`) and
a long run of hex digits (`hex`). Weak candidates say little alone: a named account or client (`id`), a mixed run
of letters and digits (`secret`), an address of a service (`endpoint`). A weak candidate is reported only when a
complementary part lies in its scope, at most `scope` code points away in the same text: an identifier for a
secret, and a secret for an identifier or an endpoint.

Texts are read once, for the spans of all kinds; these are written to the shared folder, without the texts. Candidates
are rows of (text, bins of the interval, span); an equi-join on the bin and a check of the distance find the partners.
A bin of the join holds a bounded number of parts, as spans don't overlap within a kind and have a least length, so no
group grows with the input, and work is in proportion to the number of spans. Texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, let, running

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: Least lengths: of the assigned value, of an access identifier, of a run of hex digits.
LEAST = {"assign": 12, "access": 18, "hex": 16}
SCOPE, BIN = 200, 256


def either_case(word: str) -> str:
    """word as a pattern that takes ASCII letters in either case, and nothing else."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join((*(either_case(w) for w in ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")))
ACCOUNTS = "|".join(either_case(w) for w in ("access_key_id", "client_id", "user_name", "username", "user_id", "login", "account"))
PATTERNS = {
    "assign": rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": rf"[0-9a-f]{{{LEAST['hex']},}}",  # a shorter run would be dropped whole, and nothing in it is longer
    "id": rf"""(?:{ACCOUNTS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{3,}}""",
    "secret": r"[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{4,}""",
}


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches of a kind that do not overlap, failing ones dropped."""
    p = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)
    value = F.regexp_extract_all(text, F.lit(p), F.lit(2)) if kind == "assign" else found
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(hits: Column) -> Column:
        cuts = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))

        def ends(c: Column) -> Column:
            before = F.zip_with(c, running(F.transform(c, lambda x: x["gap"] + x["hit"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"]).alias("end")))
            return F.zip_with(before, value, lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value")))

        return let(cuts, ends)

    every = let(found, placed)
    if kind in LEAST:
        every = F.filter(every, lambda m: F.length(m["value"]) >= LEAST[kind])
    if kind == "secret":
        every = F.filter(every, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    quick = {"access": F.contains(text, F.lit("AKIA")), "endpoint": F.contains(text, F.lit("://"))}.get(kind, text.rlike(p))
    return F.when(quick, every).otherwise(none)


def spans_of(text: Column, kinds: tuple) -> Column:
    """array<struct<start, kind_no, end>> of all matches of these kinds."""
    def one(kind: str) -> Column:
        return F.transform(matches(text, kind), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), m["end"].alias("end")))

    return F.concat(*[one(k) for k in kinds])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    listed = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(listed, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


STRONG, WEAK = KINDS[:3], KINDS[3:]
_SPANS = "array<struct<start:int,no:int,end:int>>"


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, weak): the weak candidates of each text that has any with a complementary part in scope.

    found: row (the number of a text), base and more, the spans of strong and of weak kinds.
    """
    parts = found.filter(F.size("more") > 0).select("row", F.explode(F.concat("base", "more")).alias("p")).select("row", "p.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.greatest(a, F.lit(0)) / BIN), F.floor(b / BIN)))
    # a mixed run that is part of a strong span is that span
    runs = parts.filter("no = 4").withColumn("bin", bins(F.col("start"), F.col("end"))).alias("r")
    strong = parts.filter("no < 3").withColumn("bin", bins(F.col("start"), F.col("end"))).alias("s")
    over = runs.join(strong, (F.col("r.row") == F.col("s.row")) & (F.col("r.bin") == F.col("s.bin")) & (F.col("s.start") < F.col("r.end")) & (F.col("s.end") > F.col("r.start")), "left_semi")
    parts = parts.join(over.select("row", "start", "no").distinct(), ["row", "start", "no"], "left_anti")
    role = F.when(F.col("no").isin(0, 2, 4), "secret").when(F.col("no").isin(1, 3), "identifier").otherwise("endpoint")
    parts = parts.withColumn("role", role)
    weak = parts.filter("no >= 3").withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope)).alias("w")
    other = parts.filter("role <> 'endpoint'").withColumn("bin", bins(F.col("start"), F.col("end"))).alias("o")
    needs = F.when(F.col("w.role") == "secret", "identifier").otherwise("secret")
    near = (F.col("o.start") <= F.col("w.end") + scope) & (F.col("o.end") >= F.col("w.start") - scope)
    kept = weak.join(other, (F.col("w.row") == F.col("o.row")) & (F.col("w.bin") == F.col("o.bin")) & (needs == F.col("o.role")) & near, "left_semi")
    return kept.groupBy("row").agg(F.collect_set(F.struct("start", "no", "end")).alias("weak"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans), a row for each row of docs (doc_id, text; other columns are left aside).

    base: strong spans, spans: these and the linked weak ones, both array<struct<start, no, end>> with no the
    place in KINDS, code points from 0, end exclusive. A null text is an empty one. Rows that are alike, or share a
    doc_id, are rows each and have results each.
    """
    scratch = Scratch(docs.sparkSession)
    t = F.col("text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = F.contains(t, F.lit("AKIA")) | F.contains(t, F.lit("://")) | t.rlike(PATTERNS["id"])  # else no part can have a partner
    spans = docs.select("doc_id", spans_of(t, STRONG).alias("base"), F.when(some, spans_of(t, WEAK)).otherwise(F.array().cast(_SPANS)).alias("more"))
    # numbered as they are written: a file's rows don't change if a task runs again
    found = scratch.table(spans, "spans").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    weak = linked(found, scope)
    both = found.join(weak, "row", "left")
    return both.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.concat("base", "weak"))).alias("spans"))
