"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, jaccard, licenses, mixing, pii, secrets, tokens, toxicity, warc
from ._common import Scratch, read


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark).path("archive")
    warc.write_archive(read(spark, sf_dir, "pages"), at)
    return warc.described(warc.read_archive(spark, at))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_sections(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), F.array_join(F.col("sections").cast("array<string>"), ",").alias("section_tokens"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the tree source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")).drop("text")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, into="score")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), spans="spans")
    of = lambda k: F.size(F.filter("spans", lambda m: m["kind"] == k)).alias(f"n_{k}")
    counts = [of(k) for k in pii.KINDS]
    return out.select("doc_id", F.size("spans").alias("n_pii"), *counts, F.array_join(F.transform("spans", lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["pseudonym"])), ",").alias("pseudonyms"), "text")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    of = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    base = secrets.written(F.col("base"))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def _secret_sql() -> str:
    """Positions come from the gaps between matches, as in the query, or each kind in turn; the join is on the row."""
    def hits(kind: str) -> str:
        p = secrets.PATTERNS[kind].replace("'", "''")
        value = f"regexp_extract_all(text, '{p}', 2)" if kind == "assign" else "h"
        least = {"assign": "len(v) >= 12", "access": "len(v) >= 18", "hex": "true", "secret": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"}.get(kind, "true")
        return f"""SELECT r, {secrets.KINDS.index(kind)} AS no, s AS start, s + len(m) AS stop FROM (
  SELECT r, unnest(h) AS m, unnest({value}) AS v, unnest(list_transform(range(1, len(h) + 1), lambda i: len(array_to_string(g[:i], '')) + len(array_to_string(h[:i - 1], '')))) AS s
  FROM (SELECT r, text, regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}'))) WHERE {least}"""

    every = " UNION ALL ".join(hits(k) for k in secrets.KINDS)
    names = "['" + "', '".join(secrets.KINDS) + "']"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({every}),
p AS (SELECT *, CASE WHEN no IN (0, 2, 4) THEN 'secret' WHEN no IN (1, 3) THEN 'identifier' ELSE 'endpoint' END AS role FROM a
      WHERE no <> 4 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.no < 3 AND b.start < a.stop AND b.stop > a.start)),
k AS (SELECT * FROM p WHERE no < 3 OR EXISTS (SELECT 1 FROM p o WHERE o.r = p.r AND o.role = CASE p.role WHEN 'secret' THEN 'identifier' ELSE 'secret' END
        AND o.start <= p.stop + {secrets.SCOPE} AND o.stop >= p.start - {secrets.SCOPE})),
g AS (SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        string_agg({names}[no + 1] || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) FILTER (no < 3) AS base,
        string_agg({names}[no + 1] || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def _license_sql() -> str:
    """Weights come from the templates' texts, and every unit of every text is compared with every template."""
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join(f"({i}, {cell(name)}, {cell(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    plain = ", ".join(cell(w) for w in sorted(licenses.FUNCTION_WORDS))
    least, share = licenses.LEAST, licenses.SHARE
    tokens = lambda c: f"list_filter(regexp_extract_all(translate({c}, '{licenses.CAPITALS}', '{licenses.SMALLS}'), '{licenses.TOKEN}'), lambda t: t NOT IN ({plain}))"
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH t0(template, licence, text) AS (VALUES {values}),
t1 AS (SELECT template, licence, unnest({tokens('text')}) AS token FROM t0),
t2 AS (SELECT template, licence, token, count(*) AS k FROM t1 GROUP BY ALL),
idf AS (SELECT token, round(ln((1 + (SELECT count(*) FROM t0)) / (1 + count(DISTINCT template))) + 1, 12) AS idf FROM t2 GROUP BY token),
tmpl AS (SELECT template, licence, token, round(k * idf / sqrt(sum((k * idf) ** 2) OVER (PARTITION BY template)), 12) AS weight FROM t2 JOIN idf USING (token)),
f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, text FROM documents),
g AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, len(regexp_extract_all(text, '{word}')) AS total FROM f),
seg AS (SELECT doc_id, 0 AS sort, unnest(range(len(p))) AS i, unnest(p) AS s FROM (SELECT doc_id, string_split_regex(text, '{licenses.BREAK}') AS p FROM g)
  UNION ALL SELECT doc_id, 1, i, s FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS s FROM (SELECT doc_id, string_split_regex(text, '{licenses.BLANK_LINE}') AS p FROM g)) WHERE regexp_matches(s, '{licenses.BREAK}')),
hit AS (SELECT *, sort * 1000000000 + i AS no, len(regexp_extract_all(s, '{word}')) AS words FROM seg),
tok AS (SELECT doc_id, no, unnest({tokens('s')}) AS token FROM hit),
tf AS (SELECT doc_id, no, t.token, count(*) * any_value(coalesce(idf, round(ln(1 + (SELECT count(*) FROM t0)) + 1, 12))) AS v FROM tok t LEFT JOIN idf USING (token) GROUP BY ALL),
norm AS (SELECT doc_id, no, sqrt(sum(v * v)) AS norm FROM tf GROUP BY ALL),
dot AS (SELECT doc_id, no, template, licence, sum(v * weight) AS dot FROM tf JOIN tmpl USING (token) GROUP BY ALL),
sc AS (SELECT doc_id, no, licence, round(dot / norm, 4) AS cosine FROM dot JOIN norm USING (doc_id, no) WHERE round(dot / norm, 4) >= {least}),
best AS (SELECT doc_id, no, min((-cosine, licence)) AS b FROM sc GROUP BY ALL),
own AS (SELECT doc_id, min(b) AS b, greatest(coalesce(sum(words) FILTER (sort = 0), 0), coalesce(max(words) FILTER (sort = 1), 0)) AS words FROM best JOIN hit USING (doc_id, no) GROUP BY doc_id),
o AS (SELECT g.doc_id, g.path, g.dir, b[2] AS own, -b[1] AS cosine, own.doc_id IS NOT NULL AND (regexp_matches(path, '{licenses.FILE_NAME}') OR words >= {share} * total) AS is_file FROM g LEFT JOIN own USING (doc_id)),
lic AS (SELECT dir AS above, min((-cosine, own))[2] AS given FROM o WHERE is_file GROUP BY dir),
near AS (SELECT d.dir, arg_max(given, len(above)) AS given, arg_max(above, len(above)) AS above FROM (SELECT DISTINCT dir FROM o) d JOIN lic ON above = '' OR d.dir = above OR starts_with(d.dir, above || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(own, given) AS licence, cosine,
  CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
  CASE WHEN is_file OR own IS NOT NULL THEN NULL ELSE above END AS from_directory
FROM o LEFT JOIN near USING (dir)
"""


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_warc": op2_warc,
    "op3_jaccard": op3_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_licenses": op5_licenses,
    "op6_fingerprints": op6_fingerprints,
    "op7_decontaminate": op7_decontaminate,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}

SQL = {
    "op5_licenses": _license_sql(),
    "op2_warc": """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
    row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to, true AS sound FROM d
""",
    "op3_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, f.b FROM r JOIN f ON r.y = f.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
""",
    "op1_secrets": _secret_sql(),
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * 2 AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, (cap / weight, rank)) AS final FROM l WHERE level * weight <= cap),
t AS (SELECT source, rank, source_size, coalesce(least(cap, final * weight), cap) AS target FROM w LEFT JOIN f ON true),
q AS (SELECT d.*, t.rank, t.source_size, t.target, sum(size) OVER (PARTITION BY t.rank ORDER BY k ROWS UNBOUNDED PRECEDING) AS queued
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (queued + turn * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0),
c AS (SELECT k, rank, sum(size) OVER (ORDER BY finish, rank, k, turn ROWS UNBOUNDED PRECEDING) AS run, size FROM e),
g AS (SELECT k, rank, sum(size) AS taken FROM c WHERE run <= (SELECT sum(size)::DOUBLE * 1.5::DOUBLE FROM d) GROUP BY k, rank)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (k, rank)
""",
}
