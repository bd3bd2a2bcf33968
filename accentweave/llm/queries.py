"""The operators bound to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, mixing, neighbours, substring, templates, tokens, toxicity
from . import license as licences


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _fold(parts: int):
    """The remainder of crc32 of the document's number as text; null where that is null."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs, _fold(4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_kept").alias("kept"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), null_ids=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels, _fold(3) != 1)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), F.col("toxic").alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"), by_row=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_ngram_jaccard, op4_mixing, op5_substring_dedup, op6_toxicity, op7_neighbours, op8_licenses, op9_line_dedup, op10_token_counts)}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
UNION ALL SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])) END::BIGINT, NULL FROM (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS w FROM documents WHERE doc_id IS NULL)"""

_OP4 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM g),
w AS (SELECT *, ((rank % 3) + 1)::DOUBLE AS weight, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM o),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, max(CASE WHEN cap < level * weight THEN NULL ELSE level END) OVER () AS final FROM v),
q AS (SELECT source, source_size, rank, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE least(final * weight, cap::DOUBLE) END AS target FROM t),
c AS (SELECT *, floor(target)::BIGINT AS quota, (sum(floor(target)::BIGINT) OVER ())::BIGINT AS whole, (sum(floor(target)::BIGINT) OVER (ORDER BY rank))::BIGINT AS upto FROM q),
p AS (SELECT i AS slot, list_sum([((i >> b) & 1) << (15 - b) FOR b IN range(16)])::BIGINT AS point FROM range(65536) AS r(i)),
n AS (SELECT c.rank, count(*) AS turns FROM c JOIN p ON p.point >= ((upto - quota) * 65536 + whole - 1) // whole AND p.point < (upto * 65536 + whole - 1) // whole WHERE c.quota > 0 GROUP BY c.rank),
e AS (SELECT c.*, CASE WHEN quota = 0 THEN 0 WHEN n.turns IS NULL THEN least((whole + 65535) // 65536, quota) ELSE least((n.turns * whole + 65535) // 65536, source_size * 3) END AS reach FROM c LEFT JOIN n ON n.rank = c.rank),
f AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.reach,
  coalesce(sum(d.size) OVER (PARTITION BY e.rank ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, reach) - start) + greatest(0, least(start + source_size + size, reach) - start - source_size) + greatest(0, least(start + 2 * source_size + size, reach) - start - 2 * source_size))::BIGINT AS taken FROM f"""

_OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(i) WHERE len(w) >= 50),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS gone FROM x),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT k.doc_id, k.i, k.word, coalesce(max(m.gone::INTEGER) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM k LEFT JOIN m ON m.doc_id = k.doc_id AND m.i = k.i)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, coalesce(sum(c.gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (c.gone = 0), '')) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""


def _canonical(text: str) -> str:
    """A text's canonical lines; lines are tested one by one, as RE2 does not look ahead."""
    dropped = r"regexp_matches(l, '^[ \t\r]*(copyright\b|\(c\)|©)') AND NOT regexp_matches(l, '^[ \t\r]*copyright( notice| holder| owner)')"
    out = f"array_to_string([CASE WHEN {dropped} THEN '' ELSE l END FOR l IN string_split(lower({text}), chr(10))], chr(10))"
    out = f"translate({out}, {_quoted(licences._PUNCTUATION)}, {_quoted(' ' * len(licences._PUNCTUATION))})"
    out = f"' ' || regexp_replace(replace({out}, chr(10), ' ' || chr(10) || ' '), ' {{2,}}', ' ', 'g') || ' '"
    for a, b in licences.SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return out


def _op8() -> str:
    known = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licences.NOTICES + licences.LICENCES)
    whole = r"trim(regexp_replace(c, '[ \n]+', ' ', 'g'))"
    return f"""
WITH k AS (SELECT sha256({whole}) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_canonical('text')} AS c FROM (VALUES {known}) AS v(license_id, text)) GROUP BY 1),
d AS (SELECT doc_id, {_canonical('text')} AS c FROM documents),
n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT k.license_id)), ',') AS notices, count(*) AS n_notices FROM (SELECT doc_id, sha256(trim(unnest(string_split(c, chr(10))))) AS digest FROM d) l JOIN k ON k.digest = l.digest GROUP BY doc_id)
SELECT d.doc_id, sha256({whole}) AS digest, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0)::BIGINT AS n_notices FROM d LEFT JOIN k ON k.digest = sha256({whole}) LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM d.doc_id"""


_OP9 = rf"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, no, raw, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN regexp_extract_all(raw, '{_WORD}')] AS t FROM r WHERE regexp_matches(raw, '{_WORD}')),
m AS (SELECT *, array_to_string(t, ' ') AS masked, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM l),
own AS (SELECT masked FROM m GROUP BY masked HAVING count(DISTINCT doc_id) >= 10),
wide AS (SELECT leaf FROM m GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10 AND count(DISTINCT masked) > 1),
x AS (SELECT doc_id, masked, t, len(t) || ' ' || d || ' ' || array_to_string(t[1:d], ' ') AS leaf FROM m, (VALUES (3), (4), (5)) AS depths(d) WHERE leaf IN (SELECT leaf FROM wide)),
v AS (SELECT leaf, unnest(t) AS token, unnest(range(len(t))) AS pos FROM x),
c AS (SELECT leaf, pos, token, count(*) AS votes FROM v GROUP BY leaf, pos, token),
f AS (SELECT leaf, pos, CASE WHEN 2 * max(votes) > sum(votes) AND arg_max(token, votes) <> '<*>' THEN arg_max(token, votes) END AS fixed FROM c GROUP BY leaf, pos),
s AS (SELECT leaf, list(fixed ORDER BY pos) AS fixed FROM f GROUP BY leaf HAVING count(fixed) >= 0.6 * count(*) AND count(fixed) > 0),
g AS (SELECT x.doc_id, x.leaf, x.masked FROM x JOIN s ON s.leaf = x.leaf WHERE len([1 FOR i IN range(1, len(x.t) + 1) IF s.fixed[i] IS NOT NULL AND s.fixed[i] <> x.t[i]]) = 0),
lost AS (SELECT masked FROM own UNION SELECT masked FROM g WHERE leaf IN (SELECT leaf FROM g GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10)),
k AS (SELECT r.doc_id, r.no, r.raw, m.masked IS NOT NULL AS filled, m.masked IS NOT NULL AND m.masked IN (SELECT masked FROM lost) AS gone FROM r LEFT JOIN m ON m.doc_id = r.doc_id AND m.no = r.no)
SELECT d.doc_id, count(k.no) FILTER (k.filled) AS n_lines, count(k.no) FILTER (k.gone) AS n_dropped, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE sha256(coalesce(string_agg(k.raw, chr(10) ORDER BY k.no) FILTER (NOT k.gone), '')) END AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """For unique document numbers, as the test tables have. The other queries hold a model, an index or a tokenizer."""
    return {"op3_ngram_jaccard": _OP3, "op4_mixing": _OP4, "op5_substring_dedup": _OP5, "op8_licenses": _op8(), "op9_line_dedup": _OP9}
