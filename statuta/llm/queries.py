"""One query per operator over its whole table, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, fill_middle, licenses, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, token_ids, toxicity
from .shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior verdict of every text; null texts have no words and fail, repeated rows are judged each."""
    return quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row; a null text has size 0, a null source is one of its own."""
    df = mixing.plan(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts, null and empty ones included, learned from the rows that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text, null as empty; base kinds as the contract has them, added kinds above the score."""
    return pii.report(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every row, null and empty texts with none of their own."""
    files = licenses.corpus_files(table(spark, sf_dir, "documents"))
    return licenses.scan(spark, files).select("doc_id", "path", "own_licence", "similarity", "licence", "inherited_from")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every text; a null or empty one is the end token alone."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row; null texts weigh nothing, a text above the limit is a shard of its own."""
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "shard", "shard_depth", "shard_bytes", "doc_bytes")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked passages of the benchmark in all texts; null and empty ones have none."""
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every text, null as empty."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document id; texts without words are linked with nothing."""
    return ngram_join.classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, parts and digests of every row; null and empty texts stay plain."""
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document, read back from the shards it was written to."""
    return token_ids.encode(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of a language and their leading terms; null text, lang and source are ''."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_mixing, op3_toxicity, op4_pii, op5_licenses, op6_lm_scoring, op7_sharding, op8_decontamination, op9_quality_classifier, op10_ngram_join,
        op11_fill_middle, op12_token_ids, op13_divergence,
    )
}

ORACLES = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
c AS (SELECT *, SUM(source_size) OVER () - COALESCE(SUM(3 * source_size) OVER o, 0) AS left_size,
             SUM(weight) OVER () - COALESCE(SUM(weight) OVER o, 0) AS left_weight
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, LEAST((MAX(left_size::DOUBLE / left_weight::DOUBLE) OVER ()) * weight, (3 * source_size)::DOUBLE) AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5(COALESCE(d.doc_id::VARCHAR, 'null') || ':mix-1'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (FLOOR(rate) + CASE WHEN u < rate - FLOOR(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op7_sharding": r"""
WITH d AS (SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS doc_bytes, ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT d.*, k.depth, h >> (60 - k.depth) AS prefix FROM d, (SELECT UNNEST(range(0, 41))::INTEGER AS depth) k),
b AS (SELECT depth, prefix, SUM(doc_bytes)::BIGINT AS shard_bytes FROM e GROUP BY depth, prefix HAVING SUM(doc_bytes) <= 4194304 OR MIN(h) = MAX(h)),
f AS (SELECT doc_id, doc_bytes, MIN(e.depth) AS shard_depth, ARG_MIN(shard_bytes, e.depth) AS shard_bytes, ANY_VALUE(h) AS h
      FROM e JOIN b ON e.depth = b.depth AND e.prefix = b.prefix GROUP BY doc_id, doc_bytes)
SELECT doc_id, CASE WHEN shard_depth = 0 THEN '' ELSE lpad(bin(h >> (60 - shard_depth)), shard_depth, '0') END AS shard, shard_depth, shard_bytes, doc_bytes
FROM f""",
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
             [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS r FROM d),
c AS (SELECT *, len(lines)::BIGINT AS n, LEAST(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS lo, GREATEST(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, COALESCE(array_to_string(lines[1:lo], ''), '') AS prefix, COALESCE(array_to_string(lines[lo + 1:hi], ''), '') AS middle, COALESCE(array_to_string(lines[hi + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""",
    "op13_divergence": r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
t AS (SELECT rid, lang, source, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, COUNT(*) AS total FROM t GROUP BY lang, term HAVING COUNT(DISTINCT rid) >= 30),
v AS (SELECT lang, COUNT(*) AS v, SUM(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM t GROUP BY lang, source, term),
gk AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n, k.total FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, SUM(n) AS n FROM gk GROUP BY lang, source),
p AS (SELECT gk.lang, gk.source, gk.term, gk.n, (1 + (1000000000::HUGEINT * (gk.n + 5)) // (gn.n + 5 * v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (gk.total + 5)) // (v.n + 5 * v.v))::BIGINT AS q
      FROM gk JOIN gn ON gk.lang = gn.lang AND gk.source = gn.source JOIN v ON gk.lang = v.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, SUM(ABS(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
          ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
