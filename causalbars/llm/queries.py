"""The p3, p6, p7 and p8 queries: whole tables, whole texts, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import leak, mix, percentiles, reading
from causalbars.runtime import table


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.path_percentiles(table(spark, d, "path_arrays"))


def p3_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles within 0.005 of their rank, from day summaries (0.0025) merged to months (0.0025 more)."""
    return percentiles.combine(percentiles.month_summaries(percentiles.day_summaries(table(spark, d, "path_arrays"))))


def p3_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of p3_from_days holds its stated error, by counting over all values."""
    return percentiles.within(table(spark, d, "path_arrays"), p3_from_days(spark, d), 0.005)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return leak.without_leaks(docs, leak.leaks(docs, table(spark, d, "eval_items"))).select("doc_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_corpus_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix of as many tokens as the listed sources have: small ones are repeated up to their caps, the rest give more."""
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), mix.CORPUS)[0]


def p7_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), mix.CORPUS)[1]


def p7_character_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same with texts measured in characters, which SQL can count as well."""
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), mix.CORPUS, size=F.length("text"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return levels.where("is_english and level >= 3.5").select("doc_id")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    levels = reading.reading_levels(docs, table(spark, d, "reading_labels"))
    return levels.where("is_english").groupBy(F.round("level").cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_from_days, p3_rank_error, p6_found, p6_clean, p7_mix, p7_shares, p7_corpus_mix, p7_corpus_shares, p7_character_shares, p8_found, p8_profile)}

P3_SQL = """
WITH one AS (SELECT DISTINCT ON (event_id, h) symbol, h, mfe_pts, mae_pts, t_mfe FROM path_arrays WHERE elig ORDER BY event_id, h),
v AS (
  SELECT symbol, h, 'mfe_pts' AS field, mfe_pts::DOUBLE AS value FROM one
  UNION ALL SELECT symbol, h, 'mae_pts', mae_pts::DOUBLE FROM one
  UNION ALL SELECT symbol, h, 't_mfe', t_mfe::DOUBLE FROM one),
r AS (
  SELECT symbol, h, field, value, row_number() OVER (PARTITION BY symbol, h, field ORDER BY value) AS rk, count(*) OVER (PARTITION BY symbol, h, field) AS n
  FROM v WHERE value IS NOT NULL)
SELECT symbol, h, field, q, n, value FROM r, (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS q)
WHERE rk = greatest(1, ceil(q * n))
"""
P7_SQL = r"""
WITH t AS (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[-\s]+', '_', 'g') AS source, sum(target_share) AS target, max(max_repeats) AS most FROM mix_targets GROUP BY 1),
d AS (SELECT doc_id, nullif(regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[-\s]+', '_', 'g'), '') AS source, coalesce(length(text), 0) AS n,
  ('0x' || substr(md5(doc_id || '|1729'), 1, 7))::BIGINT AS h FROM documents),
z AS (SELECT source, sum(n)::BIGINT AS size FROM d GROUP BY 1),
e AS (SELECT coalesce(t.source, z.source) AS source, target, most, coalesce(size, 0) AS size, coalesce(most * size, 0) AS cap FROM t FULL JOIN z ON t.source = z.source),
-- sources in the order in which a rising level meets their caps: clamped while the level of the rest stands above
l AS (SELECT *, ((SELECT sum(size) FROM e WHERE target > 0 AND size > 0 AND most > 0) - coalesce(sum(cap) OVER before, 0)) / (sum(target) OVER () - coalesce(sum(target) OVER before, 0)) AS level
  FROM e WHERE target > 0 AND size > 0 AND most > 0 WINDOW before AS (ORDER BY cap / target, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, least(cap, target * (SELECT arg_min(level, cap / target) FROM l WHERE level * target <= cap)) / size AS rate FROM l),
p AS (SELECT source, floor(rate + 1e-9)::BIGINT AS whole, greatest(0, (rate - floor(rate + 1e-9)) * size) AS part FROM f),
c1 AS (SELECT source, part, (h >> 14) AS b1, sum(n) AS n FROM d JOIN p USING (source) WHERE part > 0 GROUP BY ALL),
c2 AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY b1) AS upto FROM c1),
c3 AS (SELECT source, b1, part - (upto - n) AS rest FROM c2 WHERE upto >= part QUALIFY row_number() OVER (PARTITION BY source ORDER BY b1) = 1),
c4 AS (SELECT source, b1, rest, (h & 16383) AS b2, sum(n) AS n FROM d JOIN c3 USING (source) WHERE (h >> 14) = b1 GROUP BY ALL),
c5 AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY b2) AS upto FROM c4),
c6 AS (SELECT c3.source, c3.b1, coalesce(max(b2) FILTER (WHERE upto - n / 2 <= c5.rest), -1) AS b2 FROM c3 LEFT JOIN c5 USING (source) GROUP BY 1, 2),
m AS (SELECT d.source, n, whole + coalesce(((h >> 14) < c6.b1 OR ((h >> 14) = c6.b1 AND (h & 16383) <= c6.b2))::INT, 0) AS copies FROM d JOIN p USING (source) LEFT JOIN c6 USING (source)),
g AS (SELECT source, sum(n * copies)::BIGINT AS mixed, count(*) AS docs, max(copies)::INT AS copies FROM m WHERE copies > 0 AND n > 0 GROUP BY 1)
SELECT e.source, coalesce(target, 0) AS target_share, coalesce(mixed / (SELECT sum(mixed) FROM g), 0)::DOUBLE AS reached_share, size AS size_tokens, coalesce(mixed, 0) AS mix_tokens, coalesce(docs, 0) AS n_documents, most AS max_repeats, coalesce(copies, 0) AS max_copies
FROM e LEFT JOIN g ON e.source = g.source
"""
P3_ERROR_SQL = P3_SQL.replace("SELECT symbol, h, field, q, n, value FROM r", "SELECT symbol, h, field, q, n, true AS within FROM r")
ORACLE_SQL: dict[str, str] = {"p3_percentiles": P3_SQL, "p3_rank_error": P3_ERROR_SQL, "p7_character_shares": P7_SQL}
