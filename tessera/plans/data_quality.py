"""Queries of the data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import clean_key
from tessera.operators.heavy_keys import heavy_keys, key_profile
from tessera.operators.orphans import Parent, Reference, orphan_references
from tessera.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    reviews, tips = table(spark, folder, "review_train"), table(spark, folder, "tip")
    return orphan_references(
        [
            Reference("review_train", reviews, "business_id", "review_id", "business"),
            Reference("review_train", reviews, "user_id", "review_id", "users"),
            Reference("tip", tips, "business_id", "tip_id", "business"),
        ],
        [Parent("business", table(spark, folder, "business"), "business_id"), Parent("users", table(spark, folder, "users"), "user_id")],
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphan reference of review_train and tip."""
    return _orphans(spark, folder)


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted by table, field, reason and month."""
    return _orphans(spark, folder).groupBy("table_name", "field", "reason", "period").agg(F.count(F.lit(1)).alias("n_records"))


def _review_keys() -> dict:
    return {c: clean_key(c) for c in ("business_id", "user_id")}


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold at least 2 percent of the reviews."""
    return heavy_keys(table(spark, folder, "review_train"), _review_keys(), F.col("stars"), 0.02).select("field", "key_value")


def p7_key_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct stars, modal stars and quartiles of every business and user."""
    return key_profile(table(spark, folder, "review_train"), _review_keys(), F.col("stars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p7_found, p7_key_profile)}

_ORPHANS_SQL = r"""
WITH key_rows AS (
  SELECT 'review_train' AS table_name, 'business_id' AS field, review_id AS record_id, trim(business_id, E' \t\r\n') AS k, loaded_at AS t, 'b' AS p FROM review_train
  UNION ALL SELECT 'review_train', 'user_id', review_id, trim(user_id, E' \t\r\n'), loaded_at, 'u' FROM review_train
  UNION ALL SELECT 'tip', 'business_id', tip_id, trim(business_id, E' \t\r\n'), loaded_at, 'b' FROM tip
), refs AS (SELECT DISTINCT * FROM key_rows WHERE k <> ''),
parent AS (
  SELECT 'b' AS p, trim(business_id, E' \t\r\n') AS k, loaded_at, removed_at FROM business
  UNION ALL SELECT 'u', trim(user_id, E' \t\r\n'), loaded_at, removed_at FROM users
), found AS (
  SELECT r.table_name, r.field, r.record_id, r.t, count(q.k) AS n_rows,
    count(*) FILTER (q.loaded_at <= r.t) AS n_before,
    count(*) FILTER (q.loaded_at <= r.t AND (q.removed_at IS NULL OR q.removed_at > r.t)) AS n_present
  FROM refs r LEFT JOIN parent q ON q.p = r.p AND q.k = r.k GROUP BY ALL
), orphan AS (
  SELECT DISTINCT table_name, field, record_id,
    CASE WHEN n_rows = 0 THEN 'missing' WHEN n_before = 0 THEN 'late' ELSE 'deleted' END AS reason,
    strftime(t, '%Y-%m') AS period
  FROM found WHERE n_present = 0
)
"""

SQL = {
    "p1_found": _ORPHANS_SQL + "SELECT * FROM orphan",
    "p1_report": _ORPHANS_SQL + "SELECT table_name, field, reason, period, count(*) AS n_records FROM orphan GROUP BY ALL",
    "p7_found": r"""
WITH k AS (
  SELECT 'business_id' AS field, trim(business_id, E' \t\r\n') AS key_value FROM review_train
  UNION ALL SELECT 'user_id', trim(user_id, E' \t\r\n') FROM review_train)
SELECT field, key_value FROM k WHERE key_value <> '' GROUP BY ALL
HAVING count(*) >= 0.02 * (SELECT count(*) FROM review_train)""",
    "p7_key_profile": r"""
WITH k AS (
  SELECT 'business_id' AS field, trim(business_id, E' \t\r\n') AS key_value, stars FROM review_train
  UNION ALL SELECT 'user_id', trim(user_id, E' \t\r\n'), stars FROM review_train),
w AS (SELECT field, key_value, stars, count(*) AS n FROM k WHERE key_value <> '' AND stars IS NOT NULL GROUP BY ALL),
m AS (SELECT field, key_value, first(stars ORDER BY n DESC, stars) AS mode FROM w GROUP BY ALL)
SELECT k.field, k.key_value, count(*) AS n_rows, count(DISTINCT stars) AS n_values, any_value(m.mode) AS mode,
  quantile_disc(stars, 0.25) AS p25, quantile_disc(stars, 0.5) AS p50, quantile_disc(stars, 0.75) AS p75
FROM k LEFT JOIN m ON m.field = k.field AND m.key_value = k.key_value WHERE k.key_value <> '' GROUP BY k.field, k.key_value""",
}
