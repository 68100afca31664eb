"""Queries of the operators on packed and nested fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.multi_value import packed_values
from tessera.operators.nested import flatten, map_entries
from tessera.sources.tables import table

#: Delimiters of each packed field; blanks part ids and years, but not the words of a category.
DELIMITERS = {"categories": ",;|/\t\r\n", "friends": ",;| \t\r\n", "elite": ",;|/& \t\r\n"}


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    entries = map_entries(table(spark, folder, "business"), "business_id", ["attributes", "hours"])
    return entries.unionByName(map_entries(table(spark, folder, "checkin"), "business_id", ["time"]))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The path of every leaf of business.attributes, business.hours and checkin.time."""
    return flatten(_entries(spark, folder)).paths.select(F.col("record_id").alias("business_id"), "root", "path").distinct()


def p3_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The merged schema of the nested fields."""
    return flatten(_entries(spark, folder).distinct()).schema


def p3_first_array_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The child tables of the outermost arrays, with the link to their parent rows."""
    return flatten(_entries(spark, folder).distinct()).table(1)


def p3_checkin_table(spark: SparkSession, folder: str) -> DataFrame:
    """The records' own table of checkin.time, whose values hold no arrays."""
    leaves = flatten(map_entries(table(spark, folder, "checkin"), "business_id", ["time"]).distinct()).leaves
    return leaves.select(F.col("record_id").alias("business_id"), "root", "level", "path", "kind", "value")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per value of business.categories, users.friends and users.elite."""
    parts = None
    for name, key, field in (("business", "business_id", "categories"), ("users", "user_id", "friends"), ("users", "user_id", "elite")):
        part = packed_values(table(spark, folder, name), F.col(key), F.col(field), DELIMITERS[field])
        part = part.select(F.lit(name).alias("table_name"), "record_id", F.lit(field).alias("field"), "pos", "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts.distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_schema, p3_first_array_rows, p3_checkin_table, p6_found)}

SQL = {
    "p3_checkin_table": """SELECT DISTINCT business_id, 'time' AS root, 0 AS level, unnest(map_keys("time")) AS path, 'leaf' AS kind, unnest(map_values("time"))::VARCHAR AS value FROM checkin""",
    "p6_found": r"""
WITH field AS (
  SELECT DISTINCT 'business' AS table_name, business_id AS record_id, 'categories' AS field, trim(categories, E' \t\r\n') AS t FROM business
  UNION SELECT 'users', user_id, 'friends', trim(friends, E' \t\r\n') FROM users
  UNION SELECT 'users', user_id, 'elite', trim(elite, E' \t\r\n') FROM users
), piece AS (
  SELECT table_name, record_id, field, t LIKE '[%]' AS is_list, unnest(CASE
      WHEN field = 'friends' THEN regexp_extract_all(t, '[A-Za-z0-9_-]{22}')
      WHEN field = 'elite' THEN regexp_extract_all(t, '[0-9]{4}')
      WHEN t LIKE '[%]' THEN regexp_extract_all(t, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''')
      ELSE list_filter(list_transform(regexp_extract_all(t, '\s*(?:"(?:[^"]|"")*"|[^,;|/\t\r\n"]+)+'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') END) AS v,
    generate_subscripts(CASE
      WHEN field = 'friends' THEN regexp_extract_all(t, '[A-Za-z0-9_-]{22}')
      WHEN field = 'elite' THEN regexp_extract_all(t, '[0-9]{4}')
      WHEN t LIKE '[%]' THEN regexp_extract_all(t, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''')
      ELSE list_filter(list_transform(regexp_extract_all(t, '\s*(?:"(?:[^"]|"")*"|[^,;|/\t\r\n"]+)+'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') END, 1) AS pos
  FROM field WHERE lower(t) NOT IN ('', '-', 'n/a', 'none', '[]')
)
SELECT DISTINCT table_name, record_id, field, pos, CASE
    WHEN is_list AND field = 'categories' THEN replace(v[2:-2], '\"', '"')
    WHEN v LIKE '"%"' AND field = 'categories' THEN replace(v[2:-2], '""', '"')
    ELSE v END AS value
FROM piece""",
}
