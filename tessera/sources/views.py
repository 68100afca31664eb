"""The tables in the roles that the analytics operators take them in.

Keys lose surrounding blanks, tabs and line ends; of several deliveries of one
business or user the latest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import clean_key
from tessera.sources.tables import table


def latest(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """One row per ``key`` that is not null: that of the greatest ``loaded_at``, then ``ties``.

    Null counts as the least.  A partial aggregate keeps one row per key and
    task, so a key with very many deliveries costs no more than others.
    """
    order = F.struct("loaded_at", *ties)
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("last"))
    return best.select(key, "last.*")


def businesses(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "business")
    return latest(df.withColumn("business_id", clean_key("business_id")), "business_id", ["review_count", "stars", "city", "categories"])


def users(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "users")
    return latest(df.withColumn("user_id", clean_key("user_id")), "user_id", ["review_count", "average_stars", "friends", "elite"])


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "review_train")
    return df.select("review_id", clean_key("user_id").alias("user_id"), clean_key("business_id").alias("business_id"), "stars", "date")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``user, item, rating``: one average per pair, of the rows with both keys and a rating."""
    df = table(spark, folder, "yelp_train")
    rows = df.select(clean_key("user_id").alias("user"), clean_key("business_id").alias("item"), F.col("stars").alias("rating")).dropna()
    return rows.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """``user, item``, each pair once, of the rows with both keys."""
    df = table(spark, folder, "yelp_train")
    return df.select(clean_key("user_id").alias("user"), clean_key("business_id").alias("item")).dropna().distinct()


def counted_per_business(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``business_id`` of every row of a table that names businesses."""
    return table(spark, folder, name).withColumn("business_id", clean_key("business_id")).where(F.col("business_id").isNotNull())


_TRIM = r"nullif(trim({0}, E' \t\r\n'), '')"

#: The same views as SQL, to be put after WITH.
SQL = {
    "b": f"""b AS (SELECT * FROM (SELECT * REPLACE ({_TRIM.format('business_id')} AS business_id) FROM business) WHERE business_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY loaded_at DESC NULLS LAST, review_count DESC NULLS LAST, stars DESC NULLS LAST, city DESC NULLS LAST, categories DESC NULLS LAST) = 1)""",
    "u": f"""u AS (SELECT * FROM (SELECT * REPLACE ({_TRIM.format('user_id')} AS user_id) FROM users) WHERE user_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY loaded_at DESC NULLS LAST, review_count DESC NULLS LAST, average_stars DESC NULLS LAST, friends DESC NULLS LAST, elite DESC NULLS LAST) = 1)""",
    "r": f"r AS (SELECT review_id, {_TRIM.format('user_id')} AS user_id, {_TRIM.format('business_id')} AS business_id, stars, date FROM review_train)",
    "y": f"""y AS (SELECT u AS "user", i AS item, avg(stars) AS rating FROM (SELECT {_TRIM.format('user_id')} AS u, {_TRIM.format('business_id')} AS i, stars FROM yelp_train)
      WHERE u IS NOT NULL AND i IS NOT NULL AND stars IS NOT NULL GROUP BY ALL)""",
    "v": f"""v AS (SELECT DISTINCT u AS "user", i AS item FROM (SELECT {_TRIM.format('user_id')} AS u, {_TRIM.format('business_id')} AS i FROM yelp_train) WHERE u IS NOT NULL AND i IS NOT NULL)""",
    "t": f"t AS (SELECT {_TRIM.format('business_id')} AS business_id, text, likes, tip_id, loaded_at FROM tip WHERE {_TRIM.format('business_id')} IS NOT NULL)",
    "c": f"""c AS (SELECT {_TRIM.format('business_id')} AS business_id, "time" FROM checkin WHERE {_TRIM.format('business_id')} IS NOT NULL)""",
    "p": f"p AS (SELECT {_TRIM.format('business_id')} AS business_id FROM photo WHERE {_TRIM.format('business_id')} IS NOT NULL)",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
