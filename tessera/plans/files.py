"""Queries that write a table in one of the file formats and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.baskets import basket_items
from tessera.plans import analytics
from tessera.session import workspace
from tessera.sources import readers, sinks
from tessera.sources.tables import table


def _path(spark: SparkSession) -> str:
    return f"{workspace(spark)}/file-{uuid.uuid4().hex}"


def file_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews as JSON lines, read with the declared schema; only some columns are parsed."""
    path = _path(spark)
    rows = table(spark, folder, "review_train").select("review_id", "user_id", "business_id", "stars", "date")
    rows.write.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return readers.read_json_lines(spark, path, "review", ["review_id", "user_id", "stars", "date"])


def file_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The city ratings as headered CSV."""
    path = _path(spark)
    sinks.write_csv(analytics.city_rating(spark, folder), path)
    return readers.read_csv(spark, path, "city string, stars double")


def file_intermediate(spark: SparkSession, folder: str) -> DataFrame:
    """The large baskets as the intermediate CSV, under its own header."""
    path = _path(spark)
    sinks.write_csv(analytics.transaction_etl(spark, folder).select(F.col("basket").alias("DATE-CUSTOMER_ID"), F.col("item").alias("PRODUCT_ID")), path)
    return readers.read_intermediate(spark, path)


def file_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Dated baskets as quoted CSV with padded numbers, read by position."""
    path = _path(spark)
    items = basket_items(table(spark, folder, "customer_product"), "date_customer_id", "product_id").distinct().where(F.col("basket").rlike("^[0-9]{8}-[0-9]{1,18}$"))
    parts = F.split("basket", "-")
    padded = lambda c: F.lpad(c.cast("string"), 20, "0")
    none = [F.lit("").alias(c) for c in ("x", "y", "z")]
    items.select(parts[0].alias("date"), padded(parts[1]).alias("customer"), *none, padded(F.col("item")).alias("product")).write.csv(path, header=True, quoteAll=True)
    return readers.read_transactions(spark, path)


def file_points(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as lines of numbers: size and sum of each as they are read."""
    path = _path(spark)
    features = F.col("embedding").cast("array<double>").cast("array<string>")
    table(spark, folder, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(features, ",")).alias("value")).write.text(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return readers.read_points(spark, path).select("id", "label", F.size("features").alias("n"), F.round(total, 6).alias("total"))


QUERIES = {f.__name__: f for f in (file_json_lines, file_csv, file_intermediate, file_transactions, file_points)}

SQL = {
    "file_json_lines": "SELECT review_id, user_id, stars, date FROM review_train",
    "file_csv": analytics.SQL["city_rating"],
    "file_intermediate": analytics.TRANSACTIONS + "SELECT basket AS date_customer_id, item AS product_id FROM k SEMI JOIN big USING (basket)",
    "file_transactions": analytics.TRANSACTIONS + "SELECT basket AS date_customer_id, item AS product_id FROM k WHERE regexp_full_match(basket, '[0-9]{8}-[0-9]{1,18}')",
    "file_points": "SELECT vec_id AS id, label::INT AS label, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
}
