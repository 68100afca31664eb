"""Relational core: profiles, top-k, lookups with defaults, partition studies."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """``key, n``: the ``k`` most frequent keys that are not null; equals by key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(k)


def review_profile(reviews: DataFrame, year: int) -> DataFrame:
    """One row: reviews, reviews of ``year``, distinct users and businesses."""
    return reviews.agg(
        F.count(F.lit(1)).alias("n_review"),
        F.count_if(F.year("date") == year).alias("n_review_year"),
        F.count_distinct("user_id").alias("n_user"),
        F.count_distinct("business_id").alias("n_business"),
    )


def profile_document(reviews: DataFrame, year: int, k: int) -> DataFrame:
    """``review_profile`` with the ``k`` most active users and businesses as arrays of pairs."""
    row = review_profile(reviews, year)
    for name in ("user", "business"):
        top = top_k(reviews, f"{name}_id", k)  # k rows
        pairs = top.agg(F.collect_list(F.struct(F.col("n"), F.col(f"{name}_id").alias("id"))).alias("p"))
        ordered = F.array_sort("p", lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).cast("int"))
        row = row.withColumn(f"top{k}_{name}", pairs.select(F.transform(ordered, lambda x: F.array(x["id"], x["n"].cast("string")))).scalar())
    return row


def mean_by_lookup(facts: DataFrame, lookup: DataFrame, key: str, group: Column, value: str, name: str) -> DataFrame:
    """``name, mean``: the mean of ``value`` of ``facts`` by a group that ``lookup`` gives for ``key``.

    Facts are first summed by key, map-side, so the join moves one row per key
    whatever a key's share of the facts.
    """
    sums = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    joined = sums.join(lookup.select(key, group.alias(name)), key)
    return joined.groupBy(name).agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))


def with_defaults(df: DataFrame, lookup: DataFrame, key: str, defaults: Mapping[str, Any]) -> DataFrame:
    """``df`` with the columns of ``lookup`` that ``defaults`` names; the default where the key or value is absent.

    ``lookup`` has one row per key.  Which side is broadcast, if any, follows
    from the measured sizes.
    """
    wanted = lookup.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in defaults))
    joined = df.join(wanted, F.col(key) == F.col("__key"), "left")
    return joined.select(*df.columns, *(F.coalesce(f"__{c}", F.lit(d)).alias(c) for c, d in defaults.items()))


def having_count(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` has at least so many rows."""
    valid = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select(key)
    return df.join(valid, key, "left_semi")


def partition_sizes(df: DataFrame, partitions: int, by: Column | None = None) -> DataFrame:
    """``partition, n_items`` of ``df`` as placed by ``by`` modulo ``partitions``, empty partitions too.

    Without ``by`` the rows stay as they are placed now, and only partitions
    with rows come out.
    """
    if by is None:
        return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_items"))
    placed = df.repartitionById(partitions, F.pmod(by, F.lit(partitions)).cast("int"))
    counts = placed.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n_items"))


def error_histogram(df: DataFrame, truth: str, guess: str) -> tuple[DataFrame, DataFrame]:
    """Root of the mean squared error (one row), and rows by whole part of the absolute error, 4 and above as one."""
    error = F.col(truth) - F.col(guess)
    rmse = df.agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    bin_ = F.least(F.lit(4), F.floor(F.abs(error))).cast("int").alias("error_from")
    return rmse, df.where(error.isNotNull()).groupBy(bin_).agg(F.count(F.lit(1)).alias("n"))
