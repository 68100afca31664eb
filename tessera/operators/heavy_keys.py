"""Per-key results where a few keys hold most records.

Value-frequency compression: rows are grouped by (key, value) before key, with
map-side combine, so that a key's repeated values become one weighted row and
the work of a heavy key is spread over its values.  Counts, exact distinct
counts, modes and percentiles then come from the weighted values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

#: Ranges between quantiles of a field's values, and the parts of each: the blocks of exact percentiles.
RANGES, PARTS = 64, 16


def compress(df: DataFrame, keys: Mapping[str, Column], value: Column) -> DataFrame:
    """``field, key_value, value, weight``: one row per field, key and value.

    ``keys`` names the key columns to profile; all are taken in one scan.  A row
    without a key counts under a null ``key_value``, one without a value under a
    null ``value``, so the weights of a field add up to the rows of ``df``.  An
    empty table gives no rows.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), key.alias("key_value")) for name, key in keys.items())))
    return (
        df.select(each.alias("k"), value.alias("value"))
        .groupBy(F.col("k.field").alias("field"), F.col("k.key_value").alias("key_value"), "value")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def key_totals(weighted: DataFrame) -> DataFrame:
    """``field, key_value, n_rows, n_values, mode`` of each key of ``compress``.

    ``n_values`` counts distinct values that are not null.  ``mode`` is the most
    frequent value, among equals the smallest, and null if there is no value.
    """
    seen = F.col("value").isNotNull()
    return weighted.groupBy("field", "key_value").agg(
        F.sum("weight").alias("n_rows"),
        F.count("value").alias("n_values"),
        F.max_by("value", F.when(seen, F.struct(F.col("weight"), -F.col("value")))).alias("mode"),
    )


def key_percentiles(weighted: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """``field, key_value`` and for each percentile p the column ``p<100 p>``.

    Exact: the smallest value at which the cumulated weight reaches the share p
    of the key's weight; nulls don't count.  A key's values are first summed by
    blocks, so that no sort holds more than the blocks of a key or one block of
    its distinct values.  Blocks are parts of ranges between quantiles of the
    field's values, so that outliers don't crowd all others into one.
    """
    values = weighted.where(F.col("value").isNotNull() & F.col("key_value").isNotNull())
    quantiles = F.percentile_approx("value", [i / RANGES for i in range(RANGES + 1)])
    ends = values.groupBy("field").agg(quantiles.alias("ends"))  # a row per field
    own = F.greatest(F.lit(1), F.size(F.filter("ends", lambda e: e <= F.col("value"))))  # the range that holds the value, from 1
    low, high = F.get("ends", own - 1), F.get("ends", own)
    part = F.when(high > low, F.floor((F.col("value") - low) / (high - low) * PARTS))
    block = (own - 1) * PARTS + F.coalesce(F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), part)), F.lit(0))
    placed = values.join(F.broadcast(ends), "field").select("field", "key_value", block.cast("int").alias("block"), "value", "weight")
    key = ["field", "key_value"]
    sums = placed.groupBy(*key, "block").agg(F.sum("weight").alias("in_block"))
    order = W.partitionBy(*key).orderBy("block")
    sums = sums.select(
        *key, "block",
        (F.sum("in_block").over(order) - F.col("in_block")).alias("before"),
        F.sum("in_block").over(order).alias("until"),
        F.sum("in_block").over(W.partitionBy(*key)).alias("total"),
    )
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total"))).alias("rank")) for i, p in enumerate(percentiles))))
    hit = sums.withColumn("w", wanted).where((F.col("before") < F.col("w.rank")) & (F.col("w.rank") <= F.col("until")))
    hit = hit.groupBy(*key, "block").agg(F.min("before").alias("before"), F.collect_list("w").alias("wanted"))
    inside = placed.join(hit, [*key, "block"])
    run = F.col("before") + F.sum("weight").over(W.partitionBy(*key, "block").orderBy("value"))
    inside = inside.withColumn("run", run).withColumn("w", F.explode("wanted"))
    return inside.where(F.col("run") >= F.col("w.rank")).groupBy(*key).agg(
        *(F.min(F.when(F.col("w.i") == i, F.col("value"))).alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles))
    )


def key_profile(df: DataFrame, keys: Mapping[str, Column], value: Column, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Totals and percentiles of each key that is not null; see the two functions above."""
    weighted = materialize(compress(df, keys, value))
    totals = key_totals(weighted).where(F.col("key_value").isNotNull())
    return totals.join(key_percentiles(weighted, percentiles), ["field", "key_value"], "left")


def heavy_keys(df: DataFrame, keys: Mapping[str, Column], value: Column, share: float) -> DataFrame:
    """``field, key_value, n_rows`` of the keys that hold at least ``share`` of all rows.

    All rows of ``df`` count in the whole, those without a key too.
    """
    whole = df.agg(F.count(F.lit(1))).scalar()  # reads no column
    totals = key_totals(compress(df, keys, value))
    return totals.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * whole)).select("field", "key_value", "n_rows")
