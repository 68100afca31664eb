"""Stream sketches in set form: the state after each element follows from first and last positions.

Streams are tables ``pos, batch, key``: position, number of the batch, text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.hashing import BLOOM_HASHES, BLOOM_MODULUS, SKETCH_MODULUS, SKETCH_RANGE, draw, family_column, linear_hash, text_number


def count_batches(df: DataFrame, position: str, key: str, size: int) -> DataFrame:
    """The stream of ``df`` in batches of ``size`` positions."""
    return df.select(F.col(position).alias("pos"), F.floor(F.col(position) / size).cast("bigint").alias("batch"), F.col(key).cast("string").alias("key"))


def bloom_rates(stream: DataFrame, bits: int, hashes: Sequence[tuple[int, int]] = BLOOM_HASHES, modulus: int = BLOOM_MODULUS) -> DataFrame:
    """``batch, n_false, n_true, rate`` of a Bloom filter that lives as long as the stream.

    A bit is set from the first position of a key that hashes to it.  A new key
    is a false positive if all its bits were set before, else a true negative;
    a key seen before is neither.  So one row per key decides, whatever a key's
    share of the stream.  ``rate``: ``n_false / (n_false + n_true)``, null where
    a batch has no new key.  Null keys are ignored.
    """
    first = stream.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("pos", "batch")).alias("f")).select("key", "f.pos", "f.batch")
    return rates_of_first(first, stream.select("batch").distinct(), bits, hashes, modulus)


def rates_of_first(first: DataFrame, every: DataFrame, bits: int, hashes: Sequence[tuple[int, int]] = BLOOM_HASHES, modulus: int = BLOOM_MODULUS) -> DataFrame:
    """``bloom_rates`` from where each key came first (``key, pos, batch``) and all batches (``batch``)."""
    x = text_number(F.col("key"), modulus)
    bit = linear_hash(F.col("x"), F.col("h.a"), F.col("h.b"), modulus, bits)
    placed = first.withColumn("x", x).withColumn("h", F.explode(family_column(list(hashes)))).select("key", "pos", "batch", bit.alias("bit"))
    since = placed.groupBy("bit").agg(F.min("pos").alias("since"))
    decided = placed.join(since, "bit").groupBy("key", "pos", "batch").agg(F.max("since").alias("ready"))
    flags = decided.select("batch", (F.col("ready") < F.col("pos")).cast("bigint").alias("false"))
    by = flags.groupBy("batch").agg(F.sum("false").alias("n_false"), F.sum(1 - F.col("false")).alias("n_true"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.join(by, "batch", "left").select("batch", zero("n_false"), zero("n_true"), F.try_divide("n_false", F.col("n_false") + F.col("n_true")).alias("rate"))


def trailing_zeros(stream: DataFrame, family: list[tuple[int, int]], size: int = SKETCH_RANGE, modulus: int = SKETCH_MODULUS) -> DataFrame:
    """``batch, number, zeros``: the most trailing zeros of each hash function in each batch; a hash of 0 has one."""
    once = stream.where(F.col("key").isNotNull()).select("batch", "key").distinct()
    hashed = linear_hash(F.col("x"), F.col("h.a"), F.col("h.b"), modulus, size)
    binary = F.bin(hashed)
    zeros = F.length(binary) - F.length(F.rtrim(binary, F.lit("0")))
    each = once.select("batch", text_number(F.col("key"), modulus).alias("x")).withColumn("h", F.explode(family_column(family)))
    return each.groupBy("batch", F.col("h.number").alias("number")).agg(F.max(zeros).alias("zeros"))


def distinct_estimates(zeros: DataFrame, group: int = 20) -> DataFrame:
    """``batch, estimate``: 2 to the mean of the medians of groups of hash functions, rounded down."""
    medians = zeros.groupBy("batch", F.floor(F.col("number") / group).alias("g")).agg(F.median("zeros").alias("m"))
    return medians.groupBy("batch").agg(F.floor(F.pow(F.lit(2.0), F.avg("m"))).cast("bigint").alias("estimate"))


def distinct_per_batch(stream: DataFrame) -> DataFrame:
    """``batch, n_distinct``."""
    return stream.groupBy("batch").agg(F.count_distinct("key").alias("n_distinct"))


def slot_writers(stream: DataFrame, size: int, seed: int) -> DataFrame:
    """``batch, slot, last``: of the slots that a batch writes the last position and key."""
    n = F.col("pos") - size + 1
    later = F.col("pos") >= size
    kept = ~later | (draw(F.col("pos"), seed) < F.lit(float(size)) / (n + size))
    slot = F.when(later, F.floor(draw(F.col("pos"), seed + 1) * size)).otherwise(F.col("pos")).cast("int")
    return stream.where(kept).groupBy("batch", slot.alias("slot")).agg(F.max(F.struct("pos", "key")).alias("last"))


def reservoir(stream: DataFrame, size: int, seed: int) -> DataFrame:
    """``seqnum, slot, value``: what each slot of the sample holds after each batch of ``size`` elements.

    The first batch fills the slots in order.  The n-th later element is kept
    with probability ``size / (size + n)`` and replaces a slot drawn evenly.  A
    slot holds its latest writer.  Positions must be 0, 1, 2, ...
    """
    return slots_over_time(slot_writers(stream, size, seed), stream.select("batch").distinct(), size)


def slots_over_time(writers: DataFrame, every: DataFrame, size: int) -> DataFrame:
    """``seqnum, slot, value`` of the writers of slots and all batches."""
    writes = writers.select("batch", "slot", F.col("last.key").alias("value"))
    grid = every.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    order = W.partitionBy("slot").orderBy("batch")
    filled = grid.join(writes, ["batch", "slot"], "left").withColumn("value", F.last("value", ignorenulls=True).over(order))
    return filled.select(((F.col("batch") + 1) * size).alias("seqnum"), "slot", "value")
