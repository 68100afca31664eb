"""The stream sketches as Structured Streaming queries.

Streams have ``pos, batch, key`` as in ``tessera.operators.sketch``; the results
are those of the set forms there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import BLOOM_HASHES, BLOOM_MODULUS, SKETCH_MODULUS, SKETCH_RANGE, family_column, linear_hash, text_number
from tessera.operators.sketch import distinct_estimates, rates_of_first, slot_writers, slots_over_time
from tessera.session import workspace


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that is there, and gives what it wrote.

    Every micro-batch is written to a folder of its own, so a batch that is
    repeated after a failure replaces itself.  In complete mode the last counts.
    """
    spark = stream.sparkSession
    base = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    last = {"id": -1}

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        last["id"] = max(last["id"], batch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if last["id"] < 0:
        return spark.createDataFrame([], stream.schema)
    path = f"{base}/out/batch={last['id']}" if mode == "complete" else f"{base}/out/batch=*"
    return spark.read.schema(stream.schema).parquet(path)


def stream_of(spark: SparkSession, folder: str, name: str, position: str, key: str, size: int) -> DataFrame:
    """The table ``name`` as a stream in batches of ``size`` positions."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet")
    return source.select(F.col(position).alias("pos"), F.floor(F.col(position) / size).cast("bigint").alias("batch"), F.col(key).cast("string").alias("key"))


# Streaming DataFrames, to be written in update mode: what they give for a key
# replaces what they gave before, so that a batch costs only what it changes.


def first_positions(stream: DataFrame) -> DataFrame:
    """``key, f``: the position and batch at which each key came first; null is a key.  The state is a row per key, spread by key."""
    return stream.groupBy("key").agg(F.min(F.struct("pos", "batch")).alias("f"))


def batch_keys(stream: DataFrame) -> DataFrame:
    """``batch, key, n``: the keys of each batch."""
    return stream.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("n"))


def most_zeros(stream: DataFrame, family: list[tuple[int, int]]) -> DataFrame:
    """``batch, number, zeros``: the state is one maximum per batch and hash function."""
    x = text_number(F.col("key"), SKETCH_MODULUS)
    each = stream.where(F.col("key").isNotNull()).select("batch", x.alias("x")).withColumn("h", F.explode(family_column(family)))
    binary = F.bin(linear_hash(F.col("x"), F.col("h.a"), F.col("h.b"), SKETCH_MODULUS, SKETCH_RANGE))
    zeros = F.length(binary) - F.length(F.rtrim(binary, F.lit("0")))
    return each.groupBy("batch", F.col("h.number").alias("number")).agg(F.max(zeros).alias("zeros"))


# The same run over all that is there, with the results of the set forms.


def distinct_counts(stream: DataFrame) -> DataFrame:
    """``batch, n_distinct``."""
    return run_to_end(batch_keys(stream), "update").groupBy("batch").agg(F.count_distinct("key").alias("n_distinct"))


def estimates(stream: DataFrame, family: list[tuple[int, int]]) -> DataFrame:
    """``batch, estimate`` of Flajolet and Martin."""
    written = run_to_end(most_zeros(stream, family), "update")
    return distinct_estimates(written.groupBy("batch", "number").agg(F.max("zeros").alias("zeros")))


def _batches(stream: DataFrame) -> DataFrame:
    return run_to_end(stream.groupBy("batch").agg(F.count(F.lit(1)).alias("n")), "update").select("batch").distinct()


def bloom_rates(stream: DataFrame, bits: int, hashes=BLOOM_HASHES, modulus: int = BLOOM_MODULUS) -> DataFrame:
    """``batch, n_false, n_true, rate`` of a filter that lives as long as the stream.

    Which bits were set when a key came first follows from where the keys came
    first, so no task holds the filter or all keys.
    """
    written = run_to_end(first_positions(stream), "update").where(F.col("key").isNotNull())
    first = written.groupBy("key").agg(F.min("f").alias("f")).select("key", "f.pos", "f.batch")
    return rates_of_first(first, _batches(stream), bits, hashes, modulus)


def reservoir(stream: DataFrame, size: int, seed: int) -> DataFrame:
    """``seqnum, slot, value`` after each batch; the state is the latest writer of each slot that a batch writes."""
    written = run_to_end(slot_writers(stream, size, seed), "update")
    return slots_over_time(written.groupBy("batch", "slot").agg(F.max("last").alias("last")), _batches(stream), size)
