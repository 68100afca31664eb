"""Queries of the stream sketches, in set form and as Structured Streaming, and of the clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import BLOOM_HASHES, BLOOM_MODULUS, SKETCH_MODULUS, SKETCH_RANGE, draw_sql, hash_family
from tessera.operators import cluster, sketch
from tessera.session import materialize
from tessera.sources import sinks
from tessera.sources.tables import table
from tessera.streaming import sketches

BATCH = 1000
#: Few enough that a filter over the events' users gives false positives.
BITS = 997
FAMILY = hash_family(100, 2, SKETCH_MODULUS)
RESERVOIR, SEED = 100, 5
N_CLUSTERS = 10


def _set_form(spark: SparkSession, folder: str, size: int = BATCH) -> DataFrame:
    return sketch.count_batches(table(spark, folder, "events"), "event_id", "user_id", size)


def _stream(spark: SparkSession, folder: str, size: int = BATCH) -> DataFrame:
    return sketches.stream_of(spark, folder, "events", "event_id", "user_id", size)


def _rounded(rates: DataFrame) -> DataFrame:
    return rates.select("batch", "n_false", "n_true", F.round("rate", 6).alias("rate"))


def bloom_fpr(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(sketch.bloom_rates(_set_form(spark, folder), BITS))


def fm_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.distinct_estimates(sketch.trailing_zeros(_set_form(spark, folder), FAMILY))


def batch_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.distinct_per_batch(_set_form(spark, folder))


def reservoir_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.reservoir(_set_form(spark, folder, RESERVOIR), RESERVOIR, SEED)


def reservoir_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.reservoir_report(reservoir_slots(spark, folder))


def bloom_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.fpr_report(bloom_fpr(spark, folder))


def estimate_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.estimate_report(batch_distinct(spark, folder), fm_estimate(spark, folder))


def stream_bloom_fpr(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(sketches.bloom_rates(_stream(spark, folder), BITS))


def stream_fm_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.estimates(_stream(spark, folder), FAMILY)


def stream_batch_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.distinct_counts(_stream(spark, folder))


def stream_reservoir_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.reservoir(_stream(spark, folder, RESERVOIR), RESERVOIR, SEED)


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("bigint").alias("cluster"))


def cluster_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = cluster.summarize(_points(spark, folder))
    return found.select("cluster", "dim", "n", F.round("total", 5).alias("total"), F.round("squares", 5).alias("squares"))


def mahalanobis_assign(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest labelled cluster of each point."""
    points = _points(spark, folder)
    found = cluster.nearest(points, materialize(cluster.summarize(points)), 1000)
    return found.select("id", "cluster", F.round("distance", 4).alias("distance"))


def bfr_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.bfr(_points(spark, folder), N_CLUSTERS, materialize).labels


def bfr_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.bfr(_points(spark, folder), N_CLUSTERS, materialize).rounds


def bfr_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.cluster_report(bfr_rounds(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        bloom_fpr, fm_estimate, batch_distinct, reservoir_slots, reservoir_report, bloom_report, estimate_report, stream_bloom_fpr, stream_fm_estimate, stream_batch_distinct, stream_reservoir_slots,
        cluster_stats, mahalanobis_assign, bfr_labels, bfr_rounds, bfr_report,
    )
}

_NUMBER = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (a * 256 + x) % {0})"
_E = f"WITH e AS (SELECT event_id AS pos, event_id // {BATCH} AS batch, user_id::VARCHAR AS k FROM events)"
_BLOOM = _E + ", h(a, b) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in BLOOM_HASHES) + f"""), f AS (SELECT k, min(pos) AS pos, min(batch) AS batch, {_NUMBER.format(BLOOM_MODULUS)} AS x FROM e GROUP BY k),
bit AS (SELECT k, pos, batch, (a * x + b) % {BLOOM_MODULUS} % {BITS} AS bit FROM f, h), since AS (SELECT bit, min(pos) AS since FROM bit GROUP BY 1),
d AS (SELECT k, pos, batch, max(since) AS ready FROM bit JOIN since USING (bit) GROUP BY ALL),
n AS (SELECT batch, count(*) FILTER (ready < pos) AS n_false, count(*) FILTER (ready >= pos) AS n_true FROM d GROUP BY 1)
SELECT batch, coalesce(n_false, 0) AS n_false, coalesce(n_true, 0) AS n_true, round(n_false / nullif(n_false + n_true, 0), 6) AS rate FROM (SELECT DISTINCT batch FROM e) LEFT JOIN n USING (batch)"""
_FM = _E + ", h(number, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(FAMILY)) + f"""),
x AS (SELECT DISTINCT batch, k, {_NUMBER.format(SKETCH_MODULUS)} AS x FROM e),
z AS (SELECT batch, number, max(length(t) - length(rtrim(t, '0'))) AS z FROM (SELECT batch, number, bin(((a * x + b) % {SKETCH_MODULUS} % {SKETCH_RANGE})::BIGINT) AS t FROM x, h) GROUP BY 1, 2),
m AS (SELECT batch, number // 20 AS g, median(z) AS m FROM z GROUP BY 1, 2)
SELECT batch, floor(power(2, avg(m)))::BIGINT AS estimate FROM m GROUP BY 1"""
_RESERVOIR = f"""WITH e AS (SELECT event_id AS pos, event_id // {RESERVOIR} AS batch, user_id::VARCHAR AS k, {draw_sql('event_id', SEED)} AS u1, {draw_sql('event_id', SEED + 1)} AS u2 FROM events),
w AS (SELECT pos, batch, k, (CASE WHEN pos >= {RESERVOIR} THEN floor(u2 * {RESERVOIR}) ELSE pos END)::INT AS slot FROM e
  WHERE pos < {RESERVOIR} OR u1 < {float(RESERVOIR)} / (pos - {RESERVOIR} + 1 + {RESERVOIR})),
l AS (SELECT batch, slot, arg_max(k, pos) AS k FROM w GROUP BY 1, 2),
g AS (SELECT b.batch, s.slot::INT AS slot FROM (SELECT DISTINCT batch FROM e) b, range({RESERVOIR}) AS s(slot))
SELECT (g.batch + 1) * {RESERVOIR} AS seqnum, g.slot, last_value(k IGNORE NULLS) OVER (PARTITION BY g.slot ORDER BY g.batch) AS value FROM g LEFT JOIN l USING (batch, slot)"""
_STATS = """WITH x AS (SELECT vec_id AS id, label::BIGINT AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS dim FROM embeddings),
s AS (SELECT cluster, dim, count(*) AS n, sum(x) AS total, sum(x * x) AS squares FROM x GROUP BY 1, 2)"""

_SHOWN = ", ".join(f'max(value) FILTER (slot = {i}) AS "{i}_id"' for i in (0, 20, 40, 60, 80))

SQL = {
    "reservoir_report": f"SELECT seqnum, {_SHOWN} FROM ({_RESERVOIR}) GROUP BY 1",
    "bloom_report": f'SELECT batch AS "Time", coalesce(rate, 0)::DOUBLE AS "FPR" FROM ({_BLOOM})',
    "estimate_report": f'SELECT t.batch AS "Time", n AS "Ground Truth", coalesce(estimate, 0) AS "Estimation" FROM (SELECT event_id // {BATCH} AS batch, count(DISTINCT user_id) AS n FROM events GROUP BY 1) t LEFT JOIN ({_FM}) f ON f.batch = t.batch',
    "bloom_fpr": _BLOOM,
    "stream_bloom_fpr": _BLOOM,
    "fm_estimate": _FM,
    "stream_fm_estimate": _FM,
    "batch_distinct": _E + " SELECT batch, count(DISTINCT k) AS n_distinct FROM e GROUP BY 1",
    "stream_batch_distinct": _E + " SELECT batch, count(DISTINCT k) AS n_distinct FROM e GROUP BY 1",
    "reservoir_slots": _RESERVOIR,
    "stream_reservoir_slots": _RESERVOIR,
    "cluster_stats": _STATS + " SELECT cluster, dim, n, round(total, 5) AS total, round(squares, 5) AS squares FROM s",
    "mahalanobis_assign": _STATS + f""", c AS (SELECT cluster, dim, total / n AS m, greatest({cluster.LEAST_VARIANCE}, squares / n - (total / n) * (total / n)) AS v FROM s),
d AS (SELECT x.id, c.cluster, sqrt(sum((x.x - m) * (x.x - m) / v)) AS d FROM x JOIN c USING (dim) GROUP BY 1, 2)
SELECT id, arg_min(cluster, (d, cluster)) AS cluster, round(min(d), 4) AS distance FROM d GROUP BY 1""",
}
