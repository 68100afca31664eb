"""Clustering of points in chunks with compact summaries (BFR).

Points are ``id, features`` (array of doubles, all of one length).  A cluster is
summarised by number, sum and sum of squares in each dimension.  A chunk's
points are all compared with the summaries as they were before the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Materialize = Callable[[DataFrame], DataFrame]
#: Summaries that are sent to every task at once.
SUMMARIES_SENT = 10_000
#: Least variance of a dimension, for clusters without spread.
LEAST_VARIANCE = 1e-6


def summarize(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, dim, n, total, squares`` of points with a cluster."""
    long = points.select(F.col(cluster).alias("cluster"), F.posexplode("features").alias("dim", "x"))
    return long.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def merge(one: DataFrame, two: DataFrame) -> DataFrame:
    """Summaries of both added up by cluster."""
    return one.unionByName(two).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def centres(summaries: DataFrame) -> DataFrame:
    """``cluster, centre, variance``: one row per cluster, arrays by dimension."""
    mean = F.col("total") / F.col("n")
    variance = F.greatest(F.lit(LEAST_VARIANCE), F.col("squares") / F.col("n") - mean * mean)
    packed = summaries.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", mean.alias("mean"), variance.alias("variance")))).alias("p"))
    return packed.select("cluster", F.col("p.mean").alias("centre"), F.col("p.variance").alias("variance"))


def nearest(points: DataFrame, summaries: DataFrame, clusters: int) -> DataFrame:
    """``id, features, cluster, distance``: the nearest cluster by Mahalanobis distance, of equals the least.

    ``clusters`` bounds the number of summaries.  They are sent to all tasks as
    one row of at most about ``SUMMARIES_SENT``; of more, every block offers its
    nearest and the best offer counts.  Ids are distinct.
    """
    packed = centres(summaries)
    blocks = max(1, -(-clusters // SUMMARIES_SENT))
    if blocks == 1:
        return _nearest_sent(points, packed)
    offered = None
    for i in range(blocks):
        part = _nearest_sent(points, packed.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == i))
        offered = part if offered is None else offered.unionByName(part)
    best = offered.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("best"), F.any_value("features").alias("features"))
    return best.select("id", "features", "best.cluster", "best.distance")


def _nearest_sent(points: DataFrame, packed: DataFrame) -> DataFrame:
    every = packed.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre", "variance"))).alias("every"))
    terms = lambda x, c: F.zip_with(F.zip_with(x, c["centre"], lambda a, b: a - b), c["variance"], lambda d, v: d * d / v)
    distance = lambda x, c: F.sqrt(F.aggregate(terms(x, c), F.lit(0.0), lambda a, t: a + t))
    offers = F.transform(F.col("every"), lambda c: F.struct(distance(F.col("features"), c).alias("distance"), c["cluster"].alias("cluster")))
    scored = points.select("id", "features").join(F.broadcast(every)).withColumn("best", F.array_min(offers))
    return scored.select("id", "features", "best.cluster", "best.distance")


@dataclass(frozen=True)
class Clustering:
    """``labels``: ``id, cluster``, -1 for points of no main cluster; ``rounds``: one row per chunk."""

    labels: DataFrame
    rounds: DataFrame


def _kmeans(points: DataFrame, k: int, seed: int, materialize: Materialize) -> DataFrame:
    """``id, features, cluster`` by k-means, of at most as many clusters as there are different points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = materialize(points.select("id", "features"))
    k = min(k, ready.select("features").distinct().limit(k).count())
    if k < 2:  # the library wants two
        return ready.withColumn("cluster", F.lit(0).cast("bigint"))
    ready = ready.withColumn("v", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster", maxIter=10).fit(ready)
    return materialize(model.transform(ready).select("id", "features", F.col("cluster").cast("bigint").alias("cluster")))


def _split_singles(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of clusters of several points, and those alone in theirs."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    joined = clustered.join(sizes, "cluster")
    return joined.where(F.col("size") > 1).drop("size"), joined.where(F.col("size") == 1).drop("size")


def bfr(points: DataFrame, n_clusters: int, materialize: Materialize, *, chunks: int = 5, first_k: int = 100, most_compressed: int = 500, seed: int = 7) -> Clustering:
    """Clusters ``points`` chunk by chunk.

    Points near a main cluster (under ``2 sqrt(d)``) join it, else a compressed
    set, else they are retained; retained points are clustered again in each
    round, groups of several becoming compressed sets, of which there are at
    most ``most_compressed`` new ones a round.  No points give no labels.
    """
    spark = points.sparkSession
    points = materialize(points.select("id", "features").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(chunks)).cast("int")))
    first_point = points.first()
    empty = spark.createDataFrame([], "round int, n_main bigint, n_sets bigint, n_compressed bigint, n_retained bigint")
    if first_point is None:
        return Clustering(points.select("id", F.lit(-1).cast("bigint").alias("cluster")), empty)
    bound = 2 * math.sqrt(len(first_point["features"]))
    labels: list[DataFrame] = []
    rounds, compressed_points = [], 0
    main = compressed = retained = None
    n_sets = 0
    for number in range(chunks):
        chunk = points.where(F.col("chunk") == number).select("id", "features")
        n = chunk.count()
        if main is None:
            if n < 2 and number < chunks - 1:
                points = materialize(points.withColumn("chunk", F.when(F.col("chunk") == number, number + 1).otherwise(F.col("chunk"))))
                rounds.append((number, 0, 0, 0, 0))
                continue
            several, alone = _split_singles(_kmeans(chunk, max(2, min(first_k, n // 5)), seed, materialize))
            if several.isEmpty():
                several, alone = chunk, alone.where(F.lit(False))
            placed = _kmeans(several, max(2, n_clusters), seed, materialize)
            main = materialize(summarize(placed))
            retained = materialize(alone.select("id", "features"))
        else:
            offered = materialize(nearest(chunk, main, n_clusters))
            placed = offered.where(F.col("distance") < bound).select("id", "features", "cluster")
            rest = offered.where(F.coalesce(F.col("distance") >= bound, F.lit(True))).select("id", "features")
            main = materialize(merge(main, summarize(placed)))
            if compressed is not None:
                offered = materialize(nearest(rest, compressed, n_sets))
                near = offered.where(F.col("distance") < bound)
                compressed = materialize(merge(compressed, summarize(near)))
                compressed_points += near.count()
                rest = offered.where(F.coalesce(F.col("distance") >= bound, F.lit(True))).select("id", "features")
            retained = materialize(retained.unionByName(rest))
        labels.append(placed.select("id", "cluster"))
        left = retained.count()
        if left > 2:
            several, alone = _split_singles(_kmeans(retained, min(max(2, left // 2), most_compressed), seed + number, materialize))
            several = materialize(several.withColumn("cluster", F.col("cluster") + (number + 1) * most_compressed))
            new = several.count()
            if new:
                compressed = materialize(merge(compressed, summarize(several)) if compressed is not None else summarize(several))
                n_sets = compressed.select("cluster").distinct().count()
                compressed_points += new
                retained = materialize(alone.select("id", "features"))
                left -= new
        n_main = sum(part.count() for part in labels)
        rounds.append((number, n_main, n_sets, compressed_points, left))
    whole = labels[0] if labels else points.select("id", F.lit(-1).cast("bigint").alias("cluster")).where(F.lit(False))
    for part in labels[1:]:
        whole = whole.unionByName(part)
    named = points.select("id").join(whole, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
    return Clustering(named, spark.createDataFrame(rounds, empty.schema))
