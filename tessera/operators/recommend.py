"""Item-based prediction, boosted trees and the switching hybrid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.overlap import shared_sums
from tessera.operators.relational import having_count
from tessera.session import materialize


def means(ratings: DataFrame, key: str) -> DataFrame:
    """``key, mean, n`` of the ratings of each user or item."""
    return ratings.groupBy(key).agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n"))


def pearson(ratings: DataFrame, min_ratings: int, more_than: int) -> DataFrame:
    """``one, two, similarity``: items whose ratings by common users rise together.

    ``ratings`` holds one ``user, item, rating`` per pair.  Items with at least
    ``min_ratings`` ratings take part, pairs with more than ``more_than`` common
    users count.  Ratings are centred on the item's mean over all its raters;
    only similarities above 0 are kept, and none comes from constant ratings.
    """
    centred = ratings.join(means(ratings, "item").select("item", "mean"), "item").select("user", "item", (F.col("rating") - F.col("mean")).alias("d"))
    rows = having_count(centred, "item", min_ratings).select(F.col("item").alias("name"), F.col("user").alias("element"), "d")
    sums = shared_sums(rows, more_than + 1, "d")
    similarity = F.try_divide("top", F.sqrt("s1") * F.sqrt("s2"))
    return sums.select("one", "two", similarity.alias("similarity")).where(F.col("similarity") > 1e-12)


def collaborative(pairs: DataFrame, ratings: DataFrame, similarities: DataFrame) -> DataFrame:
    """``user, item, user_mean, item_mean, weighted`` of each distinct pair.

    ``weighted`` is the mean of the user's ratings weighted by the similarity of
    their items to ``item``; null where no rated item is similar.
    """
    both = similarities.select(F.col("one").alias("item"), F.col("two").alias("other"), "similarity")
    both = both.unionByName(similarities.select(F.col("two").alias("item"), F.col("one").alias("other"), "similarity"))
    rated = ratings.select("user", F.col("item").alias("other"), "rating")
    # a pair meets the fewer of the items that are like its own and those that its user rated
    similar = both.groupBy("item").agg(F.count(F.lit(1)).alias("n_similar"))
    of_item = means(ratings, "item").select("item", F.col("mean").alias("item_mean")).join(similar, "item", "left")
    of_user = means(ratings, "user").select("user", F.col("mean").alias("user_mean"), F.col("n").alias("n_rated"))
    rows = materialize(pairs.select("user", "item").distinct().join(of_user, "user", "left").join(of_item, "item", "left"))
    some = F.col("n_similar").isNotNull() & F.col("n_rated").isNotNull()
    asked, meet = rows.where(some), ["user", "item", "rating", "similarity"]
    by_item = asked.where("n_similar <= n_rated").select("user", "item").join(both, "item").join(rated, ["user", "other"]).select(*meet)
    by_user = asked.where("n_similar > n_rated").select("user", "item").join(rated, "user").join(both, ["item", "other"]).select(*meet)
    sums = by_item.unionByName(by_user).groupBy("user", "item").agg(
        F.sum(F.col("rating") * F.col("similarity")).alias("top"), F.sum(F.abs("similarity")).alias("weight"),
    )
    out = asked.join(sums, ["user", "item"], "left").unionByName(rows.where(~some), allowMissingColumns=True)
    return out.select("user", "item", "user_mean", "item_mean", F.try_divide("top", "weight").alias("weighted"))


def predict(pairs: DataFrame, ratings: DataFrame, similarities: DataFrame, unknown: float = 3.0) -> DataFrame:
    """``user, item, prediction``; the item's mean, the user's, or ``unknown``, where one or both are new."""
    rows = collaborative(pairs, ratings, similarities)
    guess = (
        F.when(F.col("user_mean").isNull() & F.col("item_mean").isNull(), F.lit(unknown))
        .when(F.col("user_mean").isNull(), F.col("item_mean")).when(F.col("item_mean").isNull(), F.col("user_mean"))
        .otherwise(F.coalesce("weighted", "item_mean"))
    )
    return rows.select("user", "item", guess.alias("prediction"))


def hybrid(pairs: DataFrame, ratings: DataFrame, similarities: DataFrame, model: DataFrame) -> DataFrame:
    """``user, item, prediction``: collaborative where it can be, else that of ``model`` (``user, item, prediction``)."""
    rows = collaborative(pairs, ratings, similarities).join(model.select("user", "item", F.col("prediction").alias("modelled")), ["user", "item"], "left")
    known = F.col("user_mean").isNotNull() & F.col("item_mean").isNotNull()
    return rows.select("user", "item", F.coalesce(F.when(known, F.col("weighted")), "modelled").alias("prediction"))


def held_out(rows: DataFrame, keys: Sequence[str], nth: int = 5) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts by a hash of ``keys``: about one of ``nth`` rows is held out, the same ones at every run."""
    out = F.pmod(F.xxhash64(*keys), F.lit(nth)) == 0
    return rows.where(~out), rows.where(out)


def boosted_trees(
    train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, *, iterations: int = 30, step: float = 0.2, depth: int = 4, least_gain: float = 0.0005, seed: int = 7,
) -> DataFrame:
    """``rows`` with ``prediction`` of gradient-boosted trees fitted to ``train``; training rows without a label are left out.

    A tenth of the training rows only tells when another tree no longer improves
    their error by ``least_gain`` of it; there the model ends, or after
    ``iterations`` trees.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assemble = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error")
    known = train.where(F.col(label).isNotNull())
    judged = known.withColumn("__judge", F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(10)) == 0)
    model = GBTRegressor(
        featuresCol="__features", labelCol=label, maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed, validationIndicatorCol="__judge", validationTol=least_gain,
    )
    return model.fit(assemble.transform(judged).select("__features", "__judge", label)).transform(assemble.transform(rows)).drop("__features")
