"""Features of texts, maps and packed fields, and the feature tables of the rating models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that count for a tip's score.
KEYWORDS = ("great", "awesome", "wonderful", "beautiful", "good", "delicious", "yum", "love", "best", "excellent", "fantastic")
#: Year from which a user's years are counted.
REFERENCE_YEAR = 2023
USER_COUNTS = ("useful", "funny", "cool")
COMPLIMENTS = ("hot", "cute", "funny", "cool", "photos", "more", "profile", "list", "note", "plain", "writer")


def keyword_score(text: Column, words: Sequence[str] = KEYWORDS) -> Column:
    """Words of ``text``, parted by single blanks, that are keywords in any letter case; null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(F.lower(text), " "), lambda w: w.isin(*words))), F.lit(0)).cast("bigint")


def exclamations(text: Column) -> Column:
    """Exclamation marks of ``text``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("!")), F.lit(0)).cast("bigint")


def map_total(counts: Column) -> Column:
    """Sum of a map's values; null values count 0, a null or empty map gives 0."""
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))


def true_entries(flags: Column) -> Column:
    """Entries of a map whose value is the text ``True``; a null map has none."""
    return F.coalesce(F.size(F.map_filter(flags, lambda _, v: v == "True")), F.lit(0)).cast("bigint")


def size_or_zero(values: Column) -> Column:
    """Entries of a map or array; null has none."""
    return F.coalesce(F.when(values.isNotNull(), F.size(values)), F.lit(0)).cast("bigint")


def words_or_zero(text: Column, delimiter: str) -> Column:
    """Pieces between single delimiters; null has none, an empty text one."""
    return F.coalesce(F.size(F.split(text, delimiter)), F.lit(0)).cast("bigint")


def years_since(date: Column, year: int = REFERENCE_YEAR) -> Column:
    """Years from the year that begins the text ``date`` to ``year``; 0 if there is none."""
    return F.coalesce(F.lit(year) - F.try_to_number(F.split(date, "-")[0], F.lit("9999")).cast("int"), F.lit(0)).cast("bigint")


def top_labels(df: DataFrame, labels: Column, k: int) -> DataFrame:
    """``label, n``: the ``k`` most frequent labels of an array column; equals by label."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def indicators(df: DataFrame, keep: Sequence[str], labels: Column, vocabulary: Sequence[str], prefix: str = "label_") -> DataFrame:
    """``keep`` and a 0/1 column for each entry of a fixed vocabulary, numbered from 1; null labels give 0."""
    flag = lambda name: F.coalesce(F.array_contains(labels, name), F.lit(False)).cast("int")
    return df.select(*keep, *(flag(name).alias(f"{prefix}{i}") for i, name in enumerate(vocabulary, 1)))


def _counted(sums: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``business_id`` and the sum of each value over its table, null where a business has no row there: one shuffle for all tables."""
    parts = None
    for name, (df, value) in sums.items():
        part = df.select("business_id", *(value.cast("bigint").alias(n) if n == name else F.lit(None).cast("bigint").alias(n) for n in sums))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("business_id").agg(*(F.sum(n).alias(n) for n in sums))


def basic_features(pairs: DataFrame, business: DataFrame, user: DataFrame, tips: DataFrame, photos: DataFrame, checkins: DataFrame) -> DataFrame:
    """Six numbers for each ``user_id, business_id, ...`` of ``pairs``.

    Unknown businesses have 3 stars and no reviews, tips, photos or check-ins;
    unknown users an average of 3.
    """
    item = business.select("business_id", F.col("stars").alias("item_stars"), F.col("review_count").alias("item_reviews"))
    item = item.join(_counted({"n_tips": (tips, F.lit(1)), "n_photos": (photos, F.lit(1)), "n_checkins": (checkins, map_total(F.col("time")))}), "business_id", "full")
    rows = pairs.join(item, "business_id", "left").join(user.select("user_id", F.col("average_stars").alias("user_average")), "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        *pairs.columns, F.coalesce("item_stars", F.lit(3.0)).alias("item_stars"), zero("item_reviews"), zero("n_tips"), zero("n_photos"), zero("n_checkins"),
        F.coalesce("user_average", F.lit(3.0)).alias("user_average"),
    )


def full_features(
    pairs: DataFrame, business: DataFrame, user: DataFrame, tips: DataFrame, photos: DataFrame, checkins: DataFrame, vocabulary: Sequence[str], *, fallback: float | None = 3.5,
) -> DataFrame:
    """All features for each ``user_id, business_id, ...`` of ``pairs``.

    Unknown stars and averages are ``fallback``; without one, as for pairs that
    are to be predicted, unknown stars are the user's average and an unknown
    average is the mean of the known users'.  Unknown review counts are the mean
    of the known ones of ``pairs``, all else 0.  A business's tip score sums the
    keywords and exclamation marks of all its tips.
    """
    labels = F.split("categories", ", ")
    item = business.select(
        "business_id", F.col("stars").alias("item_stars"), F.col("review_count").alias("item_reviews"), "latitude", "longitude",
        true_entries(F.col("attributes")).alias("n_true"), words_or_zero(F.col("categories"), " ").alias("category_words"), size_or_zero(F.col("hours")).alias("n_hours"),
        *(F.coalesce(F.array_contains(labels, v), F.lit(False)).cast("int").alias(f"category_{i}") for i, v in enumerate(vocabulary, 1)),
    )
    item = item.join(_counted({
        "tip_score": (tips, keyword_score(F.col("text")) + exclamations(F.col("text"))), "tip_likes": (tips, F.col("likes")), "n_photos": (photos, F.lit(1)), "n_checkins": (checkins, map_total(F.col("time"))),
    }), "business_id", "full")
    person = user.select(
        "user_id", F.col("average_stars").alias("user_average"), F.col("review_count").alias("user_reviews"),
        words_or_zero(F.col("friends"), ",").alias("n_friends"), years_since(F.col("yelping_since")).alias("years"),
        *(F.col(c).alias(f"user_{c}") for c in USER_COUNTS), *(F.col(f"compliment_{c}").alias(f"user_{c}_compliments") for c in COMPLIMENTS),
    )
    rows = pairs.join(item, "business_id", "left").join(person, "user_id", "left")

    def mean_over_pairs(key: str, known: DataFrame) -> Column:
        """Of a value of each known business or user, the mean over the pairs: weighted by their number, without the pairs themselves."""
        weighed = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("w")).join(known.select(key, F.col("review_count").alias("v")), key).where(F.col("v").isNotNull())
        return weighed.agg(F.try_divide(F.sum(F.col("w") * F.col("v")).cast("double"), F.sum("w"))).scalar()

    rows = rows.withColumns({"mean_item_reviews": mean_over_pairs("business_id", business), "mean_user_reviews": mean_over_pairs("user_id", user)})
    if fallback is None:
        rows = rows.withColumn("user_average", F.coalesce("user_average", user.agg(F.avg("average_stars")).scalar(), F.lit(3.5)))
        rows = rows.withColumn("item_stars", F.coalesce("item_stars", "user_average"))
    of_item = ["n_true", "category_words", "n_hours", "tip_score", "tip_likes", "n_photos", "n_checkins", "n_friends", "years", *(f"category_{i}" for i in range(1, len(vocabulary) + 1))]
    counts = [*of_item, *(f"user_{c}" for c in USER_COUNTS), *(f"user_{c}_compliments" for c in COMPLIMENTS)]
    return rows.select(
        *pairs.columns,
        *(F.coalesce(c, F.lit(fallback or 3.5)).alias(c) for c in ("item_stars", "user_average")),
        F.coalesce(F.col("item_reviews").cast("double"), "mean_item_reviews").alias("item_reviews"), F.coalesce(F.col("user_reviews").cast("double"), "mean_user_reviews").alias("user_reviews"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("latitude", "longitude")),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
    )
