"""Baskets and frequent itemsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_baskets(rows: DataFrame, basket: str, item: str, larger_than: int = 0) -> DataFrame:
    """``basket, item``, each pair once, of the baskets with more than ``larger_than`` items; nulls are ignored."""
    once = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    if not larger_than:
        return once
    large = once.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > larger_than).select("basket")
    return once.join(large, "basket", "left_semi")


def _frequent(occurrences: DataFrame, support: int) -> DataFrame:
    return occurrences.groupBy("part", "items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def _levels(rows: DataFrame, support: int, max_size: int | None, materialize: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """``part, items, n`` of the itemsets of each size that are frequent within a part.

    Pairs are counted where they stand, from the frequent items of a basket,
    and combined before the shuffle.  From triples on, level k joins the
    occurrences of level k-1 in one basket that agree but for the last item,
    and candidates with an infrequent subset are removed before they are
    counted.  Only occurrences of frequent itemsets are written.
    """
    single = rows.select("part", "basket", F.array("item").alias("items"))
    levels = [materialize(_frequent(single, support))]
    held, size = single, 1

    def grown(df: DataFrame, by: list[str], size: int) -> DataFrame:
        """Itemsets of ``size`` from those of one item less that agree but for the last one."""
        head, tail = F.slice("items", 1, size - 2), F.element_at("items", -1)
        one = df.select(*by, head.alias("head"), tail.alias("x"))
        two = df.select(*by, head.alias("head"), tail.alias("y"))
        joined = one.join(two, [*by, "head"] if size > 2 else by).where(F.col("x") < F.col("y"))
        return joined.select(*by, (F.concat(one["head"], F.array("x", "y")) if size > 2 else F.array("x", "y")).alias("items"))

    while (max_size is None or size < max_size) and not levels[-1].isEmpty():
        level = levels[-1].select("part", "items")
        held = materialize(held.join(level, ["part", "items"], "left_semi"))
        size += 1
        met = grown(held, ["part", "basket"], size)
        if size > 2:
            candidates = grown(level, ["part"], size)
            subsets = candidates.withColumn("without", F.explode(F.sequence(F.lit(1), F.lit(size))))
            subset = F.concat(F.slice("items", 1, F.col("without") - 1), F.slice("items", F.col("without") + 1, F.lit(size) - F.col("without")))
            found = subsets.withColumn("subset", subset).join(level.withColumnRenamed("items", "subset"), ["part", "subset"], "left_semi")
            candidates = found.groupBy("part", "items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
            met = met.join(candidates.select("part", "items"), ["part", "items"], "left_semi")
        levels.append(materialize(_frequent(met, support)))
        held = met
    return levels


def _union(levels: list[DataFrame]) -> DataFrame:
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def frequent_itemsets(baskets: DataFrame, support: int, materialize: Callable[[DataFrame], DataFrame], max_size: int | None = None) -> DataFrame:
    """``items, n``: all sets of items (ascending) that at least ``support`` baskets hold.

    ``baskets`` holds distinct ``basket, item``.  No baskets, or none frequent,
    give no rows.
    """
    return _union(_levels(baskets.select(F.lit(0).alias("part"), "basket", "item"), support, max_size, materialize)).select("items", "n")


def frequent_itemsets_by_growth(baskets: DataFrame, support: int) -> DataFrame:
    """The same by pattern growth, for baskets that fit an executor's memory one by one."""
    from pyspark.ml.fpm import FPGrowth

    n = baskets.select("basket").distinct().count()
    grouped = baskets.groupBy("basket").agg(F.collect_list("item").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (support - 0.5) / max(1, n)))).fit(grouped).freqItemsets
    return found.where(F.col("freq") >= support).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def son_candidates(baskets: DataFrame, support: int, partitions: int, materialize: Callable[[DataFrame], DataFrame], max_size: int | None = None) -> DataFrame:
    """``items``: the itemsets that reach ``ceil(support / partitions)`` within some part.

    ``baskets`` holds distinct ``basket, item, part``; the part of a basket is
    given, so the result doesn't depend on how rows happen to be placed.
    """
    return _union(_levels(baskets, -(-support // partitions), max_size, materialize)).select("items").distinct()


def count_candidates(baskets: DataFrame, candidates: DataFrame, support: int, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``items, n``: the ``candidates`` (``items``, distinct) that at least ``support`` of all baskets hold.

    ``baskets`` holds distinct ``basket, item``.  A candidate meets the baskets
    of its rarest item first, then those that also hold the next, so that
    frequent items are looked up in what is left.
    """
    frequency = baskets.groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    each = candidates.select("items", F.explode("items").alias("item")).join(frequency, "item")
    ordered = each.groupBy("items").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("order"))  # as many entries as the itemset
    left = ordered.where(F.size("order") == F.size("items")).select("items", F.col("order.item").alias("order"))
    most = candidates.agg(F.max(F.size("items"))).first()[0] or 0  # one number
    counts = [candidates.select("items", F.lit(0).cast("bigint").alias("n")).where(F.lit(False))]
    for at in range(most):
        asked = left.withColumn("item", F.get("order", F.lit(at)))
        met = asked.join(baskets, "item" if at == 0 else ["basket", "item"]).drop("item")
        left = materialize(met.where(F.size("order") > at + 1))
        counts.append(met.where(F.size("order") == at + 1).groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    return _union(counts).where(F.col("n") >= support)
