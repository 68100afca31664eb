"""Queries of the relational core, the features and the itemsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.baskets import BASKET_SQL, basket_items
from tessera.operators import features, itemsets, relational
from tessera.session import materialize
from tessera.sources import sinks, views
from tessera.sources.tables import table

YEAR, TOP = 2018, 10
PARTITIONS = 7
MIN_REVIEWS = 20
MORE_ITEMS_THAN = 5
#: Share of the baskets that hold a frequent itemset; parts of the two-pass method.
SUPPORT_SHARE, PARTS = 0.004, 4


def review_profile(spark: SparkSession, folder: str) -> DataFrame:
    return relational.review_profile(views.reviews(spark, folder), YEAR)


def review_profile_document(spark: SparkSession, folder: str) -> DataFrame:
    """The profile as one JSON document."""
    return sinks.json_document(relational.profile_document(views.reviews(spark, folder), YEAR, TOP))


def top_users(spark: SparkSession, folder: str) -> DataFrame:
    return relational.top_k(views.reviews(spark, folder), "user_id", TOP)


def top_items(spark: SparkSession, folder: str) -> DataFrame:
    return relational.top_k(views.reviews(spark, folder), "business_id", TOP)


def city_rating(spark: SparkSession, folder: str) -> DataFrame:
    """Mean stars of the reviews of each city, city names without case and outer blanks."""
    city = F.lower(F.btrim("city"))
    means = relational.mean_by_lookup(views.reviews(spark, folder), views.businesses(spark, folder), "business_id", city, "stars", "city")
    return means.select("city", F.round("mean", 6).alias("stars"))


def city_rating_top10(spark: SparkSession, folder: str) -> DataFrame:
    return city_rating(spark, folder).where(F.col("city").isNotNull()).orderBy(F.desc("stars"), "city").limit(TOP)


def city_rating_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """All cities, the best first."""
    return city_rating(spark, folder).orderBy(F.desc("stars"), "city")


def partition_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews by partition when placed by the first character of the business."""
    rows = views.reviews(spark, folder).where(F.col("business_id").isNotNull()).select("business_id")
    return relational.partition_sizes(rows, PARTITIONS, F.ascii("business_id"))


def partition_histogram_default(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews by partition as the scan places them."""
    return relational.partition_sizes(views.reviews(spark, folder).select("business_id"), PARTITIONS)


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, folder, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def map_sum(spark: SparkSession, folder: str) -> DataFrame:
    checkins = views.counted_per_business(spark, folder, "checkin")
    return checkins.groupBy("business_id").agg(F.sum(features.map_total(F.col("time"))).alias("n_checkins"))


def keyword_score(spark: SparkSession, folder: str) -> DataFrame:
    tips = views.counted_per_business(spark, folder, "tip")
    return tips.groupBy("business_id").agg(F.sum(features.keyword_score(F.col("text"))).alias("score"))


def exclamation_count(spark: SparkSession, folder: str) -> DataFrame:
    tips = views.counted_per_business(spark, folder, "tip")
    return tips.groupBy("business_id").agg(F.sum(features.exclamations(F.col("text"))).alias("n"))


def _labels() -> Column:
    return F.split("categories", ", ")


def category_top(spark: SparkSession, folder: str) -> DataFrame:
    return features.top_labels(views.businesses(spark, folder), _labels(), 20)


def _vocabulary(spark: SparkSession, folder: str) -> list[str]:
    return [r["label"] for r in category_top(spark, folder).orderBy(F.desc("n"), "label").collect()]  # 20 rows


def category_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """0/1 columns of the 20 most frequent categories."""
    return features.indicators(views.businesses(spark, folder), ["business_id"], _labels(), _vocabulary(spark, folder))


def semi_valid_items(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of the businesses with enough of them."""
    return relational.having_count(views.ratings(spark, folder), "item", MIN_REVIEWS).select("user", "item", F.round("rating", 6).alias("rating"))


def left_default(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with the stars and review count of their business, or defaults."""
    rows = views.reviews(spark, folder).select("review_id", "business_id")
    known = views.businesses(spark, folder).select("business_id", F.col("stars").alias("item_stars"), F.col("review_count").alias("item_reviews"))
    return relational.with_defaults(rows, known, "business_id", {"item_stars": 3.0, "item_reviews": 0})


def last_value_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return views.businesses(spark, folder).select("business_id", "stars", "review_count")


def _visits(spark: SparkSession, folder: str, basket: str, item: str, larger_than: int = 0) -> DataFrame:
    return itemsets.build_baskets(views.visits(spark, folder), basket, item, larger_than)


def basket_build(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the baskets by user and by business."""
    by_user, by_item = _visits(spark, folder, "user", "item"), _visits(spark, folder, "item", "user")
    size = lambda df, kind: df.groupBy("basket").agg(F.count(F.lit(1)).alias("n_items")).withColumn("by", F.lit(kind))
    return size(by_user, "user").unionByName(size(by_item, "item"))


def basket_size_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, "user", "item", MORE_ITEMS_THAN)


def _transactions(spark: SparkSession, folder: str, larger_than: int = 0) -> DataFrame:
    rows = basket_items(table(spark, folder, "customer_product"), "date_customer_id", "product_id")
    return itemsets.build_baskets(rows, "basket", "item", larger_than)


def transaction_etl(spark: SparkSession, folder: str) -> DataFrame:
    """Baskets of a date and a customer with more than five products."""
    return _transactions(spark, folder, MORE_ITEMS_THAN)


def _support(baskets: DataFrame, share: float) -> int:
    return max(2, int(-(-baskets.select("basket").distinct().count() * share // 1)))


def _itemsets(spark: SparkSession, folder: str, max_size: int | None = None) -> DataFrame:
    baskets = materialize(_transactions(spark, folder))
    return itemsets.frequent_itemsets(baskets, _support(baskets, SUPPORT_SHARE), materialize, max_size)


def _spelled(found: DataFrame) -> DataFrame:
    """Items of an itemset as one text, so that the rows are flat."""
    return found.select(F.size("items").alias("size"), F.array_join(F.col("items").cast("array<string>"), " ").alias("items"), "n")


def itemsets_l1(spark: SparkSession, folder: str) -> DataFrame:
    return _spelled(_itemsets(spark, folder, 1))


def itemsets_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _spelled(_itemsets(spark, folder, 2)).where("size = 2")


def itemsets_l3(spark: SparkSession, folder: str) -> DataFrame:
    return _spelled(_itemsets(spark, folder, 3)).where("size = 3")


def itemsets_all(spark: SparkSession, folder: str) -> DataFrame:
    return _spelled(_itemsets(spark, folder))


def itemsets_by_growth(spark: SparkSession, folder: str) -> DataFrame:
    """The same by pattern growth."""
    baskets = materialize(_transactions(spark, folder))
    return _spelled(itemsets.frequent_itemsets_by_growth(baskets, _support(baskets, SUPPORT_SHARE)))


def itemset_report(spark: SparkSession, folder: str) -> DataFrame:
    """The frequent itemsets as the lines of a report."""
    found = _itemsets(spark, folder)
    return sinks.itemset_report(found.withColumn("items", F.col("items").cast("array<string>")))


def _two_passes(spark: SparkSession, folder: str) -> tuple[DataFrame, int, DataFrame]:
    """The baskets, the support, and the itemsets that are frequent within one of four parts of the baskets."""
    baskets = materialize(_transactions(spark, folder))
    support = _support(baskets, SUPPORT_SHARE)
    parted = baskets.withColumn("part", (F.substring_index("basket", "-", -1).cast("bigint") % PARTS).cast("int"))
    return baskets, support, itemsets.son_candidates(parted, support, PARTS, materialize)


def son_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The itemsets of every size that are frequent within one of four parts of the baskets."""
    return _two_passes(spark, folder)[2].select(F.array_join(F.col("items").cast("array<string>"), " ").alias("items"))


def son_frequent(spark: SparkSession, folder: str) -> DataFrame:
    """The frequent itemsets by both passes: the candidates of the parts, counted over all baskets."""
    baskets, support, candidates = _two_passes(spark, folder)
    return _spelled(itemsets.count_candidates(baskets, materialize(candidates), support, materialize))


def itemset_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The report of both passes: the lines of the candidates and those of the frequent itemsets."""
    baskets, support, candidates = _two_passes(spark, folder)
    candidates = materialize(candidates)
    frequent = itemsets.count_candidates(baskets, candidates, support, materialize)
    text = lambda df: df.select(F.col("items").cast("array<string>").alias("items"))
    return sinks.itemset_sections(text(candidates), text(frequent))


QUERIES = {
    f.__name__: f
    for f in (
        review_profile, review_profile_document, top_users, top_items, city_rating, city_rating_top10, city_rating_sorted, partition_histogram, partition_histogram_default, json_props, map_sum,
        keyword_score, exclamation_count, category_top, category_indicators, semi_valid_items, left_default, last_value_per_key, basket_build, basket_size_filter,
        transaction_etl, itemsets_l1, itemsets_l2, itemsets_l3, itemsets_all, itemsets_by_growth, itemset_report, itemset_sections, son_candidates, son_frequent,
    )
}

_V = views.with_views
_CITY = _V("b", "r") + """, m AS (SELECT lower(trim(city)) AS city, round(sum(r.stars) / nullif(count(r.stars), 0), 6) AS stars FROM r JOIN b USING (business_id) GROUP BY 1)"""
_TOP20 = _V("b") + """, label AS (SELECT business_id, unnest(string_split(categories, ', ')) AS label FROM b),
top20 AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM label GROUP BY label ORDER BY n DESC, label LIMIT 20)"""
_WORDS = ", ".join(f"'{w}'" for w in features.KEYWORDS)
TRANSACTIONS = rf"""WITH RECURSIVE bare AS (SELECT translate(date_customer_id, E'"'' \t\r\n', '') AS t, product_id AS item FROM customer_product),
k AS (SELECT DISTINCT {BASKET_SQL} AS basket, item FROM bare WHERE t <> '' AND item IS NOT NULL),
big AS (SELECT basket FROM k GROUP BY 1 HAVING count(*) > {MORE_ITEMS_THAN}),
s AS (SELECT greatest(2, ceil(count(DISTINCT basket) * {SUPPORT_SHARE})::BIGINT) AS s FROM k),
l1 AS (SELECT item, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)),
f AS (SELECT * FROM k SEMI JOIN l1 USING (item)),
l2 AS (SELECT a.item AS i1, b.item AS i2, count(*) AS n FROM f a JOIN f b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL HAVING count(*) >= (SELECT s FROM s)),
o2 AS (SELECT a.basket, a.item AS i1, b.item AS i2 FROM f a JOIN f b ON a.basket = b.basket AND a.item < b.item SEMI JOIN l2 ON l2.i1 = a.item AND l2.i2 = b.item),
l3 AS (SELECT i1, i2, item AS i3, count(*) AS n FROM o2 JOIN f ON f.basket = o2.basket AND item > i2 GROUP BY ALL HAVING count(*) >= (SELECT s FROM s)),
o3 AS (SELECT o2.basket, o2.i1, o2.i2, item AS i3 FROM o2 JOIN f ON f.basket = o2.basket AND item > i2 SEMI JOIN l3 ON l3.i1 = o2.i1 AND l3.i2 = o2.i2 AND l3.i3 = item),
l4 AS (SELECT i1, i2, i3, item AS i4, count(*) AS n FROM o3 JOIN f ON f.basket = o3.basket AND item > i3 GROUP BY ALL HAVING count(*) >= (SELECT s FROM s)),
every AS (SELECT 1 AS size, item::VARCHAR AS items, n FROM l1 UNION ALL SELECT 2, i1 || ' ' || i2, n FROM l2 UNION ALL SELECT 3, i1 || ' ' || i2 || ' ' || i3, n FROM l3
  UNION ALL SELECT 4, i1 || ' ' || i2 || ' ' || i3 || ' ' || i4, n FROM l4)
"""
#: Candidates of every size: occurrences of a basket's itemsets that are frequent within its part.
_HELD = f""", q AS (SELECT *, string_split(basket, '-')[-1]::BIGINT % {PARTS} AS part FROM k), t AS (SELECT ceil(s / {PARTS}) AS t FROM s),
c1 AS (SELECT part, item FROM q GROUP BY ALL HAVING count(*) >= (SELECT t FROM t)),
g AS MATERIALIZED (SELECT q.* FROM q SEMI JOIN c1 ON c1.part = q.part AND c1.item = q.item),
held AS (SELECT part, basket, item AS last, item::VARCHAR AS items FROM g
  UNION ALL SELECT part, basket, last, items FROM (
    SELECT held.part, held.basket, g.item AS last, items || ' ' || g.item AS items, count(*) OVER (PARTITION BY held.part, items, g.item) AS n
    FROM held JOIN g ON g.basket = held.basket AND g.part = held.part AND g.item > held.last) WHERE n >= (SELECT t FROM t))
"""
#: The lines of a report of the itemsets in the table that is named.
_LINES = """, line AS (SELECT len(string_split(items, ' '))::INT AS size, string_agg('(''' || replace(items, ' ', ''', ''') || ''')', ',' ORDER BY string_split(items, ' ')) AS line FROM {0} GROUP BY 1)
"""

SQL = {
    "review_profile": _V("r") + f" SELECT count(*) AS n_review, count(*) FILTER (year(date) = {YEAR}) AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business FROM r",
    "top_users": _V("r") + f" SELECT user_id, count(*) AS n FROM r WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT {TOP}",
    "top_items": _V("r") + f" SELECT business_id, count(*) AS n FROM r WHERE business_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, business_id LIMIT {TOP}",
    "city_rating": _CITY + " SELECT * FROM m",
    "city_rating_sorted": _CITY + " SELECT * FROM m ORDER BY stars DESC NULLS LAST, city NULLS FIRST",
    "itemset_report": TRANSACTIONS + _LINES.format("every") + "SELECT * FROM line",
    "itemset_sections": TRANSACTIONS + _HELD + ", c AS (SELECT DISTINCT items FROM held)" + _LINES.format("c") + ", other" + _LINES.format("every").removeprefix(", line")
    + "SELECT 'Candidates' AS section, * FROM line UNION ALL SELECT 'Frequent Itemsets', * FROM other",
    "city_rating_top10": _CITY + f" SELECT * FROM m WHERE city IS NOT NULL ORDER BY stars DESC NULLS LAST, city LIMIT {TOP}",
    "partition_histogram": _V("r") + f""", n AS (SELECT (ascii(business_id) % {PARTITIONS})::INT AS partition, count(*) AS c FROM r WHERE business_id IS NOT NULL GROUP BY 1)
SELECT x.partition::INT AS partition, coalesce(c, 0) AS n_items FROM range({PARTITIONS}) AS x(partition) LEFT JOIN n ON n.partition = x.partition""",
    "json_props": "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "map_sum": _V("c") + ' SELECT business_id, sum(coalesce(list_sum(map_values("time")), 0))::BIGINT AS n_checkins FROM c GROUP BY 1',
    "keyword_score": _V("t") + f" SELECT business_id, sum(coalesce(len(list_filter(string_split(lower(text), ' '), lambda w: w IN ({_WORDS}))), 0))::BIGINT AS score FROM t GROUP BY 1",
    "exclamation_count": _V("t") + " SELECT business_id, sum(coalesce(length(text) - length(replace(text, '!', '')), 0))::BIGINT AS n FROM t GROUP BY 1",
    "category_top": _TOP20 + " SELECT label, n FROM top20",
    "category_indicators": _TOP20 + " SELECT b.business_id, " + ", ".join(f"coalesce(max(CASE WHEN rank = {i} THEN 1 ELSE 0 END), 0)::INT AS label_{i}" for i in range(1, 21))
    + " FROM b LEFT JOIN label USING (business_id) LEFT JOIN top20 USING (label) GROUP BY 1",
    "semi_valid_items": _V("y") + f""" SELECT "user", item, round(rating, 6) AS rating FROM y SEMI JOIN (SELECT item FROM y GROUP BY 1 HAVING count(*) >= {MIN_REVIEWS}) USING (item)""",
    "left_default": _V("b", "r") + " SELECT review_id, business_id, coalesce(b.stars, 3.0)::DOUBLE AS item_stars, coalesce(b.review_count, 0) AS item_reviews FROM r LEFT JOIN b USING (business_id)",
    "last_value_per_key": _V("b") + " SELECT business_id, stars, review_count FROM b",
    "basket_build": _V("v") + """ SELECT "user" AS basket, count(*) AS n_items, 'user' AS by FROM v GROUP BY 1 UNION ALL SELECT item, count(*), 'item' FROM v GROUP BY 1""",
    "basket_size_filter": _V("v") + f""" SELECT "user" AS basket, item FROM v SEMI JOIN (SELECT "user" FROM v GROUP BY 1 HAVING count(*) > {MORE_ITEMS_THAN}) USING ("user")""",
    "transaction_etl": TRANSACTIONS + "SELECT basket, item FROM k SEMI JOIN big USING (basket)",
    "itemsets_l1": TRANSACTIONS + "SELECT * FROM every WHERE size = 1",
    "itemsets_l2": TRANSACTIONS + "SELECT * FROM every WHERE size = 2",
    "itemsets_l3": TRANSACTIONS + "SELECT * FROM every WHERE size = 3",
    "itemsets_all": TRANSACTIONS + "SELECT * FROM every",
    "itemsets_by_growth": TRANSACTIONS + "SELECT * FROM every",
    "son_frequent": TRANSACTIONS + "SELECT * FROM every",
    "son_candidates": TRANSACTIONS + _HELD + "SELECT DISTINCT items FROM held",
}
