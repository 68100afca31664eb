"""Queries of similarity, recommendation and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import SKETCH_MODULUS, hash_family, text_number
from tessera.operators import features, graph, minhash, recommend, relational
from tessera.session import materialize
from tessera.sources import sinks, views
from tessera.sources.tables import table

#: 125 bands of 2: a pair of similarity 0.5 is missed with probability 0.75**125.
N_HASHES, ROWS_PER_BAND, SIMILAR = 250, 2, 0.5
FAMILY = hash_family(N_HASHES, 1, SKETCH_MODULUS)
MIN_RATINGS, MORE_COMMON_THAN = 10, 3
HYBRID_MIN_RATINGS, HYBRID_MORE_COMMON_THAN = 15, 5
#: Common businesses that link two users.
LINK = 6
LPA_ROUNDS = 5


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    """Users of each business, with their numbers."""
    rows = views.visits(spark, folder).select(F.col("item").alias("name"), F.col("user").alias("element"))
    return materialize(rows.withColumn("x", text_number(F.col("element"), SKETCH_MODULUS)))


def _n_elements(rows: DataFrame) -> int:
    return rows.select("element").distinct().count()


def minhash_signature(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sets(spark, folder)
    return minhash.minhash_signatures(rows, FAMILY, _n_elements(rows)).withColumnRenamed("name", "item")


def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sets(spark, folder)
    banded = minhash.bands(minhash.minhash_minima(rows, FAMILY, _n_elements(rows)), ROWS_PER_BAND)
    return minhash.lsh_candidates(materialize(banded))


def lsh_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sets(spark, folder)
    found = minhash.similar_pairs(rows, FAMILY, _n_elements(rows), ROWS_PER_BAND, SIMILAR, materialize)
    return found.select(F.col("one").alias("business_id_1"), F.col("two").alias("business_id_2"), F.round("similarity", 6).alias("similarity"))


def item_mean(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.means(views.ratings(spark, folder), "item").select("item", F.round("mean", 6).alias("mean"), "n")


def user_mean(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.means(views.ratings(spark, folder), "user").select("user", F.round("mean", 6).alias("mean"), "n")


def _similarities(ratings: DataFrame, hybrid: bool = False) -> DataFrame:
    least, more = (HYBRID_MIN_RATINGS, HYBRID_MORE_COMMON_THAN) if hybrid else (MIN_RATINGS, MORE_COMMON_THAN)
    return materialize(recommend.pearson(ratings, least, more))


def pearson_similarity(spark: SparkSession, folder: str) -> DataFrame:
    found = _similarities(materialize(views.ratings(spark, folder)))
    return found.select("one", "two", F.round("similarity", 6).alias("similarity"))


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    """The users and businesses of the reviews, to be predicted from the ratings."""
    return views.reviews(spark, folder).select(F.col("user_id").alias("user"), F.col("business_id").alias("item")).dropna().distinct()


def cf_predict(spark: SparkSession, folder: str) -> DataFrame:
    ratings = materialize(views.ratings(spark, folder))
    found = recommend.predict(_wanted(spark, folder), ratings, _similarities(ratings))
    return found.select("user", "item", F.round("prediction", 5).alias("prediction"))


def hybrid_switch(spark: SparkSession, folder: str) -> DataFrame:
    """Collaborative where possible, else a stand-in model: the stars of the business, or 3."""
    ratings = materialize(views.ratings(spark, folder))
    wanted = materialize(_wanted(spark, folder))
    stars = views.businesses(spark, folder).select(F.col("business_id").alias("item"), F.col("stars").alias("prediction"))
    model = relational.with_defaults(wanted, stars, "item", {"prediction": 3.0})
    found = recommend.hybrid(wanted, ratings, _similarities(ratings, hybrid=True), model)
    return found.select("user", "item", F.round("prediction", 5).alias("prediction"))


def _feature_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    pairs = views.ratings(spark, folder).select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "rating")
    return (pairs, views.businesses(spark, folder), views.users(spark, folder), *(views.counted_per_business(spark, folder, n) for n in ("tip", "photo", "checkin")))


def feature_table_basic(spark: SparkSession, folder: str) -> DataFrame:
    return features.basic_features(*_feature_inputs(spark, folder)).withColumn("rating", F.round("rating", 6))


def _vocabulary(spark: SparkSession, folder: str) -> list[str]:
    top = features.top_labels(views.businesses(spark, folder), F.split("categories", ", "), 20)
    return [r["label"] for r in top.collect()]  # 20 rows


def feature_table_full(spark: SparkSession, folder: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("rating", "item_reviews", "user_reviews", "latitude", "longitude")}
    return features.full_features(*_feature_inputs(spark, folder), _vocabulary(spark, folder)).withColumns(rounded)


_NOT_FEATURES = {"user_id", "business_id", "rating", "n_photos", "n_friends", "years", "tip_likes"}


def gbt_rating(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings that were held out, as boosted trees on all features of the others predict them."""
    pairs, *rest = _feature_inputs(spark, folder)
    train, test = recommend.held_out(pairs, ["user_id", "business_id"])
    labels = _vocabulary(spark, folder)
    known = materialize(features.full_features(train, *rest, labels))
    asked = materialize(features.full_features(test, *rest, labels, fallback=None))
    used = [c for c in known.columns if c not in _NOT_FEATURES]
    return recommend.boosted_trees(known, asked, used, "rating").select("user_id", "business_id", "rating", "prediction")


def gbt_error(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the boosted trees on the held-out ratings: the histogram, and the root mean square error beside each bin."""
    rmse, bins = relational.error_histogram(materialize(gbt_rating(spark, folder)), "rating", "prediction")
    return bins.withColumn("rmse", rmse.select(F.round("rmse", 6)).scalar())


def hybrid_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The held-out pairs by the hybrid of the other ratings, with boosted trees on the six basic features."""
    pairs, *rest = _feature_inputs(spark, folder)
    train, test = recommend.held_out(pairs, ["user_id", "business_id"])
    known, asked = materialize(features.basic_features(train, *rest)), materialize(features.basic_features(test, *rest))
    used = ["item_stars", "item_reviews", "n_tips", "n_photos", "n_checkins", "user_average"]
    named = {"user_id": "user", "business_id": "item"}
    model = recommend.boosted_trees(known, asked, used, "rating").withColumnsRenamed(named).select("user", "item", "prediction")
    ratings = known.withColumnsRenamed(named).select("user", "item", "rating")
    return recommend.hybrid(model.select("user", "item"), ratings, _similarities(ratings, hybrid=True), model)


def _residuals(spark: SparkSession, folder: str) -> DataFrame:
    ratings = views.ratings(spark, folder)
    return ratings.join(recommend.means(ratings, "item").select("item", "mean"), "item")


def rmse_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the item mean as a prediction: the histogram, and the root mean square error beside each bin."""
    rmse, bins = relational.error_histogram(_residuals(spark, folder), "rating", "mean")
    return bins.withColumn("rmse", rmse.select(F.round("rmse", 6)).scalar())


def _edges(spark: SparkSession, folder: str, least: int) -> DataFrame:
    return materialize(graph.co_occurrence_edges(views.visits(spark, folder), least))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.co_occurrence_edges(views.visits(spark, folder), LINK)


def graph_directed(spark: SparkSession, folder: str) -> DataFrame:
    """Both directions of each edge with their relationship."""
    return graph.symmetric(_edges(spark, folder, LINK)).withColumn("relationship", F.lit("friend"))


def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_edges(spark, folder, LINK))


def components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(_edges(spark, folder, LINK), materialize)


def bfs_levels(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.bfs(_edges(spark, folder, LINK), materialize)
    return found.select("source", "vertex", "distance", F.col("paths").cast("bigint").alias("paths"))


def edge_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.edge_betweenness(_edges(spark, folder, LINK), materialize)
    return found.select("src", "dst", F.round("betweenness", 5).alias("betweenness"))


def betweenness_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.betweenness_report(graph.edge_betweenness(_edges(spark, folder, LINK), materialize))


def modularity_of_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Of the partition of the linked users by the parity of their id's last character."""
    edges = _edges(spark, folder, LINK)
    side = (F.ascii(F.substring("vertex", -1, 1)) % 2).alias("community")
    membership = graph.degrees(edges).select("vertex", side)
    return graph.modularity(edges, membership).select(F.round("modularity", 6).alias("modularity"))


def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, folder, LINK), LPA_ROUNDS, materialize)


def community_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.community_report(graph.communities(label_propagation(spark, folder)))


def girvan_newman(spark: SparkSession, folder: str) -> DataFrame:
    return graph.girvan_newman(_edges(spark, folder, LINK), materialize)[0]


QUERIES = {
    f.__name__: f
    for f in (
        minhash_signature, lsh_candidates, lsh_pairs, item_mean, user_mean, pearson_similarity, cf_predict, hybrid_switch, feature_table_basic, feature_table_full, gbt_rating,
        gbt_error, hybrid_trees, rmse_histogram, graph_edges, graph_directed, graph_degree, components, bfs_levels, edge_betweenness, betweenness_report, modularity_of_partition,
        label_propagation, community_report, girvan_newman,
    )
}

_V = views.with_views
_NUMBER = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(e, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (a * 256 + x) % {SKETCH_MODULUS})"
_FAMILY = "h(number, a, b) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(FAMILY)) + ")"
_SIGNATURES = _V("v") + f""", e AS (SELECT DISTINCT "user" AS e FROM v), x AS (SELECT e, {_NUMBER} AS x FROM e), m AS (SELECT count(*) AS m FROM e), {_FAMILY},
sig AS (SELECT item, number, min((a::HUGEINT * x + b) % {SKETCH_MODULUS} % (SELECT m FROM m))::BIGINT AS least FROM v JOIN x ON x.e = v."user", h GROUP BY ALL)"""


def _pearson_sql(least: int, more: int) -> str:
    return f""", valid AS (SELECT item FROM y GROUP BY 1 HAVING count(*) >= {least}),
d AS (SELECT "user", item, rating - avg(rating) OVER (PARTITION BY item) AS d FROM y),
g AS (SELECT * FROM d SEMI JOIN valid USING (item)),
pair AS (SELECT a.item AS one, b.item AS two, count(*) AS n, sum(a.d * b.d) AS top, sqrt(sum(a.d * a.d)) * sqrt(sum(b.d * b.d)) AS bottom
  FROM g a JOIN g b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2),
sim AS (SELECT one, two, top / bottom AS similarity FROM pair WHERE n > {more} AND bottom > 0 AND top / bottom > 1e-12)"""


_PREDICTED = """, both_ways AS (SELECT one AS item, two AS other, similarity FROM sim UNION ALL SELECT two, one, similarity FROM sim),
w AS (SELECT DISTINCT user_id AS "user", business_id AS item FROM r WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
um AS (SELECT "user", avg(rating) AS um FROM y GROUP BY 1), im AS (SELECT item, avg(rating) AS im FROM y GROUP BY 1),
cf AS (SELECT w."user", w.item, sum(y.rating * s.similarity) / sum(abs(s.similarity)) AS cf FROM w JOIN both_ways s ON s.item = w.item JOIN y ON y."user" = w."user" AND y.item = s.other GROUP BY ALL),
p AS (SELECT w."user", w.item, um, im, cf FROM w LEFT JOIN cf ON cf."user" = w."user" AND cf.item = w.item LEFT JOIN um ON um."user" = w."user" LEFT JOIN im ON im.item = w.item)"""
_COUNTED = """, nt AS (SELECT business_id, count(*) AS n_tips, sum(len(list_filter(string_split(coalesce(lower(text), ''), ' '), lambda w: w IN (%s))) + coalesce(length(text) - length(replace(text, '!', '')), 0))::BIGINT AS tip_score, sum(likes)::BIGINT AS tip_likes FROM t GROUP BY 1),
np AS (SELECT business_id, count(*) AS n_photos FROM p GROUP BY 1),
nc AS (SELECT business_id, sum(coalesce(list_sum(map_values("time")), 0))::BIGINT AS n_checkins FROM c GROUP BY 1)""" % ", ".join(f"'{w}'" for w in features.KEYWORDS)
_JOINED = """ FROM y LEFT JOIN b ON b.business_id = y.item LEFT JOIN u ON u.user_id = y."user" LEFT JOIN nt ON nt.business_id = y.item LEFT JOIN np ON np.business_id = y.item LEFT JOIN nc ON nc.business_id = y.item"""
_TOP20 = """, label AS (SELECT unnest(string_split(categories, ', ')) AS label FROM b), top20 AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM label GROUP BY label ORDER BY count(*) DESC, label LIMIT 20)"""


def _edges_sql(least: int) -> str:
    return _V("v") + f""", e AS (SELECT a."user" AS src, b."user" AS dst FROM v a JOIN v b ON a.item = b.item AND a."user" < b."user" GROUP BY 1, 2 HAVING count(*) >= {least}),
s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


#: Walks that never come back to a vertex at a greater depth are the shortest paths.
_WALKS = """, vx AS (SELECT DISTINCT src AS vertex FROM s),
reach AS (SELECT vertex AS source, vertex, 0 AS distance FROM vx UNION SELECT reach.source, s.dst, reach.distance + 1 FROM reach JOIN s ON s.src = reach.vertex WHERE reach.distance < 12),
dist AS (SELECT source, vertex, min(distance) AS distance FROM reach GROUP BY 1, 2),
walk AS (SELECT source, vertex, 0 AS distance, 1::HUGEINT AS paths FROM dist WHERE distance = 0
  UNION ALL (SELECT w.source, s.dst, w.distance + 1, sum(w.paths)::HUGEINT FROM walk w JOIN s ON s.src = w.vertex JOIN dist d ON d.source = w.source AND d.vertex = s.dst AND d.distance = w.distance + 1 GROUP BY 1, 2, 3))"""

def _propagation(rounds: int) -> str:
    """Of each round the votes of the neighbours and, of the most frequent labels, the least."""
    steps = [", l0 AS (SELECT DISTINCT src AS vertex, src AS label FROM s)"]
    for i in range(rounds):
        steps.append(f"n{i} AS (SELECT s.src AS vertex, label, count(*) AS n FROM s JOIN l{i} ON l{i}.vertex = s.dst GROUP BY 1, 2)")
        steps.append(f"l{i + 1} AS (SELECT vertex, label FROM n{i} QUALIFY row_number() OVER (PARTITION BY vertex ORDER BY n DESC, label) = 1)")
    return ", ".join(steps)


_BETWEENNESS = _edges_sql(LINK) + _WALKS + """,
id AS MATERIALIZED (SELECT vertex, row_number() OVER (ORDER BY vertex)::INT AS i FROM vx),
w AS MATERIALIZED (SELECT a.i AS s, b.i AS v, distance::INT AS d, paths::DOUBLE AS p FROM walk JOIN id a ON a.vertex = source JOIN id b ON b.vertex = walk.vertex),
link AS MATERIALIZED (SELECT a.i AS x, b.i AS y FROM s JOIN id a ON a.vertex = src JOIN id b ON b.vertex = dst),
step AS MATERIALIZED (SELECT w.s, x, y, w.d + 1 AS d, w.p FROM w JOIN link ON x = w.v JOIN w n ON n.s = w.s AND n.v = y AND n.d = w.d + 1),
part AS (SELECT step.x, step.y, sum(step.p * b.p / w.p) AS c FROM step JOIN w b ON b.s = step.y JOIN w ON w.s = step.s AND w.v = b.v AND w.d = step.d + b.d GROUP BY 1, 2),
found AS (SELECT a.vertex AS src, b.vertex AS dst, round(sum(c) / 2, 5) AS betweenness FROM part JOIN id a ON a.i = least(x, y) JOIN id b ON b.i = greatest(x, y) GROUP BY 1, 2)
"""
_Q = "''" * 2

SQL = {
    "label_propagation": _edges_sql(LINK) + _propagation(LPA_ROUNDS) + f" SELECT * FROM l{LPA_ROUNDS}",
    "community_report": _edges_sql(LINK) + _propagation(LPA_ROUNDS) + f" SELECT string_agg({_Q} || vertex || {_Q}, ', ' ORDER BY vertex) AS line FROM l{LPA_ROUNDS} GROUP BY label",
    "betweenness_report": _BETWEENNESS + f" SELECT '(' || {_Q} || src || {_Q} || ', ' || {_Q} || dst || {_Q} || '),' || betweenness AS line FROM found",
    "minhash_signature": _SIGNATURES + " SELECT item, number, least FROM sig",
    "lsh_candidates": _SIGNATURES + """, band AS (SELECT item, number // 2 AS band, string_agg(least::VARCHAR, '-' ORDER BY number) AS bucket FROM sig GROUP BY 1, 2)
SELECT DISTINCT a.item AS one, b.item AS two FROM band a JOIN band b ON a.band = b.band AND a.bucket = b.bucket AND a.item < b.item""",
    "lsh_pairs": _V("v") + """, n AS (SELECT item, count(*) AS n FROM v GROUP BY 1),
q AS (SELECT a.item AS one, b.item AS two, count(*) AS c FROM v a JOIN v b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2)
SELECT one AS business_id_1, two AS business_id_2, round(c / (x.n + z.n - c), 6) AS similarity FROM q JOIN n x ON x.item = one JOIN n z ON z.item = two WHERE c / (x.n + z.n - c) >= 0.5""",
    "item_mean": _V("y") + " SELECT item, round(avg(rating), 6) AS mean, count(*) AS n FROM y GROUP BY 1",
    "user_mean": _V("y") + """ SELECT "user", round(avg(rating), 6) AS mean, count(*) AS n FROM y GROUP BY 1""",
    "pearson_similarity": _V("y") + _pearson_sql(MIN_RATINGS, MORE_COMMON_THAN) + " SELECT one, two, round(similarity, 6) AS similarity FROM sim",
    "cf_predict": _V("y", "r") + _pearson_sql(MIN_RATINGS, MORE_COMMON_THAN) + _PREDICTED + """
SELECT "user", item, round(CASE WHEN um IS NULL AND im IS NULL THEN 3 WHEN um IS NULL THEN im WHEN im IS NULL THEN um ELSE coalesce(cf, im) END, 5)::DOUBLE AS prediction FROM p""",
    "hybrid_switch": _V("y", "r", "b") + _pearson_sql(HYBRID_MIN_RATINGS, HYBRID_MORE_COMMON_THAN) + _PREDICTED + """
SELECT "user", item, round(coalesce(CASE WHEN um IS NOT NULL AND im IS NOT NULL THEN cf END, b.stars, 3.0), 5)::DOUBLE AS prediction FROM p LEFT JOIN b ON b.business_id = item""",
    "feature_table_basic": _V("y", "b", "u", "t", "p", "c") + _COUNTED + """
SELECT y."user" AS user_id, y.item AS business_id, round(rating, 6) AS rating, coalesce(b.stars, 3.0)::DOUBLE AS item_stars, coalesce(b.review_count, 0)::BIGINT AS item_reviews,
  coalesce(n_tips, 0)::BIGINT AS n_tips, coalesce(n_photos, 0)::BIGINT AS n_photos, coalesce(n_checkins, 0)::BIGINT AS n_checkins, coalesce(u.average_stars, 3.0)::DOUBLE AS user_average""" + _JOINED,
    "feature_table_full": _V("y", "b", "u", "t", "p", "c") + _COUNTED + _TOP20 + """
SELECT y."user" AS user_id, y.item AS business_id, round(rating, 6) AS rating, coalesce(b.stars, 3.5)::DOUBLE AS item_stars, coalesce(u.average_stars, 3.5)::DOUBLE AS user_average,
  round(coalesce(b.review_count::DOUBLE, avg(b.review_count) OVER ()), 6) AS item_reviews, round(coalesce(u.review_count::DOUBLE, avg(u.review_count) OVER ()), 6) AS user_reviews,
  round(coalesce(latitude, 0.0), 6)::DOUBLE AS latitude, round(coalesce(longitude, 0.0), 6)::DOUBLE AS longitude,
  coalesce(len(list_filter(map_values(attributes), lambda w: w = 'True')), 0)::BIGINT AS n_true, coalesce(len(string_split(categories, ' ')), 0)::BIGINT AS category_words, coalesce(cardinality(hours), 0)::BIGINT AS n_hours,
  coalesce(tip_score, 0)::BIGINT AS tip_score, coalesce(tip_likes, 0)::BIGINT AS tip_likes, coalesce(n_photos, 0)::BIGINT AS n_photos, coalesce(n_checkins, 0)::BIGINT AS n_checkins,
  coalesce(len(string_split(friends, ',')), 0)::BIGINT AS n_friends, coalesce(2023 - try_cast(string_split(yelping_since, '-')[1] AS INT), 0)::BIGINT AS years,
  """ + ", ".join(f"coalesce({c}, 0)::BIGINT AS user_{c}" for c in features.USER_COUNTS) + ", "
    + ", ".join(f"coalesce(compliment_{c}, 0)::BIGINT AS user_{c}_compliments" for c in features.COMPLIMENTS) + ", "
    + ", ".join(f"coalesce(list_contains(string_split(categories, ', '), (SELECT label FROM top20 WHERE rank = {i})), false)::BIGINT AS category_{i}" for i in range(1, 21)) + _JOINED,
    "rmse_histogram": _V("y") + """, e AS (SELECT rating - avg(rating) OVER (PARTITION BY item) AS e FROM y)
SELECT least(4, floor(abs(e)))::INT AS error_from, count(*) AS n, (SELECT round(sqrt(avg(e * e)), 6) FROM e) AS rmse FROM e GROUP BY 1""",
    "graph_edges": _edges_sql(LINK) + " SELECT src, dst FROM e",
    "graph_directed": _edges_sql(LINK) + " SELECT src, dst, 'friend' AS relationship FROM s",
    "graph_degree": _edges_sql(LINK) + " SELECT src AS vertex, count(*) AS degree FROM s GROUP BY 1",
    "components": _edges_sql(LINK) + """, comp AS (SELECT DISTINCT src AS vertex, src AS label FROM s UNION SELECT s.dst, comp.label FROM comp JOIN s ON s.src = comp.vertex)
SELECT vertex, min(label) AS component FROM comp GROUP BY 1""",
    "bfs_levels": _edges_sql(LINK) + _WALKS + " SELECT source, vertex, distance, paths::BIGINT AS paths FROM walk",
    "edge_betweenness": _BETWEENNESS + " SELECT * FROM found",
    "modularity_of_partition": _edges_sql(LINK) + """, k AS (SELECT src AS vertex, count(*) AS k, ascii(right(src, 1)) % 2 AS c FROM s GROUP BY ALL), m AS (SELECT count(*)::DOUBLE AS m FROM e),
i AS (SELECT ascii(right(src, 1)) % 2 AS c, count(*) AS l FROM e WHERE ascii(right(src, 1)) % 2 = ascii(right(dst, 1)) % 2 GROUP BY 1), kc AS (SELECT c, sum(k) AS k FROM k GROUP BY 1)
SELECT round(sum(coalesce(l, 0) / m.m - power(kc.k / (2 * m.m), 2)), 6) AS modularity FROM kc LEFT JOIN i USING (c), m""",
}
