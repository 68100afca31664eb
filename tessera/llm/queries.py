"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.baskets import BASKET_SQL, basket_items
from tessera.functions.keys import clean_key
from tessera.llm.cooccurrence import item_pairs
from tessera.llm.packing import pack
from tessera.llm.set_similarity import class_links, similar_pairs
from tessera.llm.shared_spans import shared_spans
from tessera.llm.tokens import decode, encode, encode_with_offsets, token_counts
from tessera.session import materialize
from tessera.sources.tables import table

#: Tokens that a container holds.
CAPACITY = 2048


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _raters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "yelp_train").select(clean_key("business_id").alias("name"), clean_key("user_id").alias("element"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses whose sets of users overlap by at least half of their union."""
    return similar_pairs(_raters(spark, folder), 0.5, materialize, min_size=5).select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Of every business of 5 users or more the class of businesses with the same users, and how many others are similar."""
    return class_links(_raters(spark, folder), 0.5, materialize, min_size=5).select(F.col("name").alias("business_id"), "class", "n_links")


def _bought_together(spark: SparkSession, folder: str) -> DataFrame:
    rows = basket_items(table(spark, folder, "customer_product"), "date_customer_id", "product_id")
    return item_pairs(rows, materialize, min_count=5, min_share=0.0015, min_lift=4.0)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of products bought together often, and four times as often as chance."""
    return _bought_together(spark, folder).select(F.col("item_1").alias("product_id_1"), F.col("item_2").alias("product_id_2"))


def p5_lift(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts, lift and pointwise mutual information."""
    pairs = _bought_together(spark, folder)
    return pairs.select(
        F.col("item_1").alias("product_id_1"), F.col("item_2").alias("product_id_2"), "n_1", "n_2", "n_both",
        F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"),
    )


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(_documents(spark, folder), "doc_id", "text")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return decode(encode(_documents(spark, folder), "doc_id", "text"))


def p8_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document with the characters that each token covers."""
    return encode_with_offsets(_documents(spark, folder), "doc_id", "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each of its pieces."""
    return pack(token_counts(_documents(spark, folder), "doc_id", "text"), CAPACITY, materialize)


def p9_harmonic(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the classical reciprocal classes, which need more containers."""
    return pack(token_counts(_documents(spark, folder), "doc_id", "text"), CAPACITY, materialize, reciprocal=True)


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of both plans: documents placed, and how many tokens are lost, containers overfull or skipped, and texts cut without need."""
    sizes = materialize(token_counts(_documents(spark, folder), "doc_id", "text"))
    whole = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"))
    every = None
    for name, reciprocal in (("best", False), ("harmonic", True)):
        placed = materialize(pack(sizes, CAPACITY, materialize, reciprocal=reciprocal))
        by_doc = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"))
        docs = by_doc.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.when(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY)), 1).otherwise(0)).alias("n_cut"), F.sum("n").alias("tokens"))
        fill = placed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("n"))
        bins = fill.agg(F.sum(F.when(F.col("n") > CAPACITY, 1).otherwise(0)).alias("n_overfull"), (F.max("container") + 1 - F.count(F.lit(1))).alias("n_skipped"))
        each = docs.join(bins, how="cross").join(whole, how="cross")  # one row each
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        row = each.select(F.lit(name).alias("plan"), "n_documents", zero(F.col("all") - F.col("tokens")).alias("n_lost"), *(zero(F.col(c)).alias(c) for c in ("n_overfull", "n_skipped", "n_cut")))
        every = row if every is None else every.unionByName(row)
    return every


def p8_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document the characters that its tokens cover, and the gaps and steps back between neighbours."""
    found = p8_offsets(spark, folder)
    step = F.sequence(F.lit(1), F.size("starts") - 1)
    apart = lambda i: (F.get("starts", i) > F.get("ends", i - 1)) | (F.get("starts", i) < F.get("starts", i - 1))
    gaps = F.when(F.size("starts") > 1, F.size(F.filter(step, apart))).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return found.select("doc_id", zero(F.get("starts", F.lit(0))).alias("covered_from"), zero(F.get("ends", F.size("ends") - 1)).alias("covered_to"), gaps.cast("bigint").alias("n_gaps"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and pieces of every container."""
    placed = p9_containers(spark, folder).where(F.col("container").isNotNull())
    return placed.groupBy("container").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of each document that also stand in another one."""
    return shared_spans(_documents(spark, folder))


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document, how many characters are shared and which part of it that is."""
    spans = p10_found(spark, folder).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    sizes = _documents(spark, folder).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0)).cast("bigint")
    return sizes.join(spans, "doc_id", "left").select("doc_id", "n_chars", shared.alias("n_shared"), F.round(F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)), 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    p4_found, p4_links, p5_found, p5_lift, p8_ids, p8_decoded, p8_offsets, p8_covered, p9_containers, p9_harmonic, p9_fill, p9_invariants, p10_found, p10_coverage,
)}

_BASKETS = rf"""
WITH bare AS (
  SELECT translate(date_customer_id, E'"'' \t\r\n', '') AS t, product_id FROM customer_product
), once AS (
  SELECT DISTINCT product_id AS item, {BASKET_SQL} AS basket
  FROM bare WHERE t <> '' AND product_id IS NOT NULL
), n AS (SELECT count(DISTINCT basket) AS n FROM once),
item AS (SELECT item, count(*) AS c FROM once GROUP BY 1),
pair AS (
  SELECT a.item AS i1, b.item AS i2, count(*) AS c FROM once a JOIN once b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2
), found AS (
  SELECT i1, i2, x.c AS n_1, y.c AS n_2, p.c AS n_both, p.c * n.n / (x.c::DOUBLE * y.c) AS lift
  FROM pair p JOIN item x ON x.item = i1 JOIN item y ON y.item = i2, n
  WHERE p.c >= 5 AND p.c / n.n >= 0.0015 AND p.c * n.n / (x.c::DOUBLE * y.c) >= 4
)
"""

_SPANS = """
WITH w AS (
  SELECT doc_id, s, text[s + 1 : s + 200] AS t FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS s FROM documents WHERE length(text) >= 200)
), shared AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, s FROM w SEMI JOIN shared USING (t)),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM hit),
grouped AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
span AS (SELECT doc_id, min(s)::BIGINT AS span_start, (max(s) + 200)::BIGINT AS span_end FROM grouped GROUP BY doc_id, run)
"""

_RATERS = r"""
WITH once AS (
  SELECT DISTINCT trim(business_id, E' \t\r\n') AS b, trim(user_id, E' \t\r\n') AS u FROM yelp_train
  WHERE trim(business_id, E' \t\r\n') <> '' AND trim(user_id, E' \t\r\n') <> ''
), size AS (SELECT b, count(*) AS n FROM once GROUP BY 1 HAVING count(*) >= 5),
pair AS (SELECT x.b AS b1, y.b AS b2, count(*) AS c FROM once x JOIN once y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2),
near AS (SELECT b1, b2, c = s.n AND c = t.n AS same FROM pair JOIN size s ON s.b = b1 JOIN size t ON t.b = b2 WHERE c / (s.n + t.n - c) >= 0.5)
"""

SQL = {
    "p4_found": _RATERS + "SELECT b1 AS business_id_1, b2 AS business_id_2 FROM near",
    "p4_links": _RATERS + """, both_ways AS (SELECT b1, b2, same FROM near UNION ALL SELECT b2, b1, same FROM near)
SELECT size.b AS business_id, coalesce(least(size.b, min(b2) FILTER (same)), size.b) AS class, count(b2) AS n_links FROM size LEFT JOIN both_ways ON b1 = size.b GROUP BY size.b""",
    "p5_found": _BASKETS + "SELECT i1 AS product_id_1, i2 AS product_id_2 FROM found",
    "p5_lift": _BASKETS + "SELECT i1 AS product_id_1, i2 AS product_id_2, n_1, n_2, n_both, round(lift, 6) AS lift, round(ln(lift), 6) AS pmi FROM found",
    "p8_covered": "SELECT doc_id, 0::BIGINT AS covered_from, coalesce(length(text), 0)::BIGINT AS covered_to, 0::BIGINT AS n_gaps FROM documents",
    "p9_invariants": "SELECT plan, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_lost, 0::BIGINT AS n_overfull, 0::BIGINT AS n_skipped, 0::BIGINT AS n_cut FROM (VALUES ('best'), ('harmonic')) t(plan)",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_found": _SPANS + "SELECT * FROM span",
    "p10_coverage": _SPANS + """, sums AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS c FROM span GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(c, 0)::BIGINT AS n_shared,
  coalesce(round(coalesce(c, 0) / nullif(length(text), 0), 6), 0) AS share
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id""",
}
