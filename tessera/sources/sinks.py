"""Report formats and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_document(one_row: DataFrame) -> DataFrame:
    """The row of ``one_row`` as a JSON document, column ``value``."""
    return one_row.select(F.to_json(F.struct(*one_row.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_document(one_row: DataFrame, path: str) -> None:
    """Writes ``json_document`` as text."""
    json_document(one_row).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, quoted where a value needs it; blanks are kept."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def quoted_members(items: Column) -> Column:
    """``'a', 'b'``."""
    return F.concat(F.lit("'"), F.array_join(items, "', '"), F.lit("'"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """``size, line``: ``('a', 'b'),('a', 'c')`` of each size of ``items``, in order.

    The lines of one size are as long as its itemsets are many: a report for
    reading, not for further processing.
    """
    text = F.concat(F.lit("("), quoted_members(F.col("items")), F.lit(")"))
    grouped = itemsets.groupBy(F.size("items").alias("size")).agg(F.array_sort(F.collect_list(F.struct("items", text.alias("text")))).alias("all"))
    return grouped.select("size", F.array_join(F.col("all.text"), ",").alias("line")).orderBy("size")


def community_report(communities: DataFrame) -> DataFrame:
    """``line`` for each ``community, members``: sorted by size, then by first member."""
    ordered = communities.select(F.array_sort("members").alias("members")).orderBy(F.size("members"), F.col("members")[0])
    return ordered.select(quoted_members(F.col("members")).alias("line"))


def betweenness_report(edges: DataFrame) -> DataFrame:
    """``line`` ``('a', 'b'),value`` for each ``src, dst, betweenness``, the largest first."""
    ordered = edges.orderBy(F.desc(F.round("betweenness", 5)), "src", "dst")
    return ordered.select(F.concat(F.lit("('"), "src", F.lit("', '"), "dst", F.lit("'),"), F.round("betweenness", 5).cast("string")).alias("line"))


def reservoir_report(slots: DataFrame, shown: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """``seqnum, 0_id, 20_id, ...`` of ``seqnum, slot, value``."""
    return slots.groupBy("seqnum").agg(*(F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"{s}_id") for s in shown)).orderBy("seqnum")


def fpr_report(rates: DataFrame) -> DataFrame:
    """``Time, FPR`` of ``batch, rate``: 0 where a batch has no new key."""
    return rates.select(F.col("batch").alias("Time"), F.coalesce("rate", F.lit(0.0)).alias("FPR")).orderBy("Time")


def estimate_report(truth: DataFrame, estimates: DataFrame) -> DataFrame:
    """``Time, Ground Truth, Estimation`` of ``batch, n_distinct`` and ``batch, estimate``."""
    both = truth.join(estimates, "batch", "left")
    return both.select(F.col("batch").alias("Time"), F.col("n_distinct").alias("Ground Truth"), F.coalesce("estimate", F.lit(0)).alias("Estimation")).orderBy("Time")


def itemset_sections(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``section, size, line``: the lines of both reports, the candidates first."""
    both = [itemset_report(df).select(F.lit(name).alias("section"), "size", "line") for name, df in (("Candidates", candidates), ("Frequent Itemsets", frequent))]
    return both[0].unionByName(both[1]).orderBy("section", "size")


def cluster_report(rounds: DataFrame) -> DataFrame:
    """``line`` of each round: points of the main clusters, compressed sets, points in them, retained points."""
    text = F.concat(F.lit("Round "), F.col("round").cast("string"), F.lit(": "), F.concat_ws(",", *(F.col(c).cast("string") for c in ("n_main", "n_sets", "n_compressed", "n_retained"))))
    return rounds.orderBy("round").select("round", text.alias("line"))


def show(df: DataFrame, n: int = 10) -> None:
    """Prints the first ``n`` rows, values in full."""
    df.show(n, truncate=False)
