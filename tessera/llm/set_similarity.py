"""All similar pairs between set-valued records, by T-occurrence list merging.

Records whose Jaccard similarity reaches t are at most 1/t times as large as
each other, so they meet in groups by size band.  A large group is divided by
tokens: in the common order of all tokens (rare ones first) two similar records
share a token among the first ``n - ceil(t n) + 1`` of either.  Each part holds
inverted lists of its records; a probe merges its lists with a heap that skips,
looks candidates up in its longest lists by binary search, and keeps the
records that reach the required overlap.  A pair that meets in several parts is
reported in that of its first common token only.

Records with equal sets are joined once, as a class.  Records too large to be
held by one task are few, and meet only records of like size; the elements that
they share are counted where they stand.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of the indexed records that a part is meant to hold, and that one task may hold of it.
TOKENS_MEANT, TOKENS_HELD = 1_000_000, 2_000_000
#: Tokens of the probing records that one task is meant to take.
TOKENS_PROBED = 200_000
#: Elements from which on a record is not held by one task.
RECORD_HELD = 1_000_000
#: Rows of the dictionary that one task numbers.
NUMBERED_TOGETHER = 200_000
#: Weight of the rule that chooses how many lists are the longest (Li, Lu and Lu, 2008).
LONG_LISTS_WEIGHT = 0.0085
_SLACK = 1e-9


def least_overlap(size: int, other: int, threshold: float) -> int:
    """Common tokens that sets of these sizes need for the Jaccard similarity ``threshold``."""
    return math.ceil(threshold / (1 + threshold) * (size + other) - _SLACK)


def prefix_length(size: int, threshold: float) -> int:
    """Tokens among which, in the common order, a similar record's first common token lies."""
    return size - math.ceil(threshold * size - _SLACK) + 1


def merge_skip(lists: list[list[int]], needed: int) -> list[tuple[int, int]]:
    """``(id, count)`` of the ids that at least ``needed`` of the ascending lists hold.

    The heads of the lists are on a heap.  When fewer lists than needed have the
    least head, enough heads are popped that the next one bounds what can still
    qualify, and the popped lists skip to it.
    """
    heap = [(entries[0], i) for i, entries in enumerate(lists) if entries]
    heapq.heapify(heap)
    at = [0] * len(lists)
    found = []
    while len(heap) >= needed:
        head = heap[0][0]
        popped = []
        while heap and heap[0][0] == head:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= needed:
            found.append((head, len(popped)))
            for i in popped:
                at[i] += 1
                if at[i] < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at[i]], i))
            continue
        while heap and len(popped) < needed - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i], target, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return found


class InvertedLists:
    """Inverted lists of records; inner ids ascend with the size of the record."""

    def __init__(self, names: list[str], sets: list[np.ndarray]) -> None:
        order = sorted(range(len(names)), key=lambda i: (len(sets[i]), names[i]))
        self.names = [names[i] for i in order]
        self.sets = [sets[i] for i in order]
        self.sizes = [len(s) for s in self.sets]
        self.order = list(zip(self.sizes, self.names, strict=True))
        tokens = np.concatenate(self.sets)
        ids = np.repeat(np.arange(len(order)), self.sizes)
        by = np.lexsort((ids, tokens))
        tokens, self.ids = tokens[by], ids[by]
        self.tokens, first = np.unique(tokens, return_index=True)
        self.first = np.r_[first, len(tokens)]

    def _held(self, probe: np.ndarray) -> np.ndarray:
        """Places of the lists of those tokens of ``probe`` that some record holds."""
        at = np.minimum(np.searchsorted(self.tokens, probe), len(self.tokens) - 1)
        return at[self.tokens[at] == probe]

    def _parts(self, at: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """Of each list the inner ids from ``low`` to below ``high``; empty ones are left out."""
        parts = []
        for i in at:
            part = self.ids[self.first[i] : self.first[i + 1]]
            a, b = np.searchsorted(part, (low, high))
            if a < b:
                parts.append(part[a:b])
        return parts

    def similar(self, name: str, probe: np.ndarray, threshold: float, divisions: int = 1, division: int = 0) -> Iterator[int]:
        """Inner ids of similar records that are larger, or as large with a larger name.

        Of these, all whose first common token falls to ``division`` are among
        the result.
        """
        size = len(probe)
        low, high = bisect_right(self.order, (size, name)), bisect_left(self.sizes, math.floor(size / threshold + _SLACK) + 1)
        if low >= high:
            return
        prefix = probe[: prefix_length(size, threshold)]
        if divisions > 1:
            prefix = prefix[prefix % divisions == division]
        if not self._parts(self._held(prefix), low, high):
            return  # no record has a first common token here
        needed = least_overlap(size, self.sizes[low], threshold)
        lists = self._parts(self._held(probe), low, high)
        if len(lists) < needed:
            return
        lists.sort(key=len)
        longest = len(lists[-1])
        n_long = min(needed - 1, int(needed / (LONG_LISTS_WEIGHT * math.log2(longest + 1) + 1)), len(lists) - 1)
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found = merge_skip([x.tolist() for x in short], max(1, needed - n_long))
        if not found:
            return
        ids, counts = (np.array(x) for x in zip(*found, strict=True))
        for entries in long:
            where = np.minimum(np.searchsorted(entries, ids), len(entries) - 1)
            counts += entries[where] == ids
        for i, count in zip(ids.tolist(), counts.tolist(), strict=True):
            if count >= least_overlap(size, self.sizes[i], threshold):
                yield i


def _join_parts(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the rows of each part, slice and share, of which the indexed ones come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, index = None, [], [], None
        for batch in batches:
            values = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False))]
            out: tuple[list[str], list[str]] = [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "slice", "share", "divisions", "division", "probing", "name"))
            for k, (part, piece, share, divisions, division, probing, name) in enumerate(zip(*columns, strict=True)):
                tokens = values[ends[k] : ends[k + 1]]
                if now != (part, piece, share):
                    now, names, sets, index = (part, piece, share), [], [], None
                if not probing:
                    names.append(name)
                    sets.append(tokens.copy())
                    continue
                if not names:
                    continue
                if index is None:
                    index = InvertedLists(names, sets)
                    names, sets = [""], []
                for i in index.similar(name, tokens, threshold, divisions, division):
                    if divisions > 1:
                        first = np.intersect1d(tokens, index.sets[i], assume_unique=True)[0]
                        if first % divisions != division:
                            continue
                    out[0].append(name)
                    out[1].append(index.names[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["one", "two"])

    return run


def numbered_sets(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """``name, tokens, band`` of the records in ``name, element`` (distinct) that may have a partner, of those in ``sizes`` (``name, band``).

    Tokens are exact numbers for the elements, ascending with their frequency.
    """
    bands = {r["band"]: r["n"] for r in sizes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 63 rows
    reach = math.ceil(-math.log2(threshold) - _SLACK)
    # a record without any other of a size within reach is never gathered, however large
    alone = [b for b in bands if sum(n for c, n in bands.items() if abs(b - c) <= reach) == 1]
    kept = rows.join(sizes.where(~F.col("band").isin(alone)).select("name", "band"), "name")
    elements = kept.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    shares = max(1, total // NUMBERED_TOGETHER)
    share = F.pmod(F.xxhash64("element"), F.lit(shares))
    number = F.row_number().over(W.partitionBy("share").orderBy("element"))
    elements = elements.withColumn("share", share).withColumn("number", number.cast("bigint"))
    # 20 bits of frequency, then a number of its own: an order of all tokens with the rare ones first
    token = F.shiftleft(F.least(F.col("n"), F.lit((1 << 20) - 1)), 42) + (F.col("number") * shares + F.col("share"))
    coded = kept.join(elements.select("element", token.alias("token")), "element")
    return coded.groupBy("name", "band").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def similar_records(rows: DataFrame, threshold: float, materialize: Callable[[DataFrame], DataFrame], *, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs ``one, two`` of similar classes, and their members ``name, class``.

    ``rows`` holds ``name, element``; nulls are ignored and repeated elements
    count once.  Records of fewer than ``min_size`` elements take no part.
    Records with equal sets form a class, named by its least member; those of
    ``RECORD_HELD`` elements or more are classes of their own.
    """
    rows = materialize(rows.where(F.col("name").isNotNull() & F.col("element").isNotNull()).select("name", "element").distinct())
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    sizes = materialize(sizes.withColumn("band", F.floor(F.log2(F.col("size") + 0.5)).cast("int")))
    held = sizes.where(F.col("size") < RECORD_HELD)
    classes, members = _merged_records(rows, held, threshold, materialize)
    if (sizes.agg(F.max("size")).first()[0] or 0) >= RECORD_HELD:
        huge = sizes.where(F.col("size") >= RECORD_HELD).select("name")
        members = members.unionByName(huge.select("name", F.col("name").alias("class")))
        alone = members.where(F.col("name") == F.col("class")).select("name")
        classes = classes.unionByName(_counted_pairs(rows, sizes.join(alone, "name", "left_semi"), threshold))
    return classes, members


def _counted_pairs(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """``one, two`` of the similar records of which at least one has ``RECORD_HELD`` elements, by counting their common elements."""
    large = sizes.where(F.col("size") >= math.ceil(RECORD_HELD * threshold - _SLACK)).select("name", "size")
    own = rows.join(large, "name")
    one, two = (own.select(F.col("name").alias(n), F.col("size").alias(f"n_{n}"), "element") for n in ("one", "two"))
    met = one.join(two, "element").where((F.col("one") < F.col("two")) & (F.greatest("n_one", "n_two") >= RECORD_HELD))
    counted = met.groupBy("one", "two", "n_one", "n_two").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= threshold * (F.col("n_one") + F.col("n_two") - F.col("n")) - _SLACK).select("one", "two")


def _merged_records(rows: DataFrame, sizes: DataFrame, threshold: float, materialize: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Similar classes and members of the records of ``sizes``, by list merging."""
    records = numbered_sets(rows, sizes, threshold).withColumn("same", F.md5(F.concat_ws(",", "tokens")))
    records = materialize(records)
    classes = records.groupBy("same").agg(F.min("name").alias("class"))
    members = records.select("name", "same").join(classes, "same").select("name", "class")
    reps = records.join(classes.select(F.col("class").alias("name")), "name", "left_semi").select("name", "band", "tokens", F.size("tokens").alias("size"))
    reps = materialize(reps)
    weights = {r["band"]: r["n"] for r in reps.groupBy("band").agg(F.sum("size").alias("n")).collect()}  # at most 63 rows
    reach = math.ceil(-math.log2(threshold) - _SLACK)
    divisions = {b: 1 + 2 * (-(-weights[b] // TOKENS_MEANT) // 2) for b in weights}  # odd
    if not weights:
        return rows.select(F.col("name").alias("one"), F.col("name").alias("two")).where(F.lit(False)), members
    of_group = F.create_map(*(F.lit(x) for pair in divisions.items() for x in pair))
    groups = F.filter(F.array(*(F.col("band") + i for i in range(reach + 1))), lambda g: g.isin(*weights))
    prefix = F.slice("tokens", 1, (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - _SLACK) + 1).cast("int"))
    spread = reps.withColumn("group", F.explode(groups)).withColumn("divisions", of_group[F.col("group")])
    spread = spread.withColumn("division", F.explode(F.array_distinct(F.transform(prefix, lambda t: (t % F.col("divisions")).cast("int")))))
    part = F.shiftleft(F.col("group").cast("bigint"), 40) + F.col("division")
    spread = spread.withColumn("part", part)
    own = F.col("group") == F.col("band")
    slices = spread.groupBy("part").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(own, F.col("size")).otherwise(0)) / TOKENS_HELD)).cast("int").alias("slices"),
        F.ceil(F.sum("size") / TOKENS_PROBED).cast("int").alias("shares"),
    )
    slices = materialize(slices)
    tasks = slices.agg(F.sum(F.col("slices") * F.col("shares"))).first()[0]  # one number
    # every share of the probes meets every slice of the index
    columns = ["part", "slice", "share", "divisions", "division", "probing", "name", "tokens"]
    n_slices, n_shares = F.coalesce("slices", F.lit(1)), F.coalesce("shares", F.lit(1))
    picked = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sliced = spread.join(slices, "part", "left")
    indexed = sliced.where(own).withColumn("slice", picked(n_slices)).withColumn("share", every(n_shares)).withColumn("probing", F.lit(0)).select(*columns)
    probes = sliced.withColumn("slice", every(n_slices)).withColumn("share", picked(n_shares)).withColumn("probing", F.lit(1)).select(*columns)
    key = ["part", "slice", "share"]
    # the work is in the merging, not in the bytes by which partitions would be coalesced
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(tasks), 20_000))
    met = indexed.unionByName(probes).repartition(partitions, *key).sortWithinPartitions(*key, "probing")
    return met.mapInArrow(_join_parts(threshold), "one string, two string"), members


def similar_pairs(rows: DataFrame, threshold: float, materialize: Callable[[DataFrame], DataFrame], *, min_size: int = 1) -> DataFrame:
    """``id_1, id_2``, ``id_1 < id_2``: all similar pairs, those of equal sets too."""
    classes, members = similar_records(rows, threshold, materialize, min_size=min_size)
    members = materialize(members)
    one, two = (members.select(F.col("name").alias(f"id_{i}"), F.col("class").alias(c)) for i, c in ((1, "one"), (2, "two")))
    across = classes.join(one, "one").join(two, "two").select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"))
    within = one.join(two, F.col("one") == F.col("two")).where(F.col("id_1") < F.col("id_2")).select("id_1", "id_2")
    return across.unionByName(within)


def class_links(rows: DataFrame, threshold: float, materialize: Callable[[DataFrame], DataFrame], *, min_size: int = 1) -> DataFrame:
    """``name, class, n_links`` of each record of at least ``min_size`` elements: its class of equal sets, and how many other records are similar.

    Copies are counted by class, not paired.
    """
    classes, members = similar_records(rows, threshold, materialize, min_size=min_size)
    classes, members = materialize(classes), materialize(members)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    both = classes.select(F.col("one").alias("class"), F.col("two").alias("other")).unionByName(classes.select(F.col("two").alias("class"), F.col("one").alias("other")))
    links = both.join(sizes.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("links"))
    known = members.join(sizes, "class").join(links, "class", "left").select("name", "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = rows.where(F.col("name").isNotNull() & F.col("element").isNotNull()).groupBy("name").agg(F.count_distinct("element").alias("n")).where(F.col("n") >= min_size)
    return whole.select("name").join(known, "name", "left").select("name", F.coalesce("class", "name").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
