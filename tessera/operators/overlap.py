"""Pairs of sets with at least so many common elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: Elements of the sets of one block, about, and pairs that are listed at once; a few elements are one block.
BLOCK, FEW, LISTED = 250_000, 20_000, 2_000_000


class _Sets:
    """Sets of element codes, in the order of ``name`` and then of the codes; ``rest`` is the number of last codes that pair nothing."""

    def __init__(self, name: np.ndarray, code: np.ndarray, value: np.ndarray, rest: int, codes: int):
        order = np.lexsort((code, name))
        self.name, self.of = np.unique(name[order], return_inverse=True)
        self.code, self.value, self.codes = code[order], value[order], codes
        self.end = np.cumsum(np.bincount(self.of, minlength=len(self.name)))
        self.key = self.of * codes + self.code
        at = np.arange(len(code))
        self.prefix = at[at < self.end[self.of] - rest] if len(code) else at
        self.last = self.code[self.end - 1 - rest]

    def find(self, sets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code stands in its set, and whether it does."""
        wanted = sets * self.codes + code
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return at, self.key[at] == wanted


def _listed(one: _Sets, two: _Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``one`` and of ``two`` with the same code among the prefixes, all those of a set of ``one`` at once."""
    by_code = two.prefix[np.argsort(two.code[two.prefix], kind="stable")]
    count = np.bincount(two.code[by_code], minlength=two.codes)
    begin = np.cumsum(count) - count
    rows = one.prefix[count[one.code[one.prefix]] > 0]
    sums = np.cumsum(count[one.code[rows]])
    ends = np.flatnonzero(np.r_[one.of[rows][1:] != one.of[rows][:-1], True]) + 1 if len(rows) else []
    low = 0
    for i, end in enumerate(ends):
        before = sums[low - 1] if low else 0
        if i + 1 == len(ends) or sums[ends[i + 1] - 1] - before > LISTED:
            own = rows[low:end]
            long = count[one.code[own]]
            step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            yield np.repeat(own, long), by_code[np.repeat(begin[one.code[own]], long) + step]
            low = end


def _shared(one: _Sets, two: _Sets, least: int, summed: bool) -> Iterator[list[np.ndarray]]:
    """Names of both, number of common elements and, if ``summed``, of their values the sums of products and of both squares."""
    for x, y in _listed(one, two):
        if one is two:
            x, y = (side[one.of[x] < one.of[y]] for side in (x, y))
        pair = one.of[x] * len(two.name) + two.of[y]
        ordered = np.sort(pair)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        found, n = ordered[first], np.diff(np.r_[first, len(ordered)])
        more = []  # rows of the common elements that are last ones of the set whose prefix ends first: there are no others
        done = []
        for mine, its, swap in ((one, two, False), (two, one, True)):
            i, j = found // len(two.name), found % len(two.name)
            chosen = np.flatnonzero((two.last[j] < one.last[i]) if swap else (one.last[i] <= two.last[j]))
            for t in range(least - 1):
                chosen = chosen[n[chosen] + least - 1 - t >= least]
                a, b = (j[chosen], i[chosen]) if swap else (i[chosen], j[chosen])
                at = mine.end[a] - 1 - t
                there, hit = its.find(b, mine.code[at])
                n[chosen] += hit
                if summed:
                    more.append((chosen[hit], there[hit], at[hit]) if swap else (chosen[hit], at[hit], there[hit]))
            done.append(chosen[n[chosen] >= least])
        kept = np.sort(np.concatenate(done))
        if not len(kept):
            continue
        i, j = found[kept] // len(two.name), found[kept] % len(two.name)
        out = [one.name[i], two.name[j], n[kept]]
        if summed:
            at = np.minimum(np.searchsorted(found[kept], pair), len(kept) - 1)
            same = found[kept][at] == pair
            parts = [(at[same], x[same], y[same])]
            for chosen, p, q in more:
                at = np.minimum(np.searchsorted(kept, chosen), len(kept) - 1)
                same = kept[at] == chosen
                parts.append((at[same], p[same], q[same]))
            at, p, q = (np.concatenate(side) for side in zip(*parts, strict=True))
            v, w = one.value[p], two.value[q]
            out += [np.bincount(at, product, len(kept)) for product in (v * w, v * v, w * w)]
        yield out


def _numbered(keys: DataFrame, column: str, number: str, *before: str) -> DataFrame:
    """The distinct ``column`` of ``keys`` with a number that rises with ``before`` and ``column``."""
    ordered = keys.orderBy(*before, column).select(column, F.monotonically_increasing_id().alias(number))
    return materialize(ordered)


def shared_sums(rows: DataFrame, least: int, value: str | None = None) -> DataFrame:
    """``one, two, n`` (``one < two``) of all pairs of sets that share ``least`` elements or more.

    ``rows`` holds distinct ``name, element`` without nulls, and with ``value``
    the result has of the common elements' values ``top, s1, s2``: the sums of
    their products and of their squares on either side.

    Sets are put in blocks; a task gets two blocks and lists their pairs, so no
    pair is shuffled before it is known to count.  Elements are numbered in one
    order, the rare ones first; sets that share ``least`` elements share one of
    the first ``size - least + 1``.  So the most frequent elements pair nothing
    unless a set consists of them; they are looked up for the pairs found.
    """
    number = lambda c: F.count(F.lit(1)).alias(c)
    elements = _numbered(rows.groupBy("element").agg(number("f")).where("f > 1"), "element", "e", "f")
    kept = rows.join(elements, "element")
    names = _numbered(kept.groupBy("name").agg(number("f")).where(F.col("f") >= least), "name", "i")
    held = materialize(kept.join(names, "name").select("i", "e", F.col(value).cast("double").alias("v") if value else F.lit(0.0).alias("v")))
    total = held.count()
    blocks = 1 if total <= FEW else max(6, -(-total // BLOCK))
    own, other = F.pmod(F.xxhash64("i"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = held.withColumn("block", own.cast("int")).withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    spread = spread.select((high * (high + 1) / 2 + low).cast("int").alias("cell"), (F.col("block") == high).alias("second"), "i", "e", "v")
    cells = blocks * (blocks + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(own) if (own := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        cell, second, i, e, v = (table[c].to_numpy() for c in ("cell", "second", "i", "e", "v"))
        high = int((np.sqrt(8 * cell[0] + 1) - 1) // 2)
        elements, code = np.unique(e, return_inverse=True)
        two = _Sets(i[second], code[second], v[second], least - 1, len(elements))
        one = two if cell[0] == high * (high + 1) // 2 + high else _Sets(i[~second], code[~second], v[~second], least - 1, len(elements))
        if not len(one.name) or not len(two.name):
            return
        for p, q, n, *sums in _shared(one, two, least, value is not None):
            swap = p > q
            if sums:
                sums = [sums[0], np.where(swap, sums[2], sums[1]), np.where(swap, sums[1], sums[2])]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(p, q), np.maximum(p, q), n, *sums)], names=fields)
            yield from (whole.slice(at, 20_000) for at in range(0, whole.num_rows, 20_000))

    fields = ["p", "q", "n", *(["top", "s1", "s2"] if value else [])]
    found = materialize(spread.repartitionById(cells, "cell").mapInArrow(run, "p long, q long, n long" + ", top double, s1 double, s2 double" * bool(value)))
    for side, at in (("one", "p"), ("two", "q")):
        found = found.join(names.select(F.col("name").alias(side), F.col("i").alias(at)), at)
    return found.select("one", "two", *fields[2:])


def common_elements(pairs: DataFrame, rows: DataFrame, values: list[str] | None = None) -> DataFrame:
    """One row for each common element of each of ``one, two``; ``values`` of both sides as ``<v>_1``, ``<v>_2``."""
    side = lambda name, i: rows.select(F.col("name").alias(name), "element", *(F.col(v).alias(f"{v}_{i}") for v in values or []))
    return pairs.join(side("one", 1), "one").join(side("two", 2), ["two", "element"])


def overlap_pairs(rows: DataFrame, least: int) -> DataFrame:
    """``one, two, n_common`` of the pairs with at least ``least`` (1 or more) common elements."""
    return shared_sums(rows, least).withColumnRenamed("n", "n_common")
