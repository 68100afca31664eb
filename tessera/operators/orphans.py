"""References to records that do not exist.

Keys are dictionary-encoded as integers within hash ranges of the keys.  For
each range and period (month) two compressed bitmaps are built: the keys that
rows of the period refer to, and the keys whose parent is present throughout
the period.  ``reference AND-NOT parent`` leaves the keys that may be orphans
in the period; they are decoded, and only their rows are held against the
exact times at which the parent was present.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.keys import clean_key, month_name, month_number
from tessera.operators.bitmaps import Bitmap
from tessera.session import materialize

#: End of a presence that has not ended.
OPEN_END = "9999-12-31 00:00:00"
#: Rows (before aggregation) for which one key range is meant.
ROWS_PER_RANGE = 100_000
NO_PERIOD = -1


@dataclass(frozen=True)
class Parent:
    """Rows that hold keys; ``until`` null: present since ``since`` without end."""

    name: str
    df: DataFrame
    key: str
    since: str = "loaded_at"
    until: str = "removed_at"


@dataclass(frozen=True)
class Reference:
    """A column ``field`` of the table ``name`` that refers to the parent ``parent``."""

    name: str
    df: DataFrame
    field: str
    record_id: str
    parent: str
    at: str = "loaded_at"


def presence(parent: Parent) -> DataFrame:
    """``key, since, until``: the disjoint times at which a key is present.

    Overlapping and touching deliveries are merged, first within the month of
    their start and then over all months, so that the many deliveries of one
    key are not sorted in one task.  Rows without a key or a start are ignored.
    """
    rows = (
        parent.df.select(clean_key(parent.key).alias("key"), F.col(parent.since).alias("since"), F.coalesce(parent.until, F.lit(OPEN_END).cast("timestamp_ntz")).alias("until"))
        .where(F.col("key").isNotNull() & F.col("since").isNotNull())
        .groupBy("key", "since").agg(F.max("until").alias("until"))
        .withColumn("month", F.trunc("since", "month"))
    )
    for by in (["key", "month"], ["key"]):
        before = W.partitionBy(*by).orderBy("since", "until")
        reach = F.max("until").over(before.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("new", F.when(reach >= F.col("since"), 0).otherwise(1)).withColumn("run", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, 0)))
        rows = rows.groupBy(*by, "run").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    return rows.select("key", "since", "until")


def _survivors(_key, references: pa.Table, parents: pa.Table) -> pa.Table:
    """References whose parent isn't present throughout the period, of one key range."""
    both = pa.chunked_array([*references["key"].chunks, *parents["key"].chunks], pa.string()).combine_chunks()
    coded = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    of_reference, of_parent = code[: len(references)], code[len(references) :]
    period, what = references["period"].to_numpy(), references["what"].to_numpy()
    first, last = parents["first_full"].to_numpy(), parents["end_full"].to_numpy()
    taken: list[np.ndarray] = []
    order = np.lexsort((what, period))
    cuts = np.flatnonzero(np.r_[True, (period[order][1:] != period[order][:-1]) | (what[order][1:] != what[order][:-1]), True]) if len(order) else [0]
    present: tuple[int, Bitmap] | None = None
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[start:end]
        now = int(period[rows[0]])
        if present is None or present[0] != now:
            present = now, Bitmap(np.unique(of_parent[(first <= now) & (now < last)]) if now != NO_PERIOD else ())
        left = Bitmap(of_reference[rows]).and_not(present[1]).codes()
        taken.append(rows[np.isin(of_reference[rows], left)])
    rows = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    # times of presence of the surviving keys
    sort = np.argsort(of_parent, kind="stable")
    lows, highs = np.searchsorted(of_parent[sort], of_reference[rows], "left"), np.searchsorted(of_parent[sort], of_reference[rows], "right")
    lengths = highs - lows
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    picked = pa.array(sort[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - lows, lengths)])
    times = [pa.ListArray.from_arrays(pa.array(offsets), parents[c].combine_chunks().take(picked)) for c in ("since", "until")]
    rows = pa.array(rows)
    return pa.table({"what": references["what"].take(rows), "key": references["key"].take(rows), "period": references["period"].take(rows), "since": times[0], "until": times[1]})


def orphan_references(references: Sequence[Reference], parents: Sequence[Parent]) -> DataFrame:
    """``table_name, field, record_id, reason, period`` of every orphan reference.

    A row is an orphan if its key has no parent row that is present at the
    row's own time.  ``reason``: ``missing`` (no parent row has the key),
    ``late`` (all its parent rows start later), else ``deleted``.  ``period``:
    month of the row's time.  Rows without a key are no references.  A row
    without a time has no period, and is an orphan only if its key is missing.
    Repeated rows give one result.  Empty parents make every reference missing.
    """
    spark = references[0].df.sparkSession
    total = sum(df.count() for df in {id(x.df): x.df for x in [*references, *parents]}.values())  # from the Parquet footers
    ranges = max(8, total // ROWS_PER_RANGE)
    key_range = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("key_range")
    rows = None
    for i, r in enumerate(references):
        part = r.df.select(F.lit(i).alias("what"), F.col(r.record_id).alias("record_id"), clean_key(r.field).alias("key"), F.col(r.at).alias("at"))
        part = part.where(F.col("key").isNotNull()).withColumn("period", F.coalesce(month_number(F.col("at")), F.lit(NO_PERIOD)))
        rows = part if rows is None else rows.unionByName(part)
    owner = {p.name: i for i, p in enumerate(parents)}
    parent_of = F.element_at(F.array(*(F.lit(owner[r.parent]) for r in references)), F.col("what") + 1).alias("parent")
    used = rows.groupBy("what", "key", "period").agg(F.lit(1).alias("one")).select(parent_of, key_range, "what", "key", "period")
    held = None
    for i, p in enumerate(parents):
        part = presence(p).select(F.lit(i).alias("parent"), "key", "since", "until")
        held = part if held is None else held.unionByName(part)
    start = F.col("since") == F.date_trunc("month", "since").cast("timestamp_ntz")
    held = held.select("parent", key_range, "key", "since", "until", (month_number(F.col("since")) + F.when(start, 0).otherwise(1)).alias("first_full"), month_number(F.col("until")).alias("end_full"))
    suspects = (
        used.groupBy("parent", "key_range").cogroup(held.groupBy("parent", "key_range"))
        .applyInArrow(_survivors, "what int, key string, period int, since array<timestamp_ntz>, until array<timestamp_ntz>")
    )
    # written, so that their size is known: few enough are sent to the rows, which then stay where they are
    found = rows.join(materialize(suspects), ["what", "key", "period"])
    at = F.col("at")
    present = F.exists(F.arrays_zip("since", "until"), lambda x: (x["since"] <= at) & (at < x["until"]))
    reason = (
        F.when(F.size("since") == 0, "missing").when(at.isNull(), None)
        .when(at < F.array_min("since"), "late").when(~present, "deleted")
    )
    name = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("what") + 1)
    return (
        found.withColumn("reason", reason).where(F.col("reason").isNotNull())
        .select(
            name([r.name for r in references]).alias("table_name"), name([r.field for r in references]).alias("field"), "record_id", "reason",
            F.when(F.col("period") != NO_PERIOD, month_name(F.col("period"))).alias("period"),
        )
        .distinct()
    )
