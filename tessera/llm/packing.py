"""Filling fixed-capacity containers with items of varying length.

Harmonic packing: lengths fall into classes, and a container of class k takes a
fixed number of that class's items, so that workers place items independently,
knowing only their ranks within their class.  With the classical reciprocal
classes (lengths in (C/(k+1), C/k], k to a container) every container may stay
up to half empty.  The default therefore makes every length a class of its own
and lets a class first use the room that longer classes left, again with a
fixed number per container.  The plan depends only on how many items each
length has, at most C numbers whatever the number of items.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items of one length that one task ranks.
RANKED_TOGETHER = 200_000


def reciprocal_bound(size: int, capacity: int) -> int:
    """Largest length of the reciprocal class of ``size``: the k-th holds (C/(k+1), C/k]."""
    return capacity // (capacity // size)


def fill_plan(counts: dict[int, int], capacity: int, reuse: bool) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs ``(size, first rank, first container, items per container)`` and the number of containers.

    Sizes are taken from the largest down.  With ``reuse`` items go where the
    least sufficient room is left, else only to new containers.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first container, containers)]
    rooms: list[int] = []
    runs, made = [], 0

    def leave(space: int, first: int, n: int) -> None:
        if reuse and space and n:
            if space not in room:
                bisect.insort(rooms, space)
                room[space] = []
            room[space].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                space = rooms[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], rooms[at]
            else:
                space, first = capacity, made
                n = -(-left // (capacity // size))
                made += n
            each = space // size
            full = min(n, left // each)
            if full:
                runs.append((size, rank, first, each))
                leave(space - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                runs.append((size, rank, first + full, left))
                leave(space - left * size, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            leave(space, first + full, n - full)
    return runs, made


def pack(sizes: DataFrame, capacity: int, materialize: Callable[[DataFrame], DataFrame], *, reciprocal: bool = False) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, container`` of ``doc_id, n_tokens``.

    An item longer than the capacity is cut into full containers and a rest,
    any other stays whole as piece 0.  An item of no tokens, or of an unknown
    number, comes out with a null container and takes no place.  Containers are
    numbered from 0 without gaps.  ``reciprocal`` keeps to the classical
    classes.
    """
    size = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    pieces = sizes.select("doc_id", size.alias("whole"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("whole") - 1) / capacity)).cast("int"))))
    first = F.col("piece").cast("bigint") * capacity
    pieces = materialize(pieces.select("doc_id", "piece", first.alias("first_token"), F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("whole") - first)).cast("int").alias("n_tokens")))
    placed = pieces.where(F.col("n_tokens") > 0)
    kind = F.floor(F.lit(capacity) / F.floor(F.lit(capacity) / F.col("n_tokens"))).cast("int") if reciprocal else F.col("n_tokens")
    counts = {r["kind"]: r["n"] for r in placed.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs, _ = fill_plan(counts, capacity, reuse=not reciprocal)
    table = np.array(runs or [(0, 0, 0, 1)], np.int64)
    by_rank = np.lexsort((table[:, 1], table[:, 0]))
    table = table[by_rank]
    shares = max(1, sum(counts.values()) // RANKED_TOGETHER + 1)
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int")
    ranked = placed.withColumn("kind", kind).withColumn("share", share)
    before = ranked.groupBy("kind", "share").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("kind", "share", (F.sum("n").over(W.partitionBy("kind").orderBy("share")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("kind", "share").orderBy("doc_id", "piece")) - 1
    ranked = ranked.withColumn("within", within).join(before, ["kind", "share"]).withColumn("rank", F.col("within") + F.col("before"))
    # ranks of a size are found among its runs: sizes and ranks as one ascending number
    top = int(max(counts.values(), default=0)) + 1
    starts = table[:, 0] * top + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column("kind").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            run = table[np.searchsorted(starts, sizes * top + ranks, "right") - 1]
            container = run[:, 2] + (ranks - run[:, 1]) // run[:, 3]
            keep = [batch.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(container)], names=["doc_id", "piece", "first_token", "n_tokens", "container"])

    schema = "doc_id bigint, piece int, first_token bigint, n_tokens int, container bigint"
    out = ranked.select("doc_id", "piece", "first_token", "n_tokens", "kind", "rank").mapInArrow(place, schema)
    return out.unionByName(pieces.where(F.col("n_tokens") == 0).withColumn("container", F.lit(None).cast("bigint")))
