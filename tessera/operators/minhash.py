"""MinHash signatures, banding and verified similar pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import SKETCH_MODULUS
from tessera.operators.overlap import common_elements

#: Elements of one set that one task takes; larger sets are shared out and their minima merged.
ELEMENTS_SHARED = 100_000
#: Elements that are hashed by all functions at once.
_AT_ONCE = 4_096


def _hashes(x: np.ndarray, a: np.ndarray, b: np.ndarray, modulus: int, size: int) -> np.ndarray:
    """``((a x + b) % modulus) % size`` of each element and function, for numbers below 2**34; ``a`` is split, so that no product overflows."""
    x = x[:, None] % modulus
    return (((a >> 16) * x % modulus << 16) % modulus + (a & 0xFFFF) * x + b) % modulus % size


def _least_by_name(minima: Callable[[pa.RecordBatch], np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by ``name`` the element-wise least of what ``minima`` gives for each; one name's minima are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for low in range(0, batch.num_rows, _AT_ONCE):
                some = batch.slice(low, _AT_ONCE)
                names = some.column(0).to_pylist()
                firsts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
                least = np.minimum.reduceat(minima(some), firsts, axis=0)
                found = [names[i] for i in firsts]
                if held is not None:
                    if found[0] == last:
                        np.minimum(least[0], held, out=least[0])
                    else:
                        found, least = [last, *found], np.concatenate([held[None], least])
                last, held = found[-1], least[-1].copy()
                if len(found) > 1:
                    yield _signatures(found[:-1], least[:-1], width)
        if held is not None:
            yield _signatures([last], held[None], width)

    return run


def _signatures(names: list, least: np.ndarray, width: int) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * width, pa.int32()), pa.array(least.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists], names=["name", "minima"])


def minhash_minima(rows: DataFrame, family: list[tuple[int, int]], size: int, modulus: int = SKETCH_MODULUS) -> DataFrame:
    """``name, minima``: of each set the least hash by each function of ``family``, in order.

    ``rows`` holds ``name, x``, ``x`` the element's number; rows without either
    are left out.  ``size`` is the range of the hashes, usually the number of
    distinct elements.  What is shuffled are the elements, and one array for
    each share of a set.
    """
    a, b = (np.array(v, np.int64) for v in zip(*family, strict=True))
    rows = rows.where(F.col("name").isNotNull() & F.col("x").isNotNull()).select(F.col("name").cast("string").alias("name"), F.col("x").cast("bigint").alias("x"))
    shares = rows.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / ELEMENTS_SHARED).cast("int").alias("shares"))
    spread = rows.join(shares, "name").withColumn("share", F.pmod(F.xxhash64("x"), "shares"))
    schema = "name string, minima array<bigint>"
    hashed = lambda batch: _hashes(batch.column(1).to_numpy(), a, b, modulus, max(1, size))
    given = lambda batch: batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(family))
    parts = spread.repartition("name", "share").sortWithinPartitions("name").select("name", "x").mapInArrow(_least_by_name(hashed, len(family)), schema)
    return parts.repartition("name").sortWithinPartitions("name").mapInArrow(_least_by_name(given, len(family)), schema)


def minhash_signatures(rows: DataFrame, family: list[tuple[int, int]], size: int, modulus: int = SKETCH_MODULUS) -> DataFrame:
    """``name, number, least``: the entries of ``minhash_minima``."""
    return minhash_minima(rows, family, size, modulus).select("name", F.posexplode("minima").alias("number", "least"))


def bands(minima: DataFrame, rows_per_band: int) -> DataFrame:
    """``name, ..., band, bucket`` of ``name, minima, ...``: the minima of each band of hash functions as one text."""
    n_bands = F.ceil(F.size("minima") / rows_per_band).cast("int")
    bucket = F.array_join(F.slice("minima", F.col("band") * rows_per_band + 1, F.lit(rows_per_band)).cast("array<string>"), "-")
    rest = [c for c in minima.columns if c != "minima"]
    return minima.withColumn("band", F.explode(F.sequence(F.lit(0), n_bands - 1))).select(*rest, "band", bucket.alias("bucket"))


def lsh_candidates(banded: DataFrame, least: float = 0.0) -> DataFrame:
    """``one, two`` (``one < two``), each once: the sets that share a bucket.

    With ``least`` above 0 ``banded`` also holds ``n``, the size of the set, and
    pairs whose sizes rule out that similarity are left out.
    """
    side = lambda name, n: banded.select(F.col("name").alias(name), "band", "bucket", *([F.col("n").alias(n)] if least else []))
    met = side("one", "n_one").join(side("two", "n_two"), ["band", "bucket"]).where(F.col("one") < F.col("two"))
    if least:
        met = met.where(F.least("n_one", "n_two") >= least * F.greatest("n_one", "n_two") - 1e-9)
    return met.select("one", "two").distinct()


def jaccard(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """``one, two, similarity`` of the pairs whose exact Jaccard similarity is at least ``least``."""
    common = common_elements(pairs, rows).groupBy("one", "two").agg(F.count(F.lit(1)).alias("c"))
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    for side in ("one", "two"):
        common = common.join(sizes.select(F.col("name").alias(side), F.col("n").alias(f"n_{side}")), side)
    similarity = F.col("c") / (F.col("n_one") + F.col("n_two") - F.col("c"))
    return common.select("one", "two", similarity.alias("similarity")).where(F.col("similarity") >= least)


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of one member of each class of equal sets, and ``name, class`` of all.

    Without this a bucket would pair all copies of one set with each other.
    """
    digest = F.sum(F.xxhash64("element").cast("decimal(38,0)")), F.sum(F.xxhash64("element", F.lit(1)).cast("decimal(38,0)")), F.count(F.lit(1))
    keys = rows.groupBy("name").agg(*(d.alias(f"d{i}") for i, d in enumerate(digest)))
    classes = keys.groupBy("d0", "d1", "d2").agg(F.min("name").alias("class"))
    members = keys.join(classes, ["d0", "d1", "d2"]).select("name", "class", F.col("d2").alias("n"))
    return rows.join(members.where(F.col("name") == F.col("class")).select("name"), "name", "left_semi"), members


def similar_pairs(rows: DataFrame, family: list[tuple[int, int]], size: int, rows_per_band: int, least: float, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``one, two, similarity``: pairs that share a bucket and are verified exactly.

    ``rows`` holds distinct ``name, element, x``.  Copies are joined once and
    come out as pairs of similarity 1.
    """
    unique, members = distinct_sets(rows)
    unique, members = materialize(unique), materialize(members)
    sized = minhash_minima(unique, family, size).join(members.select("name", "n"), "name")
    found = jaccard(lsh_candidates(materialize(bands(sized, rows_per_band)), least), unique, least)
    one, two = (members.select(F.col("name").alias(n), F.col("class").alias(c)) for n, c in (("a", "one"), ("b", "two")))
    across = found.join(one, "one").join(two, "two").select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"), "similarity")
    within = one.join(two, F.col("one") == F.col("two")).where(F.col("a") < F.col("b")).select(F.col("a").alias("one"), F.col("b").alias("two"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)
