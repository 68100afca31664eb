"""Long exact spans shared between records.

A log-structured fingerprint index.  In every window of W characters the gram
of G characters with the least hash (the leftmost of equals) is the window's
anchor; equal windows have equal anchors at equal places.  A batch of texts
becomes an immutable run of anchors, laid out in buckets of the fingerprint and
sorted within.  A new run is merge-joined with the runs of history bucket by
bucket, so that no history is shuffled or sorted again, and runs are compacted
from time to time.  A manifest in the index's folder names the runs, so that the
index can be opened again.

Anchors with a fingerprint that a second text holds are verified.  The stretch
of all windows that share an anchor is compared as a whole first; texts that
repeat it as a whole need one row for some 50 windows.  Where stretches of one
fingerprint differ, as at the ends of a repeated passage, one stretch of each
kind is fetched from its text and compared window by window.  Equality is that
of cryptographic digests of the characters, besides that of the fingerprints.
No step forms pairs of texts.  Equal stretches of the texts of one Arrow batch
are one row of a run, their places being kept beside it, so that a passage in
very many texts is a few rows of its bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize, remove, worker_cache, workspace

WINDOW = 200
#: Half a window: shorter grams recur by chance in texts that share nothing longer, and each such anchor must be verified window by window.
GRAM = WINDOW // 2
#: Characters hashed at once; longer texts are taken in overlapping segments.
CHARS_AT_ONCE = 200_000
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
#: Anchors of one Arrow batch whose equal stretches are combined at once.
ANCHORS_AT_ONCE = 1_000_000
#: Stretches of at most this many rows (60 bytes each) are sent to the tasks that read the texts; more are joined with them.
SAMPLES_SENT = 400_000
_BASE, _SEED = 0x9E3779B97F4A7C15 | 5, 0x632BE59BD9B4E019
_POSITION_BITS = 24


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, CHARS_AT_ONCE + 4 * WINDOW), b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        cache["powers"] = tuple(both)
    return cache["powers"][0][:n], cache["powers"][1][:n]


class Hashes:
    """Hashes of any stretch of an array of characters."""

    def __init__(self, codes: np.ndarray) -> None:
        power, self.inverse = _powers(len(codes) + 1)
        terms = _mix(codes.astype(np.uint64) + np.uint64(_SEED)) * power[:-1]
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return _mix((self.sums[after] - self.sums[first]) * self.inverse[first])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    until = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], until[width - 1 : n])


def _bytes(texts: list[str]) -> bytes:
    """Four bytes for each character."""
    return "".join(texts).encode("utf-32-le", "surrogatepass")


def _digests(data: bytes, first: np.ndarray, after: np.ndarray, salt: np.ndarray, size: int) -> bytes:
    """BLAKE2b digests of ``size`` bytes of the characters from ``first`` to before ``after``, each with a number as key, in a row."""
    new = hashlib.blake2b
    view = memoryview(data)
    return b"".join(new(view[a:b], digest_size=size, salt=k.to_bytes(8, "little")).digest() for a, b, k in zip((first * 4).tolist(), (after * 4).tolist(), salt.tolist(), strict=True))


def anchors(texts: list[str], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts that fit at once: text number, fingerprint, stretch, first window and number of windows."""
    data = _bytes(texts)
    codes = np.frombuffer(data, np.uint32)
    sizes = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    h = Hashes(codes)
    at = np.arange(max(0, len(codes) - gram + 1))
    prints = h.of(at, at + gram)
    shift = np.uint64(_POSITION_BITS)
    least = _sliding_least((prints >> shift << shift) | at.astype(np.uint64), window - gram + 1)
    place = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    windows = np.maximum(0, sizes - window + 1)
    ends = np.r_[0, np.cumsum(windows)]
    x = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, windows)  # first characters of the windows within one text
    text = np.repeat(np.arange(len(texts)), windows)
    place = place[x]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) if len(x) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(x)])
    first, anchor, text = x[new], place[new], text[new]
    stretch = np.frombuffer(_digests(data, first, first + count - 1 + window, (anchor - first) * (1 << 20) + count, 8), np.int64)
    return text, prints[anchor].view(np.int64), stretch, first - starts[text], count


def _portions(ids: list, texts: list, window: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """Ids, offsets and texts that are hashed at once; long texts in segments that share windows' length less one."""
    held: tuple[list, list[int], list[str]] = [], [], []
    size = 0
    for name, text in zip(ids, texts, strict=True):
        if text is None or name is None or len(text) < window:
            continue
        for start in range(0, len(text) - window + 1, CHARS_AT_ONCE):
            part = text[start : start + CHARS_AT_ONCE + window - 1]
            if size and size + len(part) > CHARS_AT_ONCE + window:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (name, start, part), strict=True):
                column.append(value)
            size += len(part)
    if size:
        yield held


_ANCHORS = "fp bigint, stretch bigint, low bigint, high bigint, first bigint, n int, equal bigint"
_NAMES = [c.split()[0] for c in _ANCHORS.split(", ")]


def _combined(fp: np.ndarray, stretch: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Anchors with equal stretches as one row, followed by the places of each.

    Of the rows of a run ``equal`` is null or the number of their places; these
    follow as rows without ``fp``: ``low`` is the text, ``stretch`` unused.
    """
    order = np.lexsort((first, doc, stretch, fp))
    fp, stretch, doc, first, n = (v[order] for v in (fp, stretch, doc, first, n))
    new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (stretch[1:] != stretch[:-1])]) if len(fp) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(fp)])
    several = size > 1
    number = np.where(several, np.random.default_rng(int.from_bytes(uuid.uuid4().bytes)).integers(-(2**63), 2**63 - 1, len(new)), 0)
    member = np.repeat(several, size)
    none = np.zeros(int(member.sum()), np.int64)
    high = doc[new + size - 1] if len(new) else none
    columns = (
        pa.array(np.r_[fp[new], none], mask=np.r_[np.zeros(len(new), bool), np.ones(len(none), bool)]), pa.array(np.r_[stretch[new], none]), pa.array(np.r_[doc[new], doc[member]]),
        pa.array(np.r_[high, doc[member]]), pa.array(np.r_[first[new], first[member]]), pa.array(np.r_[n[new], n[member]].astype(np.int32)),
        pa.array(np.r_[number, np.repeat(number, size)[member]], mask=np.r_[~several, np.zeros(len(none), bool)]),
    )
    return pa.RecordBatch.from_arrays(list(columns), names=_NAMES)


def fingerprint_run(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """The rows of ``_combined`` for the anchors of ``doc_id, text``, combined within each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                for ids, offsets, texts in _portions(some.column(0).to_pylist(), some.column(1).to_pylist(), window):
                    text, fp, stretch, first, n = anchors(texts, window, gram)
                    held.append((fp, stretch, np.array(ids, np.int64)[text], np.array(offsets, np.int64)[text] + first, n))
                    if sum(len(part[0]) for part in held) >= ANCHORS_AT_ONCE:
                        yield _combined(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held = []
            if held:
                yield _combined(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _ANCHORS)


def _window_rows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The digest of each window of the texts, with the columns before the text and the place of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                texts = some.column(some.num_columns - 1).to_pylist()
                sizes = np.array([len(t) for t in texts])
                windows = np.maximum(0, sizes - window + 1)
                ends, starts = np.r_[0, np.cumsum(windows)], np.r_[0, np.cumsum(sizes)[:-1]]
                row = np.repeat(np.arange(len(texts)), windows)
                x = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, windows)
                both = np.frombuffer(_digests(_bytes(texts), x, x + window, np.zeros(len(x), np.int64), 16), np.int64).reshape(-1, 2)
                taken = pa.array(row)
                kept = [some.column(i).take(taken) for i in range(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array((x - starts[row]).astype(np.int32)), *(pa.array(both[:, k]) for k in (0, 1))], names=[*some.schema.names[:-1], "at", "h1", "h2"])

    return run


#: Sorted buckets are read in order; a join on the fingerprint and more keeps the buckets of the fingerprint.
_LAID_OUT = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.unionOutputPartitioning": "false",
}


@contextmanager
def _laid_out(spark: SparkSession) -> Iterator[None]:
    """Plans made and run within use the layout of the runs."""
    before = {key: spark.conf.get(key, None) for key in _LAID_OUT}
    for key, value in _LAID_OUT.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class FingerprintIndex:
    """Runs of fingerprints over batches of texts, and what they share.

    ``texts`` holds ``doc_id, text`` of all batches, those to come included;
    ``folder`` must be shared by the executors.  A folder that holds an index is
    opened, and its window, gram and number of buckets count.  An index has one
    writer at a time; runs without an entry in the manifest, left by a writer
    that failed, are ignored.
    """

    def __init__(self, texts: DataFrame, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> None:
        if not 0 < gram <= window:
            raise ValueError("a gram must fit a window")
        self.spark = texts.sparkSession
        self.texts, self.folder = texts.select(F.col("doc_id").cast("bigint"), "text"), folder or f"{workspace(self.spark)}/index-{uuid.uuid4().hex}"
        self.window, self.gram, self.buckets = window, gram, buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self.hits = 0, {}, []  # level of each run; batches with hits
        if folder is not None:
            self._open()

    def _open(self) -> None:
        try:
            every = self.spark.read.parquet(f"{self.folder}/manifest")
        except Exception as error:  # no manifest: a new index
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return
        last = every.where(F.col("version") == every.agg(F.max("version")).scalar()).collect()  # a row per run and batch
        self.version = last[0]["version"]
        self.window, self.gram, self.buckets = (last[0][c] for c in ("window", "gram", "buckets"))
        self.runs = {r["run"]: r["level"] for r in last if r["kind"] == "run"}
        self.hits = [r["run"] for r in last if r["kind"] == "hits"]

    def _commit(self) -> None:
        """One more version of the manifest; the last that is whole counts."""
        self.version += 1
        kept = [("run", run, level) for run, level in self.runs.items()] + [("hits", batch, 0) for batch in self.hits]
        rows = [(*k, self.window, self.gram, self.buckets) for k in kept]
        df = self.spark.createDataFrame(rows, "kind string, run string, level int, window int, gram int, buckets int").coalesce(1)
        df.write.parquet(f"{self.folder}/manifest/version={self.version}")

    def _table(self, run: str) -> str:
        """The table of a run: buckets of the fingerprint, sorted."""
        name = f"fingerprints_{run}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, stretch BIGINT, low BIGINT, high BIGINT, first BIGINT, n INT, equal BIGINT) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY (fp, stretch) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/runs/{run}'"
        )
        return name

    def rows(self, run: str) -> DataFrame:
        """The anchors of a run."""
        return self.spark.table(self._table(run))

    def _places(self, batch: str) -> DataFrame:
        return self.spark.read.schema(_ANCHORS).parquet(f"{self.folder}/anchors/{batch}").where("fp IS NULL").select("equal", F.col("low").alias("doc_id"), "first")

    def add(self, documents: DataFrame) -> str:
        """Takes in a batch ``doc_id, text``; gives its name.  Its hits, and those it makes in earlier batches, are written."""
        batch = uuid.uuid4().hex
        fingerprint_run(documents, self.window, self.gram).write.parquet(f"{self.folder}/anchors/{batch}")
        rows = self.spark.read.schema(_ANCHORS).parquet(f"{self.folder}/anchors/{batch}").where("fp IS NOT NULL")
        with _laid_out(self.spark):
            rows.repartition(self.buckets, "fp").write.insertInto(self._table(batch))
            found = self._found(batch)
            self._verify(batch, found)
        remove(found)
        self.runs[batch] = 0
        self.hits.append(batch)
        self._commit()
        self._compact(0)
        return batch

    def shared_with_history(self, batch: str) -> DataFrame:
        """The fingerprints that a batch shares, within itself or with a run; to be planned and run within the layout."""
        by_fp = lambda run, low, high: self.rows(run).groupBy("fp").agg(F.min("low").alias(low), F.max("high").alias(high))
        own = by_fp(batch, "low", "high")
        found = own.where(F.col("low") != F.col("high")).select("fp")
        for run in self.runs:
            met = own.join(by_fp(run, "old_low", "old_high").hint("merge"), "fp")
            found = found.unionByName(met.where(F.least("low", "old_low") != F.greatest("high", "old_high")).select("fp"))
        return found

    def _found(self, batch: str) -> DataFrame:
        return materialize(self.shared_with_history(batch).distinct())

    def _verify(self, batch: str, found: DataFrame) -> None:
        """Writes ``doc_id, a, b``: the stretches of characters that the batch's texts and earlier ones newly share."""
        window = self.window
        kept = None
        for run in (batch, *self.runs):
            part = self.rows(run).join(found.hint("merge"), "fp", "left_semi").withColumn("old", F.lit(run != batch))
            kept = part if kept is None else kept.unionByName(part)
        kept = materialize(kept)
        old = lambda c: F.when(F.col("old"), F.col(c))
        kinds = kept.groupBy("fp", "stretch").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min(old("low")).alias("old_low"), F.max(old("high")).alias("old_high"), F.min(F.struct("low", "first", "n")).alias("one"),
        )
        kinds = materialize(kinds)
        several = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1).select("fp")
        samples = kinds.join(several, "fp", "left_semi").select("fp", "stretch", "low", "high", F.col("one.low").alias("doc_id"), "one.first", "one.n")
        texts = self.texts.where(F.col("text").isNotNull())
        cut = F.substring("text", (F.col("first") + 1).cast("int"), F.col("n") + window - 1)
        asked = F.broadcast(samples) if kinds.count() <= SAMPLES_SENT else samples
        pieces = texts.join(asked, "doc_id").select("fp", "stretch", "low", "high", cut.alias("cut"))
        windows = materialize(pieces.mapInArrow(_window_rows(window), "fp bigint, stretch bigint, low bigint, high bigint, at int, h1 bigint, h2 bigint"))
        equal = windows.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("high").alias("most")).where(F.col("least") != F.col("most"))
        # of stretches that one text has to itself, the windows that others have as well
        single = windows.where(F.col("low") == F.col("high")).join(equal.select("h1", "h2"), ["h1", "h2"], "left_semi")
        place = lambda value: value.cast("bigint")
        parts = _runs(single.select("fp", "stretch", place(F.col("at")).alias("a"), place(F.col("at") + 1).alias("b")), ["fp", "stretch"]).withColumn("known", F.lit(False))
        # texts that shared a whole stretch before have had their hits
        known = F.coalesce(F.col("old_low") != F.col("old_high"), F.lit(False))
        whole = kinds.where(F.col("low") != F.col("high")).select("fp", "stretch", place(F.lit(0)).alias("a"), place(F.lit(None)).alias("b"), known.alias("known"))
        met = kept.join(whole.unionByName(parts), ["fp", "stretch"]).where(~(F.col("old") & F.col("known")))
        met = materialize(met.select("equal", "low", "first", "n", "a", "b"))
        places = None
        for name in (*self.hits, batch):
            places = self._places(name) if places is None else places.unionByName(self._places(name))
        several = met.where("equal IS NOT NULL").drop("low", "first").join(places, "equal").select("doc_id", "first", "n", "a", "b")
        hits = met.where("equal IS NULL").select(F.col("low").alias("doc_id"), "first", "n", "a", "b").unionByName(several)
        hits = hits.select("doc_id", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.coalesce("b", F.col("n").cast("bigint")) + window - 1).alias("b"))
        hits.write.parquet(f"{self.folder}/hits/{batch}")
        remove(kept, kinds, windows, met)

    def _compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next when there are ``FANOUT``: one file a bucket again, for which they are shuffled once."""
        runs = [run for run, own in self.runs.items() if own == level]
        if len(runs) < FANOUT:
            return
        merged = uuid.uuid4().hex
        whole = self.rows(runs[0])
        for run in runs[1:]:
            whole = whole.unionByName(self.rows(run))
        with _laid_out(self.spark):
            whole.repartition(self.buckets, "fp").write.insertInto(self._table(merged))
        self.runs = {run: own for run, own in self.runs.items() if run not in runs} | {merged: level + 1}
        self._commit()
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
            remove(f"{self.folder}/runs/{run}", spark=self.spark)
        self._compact(level + 1)

    def batch_hits(self, batch: str) -> DataFrame:
        """``doc_id, a, b``: what became known to be shared when ``batch`` came; of its own texts all that they share with it and before."""
        return self.spark.read.schema("doc_id bigint, a bigint, b bigint").parquet(f"{self.folder}/hits/{batch}")

    def spans(self) -> DataFrame:
        """``doc_id, span_start, span_end``: the longest runs of shared characters of all batches."""
        whole = None
        for batch in self.hits:
            whole = self.batch_hits(batch) if whole is None else whole.unionByName(self.batch_hits(batch))
        if whole is None:
            whole = self.spark.createDataFrame([], "doc_id bigint, a bigint, b bigint")
        return _runs(whole, ["doc_id"]).select("doc_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def _runs(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching intervals ``a, b`` as one; ``b`` is the position after the last."""
    order = W.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(*by, "a", "b")


def shared_spans(documents: DataFrame, *, batches: int = FANOUT + 1, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, span_start, span_end`` over all of ``doc_id, text``, indexed batch by batch.

    A character is shared if it lies in a stretch of ``window`` characters that
    another ``doc_id`` has too.  Null and short texts share nothing; rows of one
    ``doc_id`` don't share with each other.
    """
    index = FingerprintIndex(documents, None, window, gram)
    for i in range(batches):
        index.add(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return index.spans()
