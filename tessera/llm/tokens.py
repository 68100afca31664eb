"""Encoding and decoding of texts with a public byte-level tokenizer.

The tokenizers library runs over Arrow batches, on one thread per task.  Token
strings spell bytes with the byte-level alphabet; the table below gives the
bytes back, so that offsets are found by adding up byte lengths and mapping
bytes to characters, and decoding joins bytes, also where a character is split
over several tokens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import worker_cache

#: Tokenizer file that the queries use; a parameter of every operator.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that one call of the library gets, in whole texts.
CHARS_PER_CALL = 200_000


def _load(path: str):
    cache = worker_cache()
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cache[path] = tokenizer
    return cache[path]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for.

    Printable bytes stand for themselves; the others, in order, are written
    with the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in one array, and where each id's bytes begin."""
    cache = worker_cache()
    if (key := ("bytes", path)) not in cache:
        alphabet = byte_alphabet()
        tokenizer = _load(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        added = {i for i in tokenizer.get_added_tokens_decoder()}
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        cache[key] = np.frombuffer(b"".join(spelled), np.uint8), np.r_[0, np.cumsum([len(s) for s in spelled])]
    return cache[key]


def _calls(texts: pa.Array) -> Iterator[list[str]]:
    """Whole texts in lists of about ``CHARS_PER_CALL`` characters; null as empty."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= CHARS_PER_CALL:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_array(texts: pa.Array, path: str) -> pa.ListArray:
    """Ids of each text, without special tokens; null and empty give an empty list."""
    tokenizer = _load(path)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    ids, lengths = [np.zeros(0, np.int32)], [0]
    for some in _calls(texts):
        for encoding in encode(some, add_special_tokens=False):
            one = np.array(encoding.ids, np.int32)
            ids.append(one)
            lengths.append(len(one))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(ids)))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ranges, one after another, and where each begins among them."""
    ends = np.r_[0, np.cumsum(lengths)]
    return np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, lengths), ends


def decode_array(lists: pa.ListArray, path: str) -> pa.Array:
    """Text of each list of ids.

    The bytes of all tokens are joined before they are read as UTF-8, so split
    characters come out whole.  What isn't UTF-8, as when the list begins or
    ends within a character, becomes U+FFFD.  A null list stays null.
    """
    table, begin = _byte_table(path)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    at, ends = _gather(begin[ids], begin[ids + 1] - begin[ids])
    joined = table[at].tobytes()
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    cuts = ends[np.r_[0, np.cumsum(sizes)]]
    valid = lists.is_valid().to_pylist()
    return pa.array([joined[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(cuts[:-1], cuts[1:], valid, strict=True)], pa.string())


def offsets_array(texts: pa.Array, lists: pa.ListArray, path: str) -> tuple[pa.ListArray, pa.ListArray]:
    """First character, and the one after the last, of each token.

    A token that holds part of a character's bytes counts the whole character,
    so neighbouring tokens may share one.
    """
    _, begin = _byte_table(path)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    data = np.frombuffer("".join(t.as_py() or "" for t in texts).encode(), np.uint8)
    character = np.r_[np.cumsum((data & 0xC0) != 0x80) - 1, 0]
    ends = np.cumsum(begin[ids + 1] - begin[ids])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    first, last = character[starts] if len(ends) else ends, character[ends - 1] + 1 if len(ends) else ends
    per_text = np.array([len(t.as_py() or "") for t in texts], np.int64)
    base = np.repeat(np.r_[0, np.cumsum(per_text)[:-1]] if len(per_text) else per_text, lists.value_lengths().to_numpy(zero_copy_only=False))
    make = lambda v: pa.ListArray.from_arrays(lists.offsets, pa.array((v - base).astype(np.int32)))
    return make(first), make(last)


def encode(df: DataFrame, doc_id: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row of ``df``, whole texts.

    Null and empty texts give an empty list; repeated rows repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_array(batch.column(1), path)], names=["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def encode_with_offsets(df: DataFrame, doc_id: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """As ``encode``, with ``starts`` and ``ends``: the characters that each token covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_array(batch.column(1), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *offsets_array(batch.column(1), ids, path)], names=["doc_id", "ids", "starts", "ends"])

    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def token_counts(df: DataFrame, doc_id: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row of ``df``; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_array(batch.column(1), path).value_lengths().cast(pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def decode(df: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decode_array(batch.column(1), path)], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
