"""Operators for training data against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import cooccurrence, set_similarity, shared_spans, tokens
from tessera.functions.baskets import basket_key
from tessera.llm.cooccurrence import item_pairs
from tessera.llm.packing import fill_plan, pack, reciprocal_bound
from tessera.session import materialize

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.BYTE_BPE_50K), reason="no tokenizer file")
TEXTS = [
    "Hello world", "", None, "   ", "naïve café — 漢字 🙂🏽 é", "<|endoftext|> is text", "a" * 3000, "\x00\x01﻿\n\r\t", "日本語" * 400, "x y ퟿", "tab\tand  two  blanks ", "🙂" * 50,
]


@needs_tokenizer
def test_encoding_equals_the_ranks():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokens.encode_array(pa.array(TEXTS), tokens.BYTE_BPE_50K).to_pylist()
    assert got == [other.encode_ordinary(t or "") for t in TEXTS]


@needs_tokenizer
@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(max_size=40), max_size=5))
def test_round_trip_and_offsets(texts):
    array = pa.array(texts, pa.string())
    ids = tokens.encode_array(array, tokens.BYTE_BPE_50K)
    assert tokens.decode_array(ids, tokens.BYTE_BPE_50K).to_pylist() == [t or "" for t in texts]
    starts, ends = tokens.offsets_array(array, ids, tokens.BYTE_BPE_50K)
    for text, one, first, last in zip(texts, ids.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        text = text or ""
        assert len(one) == len(first) == len(last)
        if one:
            assert first[0] == 0 and last[-1] == len(text)
            for i in range(1, len(one)):
                assert first[i] in (last[i - 1], last[i - 1] - 1) and last[i] >= last[i - 1]


@needs_tokenizer
def test_split_characters():
    ids = tokens.encode_array(pa.array(["🙂🏽"]), tokens.BYTE_BPE_50K).to_pylist()[0]
    assert len(ids) > 2
    assert tokens.decode_array(pa.array([ids, ids[:1], None, []], pa.list_(pa.int32())), tokens.BYTE_BPE_50K).to_pylist() == ["🙂🏽", "�", None, ""]


@needs_tokenizer
def test_encoding_of_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "again"), (None, "no id")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode(df, "doc_id", "text")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")] and got.count() == len(TEXTS) + 2
    assert [r["ids"] for r in got.where("doc_id in (1, 2)").collect()] == [[], []]
    back = {r["doc_id"]: r["text"] for r in tokens.decode(got.where("doc_id > 0")).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS) if i}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert tokens.token_counts(df, "doc_id", "text").where("doc_id = 2").first()["n_tokens"] == 0


def check_packing(rows, sizes, capacity):
    load, parts = Counter(), defaultdict(list)
    for doc, piece, first, n, container in rows:
        parts[doc].append((piece, first, n))
        if n:
            load[container] += n
        else:
            assert container is None
    assert max(load.values(), default=0) <= capacity
    assert sorted(load) == list(range(len(load)))
    assert set(parts) == set(sizes)
    for doc, pieces in parts.items():
        size = sizes[doc] or 0
        pieces.sort()
        assert sum(n for _, _, n in pieces) == size
        assert [first for _, first, _ in pieces] == [i * capacity for i in range(len(pieces))]
        assert len(pieces) == 1 if size <= capacity else all(n == capacity for _, _, n in pieces[:-1])
    return len(load)


@pytest.mark.parametrize("reciprocal", [False, True])
def test_packing(spark, reciprocal):
    draw = random.Random(1)
    sizes = {i: draw.choice([0, None, 1, 2, 33, 50, 51, 99, 100, 101, 250, draw.randrange(1, 70)]) for i in range(800)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").withColumn("container", F.lit("clash"))
    got = [tuple(r) for r in pack(df, 100, materialize, reciprocal=reciprocal).collect()]
    n = check_packing(got, sizes, 100)
    least = -(-sum(s or 0 for s in sizes.values()) // 100)
    assert n <= (1.7 * least + 3 if reciprocal else 1.05 * least + 1)


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(df, 100, materialize).count() == 0
    assert [tuple(r) for r in pack(spark.createDataFrame([(1, 0)], df.schema), 100, materialize).collect()] == [(1, 0, 0, 0, None)]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.booleans())
def test_plan_places_each_rank_once(counts, reuse):
    runs, made = fill_plan(counts, 60, reuse)
    load = Counter()
    for size, n in counts.items():
        own = sorted(r for r in runs if r[0] == size)
        assert not own or own[0][1] == 0
        for (_, rank, first, each), after in zip(own, [*[r[1] for r in own[1:]], n], strict=True):
            assert after > rank
            for r in range(rank, after):
                load[first + (r - rank) // each] += size
    assert set(load) == set(range(made)) and max(load.values(), default=0) <= 60
    assert all(reciprocal_bound(s, 60) >= s and 60 // reciprocal_bound(s, 60) == 60 // s for s in counts)


def test_basket_keys(spark):
    same = ["11/1/2016-123", "11/01/2016 - 00000123", ' "11/01/2016"-"0123" ', "2016-11-01-123", "2016-11-1-0123", "'11/1/2016'-'123'"]
    df = spark.createDataFrame([(t,) for t in [*same, None, "", ' "" ', "1/11/2016-123", "odd", "11/1/2016-0"]], "t string")
    keys = [r[0] for r in df.select(basket_key(F.col("t"))).collect()]
    assert keys[:6] == ["20161101-123"] * 6 and keys[6:] == [None, None, None, "20160111-123", "odd", "20161101-0"]


@pytest.mark.parametrize(("listed", "shared"), [(20_000, 2_000), (1, 4)])
def test_pairs_against_brute_force(spark, monkeypatch, listed, shared):
    monkeypatch.setattr(cooccurrence, "ITEMS_LISTED", listed)
    monkeypatch.setattr(cooccurrence, "ITEMS_SHARED", shared)
    draw = random.Random(2)
    rows = [(draw.choice([f"b{i}" for i in range(60)] + ["hot"] * 30), draw.randrange(25) if draw.random() < 0.95 else None) for _ in range(900)]
    rows += rows[:50] + [(None, 1)]
    df = spark.createDataFrame(rows, "basket string, item bigint").withColumn("n", F.lit("clash"))
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n, single, both = len(baskets), Counter(i for s in baskets.values() for i in s), Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    got = {(r["item_1"], r["item_2"]): r for r in item_pairs(df, materialize, min_count=3, min_share=0.05, min_lift=1.1).collect()}
    wanted = {p: c for p, c in both.items() if c >= 3 and c / n >= 0.05 and c * n / (single[p[0]] * single[p[1]]) >= 1.1}
    assert {p: r["n_both"] for p, r in got.items()} == wanted and wanted
    for (a, b), r in got.items():
        assert (r["n_1"], r["n_2"]) == (single[a], single[b])
        assert r["lift"] == pytest.approx(r["n_both"] * n / (single[a] * single[b])) and r["pmi"] == pytest.approx(np.log(r["lift"]))
    assert item_pairs(df.limit(0), materialize).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12, unique=True).map(sorted), min_size=1, max_size=8), st.integers(1, 6))
def test_merge_skip(lists, needed):
    counts = Counter(x for entries in lists for x in entries)
    assert set_similarity.merge_skip(lists, needed) == sorted((x, c) for x, c in counts.items() if c >= needed)


@pytest.mark.parametrize(("meant", "held"), [(200_000, 1_000_000), (40, 100)])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs_against_brute_force(spark, monkeypatch, meant, held, threshold):
    monkeypatch.setattr(set_similarity, "TOKENS_MEANT", meant)
    monkeypatch.setattr(set_similarity, "TOKENS_HELD", held)
    monkeypatch.setattr(set_similarity, "TOKENS_PROBED", meant)
    draw, sets = random.Random(7), {}
    for i in range(120):
        if i % 3 and sets:
            base = set(draw.choice(list(sets.values())))
            for _ in range(draw.randrange(0, 4)):
                base ^= {draw.choice(["hot"] + [f"u{j}" for j in range(60)])}
        else:
            base = {"hot"} | {f"u{draw.randrange(60)}" for _ in range(draw.randrange(1, 25))}
        sets[f"n{i:03}"] = base
    sets["giant"] = {f"g{j}" for j in range(3000)}
    for i in range(40):
        sets[f"copy{i}"] = {"hot", "u1", "u2", "u3", "u4"}
    rows = [(n, e) for n, s in sets.items() for e in s]
    draw.shuffle(rows)
    rows += rows[:100] + [(None, "u1"), ("n001", None)]
    df = spark.createDataFrame(rows, "name string, element string").withColumn("size", F.lit("clash"))
    got = [tuple(r) for r in set_similarity.similar_pairs(df, threshold, materialize, min_size=3).collect()]
    wanted = {(a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3 and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 780


@pytest.mark.parametrize("held", [1_000_000, 12])
def test_records_too_large_to_be_held_and_links(spark, monkeypatch, held):
    monkeypatch.setattr(set_similarity, "RECORD_HELD", held)
    draw = random.Random(31)
    core = list(range(30))
    sets = {f"n{i}": frozenset(draw.sample(core, draw.randrange(3, 28))) for i in range(60)}
    sets |= {f"copy{i}": frozenset(range(9)) for i in range(4)} | {f"big{i}": frozenset(range(20)) for i in range(3)} | {"tiny": frozenset([1, 2])}
    df = spark.createDataFrame([(n, str(e)) for n, s in sets.items() for e in s] * 2 + [(None, "1"), ("n1", None)], "name string, element string")
    wanted = {(a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3 and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in set_similarity.similar_pairs(df, 0.5, materialize, min_size=3).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    links = {r["name"]: r["n_links"] for r in set_similarity.class_links(df, 0.5, materialize, min_size=3).collect()}
    assert links == {n: sum(n in p for p in wanted) for n, s in sets.items() if len(s) >= 3}


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "name string, element string")
    assert set_similarity.similar_pairs(df, 0.5, materialize).count() == 0
    alone = spark.createDataFrame([("a", "x"), ("a", "y")], df.schema)
    assert set_similarity.similar_pairs(alone, 0.5, materialize).count() == 0


def brute_spans(texts, window):
    owners = defaultdict(set)
    for doc, text in texts:
        for i in range(len(text or "") - window + 1):
            owners[text[i : i + window]].add(doc)
    found = set()
    for doc, text in texts:
        flags = np.zeros(len(text or ""), bool)
        for i in range(len(text or "") - window + 1):
            if len(owners[text[i : i + window]]) > 1:
                flags[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(int), 0]))
        found |= {(doc, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)}
    return found


def corpus(draw, n, alphabet):
    passages = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(15, 120))) for _ in range(6)]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(draw.randrange(0, 4)):
            parts.append("".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 60))))
            passage = draw.choice(passages)
            a = draw.randrange(0, 10)
            parts.append(passage[a : len(passage) - draw.randrange(0, 10)])
        texts.append((i, "".join(parts)))
    return texts


@pytest.mark.parametrize(("alphabet", "gram", "batches"), [("abcdefgh 🙂é", 10, 2), ("ab", 5, 1), ("ab", 20, 3)])
def test_spans_against_brute_force(spark, monkeypatch, alphabet, gram, batches):
    monkeypatch.setattr(shared_spans, "CHARS_AT_ONCE", 150)
    texts = corpus(random.Random(11), 60, alphabet)
    texts += [(60, None), (61, ""), (62, "short"), (63, texts[5][1]), (64, "z" * 90), (65, "z" * 25), (66, "yx" * 60 + "yx" * 60), (67, texts[7][1] * 3)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = [tuple(r) for r in shared_spans.shared_spans(df, batches=batches, window=20, gram=gram).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 20)


def test_one_text_shares_nothing_with_itself(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 60), (1, "abcdefghij" * 60), (None, "abcdefghij" * 60)], "doc_id bigint, text string")
    assert shared_spans.shared_spans(df).count() == 0
    assert shared_spans.shared_spans(df.limit(0), batches=1).count() == 0


def test_index_compacts_its_runs_and_opens_again(spark, tmp_path):
    texts = corpus(random.Random(3), 60, "abcdefgh")
    whole, folder = spark.createDataFrame(texts, "doc_id bigint, text string"), f"file://{tmp_path}/index"
    index = shared_spans.FingerprintIndex(whole, folder, window=20, gram=10, buckets=3)
    for i in range(6):
        if i in (2, 5):  # another process goes on
            index = shared_spans.FingerprintIndex(whole, folder)
            assert (index.window, index.gram, index.buckets) == (20, 10, 3)
        batch = index.add(whole.where((F.col("doc_id") >= i * 10) & (F.col("doc_id") < i * 10 + 10)))
        seen = brute_spans(texts[: i * 10 + 10], 20)
        assert {tuple(r) for r in index.spans().collect()} == seen
        own = shared_spans._runs(index.batch_hits(batch).where(F.col("doc_id") >= i * 10), ["doc_id"])
        assert {tuple(r) for r in own.collect()} == {s for s in seen if s[0] >= i * 10}
    assert sorted(index.runs.values()) == [0, 0, 1]
    with shared_spans._laid_out(spark):
        plan = index.shared_with_history(next(run for run, level in index.runs.items() if not level))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan and "Sort [" not in plan


def test_equal_texts_are_few_rows(spark):
    texts = [(i, "the same passage of some length" if i % 3 else hashlib.sha256(str(i).encode()).hexdigest()) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    found = shared_spans.fingerprint_run(df, 20, 10)
    hot = found.where("fp IS NOT NULL").groupBy("fp").count().agg(F.max("count")).first()[0]
    assert hot <= 3 and found.where("fp IS NULL").count() > 300
    assert {tuple(r) for r in shared_spans.shared_spans(df, batches=2, window=20, gram=10).collect()} == brute_spans(texts, 20)


def test_sliding_least():
    values = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 7, 300):
        assert shared_spans._sliding_least(values, width).tolist() == [int(values[i : i + width].min()) for i in range(300 - width + 1)]
