"""The analytics operators against naive Python, and the plans they make."""

import csv
import datetime as dt
import json
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions.baskets import basket_key
from tessera.operators import adjacency, cluster, features, graph, itemsets, minhash, overlap, recommend, relational, sketch
from tessera.plans import analytics, mining
from tessera.session import materialize
from tessera.sources import readers, sinks
from tessera.sources.views import latest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# relational ------------------------------------------------------------------


def test_profile_and_top(spark, rows):
    data = [("r1", "u1", "b1", dt.datetime(2018, 1, 1)), ("r2", "u1", "b2", dt.datetime(2018, 12, 31, 23)), ("r3", "u2", "b1", dt.datetime(2019, 1, 1)), ("r4", None, None, None)]
    df = spark.createDataFrame(data, "review_id string, user_id string, business_id string, date timestamp_ntz")
    assert rows(relational.review_profile(df, 2018)) == [(4, 2, 2, 2)]
    assert [tuple(r) for r in relational.top_k(df, "business_id", 1).collect()] == [("b1", 2)]
    assert [tuple(r) for r in relational.top_k(df, "user_id", 9).collect()] == [("u1", 2), ("u2", 1)]
    document = json.loads(sinks.json_document(relational.profile_document(df, 2018, 1)).first()[0])
    assert document == {"n_review": 4, "n_review_year": 2, "n_user": 2, "n_business": 2, "top1_user": [["u1", "2"]], "top1_business": [["b1", "2"]]}
    assert rows(relational.review_profile(df.limit(0), 2018)) == [(0, 0, 0, 0)]


def test_mean_by_lookup(spark, rows):
    facts = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 4.0), ("c", 9.0), (None, 7.0)], "k string, v double")
    lookup = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "y")], "k string, city string")
    assert rows(relational.mean_by_lookup(facts, lookup, "k", F.col("city"), "v", "city")) == [("x", 2.5), (None, 9.0)]


def test_defaults_and_having(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    other = spark.createDataFrame([("a", 5.0, None), ("x", 1.0, 1)], "k string, s double, n int")
    assert rows(relational.with_defaults(df, other.withColumnRenamed("n", "m"), "k", {"s": 3.0, "m": 0})) == [("a", 1, 5.0, 0), ("b", 2, 3.0, 0), (None, 3, 3.0, 0)]
    assert rows(relational.having_count(df.unionByName(df.where("k = 'a'")), "k", 2)) == [("a", 1), ("a", 1)]


def test_partition_sizes(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("i",), ("a",)], "k string")
    assert rows(relational.partition_sizes(df, 4, F.ascii("k"))) == [(0, 0), (1, 3), (2, 1), (3, 0)]
    assert relational.partition_sizes(df, 4).agg(F.sum("n_items")).first()[0] == 4


def test_latest_delivery(spark, rows):
    day = dt.datetime
    df = spark.createDataFrame([("a", day(2020, 1, 1), 1, {"x": "y"}), ("a", day(2020, 2, 1), 2, None), ("a", day(2020, 2, 1), 3, {}), ("b", None, None, None), (None, day(2020, 1, 1), 9, None)], "k string, loaded_at timestamp_ntz, n int, m map<string, string>")
    assert rows(latest(df, "k", ["n"]).select("k", "n", "m")) == [("a", 3, {}), ("b", None, None)]


def test_error_histogram(spark, rows):
    df = spark.createDataFrame([(1.0, 1.5), (5.0, 0.5), (3.0, 1.0), (None, 1.0)], "t double, g double")
    rmse, bins = relational.error_histogram(df, "t", "g")
    assert rmse.first()[0] == pytest.approx((24.5 / 3) ** 0.5) and rows(bins) == [(0, 1), (2, 1), (4, 1)]


# functions and features --------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=5))
def test_text_numbers(spark, texts):
    p = hashing.SKETCH_MODULUS
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hashing.text_number(F.col("t"), p)).collect()]
    assert got == [int.from_bytes(t.encode(), "big") % p for t in texts]


def test_linear_hash(spark):
    p, m = hashing.SKETCH_MODULUS, hashing.SKETCH_RANGE
    draw = random.Random(0)
    data = [(draw.randrange(p), draw.randrange(1, p), draw.randrange(p)) for _ in range(200)] + [(p - 1, p - 1, p - 1), (0, 1, 0)]
    df = spark.createDataFrame(data, "x bigint, a bigint, b bigint")
    got = [r[0] for r in df.select(hashing.linear_hash(F.col("x"), F.col("a"), F.col("b"), p, m)).collect()]
    assert got == [((a * x + b) % p) % m for x, a, b in data]
    assert len(set(hashing.hash_family(100, 2, p))) == 100


def test_text_and_map_features(spark, rows):
    data = [("Great good!! bad", {"a": "True", "b": "true", "c": None}, {"x": 1, "y": None}, "2010-05-01 10:00:00"), (None, None, None, None), ("", {}, {}, "soon"), ("GREAT  best!", {"a": "True"}, {"x": 5}, "2023")]
    df = spark.createDataFrame(data, "t string, m map<string, string>, c map<string, bigint>, d string")
    got = df.select(features.keyword_score(F.col("t")), features.exclamations(F.col("t")), features.true_entries(F.col("m")), features.size_or_zero(F.col("m")), features.map_total(F.col("c")), features.years_since(F.col("d")), features.words_or_zero(F.col("t"), " "))
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1, 3, 1, 13, 3), (0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 1), (1, 1, 1, 1, 5, 0, 3)]


def test_labels(spark, rows):
    df = spark.createDataFrame([("a", "x, y"), ("b", "y"), ("c", None)], "id string, c string")
    labels = F.split("c", ", ")
    assert [tuple(r) for r in features.top_labels(df, labels, 2).collect()] == [("y", 2), ("x", 1)]
    assert rows(features.indicators(df, ["id"], labels, ["y", "x"])) == [("a", 1, 1), ("b", 1, 0), ("c", 0, 0)]


# itemsets and overlap -----------------------------------------------------------


def random_baskets(seed, n=80, items=9):
    draw = random.Random(seed)
    return {f"b{i}": set(draw.sample([f"i{j}" for j in range(items)], draw.randrange(1, 6))) | ({"i0"} if i % 3 else set()) for i in range(n)}


@pytest.mark.parametrize("support", [2, 10, 1000])
def test_itemsets(spark, support):
    baskets = random_baskets(4)
    df = itemsets.build_baskets(spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s] * 2 + [(None, "i1"), ("b1", None)], "b string, i string"), "b", "i")
    counts = Counter(c for s in baskets.values() for k in range(1, len(s) + 1) for c in combinations(sorted(s), k))
    wanted = {c: n for c, n in counts.items() if n >= support}
    got = {tuple(r["items"]): r["n"] for r in itemsets.frequent_itemsets(df, support, materialize).collect()}
    assert got == wanted
    assert {tuple(r["items"]): r["n"] for r in itemsets.frequent_itemsets_by_growth(df, support).collect()} == wanted
    parts = df.withColumn("part", (F.substring("basket", 2, 9).cast("int") % 3))
    candidates = {tuple(r["items"]) for r in itemsets.son_candidates(parts, support, 3, materialize).collect()}
    local = set()
    for p in range(3):
        local |= {c for c, n in Counter(c for b, s in baskets.items() if int(b[1:]) % 3 == p for k in range(1, len(s) + 1) for c in combinations(sorted(s), k)).items() if n >= -(-support // 3)}
    assert candidates == local and set(wanted) <= candidates
    second = itemsets.count_candidates(df, itemsets.son_candidates(parts, support, 3, materialize), support, materialize)
    assert {tuple(r["items"]): r["n"] for r in second.collect()} == wanted
    assert itemsets.frequent_itemsets(df.limit(0), support, materialize).count() == 0
    assert itemsets.build_baskets(spark.createDataFrame([("x", "i"), ("y", "i"), ("y", "j")], "b string, i string"), "b", "i", 1).count() == 2


def own_transactions(spark, monkeypatch):
    """Random baskets in place of the transactions of a folder, a tenth of them the support."""
    baskets = {b.replace("b", "b-"): s for b, s in random_baskets(4).items()}
    df = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "basket string, item string")
    monkeypatch.setattr(analytics, "_transactions", lambda *_: df)
    monkeypatch.setattr(analytics, "SUPPORT_SHARE", 0.1)
    return baskets


def held_by(sets, least):
    return {c for c, n in Counter(c for s in sets for k in range(1, len(s) + 1) for c in combinations(sorted(s), k)).items() if n >= least}


def test_itemset_report_query_has_every_size(spark, monkeypatch):
    wanted = held_by(own_transactions(spark, monkeypatch).values(), 8)
    assert max(map(len, wanted)) > 2
    lines = dict(tuple(r) for r in analytics.itemset_report(spark, "").collect() if r["line"])
    assert lines == {k: ",".join("('" + "', '".join(c) + "')" for c in sorted(wanted) if len(c) == k) for k in {len(c) for c in wanted}}


def test_son_candidates_query_has_every_size(spark, monkeypatch):
    baskets = own_transactions(spark, monkeypatch)
    parts = [[s for b, s in baskets.items() if int(b[2:]) % analytics.PARTS == p] for p in range(analytics.PARTS)]
    wanted = set().union(*(held_by(sets, 2) for sets in parts))
    got = {tuple(r["items"].split(" ")) for r in analytics.son_candidates(spark, "").collect()}
    assert got == wanted and held_by(baskets.values(), 8) <= got and max(map(len, got)) > 2


def test_basket_key_forms(spark):
    df = spark.createDataFrame([("11/1/2016-5",), (' "11/01/2016"-"0005" ',), ("2016-11-01 - 5",), (None,)], "t string")
    assert [r[0] for r in df.select(basket_key(F.col("t"))).collect()] == ["20161101-5"] * 3 + [None]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_overlap(spark, least):
    sets = random_baskets(6, 40)
    df = spark.createDataFrame([(n, e) for n, s in sets.items() for e in s], "name string, element string")
    got = {(r["one"], r["two"]): r["n_common"] for r in overlap.overlap_pairs(df, least).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    assert "CartesianProduct" not in plan(overlap.overlap_pairs(df, least)) and "Python" not in plan(overlap.overlap_pairs(df, least))


def test_sums_of_common_values_in_blocks(spark, monkeypatch):
    in_blocks(monkeypatch)
    draw = random.Random(9)
    sets = {n: {e: draw.uniform(-2, 2) for e in sorted(s)} for n, s in random_baskets(6, 40).items()}
    df = spark.createDataFrame([(n, e, v) for n, s in sets.items() for e, v in s.items()], "name string, element string, d double")
    got = {(r["one"], r["two"]): tuple(r)[2:] for r in overlap.shared_sums(df, 3, "d").collect()}
    common = {(a, b): [(sets[a][e], sets[b][e]) for e in sets[a].keys() & sets[b].keys()] for a, b in combinations(sorted(sets), 2)}
    wanted = {k: (len(x), sum(a * b for a, b in x), sum(a * a for a, _ in x), sum(b * b for _, b in x)) for k, x in common.items() if len(x) >= 3}
    assert got == {k: pytest.approx(x) for k, x in wanted.items()} and got


def in_blocks(monkeypatch):
    for name, n in (("FEW", 0), ("BLOCK", 40), ("LISTED", 30)):
        monkeypatch.setattr(overlap, name, n)


def test_overlap_in_blocks(spark, monkeypatch):
    in_blocks(monkeypatch)
    sets = random_baskets(6, 40) | {"hot": {f"i{i}" for i in range(12)}}
    df = spark.createDataFrame([(n, e) for n, s in sets.items() for e in s], "name string, element string")
    got = [tuple(r) for r in overlap.overlap_pairs(df, 3).collect()]
    wanted = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 3}
    assert set(got) == wanted and len(got) == len(wanted) > 10


def test_lsh_finds_the_similar(spark):
    sets = random_baskets(8, 60)
    sets |= {f"copy{i}": {"i1", "i2"} for i in range(5)}
    df = spark.createDataFrame([(n, e) for n, s in sets.items() for e in s], "name string, element string").withColumn("x", hashing.text_number(F.col("element"), hashing.SKETCH_MODULUS))
    got = {(r["one"], r["two"]): round(r["similarity"], 9) for r in minhash.similar_pairs(df, mining.FAMILY, 9, 2, 0.5, materialize).collect()}
    exact = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a, b in combinations(sorted(sets), 2)}
    assert got == {p: s for p, s in exact.items() if s >= 0.5}


def test_minhash_queries_use_the_whole_family(spark, monkeypatch):
    sets = random_baskets(8, 30, 30)
    number = {e: int.from_bytes(e.encode(), "big") % hashing.SKETCH_MODULUS for s in sets.values() for e in s}
    df = spark.createDataFrame([(n, e, number[e]) for n, s in sets.items() for e in s], "name string, element string, x bigint")
    monkeypatch.setattr(mining, "_sets", lambda *_: df)
    wanted = {(n, i): min((a * number[e] + b) % hashing.SKETCH_MODULUS % len(number) for e in s) for n, s in sets.items() for i, (a, b) in enumerate(mining.FAMILY)}
    assert {(r["item"], r["number"]): r["least"] for r in mining.minhash_signature(spark, "").collect()} == wanted
    assert len({a for a, _ in mining.FAMILY}) == 250
    alike = {(x, y) for x, y in combinations(sorted(sets), 2) if any(all(wanted[x, i] == wanted[y, i] for i in (j, j + 1)) for j in range(0, 250, 2))}
    assert {tuple(r) for r in mining.lsh_candidates(spark, "").collect()} == alike


# recommendation ----------------------------------------------------------------


def test_recommendation(spark):
    draw = random.Random(3)
    ratings = {(f"u{u}", f"i{i}"): float(draw.randrange(1, 6)) for u in range(25) for i in range(8) if draw.random() < 0.6}
    ratings |= {(f"u{u}", "flat"): 3.0 for u in range(20)}
    df = spark.createDataFrame([(*k, v) for k, v in ratings.items()], "user string, item string, rating double")
    of, by = defaultdict(dict), defaultdict(dict)
    for (u, i), r in ratings.items():
        of[i][u] = by[u][i] = r
    mean = {i: np.mean(list(x.values())) for i, x in of.items()}
    wanted = {}
    for a, b in combinations(sorted(of), 2):
        common = set(of[a]) & set(of[b])
        if len(common) > 5 and min(len(of[a]), len(of[b])) >= 8:
            x, y = (np.array([of[k][u] - mean[k] for u in sorted(common)]) for k in (a, b))
            bottom = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
            if bottom > 0 and (x * y).sum() / bottom > 1e-12:
                wanted[a, b] = (x * y).sum() / bottom
    similar = materialize(recommend.pearson(df, 8, 5))
    assert {(r["one"], r["two"]): pytest.approx(r["similarity"]) for r in similar.collect()} == wanted and wanted
    pairs = [("u0", "i1"), ("u1", "flat"), ("u2", "i3"), ("new", "i1"), ("u1", "new"), ("new", "new")]
    model = spark.createDataFrame([(u, i, 9.0) for u, i in pairs], "user string, item string, prediction double")
    got = {(r["user"], r["item"]): r["prediction"] for r in recommend.predict(model, df, similar).collect()}
    mixed = {(r["user"], r["item"]): r["prediction"] for r in recommend.hybrid(model, df, similar, model).collect()}
    for u, i in pairs:
        weights = [(r, wanted[min(i, j), max(i, j)]) for j, r in by.get(u, {}).items() if (min(i, j), max(i, j)) in wanted]
        weighted = sum(r * s for r, s in weights) / sum(s for _, s in weights) if weights else None
        known = u in by and i in of
        plain = weighted if known and weights else mean[i] if i in of else np.mean(list(by[u].values())) if u in by else 3.0
        assert got[u, i] == pytest.approx(plain)
        assert mixed[u, i] == pytest.approx(weighted if known and weights else 9.0)


def test_pairs_meet_the_shorter_of_similar_and_rated_items(spark):
    similar = [("hot", f"j{k:02}", 0.5 + k / 100) for k in range(40)] + [("a", "b", 0.25)]
    ratings = {("few", "j01"): 4.0, ("few", "j02"): 1.0, **{("many", f"j{k:02}"): 1.0 + k % 5 for k in range(20)}, ("many", "b"): 5.0, ("none", "hot"): 2.0, ("x", "a"): 3.0}
    df = spark.createDataFrame([(*k, v) for k, v in ratings.items()], "user string, item string, rating double")
    pairs = [("few", "hot"), ("many", "hot"), ("many", "a"), ("none", "hot"), ("new", "hot"), ("few", "odd")]
    found = recommend.collaborative(spark.createDataFrame(pairs, "user string, item string"), df, spark.createDataFrame(similar, "one string, two string, similarity double"))
    assert "n_similar" in plan(found)
    got = {(r["user"], r["item"]): r["weighted"] for r in found.collect()}
    for u, i in pairs:
        near = [(ratings[u, two if one == i else one], x) for one, two, x in similar if i in (one, two) and (u, two if one == i else one) in ratings]
        assert got.pop((u, i)) == (pytest.approx(sum(r * x for r, x in near) / sum(x for _, x in near)) if near else None)
    assert not got


def test_predict_meets_no_more_than_it_must(spark):
    df = spark.createDataFrame([("u", f"j{k}", 1.0 + k % 5) for k in range(9)] + [("w", "j3", 4.0), ("x", "hot", 2.0)], "user string, item string, rating double")
    similar = spark.createDataFrame([("hot", f"j{k}", 0.5) for k in range(5)], "one string, two string, similarity double")
    pairs = spark.createDataFrame([("u", "hot"), ("w", "hot")], "user string, item string")
    found = recommend.predict(pairs, df, similar)
    assert {"n_similar", "n_rated"} <= {w for w in ("n_similar", "n_rated") if w in plan(found)}
    assert {r["user"]: r["prediction"] for r in found.collect()} == {"u": pytest.approx(3.0), "w": pytest.approx(4.0)}


def test_hybrid_meets_no_more_than_it_must(spark):
    df = spark.createDataFrame([("u", f"j{k}", 1.0 + k % 5) for k in range(9)] + [("w", "j3", 4.0), ("x", "hot", 2.0)], "user string, item string, rating double")
    similar = spark.createDataFrame([("hot", f"j{k}", 0.5) for k in range(5)], "one string, two string, similarity double")
    pairs = spark.createDataFrame([("u", "hot"), ("w", "hot")], "user string, item string")
    found = recommend.hybrid(pairs, df, similar, pairs.select("user", "item", F.lit(9.0).alias("prediction")))
    assert {"n_similar", "n_rated"} <= {w for w in ("n_similar", "n_rated") if w in plan(found)}
    assert {r["user"]: r["prediction"] for r in found.collect()} == {"u": pytest.approx(3.0), "w": pytest.approx(4.0)}


# graphs ------------------------------------------------------------------------

EDGES = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("d", "e"), ("d", "f"), ("d", "g"), ("e", "f"), ("f", "g"), ("x", "y")]


def brandes(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total = Counter()
    for s in near:
        distance, paths, order, queue = {s: 0}, Counter({s: 1}), [], [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in sorted(near[v]):
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
        credit = Counter()
        for w in reversed(order):
            for v in near[w]:
                if distance.get(v, -9) == distance[w] - 1:
                    flow = (1 + credit[w]) * paths[v] / paths[w]
                    total[min(v, w), max(v, w)] += flow / 2
                    credit[v] += flow
    return total


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_graph(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(graph, "EDGES_SENT", sent)
    monkeypatch.setattr(graph, "CELLS_CUT", min(sent, graph.CELLS_CUT))
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = {(r["src"], r["dst"]): r["betweenness"] for r in graph.edge_betweenness(edges, materialize).collect()}
    wanted = brandes(EDGES)
    assert set(got) == set(wanted) and all(got[e] == pytest.approx(wanted[e]) for e in got)
    levels = {(r["source"], r["vertex"]): (r["distance"], r["paths"]) for r in graph.bfs(edges, materialize).collect()}
    assert levels["a", "f"] == (3, 1.0) and levels["e", "g"] == (2, 2.0) and ("a", "x") not in levels and levels["x", "x"] == (0, 1.0)
    assert rows(graph.components(edges, materialize)) == [(v, "x" if v in "xy" else "a") for v in "abcdefgxy"]
    assert rows(graph.without_strongest(graph.edge_betweenness(edges, materialize))) == sorted(e for e in EDGES if e != ("b", "d"))
    best, q = graph.girvan_newman(edges, materialize, 3)
    assert {tuple(r) for r in best.collect()} == {(v, "a" if v in "abc" else "x" if v in "xy" else "d") for v in "abcdefgxy"}
    assert q == pytest.approx(graph.modularity(edges, best).first()[0]) and q > 0.3
    labels = dict(rows(graph.label_propagation(edges, 5, materialize)))
    assert len({labels[v] for v in "abc"}) == 1 and {labels["x"], labels["y"]} == {"x", "y"}
    report = [r[0] for r in sinks.community_report(graph.communities(best.withColumnRenamed("community", "label"))).collect()]
    assert report == ["'x', 'y'", "'a', 'b', 'c'", "'d', 'e', 'f', 'g'"]
    lines = [r[0] for r in sinks.betweenness_report(graph.edge_betweenness(edges, materialize)).collect()]
    assert lines[0] == "('b', 'd'),12.0"


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_long_chain_and_empty_graph(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(graph, "EDGES_SENT", sent)
    names = [f"v{i:03}" for i in range(60)]
    random.Random(1).shuffle(names)
    chain = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(names, names[1:])], "src string, dst string")  # noqa: B905
    assert {r["component"] for r in graph.components(chain, materialize).collect()} == {"v000"}
    empty = chain.limit(0)
    assert graph.components(empty, materialize).count() == 0 and graph.edge_betweenness(empty, materialize).count() == 0
    assert graph.girvan_newman(empty, materialize, 2)[0].count() == 0 and graph.label_propagation(empty, 2, materialize).count() == 0


def naive_girvan_newman(edges):
    """The best partition, after how many cuts it was first met, and the number of cuts."""
    degree, left, most, cuts = Counter(v for e in edges for v in e), list(edges), float("-inf"), 0
    while True:
        name = {v: v for v in degree}
        for _ in degree:
            for a, b in left:
                name[a] = name[b] = min(name[a], name[b])
        inside = sum(name[a] == name[b] for a, b in edges) / len(edges)
        q = inside - sum((sum(degree[v] for v in degree if name[v] == c) / (2 * len(edges))) ** 2 for c in set(name.values()))
        if q >= most - 1e-12:
            at = cuts if q > most + 1e-12 else at
            best, most = name, q
        if not left:
            return best, at, cuts
        found = brandes(left)
        left = [e for e in left if found[e] < max(found.values()) - 1e-9]
        cuts += 1


def test_girvan_newman_query_cuts_to_the_end(spark, monkeypatch):
    late = [tuple(e) for e in "ab af bh bi bj ce cf ch cj dg di ef eg eh gh gj hi hj".split()]
    best, at, cuts = naive_girvan_newman(late)
    assert (at, cuts) == (8, 9)
    monkeypatch.setattr(mining, "_edges", lambda *_: spark.createDataFrame(late, "src string, dst string"))
    assert dict(tuple(r) for r in mining.girvan_newman(spark, "").collect()) == best


def test_cuts_are_made_with_twins_as_one(spark, monkeypatch):
    # 8 cliques of 12 on a hub with 60 leaves: vertices times edges are far above the bound, nodes times links are not
    cliques = [[f"c{i}{j:02}" for j in range(12)] for i in range(8)]
    edges = [e for c in cliques for e in combinations(c, 2)] + [(c[0], "hub") for c in cliques] + [("hub", f"leaf{i:02}") for i in range(60)]
    monkeypatch.setattr(graph, "CELLS_CUT", 2_000)
    monkeypatch.setattr(graph, "components", None)  # the way by jobs
    best, _ = graph.girvan_newman(spark.createDataFrame(edges, "src string, dst string"), materialize)
    parts = Counter(r["community"] for r in best.collect())
    assert all(parts[c[0]] == 12 for c in cliques) and sum(parts.values()) == 157


def test_graph_queries_share_one_graph(spark, monkeypatch, rows):
    assert mining.LINK < 9
    # a and b share LINK items, b and c nine
    visits = [(u, f"i{i}") for u, own in (("a", range(mining.LINK)), ("b", range(mining.LINK + 9)), ("c", range(mining.LINK, mining.LINK + 9))) for i in own]
    monkeypatch.setattr(mining.views, "visits", lambda *_: spark.createDataFrame(visits, "user string, item string"))
    edges = [("a", "b"), ("b", "c")]
    assert rows(mining.graph_edges(spark, "")) == edges
    assert rows(mining.edge_betweenness(spark, "")) == [(*e, 2.0) for e in edges]
    assert [r[0] for r in mining.betweenness_report(spark, "").collect()] == [f"('{x}', '{y}'),2.0" for x, y in edges]
    assert {(r["source"], r["vertex"]): r["distance"] for r in mining.bfs_levels(spark, "").collect()} == {(x, y): abs(ord(x) - ord(y)) for x in "abc" for y in "abc"}
    assert {r["vertex"] for r in mining.girvan_newman(spark, "").collect()} == set("abc")


def test_small_graphs_against_naive(spark):
    draw = random.Random(12)
    for n, m in ((12, 14), (30, 25), (25, 80)):
        edges = sorted({tuple(sorted(draw.sample([f"v{i:02}" for i in range(n)], 2))) for _ in range(m)})
        found = adjacency.Graph.of(pa.table({"src": [a for a, _ in edges], "dst": [b for _, b in edges]}))
        name = {v: v for e in edges for v in e}
        for _ in name:
            for a, b in edges:
                name[a] = name[b] = min(name[a], name[b])
        assert [found.names[i] for i in found.components()] == [name[v] for v in found.names]
        label = {v: v for v in name}
        for _ in range(4):
            votes = {v: Counter(label[b if a == v else a] for a, b in edges if v in (a, b)) for v in name}
            label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
        assert [found.names[i] for i in found.propagated(4)] == [label[v] for v in found.names]
        best, most = adjacency.cut_to_the_end(found, None, False, False)
        assert {v: found.names[i] for v, i in zip(found.names, best, strict=True)} == naive_girvan_newman(edges)[0]


def test_betweenness_searches_from_one_of_all_twins(spark):
    draw = random.Random(5)
    alike = [("hub", f"leaf{i:02}") for i in range(30)] + [(f"in{i:02}", f"in{j:02}") for i in range(12) for j in range(i + 1, 12)] + [(f"in{i:02}", "top") for i in range(12)] + [("hub", "top")]
    graphs = [alike, *([tuple(sorted(draw.sample("abcdefghij", 2))) for _ in range(m)] for m in (6, 14, 30))]
    for edges in ([tuple(sorted(e)) for e in {frozenset(e) for e in g}] for g in graphs):
        got = {(r["src"], r["dst"]): r["betweenness"] for r in graph.edge_betweenness(spark.createDataFrame(edges, "src string, dst string"), materialize).collect()}
        assert got == {e: pytest.approx(x) for e, x in brandes(edges).items()}
    # leaves (one and the rest), the hub, the top, the clique
    folded = adjacency.Folded.of(adjacency.Graph.of(pa.table({"src": [a for a, _ in alike], "dst": [b for _, b in alike]})))
    assert sorted(folded.size) == [1, 1, 1, 12, 29] and sum(folded.times) == 44


def test_modularity_meanings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    one = spark.createDataFrame([(v, "all") for v in "abcd"], "vertex string, community string")
    assert graph.modularity(edges, one).first()[0] == pytest.approx(0)
    split = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p"), ("d", "q")], "vertex string, community string")
    k, m = {"a": 2, "b": 2, "c": 3, "d": 1}, 4
    link = {frozenset(e) for e in (("a", "b"), ("b", "c"), ("a", "c"))}
    q = sum((frozenset(p) in link) - k[p[0]] * k[p[1]] / (2 * m) for x in combinations("abc", 2) for p in (x, x[::-1])) - 2 * k["d"] ** 2 / (2 * m)
    assert graph.modularity(edges, split, current=edges.where("dst <> 'd'"), pairs_only=True).first()[0] == pytest.approx(q / (2 * m))


# sketches ----------------------------------------------------------------------


def test_sketches(spark):
    draw = random.Random(4)
    keys = [draw.choice([f"k{j}" for j in range(300)] + ["hot"] * 150) for _ in range(1000)]
    df = sketch.count_batches(spark.createDataFrame(list(enumerate(keys)), "p bigint, k string"), "p", "k", 100)
    bits, seen, field, rates = 400, set(), set(), defaultdict(lambda: [0, 0])
    for pos, key in enumerate(keys):
        x = int.from_bytes(key.encode(), "big")
        own = {((a * x + b) % hashing.BLOOM_MODULUS) % bits for a, b in hashing.BLOOM_HASHES}
        if key not in seen:
            rates[pos // 100][0 if own <= field else 1] += 1
        seen.add(key)
        field |= own
    got = {r["batch"]: (r["n_false"], r["n_true"], r["rate"]) for r in sketch.bloom_rates(df, bits).collect()}
    assert got == {b: (*rates[b], rates[b][0] / sum(rates[b]) if sum(rates[b]) else None) for b in range(10)} and any(f for f, _ in rates.values())
    family = hashing.hash_family(40, 9, hashing.SKETCH_MODULUS)
    estimates = {r["batch"]: r["estimate"] for r in sketch.distinct_estimates(sketch.trailing_zeros(df, family)).collect()}
    for batch in range(10):
        most = []
        for a, b in family:
            hashes = [((a * int.from_bytes(k.encode(), "big") + b) % hashing.SKETCH_MODULUS) % hashing.SKETCH_RANGE for k in keys[batch * 100 : batch * 100 + 100]]
            most.append(max(1 if h == 0 else (h & -h).bit_length() - 1 for h in hashes))
        assert estimates[batch] == int(2 ** np.mean([np.median(most[i : i + 20]) for i in (0, 20)]))
    assert {r["batch"]: r["n_distinct"] for r in sketch.distinct_per_batch(df).collect()} == {b: len(set(keys[b * 100 : b * 100 + 100])) for b in range(10)}
    slots = {(r["seqnum"], r["slot"]): r["value"] for r in sketch.reservoir(df, 100, 3).collect()}
    held, chance = list(keys[:100]), [r for r in df.select(hashing.draw(F.col("pos"), 3), hashing.draw(F.col("pos"), 4), "pos").orderBy("pos").collect()]
    for pos in range(100, 1000):
        if chance[pos][0] < 100 / (pos + 1):
            held[int(chance[pos][1] * 100)] = keys[pos]
        if pos % 100 == 99:
            assert [slots[pos + 1, s] for s in range(100)] == held


def test_reservoir_is_uniform(spark):
    """Every position is as likely to stay, and every slot to be written, by counting and without ``draw``."""
    n, size, seeds = 3000, 100, 12
    df = sketch.count_batches(spark.range(n).select(F.col("id").alias("p"), F.col("id").cast("string").alias("k")), "p", "k", size)
    held, written = Counter(), Counter()
    for seed in range(seeds):
        slots = sketch.reservoir(df, size, seed)
        for r in slots.where(F.col("seqnum") == n).collect():
            held[int(r["value"]) * 10 // n] += 1
            written[r["slot"]] += int(r["value"]) >= size
    assert sum(held.values()) == size * seeds
    assert all(abs(held[d] - 120) < 55 for d in range(10))  # five deviations
    assert len(written) == size and min(written.values()) >= seeds - 3
    draws = np.array([tuple(r) for r in spark.range(20_000).select(hashing.draw(F.col("id"), 5), hashing.draw(F.col("id"), 6)).collect()])
    assert abs(np.corrcoef(draws.T)[0, 1]) < 0.035 and abs(np.corrcoef(draws[1:, 0], draws[:-1, 0])[0, 1]) < 0.035
    grid = np.histogram2d(draws[:, 0], draws[:, 1], bins=10, range=[[0, 1], [0, 1]])[0]
    assert ((grid - 200) ** 2 / 200).sum() < 180  # 99 degrees of freedom


# clustering --------------------------------------------------------------------


def test_nearest_of_many_summaries(spark, monkeypatch, rows):
    draw = np.random.default_rng(8)
    points = spark.createDataFrame([(i, int(i % 12), [float(x) for x in draw.normal(size=2)]) for i in range(120)], "id bigint, label int, features array<double>")
    stats = cluster.summarize(points, "label")
    wanted = rows(cluster.nearest(points, stats, 12).select("id", "cluster", F.round("distance", 9)))
    monkeypatch.setattr(cluster, "SUMMARIES_SENT", 5)
    assert rows(cluster.nearest(points, stats, 12).select("id", "cluster", F.round("distance", 9))) == wanted


def test_clustering(spark):
    draw = np.random.default_rng(1)
    centre = np.array([[0, 0, 0], [30, 0, 0], [0, 30, 30]])
    data = [(i, int(i % 3), [float(x) for x in centre[i % 3] + draw.normal(size=3)]) for i in range(300)] + [(300, 9, [500.0, 500.0, 500.0])]
    points = spark.createDataFrame(data, "id bigint, label int, features array<double>")
    found = cluster.bfr(points, 3, materialize, chunks=3, first_k=20)
    labels = {r["id"]: r["cluster"] for r in found.labels.collect()}
    assert sorted(labels) == list(range(301)) and labels[300] == -1
    for k in range(3):
        own = Counter(labels[i] for i in range(300) if i % 3 == k and labels[i] >= 0)
        assert len(own) == 1 and sum(own.values()) > 80
    last = found.rounds.orderBy(F.desc("round")).first()
    assert last["n_main"] + last["n_compressed"] + last["n_retained"] == 301
    stats = cluster.summarize(points.where("label < 9"), "label")
    near = cluster.nearest(points, stats, 3).orderBy("id").collect()
    assert all(r["cluster"] == r["id"] % 3 for r in near[:300])
    x, own = np.array(data[4][2]), np.array([f for _, k, f in data if k == 1])
    assert near[4]["distance"] == pytest.approx(np.sqrt(((x - own.mean(0)) ** 2 / own.var(0)).sum()))
    assert cluster.bfr(points.limit(0), 3, materialize).labels.count() == 0


# sources, sinks, streams --------------------------------------------------------


def test_readers(spark, tmp_path, rows):
    (tmp_path / "r.json").write_text('{"review_id": "r", "user_id": "u", "stars": 4, "date": "2018-01-02 03:04:05", "more": 1}\n')
    got = readers.read_json_lines(spark, str(tmp_path / "r.json"), "review", ["user_id", "date"])
    assert rows(got) == [("u", dt.datetime(2018, 1, 2, 3, 4, 5))]
    (tmp_path / "c.csv").write_text('user_id,business_id,stars\n"u, 1",b,2.5\n')
    assert rows(readers.read_csv(spark, str(tmp_path / "c.csv"), readers.CSV_SCHEMAS["ratings"])) == [("u, 1", "b", 2.5)]
    (tmp_path / "t.csv").write_text('"D","C","x","y","z","P"\n"11/1/2016","00012","","","","0007"\n')
    assert rows(readers.read_transactions(spark, str(tmp_path / "t.csv"))) == [("11/1/2016-12", 7)]
    (tmp_path / "i.csv").write_text("DATE-CUSTOMER_ID,PRODUCT_ID\n1/1/2017-1,5\n")
    assert rows(readers.read_intermediate(spark, str(tmp_path / "i.csv"))) == [("1/1/2017-1", 5)]
    (tmp_path / "p.txt").write_text("3,1,0.5,2\n\n4,0,1,2\n")
    assert rows(readers.read_points(spark, str(tmp_path / "p.txt"))) == [(3, 1, [0.5, 2.0]), (4, 0, [1.0, 2.0])]
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_json_lines(spark, str(tmp_path / "bad.json"), "review").collect()


def test_sinks(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('a, "b"', 1.0)], "city string, stars double").coalesce(1), str(tmp_path / "o"))
    with next((tmp_path / "o").glob("*.csv")).open() as file:
        assert list(csv.reader(file)) == [["city", "stars"], ['a, "b"', "1.0"]]
    sinks.write_json_document(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("*.txt")).read_text()) == {"a": 1, "b": None}
    report = sinks.itemset_report(spark.createDataFrame([(["b"], 1), (["a"], 2), (["a", "b"], 1)], "items array<string>, n int"))
    assert [tuple(r) for r in report.collect()] == [(1, "('a'),('b')"), (2, "('a', 'b')")]


def test_drawn_lines(spark, tmp_path):
    (tmp_path / "users.txt").write_text("u1\nu2\nu3\n")
    spark.dataSource.register(readers.DrawnLines)
    read = lambda: spark.readStream.format("drawn_lines").option("path", str(tmp_path / "users.txt")).option("size", 5).option("batches", 3).option("seed", 2).load()
    query = read().writeStream.format("memory").queryName("drawn").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM drawn").collect())
    assert [r[:2] for r in got] == [(i, i // 5) for i in range(15)] and {r[2] for r in got} <= {"u1", "u2", "u3"}


def test_streams_equal_the_set_form(spark, tmp_path, rows):
    from tessera.streaming import sketches

    draw = random.Random(6)
    data = spark.createDataFrame([(i, draw.choice([f"k{j}" for j in range(90)])) for i in range(400)], "event_id bigint, user_id string")
    data.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    batch = sketch.count_batches(data, "event_id", "user_id", 50)
    stream = lambda: sketches.stream_of(spark, str(tmp_path), "events", "event_id", "user_id", 50)
    family = hashing.hash_family(40, 9, hashing.SKETCH_MODULUS)
    assert rows(sketches.bloom_rates(stream(), 97)) == rows(sketch.bloom_rates(batch, 97))
    assert rows(sketches.estimates(stream(), family)) == rows(sketch.distinct_estimates(sketch.trailing_zeros(batch, family)))
    assert rows(sketches.distinct_counts(stream())) == rows(sketch.distinct_per_batch(batch))
    assert rows(sketches.reservoir(stream(), 50, 1)) == rows(sketch.reservoir(batch, 50, 1))
