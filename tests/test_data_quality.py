"""Orphan references and heavy keys against naive Python."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.keys import clean_key, month_name, month_number
from tessera.operators.bitmaps import LIST_LIMIT, Bitmap
from tessera.operators.heavy_keys import heavy_keys, key_profile
from tessera.operators.orphans import Parent, Reference, orphan_references

BLANKS = " \t\r\n"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000)), st.sets(st.integers(0, 300_000)))
def test_bitmap_difference(a, b):
    left = Bitmap(np.array(sorted(a), np.int64)).and_not(Bitmap(np.array(sorted(b), np.int64)))
    assert left.codes().tolist() == sorted(a - b)


@pytest.mark.parametrize("dense_a", [True, False])
@pytest.mark.parametrize("dense_b", [True, False])
def test_bitmap_container_kinds(dense_a, dense_b):
    draw = random.Random(1)
    a, b = (set(draw.sample(range(65536, 131072), LIST_LIMIT * 3 if dense else 100)) for dense in (dense_a, dense_b))
    assert Bitmap(np.array(list(a))).and_not(Bitmap(np.array(list(b)))).codes().tolist() == sorted(a - b)


def naive_orphans(references, parents):
    found = set()
    for table, field, rows, parent in references:
        by_key = defaultdict(list)
        for key, since, until in parents[parent]:
            if key and key.strip(BLANKS) and since:
                by_key[key.strip(BLANKS)].append((since, until))
        for record, key, at in rows:
            key = (key or "").strip(BLANKS)
            if not key:
                continue
            held = by_key.get(key)
            if not held:
                reason = "missing"
            elif at is None or any(s <= at and (u is None or u > at) for s, u in held):
                continue
            else:
                reason = "late" if all(s > at for s, _ in held) else "deleted"
            found.add((table, field, record, reason, at and at.strftime("%Y-%m")))
    return found


def make(spark, rows, names):
    types = ", ".join(f"{n} {'timestamp_ntz' if n.endswith('_at') else 'string'}" for n in names)
    return spark.createDataFrame(rows, types)


def test_orphans_against_naive(spark):
    draw = random.Random(3)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=draw.choice([0, 0, 7]), days=draw.randrange(120))
    keys = [f"k{i}" for i in range(30)]
    parent = []
    for key in keys[:25]:
        for _ in range(draw.choice([1, 1, 2, 4])):
            since = day()
            until = since + dt.timedelta(days=draw.randrange(0, 60)) if draw.random() < 0.6 else None
            parent.append((f" {key}\n" if draw.random() < 0.3 else key, since, until))
    parent += [parent[0], (None, day(), None), ("  ", day(), None), ("k3", None, None)]
    rows = [(f"r{i}", draw.choice([*keys, "k1", "k1", "k1", " k2\t", "K3", "", None, "\r\n"]), day() if draw.random() < 0.95 else None) for i in range(600)]
    rows += rows[:20]
    other = [(f"t{i}", draw.choice(keys), day()) for i in range(50)]
    p = make(spark, parent, ["id", "loaded_at", "removed_at"]).withColumn("key", F.lit("clash"))
    r = make(spark, rows, ["record", "ref", "loaded_at"]).withColumn("since", F.lit(1)).withColumn("reason", F.lit("clash"))
    t = make(spark, other, ["record", "ref", "loaded_at"])
    found = orphan_references([Reference("r", r, "ref", "record", "p"), Reference("t", t, "ref", "record", "p")], [Parent("p", p, "id")])
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == naive_orphans([("r", "ref", rows, "p"), ("t", "ref", other, "p")], {"p": parent})
    assert {x[3] for x in got} == {"missing", "late", "deleted"}


def test_orphans_of_empty_tables(spark):
    empty_parent = make(spark, [], ["id", "loaded_at", "removed_at"])
    rows = make(spark, [("a", "x", dt.datetime(2020, 1, 1))], ["record", "ref", "loaded_at"])
    reference = lambda df: [Reference("r", df, "ref", "record", "p")]
    assert [tuple(x) for x in orphan_references(reference(rows), [Parent("p", empty_parent, "id")]).collect()] == [("r", "ref", "a", "missing", "2020-01")]
    assert orphan_references(reference(rows.limit(0)), [Parent("p", empty_parent, "id")]).count() == 0


def test_months(spark):
    df = spark.createDataFrame([(dt.datetime(1999, 12, 31, 23, 59),), (dt.datetime(2000, 1, 1),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(month_name(month_number(F.col("t")))).collect()] == ["1999-12", "2000-01"]


def test_profile_against_naive(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a"] * 50 + ["b", "c", " b ", "", None, "z\n"]), draw.choice([1.0, 2.0, 2.5, 99.0, None])) for _ in range(700)]
    rows += [("only null", None), ("one", -3.5)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("weight", F.lit(1))
    groups = defaultdict(list)
    for key, value in rows:
        if (key or "").strip(BLANKS):
            groups[key.strip(BLANKS)].append(value)
    for r in key_profile(df, {"k": clean_key("k")}, F.col("v")).collect():
        values = groups.pop(r["key_value"])
        known = sorted(v for v in values if v is not None)
        assert (r["field"], r["n_rows"], r["n_values"]) == ("k", len(values), len(set(known)))
        if known:
            assert r["mode"] == min(Counter(known).items(), key=lambda x: (-x[1], x[0]))[0]
            at = lambda p: known[max(0, -(-len(known) * p // 100) - 1)]
            assert (r["p25"], r["p50"], r["p75"]) == (at(25), at(50), at(75))
        else:
            assert r["mode"] is None and r["p50"] is None
    assert not groups


def test_percentiles_of_many_values(spark):
    draw = random.Random(6)
    rows = [("k", float(draw.randrange(5000))) for _ in range(4000)]
    r = key_profile(spark.createDataFrame(rows, "k string, v double"), {"k": F.col("k")}, F.col("v"), (0.1, 0.5)).first()
    known = sorted(v for _, v in rows)
    assert (r["p10"], r["p50"]) == (known[399], known[1999])


def test_heavy_keys_count_all_rows(spark, rows):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [(None, 1.0)] * 5 + [("b", None)] * 2 + [(" b", 2.0)] * 3, "k string, v double")
    found = heavy_keys(df, {"k": clean_key("k")}, F.col("v"), 0.25)
    assert rows(found) == [("k", "a", 10), ("k", "b", 5)]
    assert rows(heavy_keys(df, {"k": clean_key("k")}, F.col("v"), 0.26)) == [("k", "a", 10)]
    assert heavy_keys(df.limit(0), {"k": clean_key("k")}, F.col("v"), 0.02).count() == 0


def test_compression_plan_has_map_side_combine(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    plan = heavy_keys(df, {"k": F.col("k")}, F.col("v"), 0.02)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "Cartesian" not in plan
