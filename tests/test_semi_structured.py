"""Packed and nested fields."""

import ast
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.multi_value import packed_values, split_array
from tessera.operators.nested import flatten, map_entries, open_deep, opened, parse
from tessera.plans.semi_structured import DELIMITERS

CATEGORIES = [
    ("A, B", ["A", "B"]), (" A ,B\t", ["A", "B"]), ("A|B; C/D", ["A", "B", "C", "D"]), ('"A, x", B', ["A, x", "B"]), ('"Bar ""Old"", x"; B', ['Bar "Old", x', "B"]),
    ('["A", "B; c"]', ["A", "B; c"]), ("['A', \"Kids' x, y\"]", ["A", "Kids' x, y"]), ('["say \\"hi\\"", "b"]', ['say "hi"', "b"]), ("[u'A', u'B']", ["A", "B"]),
    ("Kids' A, Men's B", ["Kids' A", "Men's B"]), (",A,,B,", ["A", "B"]), ('"A"', ["A"]), ('"A",', ["A"]), ("Bed & Breakfast", ["Bed & Breakfast"]),
    ("None", []), ("none", []), ("N/A", []), ("[]", []), ("-", []), ("", []), ("   ", []), (None, []), ("['None']", []), ("Café|Crêperies", ["Café", "Crêperies"]), ("A,A", ["A", "A"]),
    ('5" pipes, Tools, Food', ['5" pipes', "Tools", "Food"]), ("[Men's Clothing, Food, Bars]", ["Men's Clothing", "Food", "Bars"]), ('5" , 6"', ['5"', '6"']), ('"A, x", 5" pipe, "B; y"', ["A, x", '5" pipe', "B; y"]),
    ('"open, never', ['"open, never']), ('a "b, c" d, e', ['a "b', 'c" d', "e"]), ('"a""b, c", d', ['a"b, c', "d"]), ("[it's, 'a, b', \"c, d\"]", ["it's", "a, b", "c, d"]), ('""', []),
    ('["Caf\\u00e9"]', ["Café"]), ("A,  B ", ["A", "B"]), (",,;", []), ("['it\\'s', \"b\"]", ["it's", "b"]), ('"a" "b", c', ['a" "b', "c"]),
]


def test_packed_forms():
    got = split_array(pa.array([t for t, _ in CATEGORIES], pa.string()), DELIMITERS["categories"]).to_pylist()
    for (text, wanted), values in zip(CATEGORIES, got, strict=True):
        assert values == wanted, text


def test_sliced_and_empty_batches():
    whole = pa.array([t for t, _ in CATEGORIES], pa.string())
    for start, length in ((3, 5), (0, 0), (20, 3)):
        assert split_array(whole.slice(start, length), DELIMITERS["categories"]).to_pylist() == [v for _, v in CATEGORIES[start : start + length]]


def test_ids_and_years():
    assert split_array(pa.array(["2010&2011/2012 2013", '"2010","2011"', "2010\n2011"]), DELIMITERS["elite"]).to_pylist() == [["2010", "2011", "2012", "2013"], ["2010", "2011"], ["2010", "2011"]]
    assert split_array(pa.array(["a-_ b\nc|d,, e"]), DELIMITERS["friends"]).to_pylist() == [["a-_", "b", "c", "d", "e"]]


_word = st.text(st.characters(codec="utf-8", exclude_characters="[]{}()\x00", exclude_categories=("Cs", "Cc", "Zs", "Zl", "Zp")), min_size=1, max_size=6).map(lambda s: "x" + s + "y")


@settings(max_examples=80, deadline=None)
@given(st.lists(_word, min_size=1, max_size=6))
def test_json_and_python_lists_round_trip(values):
    texts = [json.dumps(values), json.dumps(values, ensure_ascii=False), repr(values)]
    for got in split_array(pa.array(texts), ",;|/\t\r\n").to_pylist():
        assert got == values


@settings(max_examples=80, deadline=None)
@given(st.lists(_word, min_size=1, max_size=6), st.sampled_from([",", "; ", "|", " / ", "\t"]))
def test_quoted_fields_round_trip(values, delimiter):
    text = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_array(pa.array([text]), ",;|/\t\r\n").to_pylist() == [values]


def test_very_long_field(spark):
    text = ",".join(f'"v, {i}"' for i in range(50_000))
    df = spark.createDataFrame([("a", text), ("b", None), (None, "x,y")], "id string, f string").withColumn("pos", F.lit(1)).withColumn("value", F.lit("clash"))
    got = packed_values(df, F.col("id"), F.col("f"), ",")
    assert got.where("record_id = 'a'").count() == 50_000
    assert got.where("record_id = 'a' and pos = 49999").first()["value"] == "v, 49998"
    assert sorted(tuple(r) for r in got.where("record_id is null").collect()) == [(None, 1, "x"), (None, 2, "y")]


@pytest.mark.parametrize("text", ["{'a': [1, 2.5, -3e2, None, True], 'b': {}}", "[u'x', \"it's\", 'q\\'q', '\\u00e9\\x41\\n']", "{}", "[]", "[[], {}]", "{'a': {'b': {'c': []}}}"])
def test_python_literals(text):
    assert parse(text) == ast.literal_eval(text)


@pytest.mark.parametrize("text", ["{'a': 1", "[1, 2,, 3]", "{'a' 1}", "{1: 2}", "[1 2]", "{'a': 1}}", "{21plus}", "[true] x", "['a'", "", "[,]", "{'a':}", "{'a': 1,, 'b': 2}"])
def test_damaged_texts_stay(text):
    assert opened(text) == text


def test_wrapped_texts_are_opened():
    inner = {"a": [1, {"b": None}]}
    text = json.dumps(inner)
    for wrapped in (text, json.dumps(text), json.dumps(json.dumps(text)), repr(text), "u" + repr(text), f"  {text}\n", json.dumps(repr(inner))):
        assert opened(wrapped) == inner
    assert opened('"quiet"') == '"quiet"' and opened("u'loud'") == "u'loud'"
    assert open_deep(json.dumps({"n": "{'t': 'x', 'g': ['y']}"})) == ({"n": {"t": "x", "g": ["y"]}}, 3)


_json = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(st.characters(codec="ascii", exclude_characters="{}[]\x00"), max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


def naive_paths(value, path):
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in naive_paths(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in naive_paths(v, f"{path}.{i}")]
    return [path]


@settings(max_examples=60, deadline=None)
@given(_json)
def test_parser_reads_what_python_and_json_write(value):
    assert parse(json.dumps(value)) == value
    assert parse(repr(value)) == value


def test_flat_tables(spark):
    values = {
        "w": "plain", "n": None, "e": "", "o": '{"x": {"y": [1, [2, 3], {"z": null}]}, "q": {}}', "p": "[{'a': 'b.c', 'k': u'v'}, []]", "d": "{'a': 1", "dup": '{"a": 1, "a": {"b": 2}}',
        "nan": '{"v": NaN, "w": 1e999, "big": 123456789012345678901234567890123456789012345}', "deep": "[" * 12 + "7" + "]" * 12, "lone": '{"s": "\\ud800"}',
    }
    df = spark.createDataFrame([("b1", values), ("b1", values), ("b2", None), ("b3", {}), (None, {"k": "[1]"})], "id string, m map<string, string>").withColumn("path", F.lit("clash"))
    counts = spark.createDataFrame([("b1", {"Mon-1": 0, "Tue-2": None})], "id string, t map<string, bigint>")
    tables = flatten(map_entries(df, "id", ["m"]).unionByName(map_entries(counts, "id", ["t"])).distinct())
    got = sorted((r["root"], r["path"]) for r in tables.leaves.where("record_id = 'b1'").collect())
    wanted = [("t", "Mon-1"), ("t", "Tue-2")]
    for key, text in values.items():
        wanted += [("m", p) for p in naive_paths(None if text is None else open_deep(text)[0], key)]
    assert got == sorted(wanted)
    assert [r["path"] for r in tables.leaves.where("record_id is null").collect()] == ["k.0"]
    # every row of a child table stands in a row of the level above
    nodes = tables.nodes.where("record_id = 'b1'").collect()
    for r in nodes:
        if r["level"]:
            assert any(p["row_key"] == r["parent_key"] and p["level"] == r["level"] - 1 for p in nodes)
    z = next(r for r in nodes if r["path"] == "o.x.y.2.z")
    assert (z["level"], z["ordinal"], z["kind"], z["pattern"]) == (1, 2, "leaf", "o.x.y.[].z")
    leaf = next(r for r in nodes if r["path"] == "p.0.a")
    assert leaf["value"] == "b.c"
    kinds = {(r["pattern"], r["kind"]) for r in tables.schema.collect()}
    assert {("o.x.y.[]", "leaf"), ("o.x.y.[]", "array"), ("o.x.y.[]", "object"), ("o.q", "object")} <= kinds
    assert tables.table(2).where("column = 'o.x.y.[].[]'").count() == 2


def test_flatten_nothing(spark):
    df = spark.createDataFrame([], "id string, m map<string, string>")
    tables = flatten(map_entries(df, "id", ["m"]))
    assert tables.leaves.count() == 0 and tables.schema.count() == 0
    assert tables.paths.count() == 0 and tables.child("m", "k.[]").count() == 0


def test_child_table_of_an_array(spark):
    values = {"menu": "[{'dish': 'a', 'prices': [1, 2]}, {'dish': 'b', 'hot': True, 'prices': []}, 'closed', {}]", "other": "[{'dish': 'z'}]"}
    tables = flatten(map_entries(spark.createDataFrame([("b1", values), ("b2", {"menu": "[{'dish': 'c'}]"})], "id string, m map<string, string>"), "id", ["m"]))
    menu = tables.child("m", "menu.[]").orderBy("record_id", "ordinal").collect()
    assert [(r["record_id"], r["ordinal"], r["dish"], r["hot"], r["value"]) for r in menu] == [
        ("b1", 0, "a", None, None), ("b1", 1, "b", "true", None), ("b1", 2, None, None, "closed"), ("b1", 3, None, None, None), ("b2", 0, "c", None, None),
    ]
    prices = tables.child("m", "menu.[].prices.[]").orderBy("ordinal").collect()
    assert [(r["parent_key"], r["ordinal"], r["value"]) for r in prices] == [(menu[0]["row_key"], 0, "1"), (menu[0]["row_key"], 1, "2")]
    assert len({r["row_key"] for r in menu + prices}) == 7
    own = {r["record_id"]: r["row_key"] for r in tables.nodes.where("level = 0").select("record_id", "row_key").distinct().collect()}
    assert all(r["parent_key"] == own[r["record_id"]] for r in menu)


def test_any_depth_and_size(spark):
    deep = "[" * 5000 + "{'a': 1}" + "]" * 5000
    wide = "[" + ", ".join(f"'value {i:020}'" for i in range(1_700_000)) + "]"
    assert len(wide) > 50_000_000
    entries = spark.range(1).select(F.lit("b").alias("record_id"), F.lit("m").alias("root"), F.lit("deep").alias("key"), F.concat(F.repeat(F.lit("["), 5000), F.lit("{'a': 1}"), F.repeat(F.lit("]"), 5000)).alias("text"))
    wide_entry = spark.range(1).select(F.lit("b").alias("record_id"), F.lit("m").alias("root"), F.lit("wide").alias("key"), F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_699_999)), lambda i: F.concat(F.lit("'value "), F.lpad(i.cast("string"), 20, "0"), F.lit("'"))), ", "), F.lit("]")).alias("text"))
    assert entries.first()["text"] == deep
    tables = flatten(entries.unionByName(wide_entry))
    assert [r["path"] for r in tables.paths.where("path like 'deep%'").collect()] == ["deep" + ".0" * 5000 + ".a"]
    counted = tables.paths.where("path like 'wide%'").agg(F.count(F.lit(1)), F.count_distinct("path")).first()
    assert tuple(counted) == (1_700_000, 1_700_000)
