"""Hot keys, packed fields and nested records."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import hotkeys, nested, packed

REVIEW = "review_id long, user_id string, business_id string, stars double, ingested_at timestamp, key_id string, field_name string"


def reviews(spark, n=600):
    """A third of the rows in one key, nulls in any column, copies, and columns named as the operator's own."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        b = "hot" if i % 3 == 0 else rng.choice(["b1", "b2", None, ""])
        out.append((i, rng.choice(["u1", "u2", None]), b, rng.choice([1.0, 4.5, None]), f"2024-01-01 00:00:{i % 60:02d}", "x", None))
    out += [(*r[:4], "2024-02-01 00:00:00", "y", "z") for r in out[::10]] + [(None, "u1", "hot", 1.0, None, None, None)]
    return out, spark.createDataFrame(out, REVIEW.replace("timestamp", "string")).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def states(df):
    return hotkeys.key_states(hotkeys.latest_records(df, "review_id", ["user_id", "business_id", "stars"], "ingested_at"), ["business_id", "user_id"], "stars")


def test_key_averages_are_complete(spark):
    raw, df = reviews(spark)
    own = raw[:600]
    got = {(r.field_name, r.key_id): (r.n_records, r.avg_value) for r in hotkeys.key_averages(states(df)).collect()}
    for field, at in (("user_id", 1), ("business_id", 2)):
        for key, n in Counter(r[at] for r in own if r[at] is not None).items():
            stars = [r[3] for r in own if r[at] == key and r[3] is not None]
            assert got.pop((field, key)) == (n, pytest.approx(sum(stars) / len(stars)))
    assert not got


def test_heavy_keys_bound_is_kept(spark, rows):
    _, df = reviews(spark)
    s = states(df)
    assert ("business_id", "hot", 200) in rows(hotkeys.heavy_keys(s, 1 / 3 - 1e-9))
    assert rows(hotkeys.heavy_keys(s, 0.5)) == []
    one = spark.createDataFrame([(i, "a" if i < 3 else f"k{i}", None, 1.0, None, None, None) for i in range(100)], REVIEW)
    assert rows(hotkeys.heavy_keys(states(one), 0.03)) == [("user_id", "a", 3)]


def test_latest_delivery_wins_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "old", "b", 1.0, "2024-01-01"), (1, "new", "b", 2.0, "2024-01-02")], "review_id long, user_id string, business_id string, stars double, at string")
    assert rows(hotkeys.latest_records(df, "review_id", ["user_id", "stars"], "at")) == [(1, "new", 2.0)]
    empty = spark.createDataFrame([], REVIEW)
    assert rows(states(empty)) == [] and rows(hotkeys.heavy_keys(states(empty), 0.03)) == [] and rows(hotkeys.key_averages(states(empty))) == []


PACKED = [
    ("Bars, Food", ["Bars", "Food"]),
    ("Bars ,Food|Vegan ; Soup", ["Bars", "Food", "Vegan", "Soup"]),
    (' Tailors,"Wine, Beer & Spirits"', ["Tailors", "Wine, Beer & Spirits"]),
    ('"Bars | Lounges" \nSoup\tTea', ["Bars | Lounges", "Soup", "Tea"]),
    ('Bars, "Mom ""n"" Pop", Bars', ["Bars", 'Mom "n" Pop', "Bars"]),
    ('["Kids\' Activities", "Cr\\u00eaperies", "a \\"b\\" c"]', ["Kids' Activities", "Crêperies", 'a "b" c']),
    ("['Bars | Lounges', \"Kids' Activities\", 'it\\'s']", ["Bars | Lounges", "Kids' Activities", "it's"]),
    ("[u'a', u'b']", ["a", "b"]),
    (";Bars;;Food; ", ["Bars", "Food"]),
    ("甲、乙，丙", ["甲", "乙", "丙"]),
    ("24/7 Gyms", ["24/7 Gyms"]),
    ('"Nightlife"', ["Nightlife"]),
    ('["Open, end", "x', ["Open, end", '"x']),
    ("None", ["None"]), ("", []), ("  \n", []), (None, []), (", ; |", []), ("[]", []), ('""', []),
    ("x" * 200_000 + ",y", ["x" * 200_000, "y"]), ("a" + " " * 300_000 + "b,c", ["a" + " " * 300_000 + "b", "c"]), ('"' * 100_001 + ",", None), ("a," * 50_000, ["a"] * 50_000),
]


def test_unpack(spark):
    df = spark.createDataFrame([(str(i), t, "clash", "clash") for i, (t, _) in enumerate(PACKED)], "id string, packed string, item string, rule string")
    got: dict = {}
    for r in packed.unpack(df, "id", "packed").collect():
        got.setdefault(r.record_id, {})[r.pos] = r["item"]
    for i, (text, want) in enumerate(PACKED):
        own = got.get(str(i), {})
        assert want is None or [own[k] for k in range(len(own))] == want, text and text[:60]
    assert packed.unpack(df.limit(0), "id", "packed").count() == 0


def test_unpack_nothing_and_repeats(spark, rows):
    df = spark.createDataFrame([("a", "None"), ("b", " None "), ("c", "x"), ("c", "x"), (None, "y")], "id string, packed string")
    assert rows(packed.unpack(df, "id", "packed", nothing=("None",))) == sorted([("c", 0, "x"), ("c", 0, "x"), (None, 0, "y")], key=repr)


BLANK_PARTED = [
    ("a b  c", ["a", "b", "c"]), ("a, b c;d", ["a", "b", "c", "d"]), ('"a" "b"', ["a", "b"]), ('"a", "b c"|d', ["a", "b c", "d"]), ("a \n b\tc\u3000d", ["a", "b", "c", "d"]),
    ("['a', 'b']", ["a", "b"]), ('"a""x" b', ['a"x', "b"]), (" ", []), ("None", []),
]


def test_unpack_blank_parted(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(BLANK_PARTED)], "id string, packed string")
    got: dict = {}
    for r in packed.unpack(df, "id", "packed", nothing=("None",), blanks=True).collect():
        got.setdefault(r.record_id, {})[r.pos] = r["item"]
    assert [[got.get(str(i), {})[k] for k in sorted(got.get(str(i), {}))] for i in range(len(BLANK_PARTED))] == [w for _, w in BLANK_PARTED]


def test_skeletons_with_and_without_quotes_agree(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab,;|、，\n\t \u3000") for _ in range(rng.randrange(1, 9))).strip() for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts if t], "t string")
    for blanks in (False, True):
        for r in df.select("t", packed.skeleton(F.col("t"), blanks).alias("s"), packed.skeleton(F.concat(F.col("t"), F.lit('x"')), blanks).alias("q")).collect():
            assert r.q == r.s + '"', r


def test_rules_are_resolved_per_skeleton(spark):
    df = spark.createDataFrame([("a, b",), ('"a; b", c',), ("['a']",), ("a",), ("a|b;c",)], "t string").select(packed.skeleton(F.col("t")).alias("skeleton"))
    assert [r.skeleton for r in df.collect()] == [",", ',"', "[", "", ";|"]
    rules = {r.skeleton: r.pattern for r in packed.splitting_rules(df).collect()}
    assert rules[","] == "[^,]++" and rules[',"'].endswith("(?=[,]|$)|[^,]++") and rules[";|"] == "[^;|]++"


NESTED = [
    ({"A": "True"}, ["A"]),
    ({"A": "None", "B": None}, []),
    ({"A": "{'x': {'y': [1, None, {'z': u'q'}]}, 'n': None}"}, ["A", "A.x", "A.x.y", "A.x.y[0]", "A.x.y[2]", "A.x.y[2].z"]),
    ({"A": '"{\\"dj\\": false, \\"e\\": []}"'}, ["A", "A.dj", "A.e"]),
    ({"A": '{"p": "{\'k\': True}", "m": "[damaged"}'}, ["A", "A.p", "A.p.k", "A.m"]),
    ({"A": "{'x': true, \"y\": None, 'z': [1, 2,]}"}, ["A", "A.x", "A.z", "A.z[0]", "A.z[1]"]),
    ({"A": "{'x': 1, 'y"}, ["A"]),
    ({"A": "{}", "B": "[]", "C": "[{}]"}, ["A", "B", "C", "C[0]"]),
    ({"A": "u'no'", "B": ""}, ["A", "B"]),
    ({"A": "[" * 3_000 + "]" * 3_000}, None),
    ({}, []), (None, []),
]


def test_flatten_paths(spark):
    df = spark.createDataFrame([(str(i), a, "clash") for i, (a, _) in enumerate(NESTED)], "id string, attributes map<string,string>, record_id string")
    got: dict = {}
    for r in nested.node_paths(nested.flatten(df, "id", "attributes")).collect():
        got.setdefault(r.record_id, []).append(r.node_path)
    for i, (_, want) in enumerate(NESTED):
        if want is not None:
            assert sorted(got.get(str(i), [])) == sorted(want)
    assert nested.flatten(df.limit(0), "id", "attributes").count() == 0


def test_rows_link_to_their_parents(spark):
    hours = json.dumps([{"day": "mon", "slots": [{"open": 8}, {"open": 9}]}, {"day": "tue"}])
    df = spark.createDataFrame([("r", {"Hours": hours, "Desk": json.dumps({"hours": [{"day": "sun"}]}), "A": "1", "B": "{'c': 2}"}), ("s", {"Hours": "[1]"}), ("t", {"A": "None"})], "id string, attributes map<string,string>")
    out = nested.flatten(df, "id", "attributes").collect()
    keys = [(r.record_id, r.table_name, r.row_path) for r in out]
    assert len(set(keys)) == len(keys) == len({(k[0], k[2]) for k in keys})
    assert all((r.record_id, r.parent_table, r.parent_path) in keys for r in out if r.table_name != nested.ROOT)
    record = {r.record_id: r["columns"] for r in out if r.table_name == nested.ROOT}
    assert record == {"r": {"A": "1", "B": None, "B.c": "2", "Hours": None, "Desk": None, "Desk.hours": None}, "s": {"Hours": None}}
    assert {r.row_path for r in out if r.table_name == "slots[]"} == {"Hours[0].slots[0]", "Hours[0].slots[1]"}
    assert {r.table_name for r in out} >= {nested.ROOT, "Hours[]", "slots[]", "day"}  # day is shared by two elements
    tables = nested.flat_tables(df, "id", "attributes")
    assert sorted(r.open for r in tables["slots[]"].collect()) == ["8", "9"]
    assert {(r.record_id, r["B.c"], r.A) for r in tables[nested.ROOT].select("record_id", "`B.c`", "A").collect()} == {("r", "2", "1"), ("s", None, None)}
    assert [r.value for r in tables["Hours[]"].collect() if r.record_id == "s"] == ["1"]


def test_names_with_dots_lose_nothing(spark, rows):
    text = json.dumps({"a.b": 1, "a": {"b": 2}, "c[0]": 3, "c": [4], "@record": {"x\\": 5}, "": 6})
    df = spark.createDataFrame([("r", {"A": text, "A.a": "7"})], "id string, attributes map<string,string>")
    out = nested.flatten(df, "id", "attributes")
    values = [v for r in out.collect() for v in r["columns"].values() if v is not None]
    assert sorted(values) == ["1", "2", "3", "4", "5", "6", "7"]
    assert rows(nested.node_paths(out)) == sorted([("r", p) for p in ("A", "A.a.b", "A.a", "A.c[0]", "A.c", "A.@record", "A.@record.x\\", "A.")])


def test_recursive_elements_get_a_table():
    graph = [(nested.ROOT, "a"), ("a", "b"), ("b", "a"), ("a", "c")]
    assert nested.tabled(graph) == {nested.ROOT, "a", "b"}
