"""Sizes, rounds and features that the queries once cut."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import features, graph, itemsets, learning, nested, recommend, trees
from lodestone.plans import mining


def test_pairs_with_one_user_in_common(spark, tmp_path):
    sets = {"a": {"u1"}, "b": {"u1"}, "c": {"u1", "u2", "u3"}, "d": {"u2", "u3"}, "e": {"u9"}}
    rated = spark.createDataFrame([(u, b, 1.0 + len(b + u) + int(u[1:]) % 2) for b, s in sets.items() for u in s], "user_id string, business_id string, stars double")
    rated.write.parquet(str(tmp_path / "yelp_train.parquet"))
    want = {(x, y): round(len(sets[x] & sets[y]) / len(sets[x] | sets[y]), 6) for x, y in combinations(sorted(sets), 2) if sets[x] & sets[y]}
    assert {(r.record_1, r.record_2): r.similarity for r in mining.QUERIES["jaccard_overlaps"](spark, str(tmp_path)).collect()} == want and want["a", "b"] == 1.0
    assert {(r.item_1, r.item_2) for r in mining.QUERIES["pearson_overlaps"](spark, str(tmp_path)).collect()} == {*want}


def test_itemsets_of_any_size(spark, tmp_path):
    rng = random.Random(8)
    sets = {f"g{k}": {f"i{rng.randrange(6)}" for _ in range(rng.randrange(1, 16))} for k in range(90)}
    spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "user_id string, business_id string").write.parquet(str(tmp_path / "ub_sample_data.parquet"))
    tally = Counter(c for s in sets.values() for k in range(1, len(s) + 1) for c in combinations(sorted(s), k))
    want = {"|".join(c): n for c, n in tally.items()}
    assert max(len(c) for c in tally) == 6
    run = lambda name: mining.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.itemset: r.n for r in run("itemset_son")} == {r.itemset: r.n for r in run("fpgrowth_itemsets")} == want
    assert {r.itemset for r in run("itemset_candidates")} >= {*want} and any(r.value.count("i") >= 4 for r in run("itemset_lines") if r.value.startswith("('i0', 'i1', 'i2', 'i3')"))
    assert {r.itemset for r in run("itemset_triples")} == {x for x in want if x.count("|") == 2}
    b = itemsets.baskets(spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "g string, i string"), "g", "i")
    deep = {c: n for c, n in tally.items() if n >= 18}
    assert max(map(len, deep)) >= 4 and {tuple(r["items"]): r.n for r in itemsets.frequent_itemsets(b, 0.2).collect()} == deep
    cut = itemsets.counted(b, itemsets.candidate_itemsets(b, 18, 90, chunk=20)).where("n >= 18")
    assert {tuple(r["items"]): r.n for r in cut.collect()} == deep


def test_models_have_the_rounds_and_features_of_the_reference(spark, monkeypatch):
    asked = {}

    def told(kind, rounds):
        make = getattr(learning, kind)
        monkeypatch.setattr(learning, kind, lambda **x: asked.setdefault(kind, set()).add(x[rounds]) or make(**x | {rounds: 2}))

    told("GBTRegressor", "maxIter"), told("RandomForestRegressor", "numTrees")
    boosted = learning.boosted
    monkeypatch.setattr(learning, "boosted", lambda train, test, columns, **x: asked.update(columns=columns) or boosted(train, test, columns, **x))
    n = mining.QUERIES["model_predict"](spark, "/root/testdata/sf0.001").count()
    assert n and asked == {"columns": [*learning.INDEXED], "GBTRegressor": {100}} and len(learning.INDEXED) == 7
    asked.clear()
    assert mining.QUERIES["stacking"](spark, "/root/testdata/sf0.001").count() == n and asked == {"GBTRegressor": {200}, "RandomForestRegressor": {100}}


def test_indices_of_users_and_businesses(spark):
    rated = spark.createDataFrame([("u3", "b2"), ("u1", "b1")], "user string, item string")
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "user_id string")
    asked = spark.createDataFrame([("u3", "b1"), ("u2", "b2"), ("new", "b9")], "user string, item string")
    got = {(r.user, r.item): (r.user_idx, r.business_idx) for r in features.indexed(asked, rated, users).collect()}
    assert got == {("u3", "b1"): (2.0, 0.0), ("u2", "b2"): (1.0, 1.0), ("new", "b9"): (-1.0, -1.0)}


def test_walks_made_of_joins_have_no_level_cap(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "d"), ("e", "f")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = lambda **x: {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(df, **x).collect()}
    assert got(broadcast_bytes=0) == pytest.approx(got())
    in_parts = {(r.src, r.dst): r.betweenness for r in graph.betweenness_by_joins(df, rows_at_once=30).collect()}
    assert in_parts == pytest.approx(got())
    path = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(7)], "src string, dst string")
    assert {r.src: r.betweenness for r in graph.betweenness_by_joins(path).collect()} == {f"p{k}": (k + 1) * (7 - k) for k in range(7)}


def test_many_member_names_give_tables_for_all(spark):
    df = spark.createDataFrame([("r1", {"Hours": "{'m': {'open': 1}, 't': [2, {'x': 3}]}", "a": "1"}), ("r2", {"b": "{'m': 4}"})], "id string, attributes map<string,string>")
    paths = lambda rows: sorted((r.record_id, r.node_path) for r in nested.node_paths(rows).collect())
    want = paths(nested.flatten(df, "id", "attributes"))
    few = nested.flatten(df, "id", "attributes", max_elements=3)
    assert paths(few) == want and len(want) == 10
    keys = {(r.record_id, r.row_path) for r in few.collect()}
    assert all((r.record_id, r.parent_path) in keys or r.parent_path in ("", None) for r in few.collect())


def test_bloom_over_more_ids_than_the_fold_has(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.lit("x").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    new = mining.QUERIES["bloom_fpr_ids"](spark, str(tmp_path)).agg(F.sum("n_new"), F.sum("n_false")).first()
    assert new[0] == 40_000 and new[1] > 0


def shuffled(spark, run):
    """Records that the run's tasks write to shuffles."""
    none, store = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark.sparkContext._jsc.sc().statusStore()

    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = so_far()
    run()
    return so_far() - before


def test_weights_of_a_business_with_much_of_the_ratings(spark, tmp_path):
    n, partners = 2_000, 150
    hot = [(f"u{k:05}", "a hot one", 1.0 + k % 5) for k in range(n)]
    rated = hot + [(f"u{(7 * b + k) % n:05}", f"b{b:03}", 1.0 + (b + k) % 5) for b in range(partners) for k in range(3)]
    spark.createDataFrame(rated, "user_id string, business_id string, stars double").write.parquet(str(tmp_path / "yelp_train.parquet"))
    got, usual = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables that are not small
    try:
        assert shuffled(spark, lambda: got.extend(mining.QUERIES["pearson_pairs"](spark, str(tmp_path)).collect())) < 20 * len(rated)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert {r.item_2 for r in got if r.item_1 == "a hot one"} >= {f"b{b:03}" for b in range(partners)}


def test_weights_with_users_who_rate_much(spark):
    rng = random.Random(5)
    rated = spark.createDataFrame([(f"u{u}", f"b{b:02}", float(rng.randrange(1, 6))) for u in range(40) for b in range(25) if rng.random() < (0.9 if u < 4 else 0.06) for _ in range(1 + (b == u))], "user string, item string, stars double")
    for least in (1, 2, 3):
        want = {(r.item_1, r.item_2): r.weight for r in recommend.pearson_sharing(rated, least).collect()}
        got = {(r.item_1, r.item_2): r.weight for r in recommend.pearson_sharing(rated, least, most_items=10).collect()}
        assert got == pytest.approx(want) and want


def test_fits_take_a_task_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    for n, tasks in ((40_000, cores), (300, 1), (100_000 * cores + 1, cores + 1)):
        rows = learning.held(spark.range(0, n, 1, 7))
        sizes = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert rows.rdd.getNumPartitions() == tasks == len(sizes) and sum(sizes) == n and max(sizes) - min(sizes) <= 7
        rows.unpersist()


def ratings(n, seed):
    rng = random.Random(seed)
    return [(f"u{u}", f"b{b}", float(u % 3), float(b % 40), float((u * 7 + b) % 2), 3.0, min(5.0, max(1.0, 1.0 + u % 3 + (b % 40 > 20) + rng.choice([-1, 0, 1]))) if rng.random() < 0.95 else 1.0) for u, b in ((rng.randrange(50), rng.randrange(90)) for _ in range(n))]


RATED = "user string, item string, u_a double, b_b double, a_c double, a_d double, stars double"


def test_rounds_of_stacked_models_take_no_jobs(spark):
    rows = spark.createDataFrame(ratings(900, 1), RATED).persist()
    new = spark.createDataFrame(ratings(300, 2), RATED).persist()
    ever = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs

    def jobs(**x):
        before = ever()
        out = learning.stacked(rows, new.drop("stars"), ["u_a", "b_b", "a_c", "a_d"], ["user", "item"], **x).collect()
        return ever() - before, out

    (few, _), (many, got) = jobs(folds=3, trees=2, forest=3), jobs(folds=3, trees=25, forest=12)
    assert few == many < 60 and len(got) == 300
    (_, by_jobs) = jobs(folds=3, trees=25, forest=12, most_bytes=0)  # as where a task cannot hold the rows
    off = lambda out: (sum((p - s) ** 2 for p, s in zip(sorted_by(out), sorted_by(new.collect(), 6))) / 300) ** 0.5
    sorted_by = lambda out, k=2: [r[k] for r in sorted(out, key=lambda r: (r[0], r[1], r[k]))]
    assert off(got) == pytest.approx(off(by_jobs), rel=0.03) and off(got) < 1.0


def test_trees_grown_in_a_task_are_those_of_the_engine(spark):
    df = spark.createDataFrame(ratings(2_500, 3), RATED).withColumn("fold", F.lit(0)).coalesce(1).persist()
    columns = ["u_a", "b_b", "a_c", "a_d"]
    places = trees.Codes(trees.cuts(df, columns, 64))
    assert [len(e) for e in places.edges] == [2, 39, 1, 0]
    seen = df.toPandas()
    binned = places.binned([seen[c].to_numpy() for c in columns])
    assert (places.unpacked(places.packed(binned)) == binned).all()
    own = trees.boosted_trees(trees.Boosting(6, 4, 0.1), places.packed(binned), places, seen["stars"].to_numpy()).summed(binned)
    model = learning.GBTRegressor(labelCol="stars", maxIter=6, maxDepth=4, stepSize=0.1, maxBins=64, seed=1).fit(learning.assembled(df, columns))
    want = [r.prediction for r in model.transform(learning.assembled(df, columns)).collect()]
    assert own == pytest.approx(want)
    assert sum((own - seen["stars"]) ** 2) < 0.7 * sum((seen["stars"].mean() - seen["stars"]) ** 2)


def test_tallies_by_class_are_those_by_row():
    rng = np.random.default_rng(4)
    user, item = rng.integers(0, 40, (40, 5)), rng.integers(0, 9, (60, 9))
    u, i = rng.integers(0, 40, 5_000), rng.integers(0, 60, 5_000)
    binned, y = np.concatenate([user[u], item[i]], 1).T.astype(np.uint16), rng.random(5_000)
    places = trees.Codes([np.arange(39.0)] * 5 + [np.arange(8.0)] * 9, ["u"] * 5 + ["i"] * 9)
    codes = places.packed(binned)
    classes = places.classes(codes)
    assert len(places.sides) == 2 and {c[1].shape[1] for c in classes} == {40, 60}
    for at in (None, np.flatnonzero(u % 3 == 1), np.flatnonzero(u == 3)):
        rows = slice(None) if at is None else at
        want = [[np.bincount(f[rows], w[rows], places.width) for f in binned] for w in (y, np.ones(5_000))]
        for how in (None, classes):
            got = places.tallied(codes, at, y, None, classes=how)
            assert got[0] == pytest.approx(np.array(want[0])) and (got[1] == np.array(want[1])).all()


def test_bins_of_values_that_most_rows_share(spark):
    df = spark.createDataFrame([(0.0 if k % 4 else float(k), float(k % 3)) for k in range(4_000)] + [(float("nan"), 1.0)], "a double, b double")
    many, few = trees.cuts(df, ["a", "b"], 16)
    assert 12 <= len(many) <= 15 and (many[1:] > many[:-1]).all() and list(few) == [0.5, 1.5]
