"""Exploration, itemsets, similarity, graphs, sketches, ratings, features, sources and sinks against small programs."""

import json
import random
from collections import Counter, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import exploration, features, graph, itemsets, learning, recommend, similarity, sketches
from lodestone.sinks import writers
from lodestone.sources import readers
from lodestone.streaming import micro


def test_exploration(spark, rows):
    r = spark.createDataFrame([("u1", "b1", 4.0, "2018-01-01"), ("u2", "b1", 2.0, "1/2/2018"), ("u1", "b9", 5.0, "2019"), (None, None, None, None)], "user_id string, business_id string, stars double, review_date string")
    b = spark.createDataFrame([("b1", "Ax"), ("b2", "By")], "business_id string, city string")
    assert rows(exploration.review_counts(r, "2018")) == [(4, 2, 3, 3)]
    assert [tuple(x) for x in exploration.top_keys(r, "user_id", 2).collect()] == [("u1", 2), ("u2", 1)]
    assert [tuple(x) for x in exploration.by_average(exploration.city_averages(r, b)).collect()] == [(None, 5.0), ("Ax", 3.0)]
    assert rows(exploration.partition_sizes(r.repartition(6, "user_id"), 6))[-1][0] == 5
    report = exploration.partition_report(r, "user_id", 5).collect()
    assert {k: sum(x.n_items for x in report if x.layout == k) for k in ("default", "customized")} == {"default": 4, "customized": 4}
    assert exploration.timed(r) >= 0
    m = exploration.compared_sorts(exploration.city_averages(r, b))
    assert m["m1"][1] == m["m2"][1] and min(m["m1"][0], m["m2"][0]) >= 0
    assert r.select(exploration.distinct_keys(r, "user_id").alias("n")).first().n == 3


def brute_itemsets(sets, support, longest):
    tally = Counter(c for s in sets for k in range(1, longest + 1) for c in combinations(sorted(s), k))
    return {c: n for c, n in tally.items() if n >= support}


def test_itemsets_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    data = [(f"g{k}", f"i{min(rng.randrange(9), rng.randrange(9))}") for k in range(120) for _ in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(data + data[:20] + [("g1", None), (None, "i1")], "g string, i string")
    sets: dict = {}
    for g, i in [*data, (None, "i1")]:
        sets.setdefault(g, set()).add(i)
    b = itemsets.baskets(df, "g", "i")
    want = brute_itemsets(sets.values(), 13, 3)
    assert itemsets.support_count(b, 0.1) == 13
    got = lambda x: {tuple(r["items"]): r.n for r in x.collect()}
    assert got(itemsets.frequent_itemsets(b, 0.1)) == want and len(want) > 15
    cut = itemsets.candidate_itemsets(b, 13, len(sets), 3, chunk=10)
    assert got(itemsets.counted(b, cut).where("n >= 13")) == want  # however the baskets are cut
    assert max(r.n_parts for r in cut.collect()) > 1 and {r.n_parts for r in itemsets.candidate_itemsets(b, 13, len(sets)).collect()} == {1}
    monkeypatch.setattr(itemsets, "broadcast_if_small", lambda t: t)
    assert got(itemsets.frequent_itemsets(b, 0.1)) == want
    report = [r.value for r in writers.itemset_report(cut.withColumn("size", F.size("items")), itemsets.frequent_itemsets(b, 0.1)).collect()]
    assert report[0] == "Candidates:" and report.count("Frequent Itemsets:") == 1 and len(report) == 2 * (1 + 2 * 3)
    pairs = {tuple(r["items"]) for r in itemsets.pairs_of(spark.createDataFrame([("b",), ("a",), ("c",)], "x string")).collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {k: n for k, n in got(itemsets.fpgrowth_itemsets(b, 0.1)).items() if len(k) <= 3} == want
    assert itemsets.frequent_itemsets(b.limit(0), 0.1).count() == 0
    assert {r.basket for r in itemsets.baskets(df, "g", "i", 3).collect()} == {g for g, s in sets.items() if len(s) > 3}
    lines = [r.value for r in writers.itemset_lines(itemsets.frequent_itemsets(b, 0.1, 2), "Frequent Itemsets:").collect()]
    assert lines[0] == "Frequent Itemsets:" and lines[1].startswith("('i0'),") and lines[2] == "" and lines[3].startswith("('i0', 'i1')")


def test_similarity(spark, rows):
    rng = random.Random(2)
    sets = {f"b{k}": {f"u{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))} for k in range(40)}
    df = spark.createDataFrame([(b, u) for b, s in sets.items() for u in s] * 2 + [(None, "u1"), ("b1", None)], "b string, u string")
    users = sorted({u for s in sets.values() for u in s})
    assert rows(similarity.ordinals(df, "u")) == sorted(((u, k) for k, u in enumerate(users)), key=repr)
    at, m = {u: k for k, u in enumerate(users)}, len(users)
    want = {b: tuple(min((a * at[u] + c) % similarity.PRIME % m for u in s) for a, c in similarity.hash_parameters(30)) for b, s in sets.items()}
    assert {r[0]: tuple(r)[1:] for r in similarity.signatures(df, "b", "u").collect()} == want
    jaccard = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    banded = {(x, y): jaccard(x, y) for x, y in combinations(sorted(sets), 2) if any(want[x][i : i + 2] == want[y][i : i + 2] for i in range(0, 30, 2))}
    got = {(r.record_1, r.record_2): r.similarity for r in similarity.lsh_pairs(df, "b", "u").collect()}
    assert got == pytest.approx({k: j for k, j in banded.items() if j >= 0.5})
    for least in (1, 2, 3, 5):
        shared = {(r[0], r[1]): r[2] for r in similarity.pairs_sharing(df, "b", "u", least).collect()}
        assert shared == {(x, y): len(sets[x] & sets[y]) for x, y in combinations(sorted(sets), 2) if len(sets[x] & sets[y]) >= least}
    for t in (0.2, 0.5, 0.8):
        close = {(r.record_1, r.record_2): r.similarity for r in similarity.similar_pairs(df, "b", "u", t).collect()}
        assert close == pytest.approx({(x, y): jaccard(x, y) for x, y in combinations(sorted(sets), 2) if jaccard(x, y) >= t})
    lines = [r.value for r in writers.pair_lines(similarity.similar_pairs(df, "b", "u", 0.2)).collect()]
    assert lines[0] == "business_id_1,business_id_2,similarity" and lines[1:] == sorted(lines[1:]) and len(lines) > 3


def paths_from(near, root):
    depth, todo = {root: 0}, deque([root])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in depth:
                depth[w] = depth[v] + 1
                todo.append(w)
    return depth


GRAPHS = [[("a", "b"), ("b", "c")], [("a", "b"), ("b", "c"), ("a", "c")], [("a", x) for x in "bcde"], [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "y")]]


@pytest.mark.parametrize("edges", [*GRAPHS, None])
def test_betweenness(spark, edges):
    if edges is None:
        rng = random.Random(3)
        edges = sorted({tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(20)})
    df = spark.createDataFrame(edges, "src string, dst string")
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(df).collect()}
    total = sum(d for v in near for d in paths_from(near, v).values()) / 2
    assert sum(got.values()) == pytest.approx(total) and {*got} == {*edges}
    if len(edges) < 6:
        assert {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(df, broadcast_bytes=0).collect()} == pytest.approx(got)


def test_label_propagation(spark):
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample("abcdefghij", 2))) for _ in range(14)})
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {v: v for v in near}
    for _ in range(5):
        label = {v: min(((-n, x) for x, n in Counter(label[w] for w in near[v]).items()))[1] for v in near}
    got = graph.label_propagation(spark.createDataFrame(edges, "src string, dst string"))
    assert {r.vertex: r.label for r in got.collect()} == label
    lines = [r.value for r in writers.community_lines(graph.communities(got)).collect()]
    assert sorted(lines) == sorted(", ".join(f"'{v}'" for v in sorted(label) if label[v] == x) for x in {*label.values()})


def events(spark, n=950, ids=120):
    rng = random.Random(5)
    raw = [(k, rng.randrange(ids)) for k in range(n)]
    return [u for _, u in raw], sketches.numbered(spark.createDataFrame(raw[::-1], "event_id long, user_id long"), "event_id")


def bloom_program(users, size, bits):
    pairs, seen, on, out = sketches.parameters(3, bits), set(), set(), {}
    for k, u in enumerate(users):
        own = out.setdefault(k // size, [0, 0])
        if u not in seen:
            places = {(a * (u % sketches.BLOOM_PRIME) + b) % sketches.BLOOM_PRIME % bits for a, b in pairs}
            own[0] += places <= on
            own[1] += 1
            seen.add(u)
            on |= places
    return out


def test_bloom_equals_the_sequential_program(spark):
    users, df = events(spark)
    want = bloom_program(users, 100, 211)
    assert {r.batch: [r.n_false, r.n_new] for r in sketches.bloom_rates(df, F.col("user_id"), 100, bits=211).collect()} == want and sum(x[0] for x in want.values()) > 5
    streamed = micro.bloom_rates_of(micro.stream_bloom(micro.as_stream(df), F.col("user_id"), 100, bits=211))
    assert {r.batch: [r.n_false, r.n_new] for r in streamed.collect()} == want
    counters = sketches.filter_counters(sketches.bloom_rates(df, F.col("user_id"), 100, bits=211), df, 100).collect()
    assert {r.batch: [r.false_positive, r.false_positive + r.true_negative] for r in counters} == want and sum(r.true_positive + r.false_positive + r.true_negative + r.false_negative for r in counters) == len(users)


def test_distinct_estimates(spark):
    users, df = events(spark)
    zeros = lambda h: 0 if h == 0 else (h & -h).bit_length() - 1
    want = {}
    for b in range(10):
        own = {*users[b * 100 : b * 100 + 100]}
        most = [2.0 ** max(zeros((a * u + c) % sketches.COUNT_PRIME % sketches.COUNT_RANGE) for u in own) for a, c in sketches.parameters(20, 4_294_967_295)]
        groups = sorted(sum(most[i : i + 5]) / 5 for i in range(0, 20, 5))
        want[b] = (len(own), float(round((groups[1] + groups[2]) / 2)))
    got = {r.batch: (r.n_distinct, r.estimate) for r in sketches.distinct_estimates(df, F.col("user_id"), 100, hashes=20).collect()}
    assert got == want
    assert sketches.estimate_totals(sketches.distinct_estimates(df, F.col("user_id"), 100, hashes=20)).first().n_distinct == sum(x[0] for x in want.values())


def test_samples_and_numbers(spark):
    users, df = events(spark)
    got = {r.seqnum: tuple(r)[1:] for r in sketches.positional_sample(df, "user_id").collect()}
    assert got[300] == tuple(users[200 + k] for k in (0, 20, 40, 60, 80)) and got[1000] == (users[900], users[920], users[940], None, None)
    texts = ["aB-_9", "ü", "x" * 40]
    t = spark.createDataFrame([(x,) for x in texts], "t string").select("t", sketches.text_number(F.col("t"), 999_331).alias("n")).collect()
    assert {r.t: r.n for r in t} == {x: int(x.encode().hex(), 16) % 999_331 for x in texts}
    assert abs(sketches.sketched_distinct(df.withColumn("one", F.lit(1)), "user_id", "one").first().estimate - 120) < 12


RATED = [("u1", "a", 5.0), ("u1", "b", 3.0), ("u2", "a", 4.0), ("u2", "b", 2.0), ("u2", "b", 3.0), ("u3", "a", 1.0), ("u3", "b", 2.0), ("u3", "c", 4.0), ("u4", "d", 2.0), ("u5", "d", 4.0)]


def predicted(user, item):
    of = lambda k, x: [s for *p, s in RATED if p[k] == x]
    mean = lambda x: sum(x) / len(x)
    one = {(u, i): mean([s for a, b, s in RATED if (a, b) == (u, i)]) for u, i, _ in RATED}
    if not of(0, user):
        return mean(of(1, item)) if of(1, item) else 3.0
    if not of(1, item):
        return mean(of(0, user))

    def weight(i, j):
        both = [u for u in {u for u, _ in one} if (u, i) in one and (u, j) in one]
        if not both:
            return min(mean(of(1, i)), mean(of(1, j))) / max(mean(of(1, i)), mean(of(1, j)))
        x, y = [one[u, i] for u in both], [one[u, j] for u in both]
        xx, yy = sum((v - mean(x)) ** 2 for v in x), sum((v - mean(y)) ** 2 for v in y)
        return 1.0 if xx < 1e-9 or yy < 1e-9 else sum((v - mean(x)) * (w - mean(y)) for v, w in zip(x, y)) / (xx * yy) ** 0.5

    near = [(weight(item, j), s) for (u, j), s in one.items() if u == user]
    near = [(w, s) for w, s in near if w > 1e-9]
    return sum(w * s for w, s in near) / sum(w for w, _ in near) if near else mean(of(0, user))


def test_predictions(spark):
    rated = spark.createDataFrame(RATED, "user string, item string, stars double")
    targets = [(u, i) for u in ("u1", "u2", "u3", "u4", "new") for i in ("a", "b", "c", "d", "none")]
    got = {(r.user, r.item): r.prediction for r in recommend.predictions(rated, spark.createDataFrame([*targets, targets[0]], "user string, item string")).collect()}
    assert got == pytest.approx({t: predicted(*t) for t in targets})
    truth = spark.createDataFrame([("u1", "a", 4.0), ("new", "none", 5.0), ("x", "y", 1.0)], "user string, item string, stars double")
    judged = recommend.against_truth(recommend.predictions(rated, truth), truth)
    assert recommend.rmse(judged).first().n == 3 and {r.bin: r.n_rows for r in recommend.error_histogram(judged).collect()}[2] >= 1
    assert {r.user for r in recommend.unseen(truth, rated, "user").collect()} == {"new", "x"}
    half = recommend.blended(judged, judged.withColumn("prediction", F.lit(0.0)), 0.5).where("user = 'new'").first()
    assert half.prediction == 1.5


def test_features(spark):
    attributes = {"BusinessAcceptsCreditCards": "True", "WiFi": "free", "Music": "{}", "BusinessParking": "{u'street': True, 'lot': False}", "GoodForMeal": '{"lunch": true}', "RestaurantsPriceRange2": "2", "NoiseLevel": "loud"}
    df = spark.createDataFrame([("b1", attributes, "Food, Restaurants"), ("b2", {"BusinessParking": "None", "RestaurantsPriceRange2": "x", "WiFi": "u'free'"}, "Bars, Restaurants"), ("b3", None, None)], "b string, a map<string,string>, c string")
    got = {r.b: r for r in df.select("b", *features.attribute_columns(F.col("a")), features.category_code(F.col("c")).alias("c"), features.category_code(F.col("c"), trim=True).alias("t")).collect()}
    assert len(got["b1"]) == 36
    b = got["b1"]
    assert (b.BusinessAcceptsCreditCards, b.WiFi, b.Music, b.BusinessParking_street, b.BusinessParking_lot, b.GoodForMeal_lunch, b.RestaurantsPriceRange2, b.c) == (1, 1, 1, 1, 0, 1, 2, 1) and b.NoiseLevel > 0
    assert (got["b2"].c, got["b2"].t, got["b2"].WiFi, got["b2"].RestaurantsPriceRange2, got["b3"].c) == (0, 1, 0, 0, 1)
    assert all(v == 0 for k, v in got["b3"].asDict().items() if k not in ("b", "c", "t"))
    f = spark.createDataFrame([("None",), (None,), ("x",), ("x, y",)], "f string").select(features.friend_count(F.col("f")).alias("n"))
    assert [r.n for r in f.collect()] == [0, 0, 1, 2]


def test_models_beat_the_mean(spark):
    rng = random.Random(6)
    users = [(f"u{k}", k % 7, "2015-01-01", "None", k % 5, 0, 0, 0, 1.0 + k % 5, 0) for k in range(60)]
    u = spark.createDataFrame(users, readers.USER)
    b = spark.createDataFrame([(f"b{k}", 1.0 + k % 5, k, 1, None if k % 3 else "90210", None, {"WiFi": "free"} if k % 2 else None) for k in range(30)], readers.BUSINESS)
    raw = [(f"u{rng.randrange(61)}", f"b{rng.randrange(31)}") for _ in range(700)]
    rated = [(x, y, min(5.0, max(1.0, (1 + int(x[1:]) % 5 + 1 + int(y[1:]) % 5) / 2 + rng.choice([-0.5, 0, 0.5])))) for x, y in raw]
    r = spark.createDataFrame(rated, "user string, item string, stars double")
    train, test = r.limit(600), r.subtract(r.limit(600)).dropDuplicates(["user", "item"])
    mean = sum(s for *_, s in rated) / len(rated)
    off = test.agg(F.sqrt(F.avg(F.pow(F.col("stars") - mean, 2))).alias("r")).first().r
    x = lambda p, t: features.simple_features(p, train, u, b, training=t)
    simple = learning.boosted(x(train, True), x(test, False), [*learning.SIMPLE], trees=5)
    tr, te = features.joined_features(train, u, b), features.joined_features(test, u, b, train)
    columns = [c for c in tr.columns if c[:2] in ("u_", "b_", "a_")]
    assert len(columns) == 9 + 5 + 33
    deep = learning.stacked(tr, te, columns, ["user", "item"], folds=2, trees=3)
    assert recommend.rmse(recommend.against_truth(deep, test)).first().rmse < off
    assert simple.count() == test.count()


def test_sources_and_sinks(spark, tmp_path, rows):
    (tmp_path / "r.csv").write_text('user_id,business_id,stars\nu1,b1,4.0\n"u,2",b2,1\n')
    (tmp_path / "t.csv").write_text('"DAY","CUSTOMER","A","B","C","PRODUCT"\n"11/1/2000","0012","x","y","z","0047"\n')
    (tmp_path / "u.json").write_text("\n".join(json.dumps({"user_id": u, "business_id": "b", "stars": 3, "date": "2018", "more": [1]}) for u in ("a", "ü")))
    assert rows(readers.csv_table(spark, str(tmp_path / "r.csv"), readers.RATING)) == [("u,2", "b2", 1.0), ("u1", "b1", 4.0)]
    assert rows(readers.transactions(spark, str(tmp_path / "t.csv"))) == [("11/1/2000-12", "47")]
    assert rows(readers.json_lines(spark, str(tmp_path / "u.json"), readers.REVIEW)) == [("a", "b", 3.0, "2018"), ("ü", "b", 3.0, "2018")]
    assert readers.text_lines(spark, str(tmp_path / "r.csv")).count() == 3
    df = readers.local_rows(spark, [("x, y", None, 1.5)], "a string, b string, c double")
    writers.write_csv(df, str(tmp_path / "out"))
    assert rows(spark.read.csv(str(tmp_path / "out"), header=True)) == [("x, y", None, "1.5")]
    writers.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": "x, y", "b": None, "c": 1.5}
    edges = spark.createDataFrame([("a", "b", 1.234565), ("b", "c", 2.0)], "src string, dst string, betweenness double")
    writers.write_lines(writers.edge_lines(edges), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()][0] == "('b', 'c'), 2.0"


def test_streams_equal_tables(spark, rows):
    _, df = events(spark, 420)
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 3_000)).withColumn("kind", F.col("user_id") % 3)
    want = rows(timed.groupBy(F.date_trunc("day", "ts").alias("d"), "kind").count())
    assert rows(micro.drained(micro.windowed_counts(micro.as_stream(timed), "ts", "kind"), "complete")) == want
    assert rows(micro.drained(micro.stream_positional(micro.as_stream(df), "user_id"), "complete")) == rows(sketches.positional_sample(df, "user_id"))
    zeros = micro.drained(micro.stream_zeros(micro.as_stream(df), F.col("user_id"), 100, 20), "complete")
    ids = micro.drained(micro.stream_ids(micro.as_stream(df), F.col("user_id"), 100), "append").groupBy("batch").agg(F.count("*").alias("n_distinct"))
    assert rows(sketches.estimates_of(zeros, ids)) == rows(sketches.distinct_estimates(df, F.col("user_id"), 100, 20))
    assert sum(r.n_events for r in micro.sessions(timed, "ts", "user_id").collect()) == 420
