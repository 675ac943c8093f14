"""Co-occurring items, similar sets, and containers."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import cooccurrence, packing, similarsets


def brute_pairs(data, support, lift):
    baskets: dict = {}
    for g, i in data:
        if g and g.strip() and i and i.strip():
            baskets.setdefault(g, set()).add(i)
    n, single = len(baskets), Counter(i for b in baskets.values() for i in b)
    both = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {(a, b): k for (a, b), k in both.items() if k >= support and k * n >= lift * single[a] * single[b]}


@pytest.mark.parametrize(("large", "cells", "bucket_items"), [(1_000, 2_000_000, 100_000), (6, 10, 7), (2, 1, 3)])
def test_pairs_equal_brute_force(spark, large, cells, bucket_items):
    rng = random.Random(5)
    items = [f"i{k:02d}" for k in range(40)]
    data = [(f"g{k}", rng.choice(items[:8] if k % 3 else items)) for k in range(60) for _ in range(rng.randrange(1, 7))]
    data += [(f"t{k}", x) for k in range(9) for x in ("p", "q", *items[:7])] + [("huge", x) for x in [*items, "p"]] + [("g1", "i01")] * 50
    data += [(None, "p"), ("g1", None), ("", "p"), (" ", "q"), ("g1", " ")]
    df = spark.createDataFrame([(g, i, 1, "clash") for g, i in data], "user_id string, business_id string, n12 int, item_1 string")
    got = {(r.item_1, r.item_2): r for r in cooccurrence.cooccurrences(df, "user_id", "business_id", 7, 4.0, large=large, cells=cells, bucket_items=bucket_items).collect()}
    want = brute_pairs(data, 7, 4.0)
    assert {k: r.n12 for k, r in got.items()} == want and ("p", "q") in want
    assert all(r.llr > 3.84 and r.lift >= 4 for r in got.values())


def test_stripes_merge_over_batches():
    def stripes(keys):
        lists = [pa.array([[2 + b, 4 + b] for _, b in keys], pa.list_(pa.int32())), pa.array([[3, 4]] * len(keys), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int32()), *lists], names=["item", "bucket", "neighbours", "counts"])

    keys = [(0, 0), (0, 0), (0, 0), (0, 1), (5, 0), (5, 0), (6, 0)]
    for cut in ([7], [1, 1, 1, 1, 1, 1, 1], [3, 4], [4, 0, 2, 1]):
        at, parts = 0, []
        for c in cut:
            parts.append(stripes(keys[at : at + c]))
            at += c
        got = {(a, b): k for x in cooccurrence._merged(10, 0)(iter(parts)) for a, b, k in zip(*x.to_pydict().values())}
        assert got == {(0, 2): 9, (0, 4): 12, (0, 3): 3, (0, 5): 4, (5, 2): 6, (5, 4): 8, (6, 2): 3, (6, 4): 4}


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "user_id string, business_id string")
    assert cooccurrence.cooccurrences(df, "user_id", "business_id", 7, 4.0).count() == 0
    one = spark.createDataFrame([(f"g{k}", "a") for k in range(9)], "user_id string, business_id string")
    assert cooccurrence.cooccurrences(one, "user_id", "business_id", 7, 4.0).count() == 0


def sets_of(rng):
    out = {}
    for k in range(60):
        base = {f"u{rng.randrange(4_000)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 40]))}
        out[f"b{k:03d}"] = base
        near = {*base} if k % 4 == 0 else {x for x in base if rng.random() < 0.8} | {f"n{k}"}
        out[f"c{k:03d}"] = near
    out["hot"] = {f"u{k}" for k in range(2_000)}
    out["hot2"] = {f"u{k}" for k in range(600, 2_100)}
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize(("chunk", "part_sets"), [(200_000, 400_000), (500, 16)])
def test_similar_sets_equal_brute_force(spark, chunk, part_sets):
    sets = sets_of(random.Random(6))
    data = [(b, u, 1, "clash") for b, s in sets.items() for u in s] * 2 + [(None, "u1", 1, None), ("b000", None, 1, None)]
    df = spark.createDataFrame(data, "business_id string, user_id string, n int, cid string")
    got = {(r.record_1, r.record_2): r.jaccard for r in similarsets.similar_sets(df, "business_id", "user_id", 0.5, chunk=chunk, part_sets=part_sets).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {k: j for k, j in want.items() if j >= 0.5}
    assert got == pytest.approx(want) and len(want) > 30
    assert similarsets.similar_sets(df.limit(0), "business_id", "user_id", 0.5).count() == 0


def test_classes_hold_copies_and_links_no_pair_twice(spark):
    data = [(f"a{k}", u) for k in range(5) for u in "pqr"] + [("b", u) for u in "pqrs"] + [("c", "z"), ("d", None)]
    members, links = similarsets.similar_classes(spark.createDataFrame(data, "b string, u string"), "b", "u", 0.5)
    of = {r.r: r.class_id for r in members.collect()}
    assert len(of) == 7 and len({of[f"a{k}"] for k in range(5)}) == 1
    assert [(r.class_1, r.class_2, r.jaccard) for r in links.collect()] == [(min(of["a0"], of["b"]), max(of["a0"], of["b"]), 0.75)]


def test_sketch_bits_agree_as_often_as_they_should():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, 30), rng.integers(-(2**62), 2**62, 15)
    m = similarsets.minima([np.r_[a, b], np.r_[a, rng.integers(-(2**62), 2**62, 15)]], 4_000)  # Jaccard 0.5
    bits = similarsets.code_bits(m)
    assert abs((bits[0] == bits[1]).mean() - 0.75) < 0.04 and abs((m[0] == m[1]).mean() - 0.5) < 0.04


def test_index_plan():
    width, segments = similarsets.plan_index(35_000, 0.5, 0.002)
    near = 0.75**width + width * 0.25 * 0.75 ** (width - 1) + width * (width - 1) / 2 * 0.25**2 * 0.75 ** (width - 2)
    assert (1 - near) ** segments <= 0.002 < (1 - near) ** (segments - 1)
    assert [similarsets.plan_index(n, 0.5, 0.002)[0] for n in (2, 10**6, 10**8, 10**12)] == [8, 23, 30, 32]


@pytest.mark.parametrize("part_bits", [0, 2])
def test_values_two_bits_off_meet(part_bits):
    rng, width = np.random.default_rng(3), 10
    v = rng.integers(0, 2**width, 60).astype(np.uint32)
    met = set()
    for part in range(2**part_bits):
        held = np.flatnonzero(np.bitwise_count((v >> np.uint32(width - part_bits)) ^ np.uint32(part)) <= 1) if part_bits else np.arange(60)
        value, at = similarsets.near_values(v[held], width, part, part_bits)
        by: dict = {}
        for x, i in zip(value, held[at]):
            by.setdefault(int(x), set()).add(int(i))
        met |= {p for s in by.values() for p in combinations(sorted(s), 2)}
    assert met == {(i, j) for i, j in combinations(range(60), 2) if int(v[i] ^ v[j]).bit_count() <= 2}


def brute_fullest(counts, space):
    best = 0
    items = [x for x, n in counts.items() for _ in range(n)]
    for k in range(len(items) + 1):
        best = max([best, *(sum(c) for c in combinations(items, k) if sum(c) <= space)])
    return best


def test_fullest_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        space = rng.randrange(0, 60)
        got = packing.fullest(counts, space)
        assert sum(got) == brute_fullest(counts, space) and all(got.count(x) <= counts[x] for x in got)


def test_fill_keeps_every_item():
    rng = random.Random(8)
    lengths = [rng.choice([rng.randrange(1, 200), rng.randrange(1, 2_049)]) for _ in range(3_000)]
    bins = packing.fill(lengths, 2_048)
    assert sorted(i for b in bins for i in b) == [*range(3_000)] and all(sum(lengths[i] for i in b) <= 2_048 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 2_048) + 1


def test_containers(spark):
    texts = [(k, f"some words about item {k} " * (k % 60), "clash") for k in range(300)] + [(300, None, ""), (301, "", ""), (302, "word " * 5_000, ""), (303, " \n", ""), (7, "twice", ""), (None, "no id", "")]
    df = spark.createDataFrame(texts, "doc_id long, text string, piece string")
    out = packing.containers(df, pool_bins=4).collect()
    full = Counter()
    for r in out:
        full[r.container_id] += r.n_tokens
    assert max(full.values()) <= 2_048
    size = {r.doc_id: r.n_tokens for r in packing.token_sizes(df.where("doc_id <> 7"), "doc_id", "text").collect()}
    held = Counter()
    for r in out:
        held[r.doc_id] += r.n_tokens
    assert {k: v for k, v in held.items() if k != 7} == size and {r.doc_id for r in out} == {*range(304)}
    pieces = sorted((r.piece, r.token_start, r.n_tokens) for r in out if r.doc_id == 302)
    assert len(pieces) > 1 and all(p[1] == p[0] * 2_048 for p in pieces) and all(p[2] == 2_048 for p in pieces[:-1])
    assert sum(r.doc_id == 7 for r in out) == 2
    assert packing.containers(df.limit(0)).count() == 0
    report = packing.fill_report(packing.containers(df.where(F.col("doc_id") < 300))).first()
    assert report.unused_share < 0.1 and report.n_containers >= report.least_containers and report.fullest <= 2_048
    alone = [r.container_id for r in packing.containers(df, capacity=16, pool_bins=4).collect() if r.n_tokens == 16 and r.container_id < 0]
    assert len(alone) == len(set(alone)) > 300 and sorted(alone) == [*range(-len(alone), 0)]
