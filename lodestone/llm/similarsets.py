"""Problem 7: all pairs of set-valued records whose sets overlap above a Jaccard threshold.

Exact copies of a set are one class. A class gets a code of one-bit minhashes, cut into segments of `width` bits. Two
sets at the threshold differ in a bit with probability (1 - t) / 2, so by the pigeonhole principle some segment differs
in few bits; classes join on segments that differ in at most two: each side tries its value and all values one bit off,
and equal ones meet. The number of segments is calibrated so that the chance of meeting in none is at most `miss`.
Pairs that meet are tested on the code's first 256 bits against a Hamming radius four standard deviations above the
mean at the threshold, and what is left is verified on the sets themselves. Codes travel in packed arrays, a few
segments together; beyond `part_sets` classes a segment is cut by its value's high bits, so that a task's share stays
bounded however many sets there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import broadcast_if_small, salted_join, spread, stage
from lodestone.operators.sketches import numbered

CHECK_BITS = 256
_SLICE = 1_000
_GROUP = 4


def plan_index(n_sets: int, threshold: float, miss: float) -> tuple[int, int]:
    """(width, segments): width grows with the number of sets up to 32 bits, so that chance meetings stay few."""
    width = min(32, max(8, round(math.log2(max(2, n_sets))) + 3))
    p = (1 + threshold) / 2
    near = sum(math.comb(width, k) * (1 - p) ** k * p ** (width - k) for k in range(3))
    return width, (1 if near >= 1 else math.ceil(math.log(miss) / math.log(1 - near)))


def hamming_radius(threshold: float, bits: int = CHECK_BITS, deviations: float = 4.0) -> int:
    """Bits that may differ: the mean for two sets at the threshold and some standard deviations more."""
    p = (1 - threshold) / 2
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20_011))
    return r.integers(0, 2**32, k, dtype=np.uint32), r.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _hashed(x: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of k hashes an element; x are 64-bit hashes already."""
    low = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    h = (low[:, None] ^ seeds[0]) * seeds[1]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minhashes of each set of 64-bit hashes; no set is empty."""
    seeds = _seeds(k)
    out = np.full((len(sets), k), 0xFFFFFFFF, dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(flat), _SLICE):
        h, own = _hashed(flat[at : at + _SLICE], seeds), owner[at : at + _SLICE]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[starts]] = np.minimum(out[own[starts]], np.minimum.reduceat(h, starts, axis=0))
    return out


def code_bits(mins: np.ndarray) -> np.ndarray:
    """One bit of each minhash."""
    return ((mins >> np.uint32(9)) & np.uint32(1)).astype(np.uint8)


def segment_values(bits: np.ndarray, width: int, segments: int) -> np.ndarray:
    """The segments of codes as numbers, one row a set."""
    body = bits[:, : width * segments].reshape(len(bits), segments, width)
    return (body.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=2).astype(np.uint32)


_CODED = "cid long, n long, code binary"


def _coded(ids, sizes, mins: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"cid": ids, "n": sizes, "code": [c.tobytes() for c in np.packbits(code_bits(mins), axis=1)]})


def _whole(k: int):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                c = b.iloc[at : at + 500]
                yield _coded(c["cid"].to_numpy(), c["n"].to_numpy(), minima([np.asarray(s) for s in c["hashes"]], k))

    return code


def _pieces(k: int):
    """The minhashes of pieces of large sets, and of the sets from these."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, n, s in zip(b["cid"], b["n"], b["hashes"]):
                yield pd.DataFrame({"cid": [c], "n": [n], "mins": [minima([np.asarray(s)], k)[0].tobytes()]})

    def merged(b: pd.DataFrame) -> pd.DataFrame:
        low = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
        for m in b["mins"]:
            low = np.minimum(low, np.frombuffer(m, dtype=np.uint32))
        return _coded(b["cid"].iloc[:1].to_numpy(), b["n"].iloc[:1].to_numpy(), low[None, :])

    return partial, merged


_PACKED = "seg int, part long, segs int, values binary, sizes binary, ids binary, words binary"


def _packed_segments(width: int, segments: int, k: int, part_bits: int):
    """Per batch of sets, group of segments and part: the values, sizes, classes and words of the Hamming test as bytes.

    A part is a value's highest part_bits bits; a set is in its own part and in those one bit off.
    """
    group = 1 if part_bits else _GROUP

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 5_000):
                c = b.iloc[start : start + 5_000]
                codes = np.stack([np.frombuffer(x, dtype=np.uint8) for x in c["code"]])
                values = segment_values(np.unpackbits(codes, axis=1)[:, :k], width, segments)
                words, n, ids = np.ascontiguousarray(codes[:, : CHECK_BITS // 8]), np.minimum(c["n"].to_numpy(), 2**32 - 1).astype(np.uint32), c["cid"].to_numpy().astype(np.int64)
                rows = []
                for seg in range(0, segments, group):
                    v = values[:, seg : seg + group]
                    own = v[:, 0] >> np.uint32(width - part_bits) if part_bits else np.zeros(len(v), np.uint32)
                    for p in np.unique(np.concatenate([own, *(own ^ np.uint32(1 << i) for i in range(part_bits))])):
                        at = np.flatnonzero(np.bitwise_count(own ^ p) <= 1)
                        rows.append((seg, int(p), v.shape[1], np.ascontiguousarray(v[at]).tobytes(), n[at].tobytes(), ids[at].tobytes(), words[at].tobytes()))
                yield pd.DataFrame(rows, columns=["seg", "part", "segs", "values", "sizes", "ids", "words"])

    return pack


def near_values(v: np.ndarray, width: int, part: int, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, place in v) of each value of v and those one bit off, within the part."""
    high = width - part_bits
    own = (v >> np.uint32(high)) if part_bits else np.zeros(len(v), np.uint32)
    here = np.flatnonzero(own == part)
    off = np.flatnonzero(own != part)  # one bit off in the part already
    moved = (v[off] & np.uint32((1 << high) - 1)) | np.uint32(part << high if part_bits else 0)
    tries = [v[here], *(v[here] ^ np.uint32(1 << i) for i in range(high)), moved]
    return np.concatenate(tries), np.concatenate([np.tile(here, high + 1), off])


def _collide(threshold: float, width: int, part_bits: int):
    """The pairs of classes that meet in a segment and whose sizes and bits allow the threshold."""
    half, full = hamming_radius(threshold, CHECK_BITS // 2), hamming_radius(threshold)

    def pairs(b: pd.DataFrame) -> pd.DataFrame:
        segs, part = int(b["segs"].iloc[0]), int(b["part"].iloc[0])
        every = np.frombuffer(b"".join(b["values"]), dtype=np.uint32).reshape(-1, segs)
        n, ids = np.frombuffer(b"".join(b["sizes"]), dtype=np.uint32), np.frombuffer(b"".join(b["ids"]), dtype=np.int64)
        words = np.frombuffer(b"".join(b["words"]), dtype=np.uint64).reshape(len(n), -1)
        order = np.argsort(ids)  # classes are numbered by size
        every, n, ids, words = every[order], n[order], ids[order], words[order]
        first, rest = np.ascontiguousarray(words[:, :2]), np.ascontiguousarray(words[:, 2:])
        found = np.zeros(0, np.int64)
        for s in range(segs):
            value, at = near_values(np.ascontiguousarray(every[:, s]), width, part, part_bits)
            key = np.sort((value.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))
            v, r = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # Sorted by size within a value, the partners of a set are the next ones up to the largest size it allows.
            most = np.floor(n / threshold)
            some, step, met = np.flatnonzero(v[:-1] == v[1:]), 1, []
            while len(some):
                i, j = r[some], r[some + step]
                fits = n[j] <= most[i]
                some, i, j = some[fits], i[fits], j[fits]
                near = np.flatnonzero(np.bitwise_count(first[i] ^ first[j]).sum(axis=1, dtype=np.uint16) <= half)
                i, j = i[near], j[near]
                met.append((i * len(n) + j)[i != j])
                step += 1
                some = some[some < len(v) - step]
                some = some[v[some] == v[some + step]]
            found = np.unique(np.concatenate([found, *met]))
        i, j = found // max(1, len(n)), found % max(1, len(n))
        apart = np.bitwise_count(first[i] ^ first[j]).sum(axis=1, dtype=np.uint16) + np.bitwise_count(rest[i] ^ rest[j]).sum(axis=1, dtype=np.uint16)
        i, j = i[apart <= full], j[apart <= full]
        return pd.DataFrame({"a": ids[i], "b": ids[j], "n_a": n[i].astype(np.int64), "n_b": n[j].astype(np.int64)})

    return pairs


def similar_classes(df: DataFrame, record: str, element: str, threshold: float, miss: float = 0.00002, chunk: int = 200_000, part_sets: int = 400_000) -> tuple[DataFrame, DataFrame]:
    """(members, links): r, class_id of every record with a set, and class_1 < class_2, jaccard of all classes that reach the threshold.

    Records of one class have equal sets, so their pairs have similarity 1 and are not spelled out. Rows with a null
    record or element are ignored and repeated rows count once. Recall at the threshold is 1 - miss and higher above
    it; every link given is verified on the elements. Two sets are one class if their sizes and two 64-bit hashes are
    equal.
    """
    rows = stage(df.select(F.col(record).cast("string").alias("r"), F.col(element).cast("string").alias("e")).dropna().distinct())
    mixed = lambda seed: F.bit_xor(F.xxhash64("e", F.lit(seed))).alias(f"f{seed}")
    sets = stage(rows.groupBy("r").agg(F.count("*").alias("n"), mixed(1), mixed(2)))
    classes = numbered(sets.groupBy("n", "f1", "f2").agg(F.min("r").alias("rep")), "n", "f1", "f2").withColumnRenamed("seq", "cid")
    classes = stage(classes.select("cid", "n", "f1", "f2", "rep"))
    n_classes = classes.count()
    width, segments = plan_index(n_classes, threshold, miss)
    k = max(CHECK_BITS, width * segments)
    part_bits = max(0, math.ceil(math.log2(max(1, n_classes / part_sets))))
    reps = classes.select("cid", "n", F.col("rep").alias("r"))  # read from the staged table
    elements = rows.select("r", F.xxhash64("e").alias("x")).join(broadcast_if_small(reps), "r").select("cid", "n", "x")
    gathered = elements.withColumn("piece", F.pmod("x", F.ceil(F.col("n") / chunk))).groupBy("cid", "n", "piece").agg(F.collect_list("x").alias("hashes"))
    gathered = gathered.select("cid", "n", "hashes")
    pack, whole = _packed_segments(width, segments, k, part_bits), _whole(k)
    packed = spread(gathered.where(F.col("n") <= chunk), "cid").mapInPandas(lambda batches: pack(whole(batches)), _PACKED)
    if classes.where(F.col("n") > chunk).limit(1).count():
        partial, merged = _pieces(k)
        split = gathered.where(F.col("n") > chunk).mapInPandas(partial, "cid long, n long, mins binary")
        packed = packed.unionByName(split.groupBy("cid").applyInPandas(merged, _CODED).mapInPandas(pack, _PACKED))
    hits = spread(packed, "seg", "part").groupBy("seg", "part").applyInPandas(_collide(threshold, width, part_bits), "a long, b long, n_a long, n_b long")
    close = stage(hits.distinct())  # a is the smaller set
    # The smaller set's elements are looked up in the larger set.
    wanted = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    asked = broadcast_if_small(stage(reps.join(wanted, "cid", "left_semi").select("r", "cid")))
    held = rows.join(asked, "r").select("cid", "e")
    shared = close.join(held.withColumnRenamed("cid", "a"), "a").join(held.withColumnRenamed("cid", "b"), ["b", "e"]).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("both"))
    links = shared.select(F.least("a", "b").alias("class_1"), F.greatest("a", "b").alias("class_2"), (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))
    members = salted_join(sets, classes.select("n", "f1", "f2", F.col("cid").alias("class_id")), ["n", "f1", "f2"]).select("r", "class_id")
    return stage(members), links.where(F.col("jaccard") >= threshold)


def similar_sets(df: DataFrame, record: str, element: str, threshold: float, **sizes: float) -> DataFrame:
    """record_1 < record_2 (by bytes) and jaccard, for all pairs of records whose sets of distinct elements reach the threshold.

    The links of similar_classes spelled out for all members; with many copies of a set that is as many pairs, and
    similar_classes the form to use. Empty tables and single records give no rows.
    """
    members, links = similar_classes(df, record, element, threshold, **sizes)
    m = lambda k: members.select(F.col("class_id").alias(f"class_{k}"), F.col("r").alias(f"r{k}"))
    across = links.join(m(1), "class_1").join(m(2), "class_2").select("r1", "r2", "jaccard")
    alike = members.groupBy("class_id").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("class_id")
    copied = members.join(alike, "class_id", "left_semi")
    within = copied.select("class_id", F.col("r").alias("r1")).join(copied.select("class_id", F.col("r").alias("r2")), "class_id").where(F.col("r1") < F.col("r2")).select("r1", "r2", F.lit(1.0).alias("jaccard"))
    return across.unionByName(within).select(F.least("r1", "r2").alias("record_1"), F.greatest("r1", "r2").alias("record_2"), "jaccard")
