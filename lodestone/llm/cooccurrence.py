"""Problem 3: how often two items share a basket, and how much more often than chance.

Stripes: each task folds its baskets into an associative array per item, of the item's neighbours and their counts, and
hands the arrays on when they reach a fixed size. The arrays are shuffled by item and bucket of neighbours and merged
there, in one pass over the sorted arrays that holds a single key's. Baskets of more than `large` items go the same way
in blocks of two slices of their items, so no task holds a whole one. What is left are pairs with enough baskets, which
a log-likelihood ratio test and the ratio to chance judge. Counts are exact at any setting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import broadcast_if_small, spread, stage
from lodestone.operators.sketches import numbered

_STRIPES = "item long, bucket int, neighbours array<int>, counts array<long>"
_STRIPE_TYPES = pa.schema([("item", pa.int64()), ("bucket", pa.int32()), ("neighbours", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_PAIR_TYPES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n12", pa.int64())])
#: Critical value of the log-likelihood ratio at the five per cent level.
SIGNIFICANT = 3.84


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and the sum of each one's counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts, starts)


def block_pairs(items: np.ndarray, s: int, t: int, slices: int, n: int) -> np.ndarray:
    """a * n + b for the pairs a < b of a basket's block: of all items if s is t, else of one of slice s and one of slice t."""
    x = np.sort(items)
    if s == t:
        i, j = np.triu_indices(len(x), 1)
        return x[i] * n + x[j]
    left, right = x[x % slices == s], x[x % slices == t]
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    return np.minimum(a, b) * n + np.maximum(a, b)


def _stripes(n: int, buckets: int, cells: int):
    """Arrays of neighbours and counts by item and bucket, of the pairs in a task's blocks."""

    def out(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        item, other = codes // n, codes % n
        order = np.lexsort((other, other % buckets, item))
        item, other, counts = item[order], other[order], counts[order]
        bucket = other % buckets
        starts = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (bucket[1:] != bucket[:-1])]) if len(item) else np.zeros(0, int)
        offsets = pa.array(np.r_[starts, len(item)].astype(np.int32))
        arrays = [pa.array(item[starts]), pa.array(bucket[starts].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(other.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts))]
        return pa.RecordBatch.from_arrays(arrays, schema=_STRIPE_TYPES)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new, held = [], 0
        for b in batches:
            ss, ts, sizes, lists = (b.column(k) for k in range(4))
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
            at = at - at[0]
            for k, (s, t, slices) in enumerate(zip(ss.to_pylist(), ts.to_pylist(), sizes.to_pylist())):
                new.append(block_pairs(flat[at[k] : at[k + 1]], s, t, slices, n))
                held += len(new[-1])
                if held >= cells:
                    codes, counts = summed(np.concatenate([codes, *new]), np.concatenate([counts, np.ones(held, np.int64)]))
                    new, held = [], 0
                    if len(codes) >= cells:
                        yield out(codes, counts)
                        codes, counts = codes[:0], counts[:0]
        yield out(*summed(np.concatenate([codes, *new]), np.concatenate([counts, np.ones(held, np.int64)])))

    return fold


def _merged(n: int, support: int):
    """Arrays sorted by item and bucket in, pairs with at least `support` baskets out; a key may go on in the next batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, last = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(c: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            c, k = summed(c, k)
            c, k = c[k >= support], k[k >= support]
            return pa.RecordBatch.from_arrays([pa.array(c // n), pa.array(c % n), pa.array(k)], schema=_PAIR_TYPES)

        for b in batches:
            if not b.num_rows:
                continue
            item, bucket, sizes = b.column(0).to_numpy(), b.column(1).to_numpy(), np.diff(b.column(2).offsets.to_numpy())
            more = np.repeat(item, sizes) * n + b.column(2).flatten().to_numpy()
            codes, counts = np.concatenate([codes, more]), np.concatenate([counts, b.column(3).flatten().to_numpy()])
            end = (item[-1], bucket[-1])
            tail = sizes[(item == end[0]) & (bucket == end[1])].sum()
            done = len(codes) - tail if last != end or tail < len(more) else 0  # all but the last key's
            if done:
                yield out(codes[:done], counts[:done])
                codes, counts = codes[done:], counts[done:]
            codes, counts = summed(codes, counts)
            last = end
        yield out(codes, counts)

    return merge


def shared_baskets(rows: DataFrame, n_items: int, support: int, large: int = 1_000, cells: int = 2_000_000, bucket_items: int = 100_000) -> DataFrame:
    """a < b, n12 of the pairs of items with at least `support` common baskets. rows: g, seq, distinct, seq in 0 to n_items - 1.

    rows is staged, as it is read for the sizes of baskets and for the baskets.
    """
    rows = stage(rows)
    sliced = rows.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > large).select("g", F.ceil(F.col("k") / large).cast("int").alias("slices"))
    cut = rows.join(broadcast_if_small(stage(sliced)), "g", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod("seq", F.col("slices")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda t: F.struct(F.least(own, t).alias("s"), F.greatest(own, t).alias("t")))
    blocks = cut.select("g", "slices", "seq", F.explode(others).alias("b")).groupBy("g", "slices", "b.s", "b.t").agg(F.collect_list("seq").alias("items"))
    blocks = blocks.where(F.size("items") > 1).select("s", "t", "slices", "items")
    stripes = blocks.mapInArrow(_stripes(n_items, -(-n_items // bucket_items), cells), _STRIPES)
    placed = spread(stripes, "item", "bucket").sortWithinPartitions("item", "bucket")
    return placed.mapInArrow(_merged(n_items, support), "a long, b long, n12 long")


def _llr(n12: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Log-likelihood ratio of two items' presence in n baskets."""
    x = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    k = [n12, n1 - n12, n2 - n12, n - n1 - n2 + n12]
    e = [n1 * n2 / n, n1 * (n - n2) / n, (n - n1) * n2 / n, (n - n1) * (n - n2) / n]
    return 2.0 * (x(k[0], e[0]) + x(k[1], e[1]) + x(k[2], e[2]) + x(k[3], e[3]))


def cooccurrences(df: DataFrame, basket: str, item: str, support: int, lift: float, least_llr: float = SIGNIFICANT, **sizes: int) -> DataFrame:
    """item_1 < item_2 (by bytes), n12, n1, n2, n_baskets, lift, llr for pairs with n12 >= support, n12 * n / (n1 * n2) >= lift and llr >= least_llr.

    Rows with a null or blank basket or item are ignored, repeated rows count once, an empty table gives no rows.
    Items in fewer than `support` baskets, or in more than n / lift (n12 is at most n2), cannot be in such a pair. The
    ratio is at least 2 * n12 * (ln(lift) - 1 + 1 / lift), 8.9 for 7 baskets and 4 times chance, so the test at its
    default drops none of those.
    """
    rows = df.select(F.col(basket).cast("string").alias("g"), F.col(item).cast("string").alias("i"))
    rows = rows.where((F.trim("g") != "") & (F.trim("i") != "")).distinct()
    n = rows.agg(F.count_distinct("g").alias("n")).first()["n"]
    counts = rows.groupBy("i").agg(F.count("*").alias("n_i"))
    able = stage(numbered(counts.where((F.col("n_i") >= support) & (F.col("n_i") * F.lit(float(lift)) <= n)), "i"))
    of = lambda *c: broadcast_if_small(able).select(*c)
    pairs = shared_baskets(rows.join(of("i", "seq"), "i").select("g", "seq"), max(1, able.count()), support, **sizes)
    side = lambda k, at: of(F.col("seq").alias(at), F.col("i").alias(f"item_{k}"), F.col("n_i").alias(f"n{k}"))
    full = pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").select("item_1", "item_2", "n12", "n1", "n2", F.lit(n).cast("long").alias("n_baskets"))
    d = {c: F.col(c).cast("double") for c in ("n12", "n1", "n2", "n_baskets")}
    full = full.withColumn("lift", d["n12"] * d["n_baskets"] / (d["n1"] * d["n2"])).withColumn("llr", _llr(d["n12"], d["n1"], d["n2"], d["n_baskets"]))
    return full.where((d["n12"] * d["n_baskets"] >= F.lit(float(lift)) * d["n1"] * d["n2"]) & (F.col("llr") >= least_llr))
