"""Sketches over numbered events: Bloom-filter false positives, distinct counts by trailing zeros, positional picks.

Events are numbered once, and batches of n are the numbers div n. What a sequential program keeps as state between
batches is here a minimum per key: a bit is set from the first event that hashes to it on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.functions.shuffle import partitions, stage

#: Fixed values of the two sketches: primes, bits of the filter, range of the counting hashes.
BLOOM_PRIME, BLOOM_BITS, BLOOM_HASHES = 999_331, 69_997, 3
COUNT_PRIME, COUNT_RANGE = 4_294_967_311, 4_294_967_296


def parameters(n: int, top: int) -> list[tuple[int, int]]:
    """n pairs (a, b) in 1 to top by a fixed rule."""
    at = lambda i: (i * 2_654_435_761 + 12_345) % 4_294_967_296
    return [(at(2 * i + 1) % top + 1, at(2 * i + 2) % top + 1) for i in range(n)]


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with seq, 0, 1, ... in the order given, which must be total; ranges are numbered in parallel."""
    n = max(partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    ranged = stage(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("k"))
    before = sizes.select("_p", (F.sum("k").over(Window.orderBy("_p")) - F.col("k")).alias("before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(before), "_p").withColumn("seq", F.col("before") + F.col("own")).drop("_p", "own", "before")


def batches(events: DataFrame, size: int) -> DataFrame:
    """batch, n_events, first_seq, last_seq."""
    return events.groupBy(F.expr(f"seq div {size}").alias("batch")).agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def text_number(c: Column, prime: int) -> Column:
    """The UTF-8 bytes of a text, read as one big number, modulo a prime under 2 ** 54."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)(?=.)", "$1,"), ","), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: (acc * 256 + x) % prime)


def filter_places(ids: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES, prime: int = BLOOM_PRIME) -> DataFrame:
    """id, seq, bit: the places of each id in the filter. The id is reduced modulo prime."""
    x = F.pmod("id", F.lit(prime))
    at = F.array(*[((F.lit(a) * x + F.lit(b)) % prime) % bits for a, b in parameters(hashes, bits)])
    return ids.select("id", "seq", F.explode(at).alias("bit"))


def bloom_rates(events: DataFrame, number: Column, batch_size: int, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES, prime: int = BLOOM_PRIME) -> DataFrame:
    """batch, n_false, n_new, fpr, fpr_new: first occurrences that the filter takes for seen ones.

    number is the id as an integer; it is reduced modulo prime. fpr is over the batch's events, fpr_new over its new
    ids. Events that share an id share their bits, so only the first of an id can be a false positive.
    """
    first = events.select("seq", number.cast("long").alias("id")).groupBy("id").agg(F.min("seq").alias("seq"))
    places = filter_places(first, bits, hashes, prime)
    set_at = places.groupBy("bit").agg(F.min("seq").alias("set_at"))
    known = places.join(set_at, "bit").groupBy("id", "seq").agg(F.max("set_at").alias("last_set"))
    false = known.groupBy(F.expr(f"seq div {batch_size}").alias("batch")).agg(F.count(F.when(F.col("last_set") < F.col("seq"), 1)).alias("n_false"), F.count("*").alias("n_new"))
    size = batches(events, batch_size).select("batch", "n_events")
    r = size.join(false, "batch", "left").select("batch", "n_events", F.coalesce("n_false", F.lit(0)).alias("n_false"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return r.select("batch", "n_false", "n_new", (F.col("n_false") / F.col("n_events")).alias("fpr"), F.when(F.col("n_new") > 0, F.col("n_false") / F.col("n_new")).alias("fpr_new"))


def filter_counters(rates: DataFrame, events: DataFrame, batch_size: int) -> DataFrame:
    """batch, true_positive, false_positive, true_negative, false_negative of each batch's events, from bloom_rates.

    An event of a seen id is always positive, one of a new id positive only by error.
    """
    size = batches(events, batch_size).select("batch", "n_events")
    return rates.join(size, "batch").select("batch", (F.col("n_events") - F.col("n_new")).alias("true_positive"), F.col("n_false").alias("false_positive"), (F.col("n_new") - F.col("n_false")).alias("true_negative"), F.lit(0).cast("long").alias("false_negative"))


def trailing_zeros(h: Column) -> Column:
    """Trailing zero bits; none for 0."""
    return F.when(h == 0, 0).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))


def batch_ids(events: DataFrame, number: Column, batch_size: int) -> DataFrame:
    """batch, x: the batch of each event and its id modulo the prime."""
    return events.select(F.expr(f"seq div {batch_size}").alias("batch"), F.pmod(number.cast("long"), F.lit(COUNT_PRIME)).alias("x"))


def _zeros_of(hashes: int):
    """Of each frame and batch the most trailing zeros of every hash, as rows of a batch and an array."""
    a, b = (np.array(x, dtype=np.uint64)[:, None] for x in zip(*parameters(hashes, 4_294_967_295)))
    prime, top, low = np.uint64(COUNT_PRIME), np.uint64(COUNT_RANGE), np.uint64(65_535)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.sort_values("batch")
            for at in range(0, len(f), 5_000):
                batch, x = f["batch"].to_numpy()[at : at + 5_000], f["x"].to_numpy()[at : at + 5_000].astype(np.uint64)
                # Products stay within 64 bits by cutting a into two parts.
                h = (((a >> np.uint64(16)) * x) % prime * np.uint64(65_536) + (a & low) * x + b) % prime % top
                zeros = np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)).astype(np.int32)
                zeros[h == 0] = 0
                starts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])
                yield pd.DataFrame({"batch": batch[starts], "zeros": [*np.maximum.reduceat(zeros, starts, axis=1).T]})

    return fold


def most_zeros(ids: DataFrame, hashes: int = 300) -> DataFrame:
    """batch, hash_no, zeros: the most trailing zeros of each hash over the batch's ids.

    Each task folds its ids into one array a batch, so what is shuffled are those and not ids times hashes.
    """
    folded = ids.select("batch", "x").mapInPandas(_zeros_of(hashes), "batch long, zeros array<int>")
    return folded.select("batch", F.posexplode("zeros").alias("hash_no", "zeros")).groupBy("batch", "hash_no").agg(F.max("zeros").alias("zeros"))


def estimates_of(zeros: DataFrame, distinct: DataFrame, group: int = 5) -> DataFrame:
    """batch, n_distinct, estimate: the median over groups of hashes of the mean of 2 ** zeros, rounded half to even."""
    grouped = zeros.groupBy("batch", F.expr(f"hash_no div {group}").alias("g")).agg(F.avg(F.pow(F.lit(2.0), F.col("zeros"))).alias("m"))
    return distinct.join(grouped.groupBy("batch").agg(F.bround(F.median("m"), 0).alias("estimate")), "batch").select("batch", "n_distinct", "estimate")


def distinct_estimates(events: DataFrame, number: Column, batch_size: int, hashes: int = 300, group: int = 5) -> DataFrame:
    """batch, n_distinct, estimate: exact and estimated distinct ids of each batch."""
    ids = batch_ids(events, number, batch_size).distinct()
    return estimates_of(most_zeros(ids, hashes), ids.groupBy("batch").agg(F.count("*").alias("n_distinct")), group)


def estimate_totals(estimates: DataFrame) -> DataFrame:
    """One row: the sums of truth and estimate over all batches."""
    return estimates.agg(F.sum("n_distinct").alias("n_distinct"), F.sum("estimate").alias("estimate"))


def sketched_distinct(df: DataFrame, key: str, by: str) -> DataFrame:
    """by, estimate with the engine's own mergeable sketch."""
    return df.groupBy(by).agg(F.approx_count_distinct(key).alias("estimate"))


def positional_sample(events: DataFrame, value: str, size: int = 100, at: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """seqnum and one column a place: the batch's elements at fixed places; null where a batch is shorter."""
    place = F.col("seq") % size
    picked = events.where(place.isin(*at)).groupBy(F.expr(f"seq div {size}").alias("batch")).agg(*[F.max(F.when(place == k, F.col(value))).alias(f"id_{k}") for k in at])
    return picked.select(((F.col("batch") + 1) * 100).alias("seqnum"), *[f"id_{k}" for k in at])
