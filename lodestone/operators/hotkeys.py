"""Problem 1: complete per-key results although a few keys hold most rows.

Rows become one per record id first: a count of the bare ids finds those delivered more than once, and only their rows
are shuffled to pick the last delivery. Each task then folds its rows into a hash table of mergeable states (count,
count of values, sum), which the engine spills when it outgrows its memory, and only those compact states are shuffled
by key. A key with a third of all rows thus sends one state per task, and no task gets more than that many states of it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import broadcast_if_small, stage


def latest_records(df: DataFrame, record_id: str, carried: list[str], delivered: str) -> DataFrame:
    """One row per record id: of repeated deliveries the last, ties broken by the carried values.

    A null record id names no record and is left out. Columns: record_id and the carried ones. The repeated ids are
    broadcast if their size allows it; else the rows are joined with them by shuffles.
    """
    rows = df.where(F.col(record_id).isNotNull()).select(record_id, *carried, delivered)
    again = stage(rows.groupBy(record_id).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(record_id))
    known = broadcast_if_small(again)
    last = F.max(F.struct(F.col(delivered).alias("_at"), *[F.col(c) for c in carried])).alias("_r")
    picked = rows.join(known, record_id, "left_semi").groupBy(record_id).agg(last)
    once = rows.join(known, record_id, "left_anti").select(record_id, *carried)
    return once.unionByName(picked.select(record_id, *[F.col(f"_r.{c}").alias(c) for c in carried]))


def key_states(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    """field_name, key_id, n_records, n_values, total: one row per field and key, the null key included.

    Null values count as records and not as values. An empty table gives no rows.
    """
    one = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_id"), F.col(value).cast("double").alias("v"))
    long = df.select(F.explode(F.array(*[one(f) for f in fields])).alias("_k")).select("_k.*")
    return long.groupBy("field_name", "key_id").agg(F.count("*").alias("n_records"), F.count("v").alias("n_values"), F.sum("v").alias("total"))


def key_averages(states: DataFrame) -> DataFrame:
    """Counts and averages of every key but null; avg_value is null where a key has no values."""
    return states.where(F.col("key_id").isNotNull()).select("field_name", "key_id", "n_records", F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values")).alias("avg_value"))


def heavy_keys(states: DataFrame, share: float) -> DataFrame:
    """The keys with at least `share` of all records of their field; null is no key but its records count in the whole.

    states is read twice, for the whole and for the keys, and staged for that.
    """
    part, held = Fraction(str(share)), stage(states.select("field_name", "key_id", "n_records"))
    # Every field counts every record once, so the sum over all fields' keys is the whole times the fields.
    whole = held.agg(F.expr("sum(n_records) div count(distinct field_name)").alias("n")).scalar()
    big = F.col("n_records") * F.lit(part.denominator) >= whole * F.lit(part.numerator)
    return held.where(F.col("key_id").isNotNull() & big)
