"""Counts, top lists, averages over a join, and what lies in which partition."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: str) -> Column:
    """A scalar: the number of distinct keys, null as one of them."""
    return df.select(F.struct(key).alias("k")).agg(F.count_distinct("k")).scalar()


def review_counts(reviews: DataFrame, year: str, user: str = "user_id", business: str = "business_id", date: str = "review_date") -> DataFrame:
    """One row: reviews, reviews whose date text contains the year, distinct users and businesses (null is one)."""
    k = lambda c: F.count_distinct(F.struct(c))
    return reviews.agg(F.count("*").alias("n_review"), F.count(F.when(F.col(date).contains(year), 1)).alias("n_review_year"), k(user).alias("n_user"), k(business).alias("n_business"))


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """key, n: the k keys with most rows, ties by key; null is a key and comes last among ties."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(k)


def city_averages(reviews: DataFrame, businesses: DataFrame, key: str = "business_id", city: str = "city", stars: str = "stars") -> DataFrame:
    """city, avg_stars over all reviews; those whose business is missing form the null city.

    The reviews are summed per business before the join, so a business with a tenth of all rows joins as one row.
    """
    per = reviews.groupBy(key).agg(F.sum(stars).alias("total"), F.count(stars).alias("n"))
    joined = per.join(businesses.select(key, city), key, "left")
    sums = joined.groupBy(city).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(city, F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avg_stars"))


def by_average(averages: DataFrame, city: str = "city") -> DataFrame:
    return averages.orderBy(F.desc("avg_stars"), F.asc_nulls_last(city))


def top_by_driver(averages: DataFrame, k: int = 10, city: str = "city") -> list:
    """The first k rows of by_average, by a sort in the driver's program; for comparison, and for a bounded number of cities."""
    return sorted(averages.collect(), key=lambda r: (r["avg_stars"] is None, -(r["avg_stars"] or 0.0), r[city] is None, r[city] or ""))[:k]


def compared_sorts(averages: DataFrame, k: int = 10, city: str = "city") -> dict[str, tuple[float, list]]:
    """Seconds and rows of the top k: m1 collects all and sorts in the driver's program, m2 leaves it to the engine."""
    out = {}
    for name, run in (("m1", lambda: top_by_driver(averages, k, city)), ("m2", lambda: by_average(averages, city).limit(k).collect())):
        began = time.perf_counter()
        rows = run()
        out[name] = (time.perf_counter() - began, rows)
    return out


def partition_sizes(df: DataFrame, n: int) -> DataFrame:
    """partition_no, n_items for 0 to n - 1, empty partitions as 0."""
    got = df.groupBy(F.spark_partition_id().alias("partition_no")).agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition_no"))
    return every.join(got, "partition_no", "left").select("partition_no", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def partition_report(df: DataFrame, key: str, n: int) -> DataFrame:
    """layout, partition_no, n_items of the table as it is read, and hashed by key into n partitions."""
    read = df.rdd.getNumPartitions()
    of = lambda x, k, name: partition_sizes(x, k).select(F.lit(name).alias("layout"), "partition_no", "n_items")
    return of(df, read, "default").unionByName(of(df.repartition(n, key), n, "customized"))


def timed(df: DataFrame) -> float:
    """Seconds to compute all of df, written nowhere."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
