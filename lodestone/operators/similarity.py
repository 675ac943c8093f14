"""Ordinals, minhash signatures and banded candidates for the Jaccard similarity of sets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.functions.shuffle import partitions, stage

PRIME = 2_147_483_647


def hash_parameters(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b) by a fixed rule, a in 1 to PRIME - 1."""
    at = lambda i: (i * 2_654_435_761 + 12_345) % 4_294_967_296
    return [(at(2 * i + 1) % (PRIME - 1) + 1, at(2 * i + 2) % PRIME) for i in range(n)]


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """key, ordinal: 0, 1, ... over the sorted distinct keys that are not null.

    Keys are range-partitioned and numbered within their range; a range's offset is the count of the ranges before.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = max(partitions(keys.sparkSession), keys.sparkSession.sparkContext.defaultParallelism)
    ranged = stage(keys.repartitionByRange(n, key).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("k"))
    before = sizes.select("_p", (F.sum("k").over(Window.orderBy("_p")) - F.col("k")).alias("before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(before), "_p").select(key, (F.col("before") + F.col("own")).alias("ordinal"))


def signatures(df: DataFrame, record: str, element: str, n: int = 30) -> DataFrame:
    """record, h0 ... : the least of ((a * x + b) % PRIME) % m over the record's elements x, m the number of elements.

    Minima are folded per task before the shuffle, so a record with many elements sends one row of minima per task.
    """
    index = ordinals(df, element)
    m = F.greatest(index.agg(F.count("*")).scalar(), F.lit(1))
    rows = df.select(F.col(record).alias("record"), element).dropna().distinct().join(index, element).withColumn("m", m)
    return rows.groupBy("record").agg(*[F.min(((F.lit(a) * F.col("ordinal") + F.lit(b)) % PRIME) % F.col("m")).alias(f"h{i}") for i, (a, b) in enumerate(hash_parameters(n))])


def bands(signature: DataFrame, n: int = 30, rows: int = 2) -> DataFrame:
    """record, band, part: the signature cut into groups of `rows`."""
    part = lambda i: F.struct(F.lit(i // rows).alias("band"), F.array(*[F.col(f"h{j}") for j in range(i, i + rows)]).alias("part"))
    return signature.select("record", F.explode(F.array(*[part(i) for i in range(0, n, rows)])).alias("b")).select("record", "b.band", "b.part")


def exact_jaccard(df: DataFrame, record: str, element: str, candidates: DataFrame) -> DataFrame:
    """record_1, record_2, similarity of candidate pairs on their sets of distinct elements."""
    rows = df.select(F.col(record).alias("record"), F.col(element).alias("element")).dropna().distinct()
    size = rows.groupBy("record").agg(F.count("*").alias("n"))
    side = lambda k: size.select(F.col("record").alias(f"record_{k}"), F.col("n").alias(f"n{k}"))
    held = lambda k: rows.withColumnRenamed("record", f"record_{k}")
    both = candidates.join(held(1), "record_1").join(held(2), ["record_2", "element"]).groupBy("record_1", "record_2").agg(F.count("*").alias("both"))
    return both.join(side(1), "record_1").join(side(2), "record_2").select("record_1", "record_2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("similarity"))


def overlap_jaccard(df: DataFrame, record: str, element: str) -> DataFrame:
    """record_1 < record_2, similarity of all pairs that share an element; every other pair has similarity 0."""
    size = df.select(F.col(record).alias("record"), F.col(element).alias("element")).dropna().distinct().groupBy("record").agg(F.count("*").alias("n"))
    side = lambda k: size.select(F.col("record").alias(f"record_{k}"), F.col("n").alias(f"n{k}"))
    both = pairs_sharing(df, record, element, 1).join(side(1), "record_1").join(side(2), "record_2")
    return both.select("record_1", "record_2", (F.col("n_shared") / (F.col("n1") + F.col("n2") - F.col("n_shared"))).alias("similarity"))


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """record_1 < record_2 that agree in all rows of some band."""
    side = lambda k: banded.select("band", "part", F.col("record").alias(f"record_{k}"))
    return side(1).join(side(2), ["band", "part"]).where(F.col("record_1") < F.col("record_2")).select("record_1", "record_2").distinct()


def lsh_pairs(df: DataFrame, record: str, element: str, threshold: float = 0.5, n: int = 30, rows: int = 2) -> DataFrame:
    """Pairs that share a band and whose sets reach the threshold."""
    found = candidate_pairs(bands(signatures(df, record, element, n), n, rows))
    return exact_jaccard(df, record, element, found).where(F.col("similarity") >= threshold)


def _sized_rows(df: DataFrame, record: str, element: str) -> DataFrame:
    """record, element, k, rank: distinct rows of records with k elements, each element's rank within its record by rarity."""
    rows = df.select(F.col(record).alias("record"), F.col(element).alias("element")).dropna().distinct()
    common = rows.groupBy("element").agg(F.count("*").alias("n"))
    ranked = rows.join(common, "element").where(F.col("n") > 1)
    own = Window.partitionBy("record").orderBy("n", "element")
    return ranked.withColumn("rank", F.row_number().over(own)).withColumn("k", F.count("*").over(Window.partitionBy("record")))


def pairs_sharing(df: DataFrame, record: str, element: str, least: int) -> DataFrame:
    """record_1 < record_2 and n_shared, for records that share at least `least` distinct elements.

    Two such records share one of the k - least + 1 rarest of their k elements that others have too, so candidates are
    joined on these alone and the most common elements make no pairs of their own. For least = 1 all are joined, as
    every shared element is a pair of the result. Candidates are counted on the whole sets.
    """
    rows = stage(_sized_rows(df, record, element).where(F.col("k") >= least))
    side = lambda r, k: r.select("element", F.col("record").alias(f"record_{k}"))
    first = rows.where(F.col("rank") <= F.col("k") - least + 1)
    met = side(first, 1).join(side(first, 2), "element").where(F.col("record_1") < F.col("record_2"))
    if least == 1:
        return met.groupBy("record_1", "record_2").agg(F.count("*").alias("n_shared"))
    found = met.select("record_1", "record_2").distinct()
    both = found.join(side(rows, 1), "record_1").join(side(rows, 2), ["record_2", "element"])
    return both.groupBy("record_1", "record_2").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)


def similar_pairs(df: DataFrame, record: str, element: str, threshold: float) -> DataFrame:
    """record_1 < record_2, similarity of all pairs whose sets' Jaccard similarity is at least threshold (over 0). Exact.

    Two such sets share one of the n - ceil(threshold * n) + 1 rarest of their n elements, and the smaller has at least
    threshold times the larger's; candidates are joined on these alone and counted on the whole sets.
    """
    rows = df.select(F.col(record).alias("record"), F.col(element).alias("element")).dropna().distinct()
    common = rows.groupBy("element").agg(F.count("*").alias("df"))
    own = Window.partitionBy("record")
    ranked = rows.join(common, "element").withColumn("rank", F.row_number().over(own.orderBy("df", "element"))).withColumn("n", F.count("*").over(own))
    rows = stage(ranked.select("record", "element", "rank", "n"))
    first = rows.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    side = lambda r, k: r.select("element", F.col("record").alias(f"record_{k}"), F.col("n").alias(f"n{k}"))
    fits = (F.col("record_1") < F.col("record_2")) & (F.col("n1") >= F.col("n2") * threshold - 1e-9) & (F.col("n2") >= F.col("n1") * threshold - 1e-9)
    found = side(first, 1).join(side(first, 2), "element").where(fits).select("record_1", "record_2", "n1", "n2").distinct()
    both = found.join(side(rows, 1).drop("n1"), "record_1").join(side(rows, 2).drop("n2"), ["record_2", "element"]).groupBy("record_1", "record_2", "n1", "n2").agg(F.count("*").alias("both"))
    return both.select("record_1", "record_2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)
