"""Helpers that keep hot keys and long lineages under control."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only on a local master, where all executors are one process, is one under the warehouse taken if none is named; on a
    cluster a missing name is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return path


def stage_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a read and not the whole history; columnar, so it is far smaller than
    a checkpoint of rows. An empty df keeps its schema. drop_staged removes the tables when their results are no longer
    read.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables that this application has staged."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(staged: DataFrame, most_bytes: int = 32_000_000) -> bool:
    """Whether a staged table's rows come to no more than most_bytes, at 32 bytes a row besides 8 a column and the texts' own lengths."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in staged.dtypes if kind == "string"]
    size = staged.agg(F.sum(sum(texts, F.lit(32 + 8 * len(staged.columns)))).alias("n")).first()["n"] or 0
    return size <= most_bytes


def broadcast_if_small(staged: DataFrame, most_bytes: int = 32_000_000) -> DataFrame:
    """A staged table, marked for broadcast if it is small; else as it is."""
    return F.broadcast(staged) if is_small(staged, most_bytes) else staged


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where single keys may hold much of `left` while `right` has few rows a key. left is read twice.

    A key with more rows than a partition's fair share is spread over as many parts as it has shares, and right's rows
    of that key are repeated once a part; all other keys are left alone. There are at most as many such keys as
    partitions, so they are broadcast. how: inner or left. A null key matches nothing.
    """
    spark = left.sparkSession
    parts = partitions(spark)
    key = [F.col(f"`{c}`") for c in on]
    counts = left.groupBy(*on).agg(F.count("*").alias("_n")).where(sum((k.isNull().cast("int") for k in key), F.lit(0)) == 0)
    total = left.count()
    hot = stage(counts.where(F.col("_n") * parts > total).select(*on, F.ceil(F.col("_n") * parts / max(total, 1)).cast("int").alias("_parts")))
    if hot.isEmpty():
        return left.join(right, on, how)
    rest = [c for c in left.columns if c not in on]
    part = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (rest or on)]), part).cast("int")
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_parts")
    spread = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), part - 1))).drop("_parts")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash df by cols into a fixed number of partitions, which adaptive execution does not merge.

    For steps whose work is far larger than their bytes, where merging small partitions would leave cores idle. The
    number is the session's spark.sql.shuffle.partitions, which follows the data, and three a core at least.
    """
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), 3 * spark.sparkContext.defaultParallelism), *cols)


def on_all_cores(df: DataFrame) -> DataFrame:
    """df, dealt out anew only if it comes in fewer partitions than there are cores.

    For long work on each row of a small table; a large one has its many splits already and is left as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
