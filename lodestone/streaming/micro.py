"""Structured-streaming twins of the event sketches, and event-time windows.

Events are numbered upstream and carry their number, so no result depends on how triggers cut the stream. Offsets,
state and results are kept in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shuffle import stage_dir
from lodestone.operators import sketches


def as_stream(events: DataFrame, files: int = 4, order: str = "seq") -> DataFrame:
    """The rows of a numbered table as a stream of files in order, one a trigger.

    One pass cuts the table into ranges, and as many tasks write them; their times are then set in the ranges' order,
    which is the order a file source reads in.
    """
    spark = events.sparkSession
    path = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    now = jvm.System.currentTimeMillis()
    for k, part in enumerate(parts):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(part), now - 1_000 * (len(parts) - k), -1)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All results of a query over what the source has now. mode: complete or append."""
    spark = stream.sparkSession
    out = f"{stage_dir(spark)}/drained-{uuid.uuid4().hex}"
    save = "overwrite" if mode == "complete" else "append"

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode(save).parquet(f"{out}/rows")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_positional(stream: DataFrame, value: str, size: int = 100, at: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    return sketches.positional_sample(stream, value, size, at)


def stream_zeros(stream: DataFrame, number: Column, batch_size: int, hashes: int = 300) -> DataFrame:
    """batch, hash_no, zeros as in the table form; the state of a batch is one number a hash."""
    return sketches.most_zeros(sketches.batch_ids(stream, number, batch_size), hashes)


def stream_ids(stream: DataFrame, number: Column, batch_size: int) -> DataFrame:
    """batch, x: each id of a batch once."""
    return sketches.batch_ids(stream, number, batch_size).dropDuplicates(["batch", "x"])


def stream_bloom(stream: DataFrame, number: Column, batch_size: int, bits: int = sketches.BLOOM_BITS, hashes: int = sketches.BLOOM_HASHES, prime: int = sketches.BLOOM_PRIME) -> DataFrame:
    """batch, n_false, n_new, n_events of a stream that comes in the order of seq, drained.

    The state is two tables in the shared folder: the ids seen, and since when each bit of the filter is set. A trigger
    joins its events with them and appends what is new, so neither is held by one task. A trigger that is run again
    overwrites its own part of them.
    """
    spark = stream.sparkSession
    path = f"{stage_dir(spark)}/filter-{uuid.uuid4().hex}"
    kinds = {"ids": "id long", "bits": "bit long, since long", "counts": "batch long, n_false long, n_new long, n_events long"}
    told: list[int] = []

    def state(name: str, before: int | None = None) -> DataFrame:
        parts = [f"{path}/{name}/{k}" for k in told if before is None or k < before]
        return spark.read.schema(kinds[name]).parquet(*parts) if parts else spark.createDataFrame([], kinds[name])

    def step(rows: DataFrame, k: int) -> None:
        rows = rows.persist()
        first = rows.groupBy("id").agg(F.min("seq").alias("seq")).join(state("ids", k), "id", "left_anti")
        first.select("id").write.mode("overwrite").parquet(f"{path}/ids/{k}")
        places = sketches.filter_places(first, bits, hashes, prime).persist()
        known = state("bits", k)
        fresh = places.groupBy("bit").agg(F.min("seq").alias("since")).join(known.select("bit"), "bit", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/bits/{k}")
        since = known.unionByName(spark.read.schema(kinds["bits"]).parquet(f"{path}/bits/{k}"))
        judged = places.join(since, "bit").groupBy("id", "seq").agg(F.max("since").alias("last_set"))
        new = judged.groupBy(F.expr(f"seq div {batch_size}").alias("batch")).agg(F.count(F.when(F.col("last_set") < F.col("seq"), 1)).alias("n_false"), F.count("*").alias("n_new"))
        size = sketches.batches(rows, batch_size).select("batch", "n_events")
        of = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        size.join(new, "batch", "left").select("batch", of("n_false"), of("n_new"), "n_events").write.mode("overwrite").parquet(f"{path}/counts/{k}")
        places.unpersist()
        rows.unpersist()
        if k not in told:
            told.append(k)

    ids = stream.select("seq", number.cast("long").alias("id"))
    ids.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return state("counts").groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("n_false", "n_new", "n_events")])


def bloom_rates_of(counts: DataFrame) -> DataFrame:
    return counts.select("batch", "n_false", "n_new", (F.col("n_false") / F.col("n_events")).alias("fpr"), F.when(F.col("n_new") > 0, F.col("n_false") / F.col("n_new")).alias("fpr_new"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, key, n_events, on a stream or a table; a stream forgets windows older than `late`."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), key, "n_events")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "6 hours") -> DataFrame:
    """key, session_start, session_end, n_events: runs of events with less than `gap` between neighbours."""
    w = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return w.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files under a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)
