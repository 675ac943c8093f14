"""Rating models: boosted trees, and out-of-fold stacking of two base models under a linear one."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import stage
from lodestone.operators import trees as grown

SIMPLE = ("u_count", "u_avg", "b_count", "b_avg", "u_useful")
INDEXED = ("user_idx", "business_idx", *SIMPLE)


#: Rows a task of a fit works on at least; a fit is many short jobs, and tasks of fewer rows are a burden.
ROWS_A_TASK = 5_000
#: Rows a task works on at most, where there is more than a task a core.
MOST_ROWS_A_TASK = 100_000
#: Bytes that a task which makes a model alone may hold, with another beside it in an executor of 3 GB; some 3.7 million rows of 47 features.
MOST_BYTES_A_MODEL = 600_000_000


def held(df: DataFrame) -> DataFrame:
    """df in memory, dealt out evenly to a task a core, to fewer if it is small and to more if it is large; unpersist it when the fits are done."""
    rows = df.persist()
    n = rows.count()
    tasks = min(-(-n // ROWS_A_TASK), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_ROWS_A_TASK)))
    few = rows.repartition(max(1, tasks)).persist()
    few.count()
    rows.unpersist()
    return few


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def boosted(train: DataFrame, test: DataFrame, columns: list[str], trees: int = 100, depth: int = 5, step: float = 0.1) -> DataFrame:
    """test with a prediction by boosted trees fitted to train's stars."""
    rows = held(assembled(train, columns).select("stars", "features"))
    model = GBTRegressor(labelCol="stars", maxIter=trees, maxDepth=depth, stepSize=step, seed=42, maxMemoryInMB=512).fit(rows)
    rows.unpersist()
    return model.transform(assembled(test, columns)).drop("features")


def stacked(train: DataFrame, test: DataFrame, columns: list[str], key: list[str], folds: int = 5, trees: int = 200, forest: int = 100, most_bytes: int = MOST_BYTES_A_MODEL) -> DataFrame:
    """test with a prediction by a linear model over two base models.

    Each base model is fitted once per fold on the other folds and predicts the fold left out; the linear model learns
    from these predictions. On test a base model's prediction is the mean over folds. Folds go by a hash of the key.
    The fits run at once: a task each where a fold's other rows come to most_bytes at most, else as jobs over one table
    kept in memory until they are done.
    """
    kept = {"maxMemoryInMB": 512, "seed": 42, "labelCol": "stars"}
    makers = [lambda: GBTRegressor(maxIter=trees, maxDepth=5, stepSize=0.1, **kept), lambda: RandomForestRegressor(numTrees=forest, maxDepth=6, **kept)]
    rows = stage(train.select(*key, "stars", *columns, F.pmod(F.xxhash64(*key, F.lit(42)), F.lit(folds)).cast("int").alias("fold")))
    want = stage(test.select(*key, *columns))
    most = rows.groupBy("fold").count().agg(F.sum("count") - (F.min("count") if folds > 1 else 0)).first()[0] or 0
    boost, wood = (make() for make in makers)
    places = grown.Codes(grown.cuts(rows, columns, min(boost.getMaxBins(), wood.getMaxBins())), ["user" if c.startswith("u_") else "item" for c in columns])
    if most * grown.bytes_a_row(places) <= most_bytes:
        coded = grown.chunks(rows, columns, places)
        models = grown.fits(coded, places, folds, grown.asked(boost), grown.asked(wood))
        left_out, on_test = stage(grown.of_left_out(coded, places, models)), grown.of_new(want, key, columns, places, models, folds)
    else:
        left_out, on_test = _by_jobs(rows, want, columns, key, folds, makers)
    meta = LinearRegression(labelCol="stars", featuresCol="base").fit(VectorAssembler(inputCols=["p0", "p1"], outputCol="base").transform(left_out))
    base = VectorAssembler(inputCols=["p0", "p1"], outputCol="base").transform(on_test)
    return meta.transform(base).select(*key, "prediction")


def _by_jobs(rows: DataFrame, want: DataFrame, columns: list[str], key: list[str], folds: int, makers: list) -> tuple[DataFrame, DataFrame]:
    """stars, p0, p1 of the rows left out, and the key, p0, p1 of those wanted, by models fitted in jobs over all partitions."""
    rows, on_test = held(assembled(rows, columns).select("stars", "features", "fold")), assembled(want, columns).select(*key, "features")
    fit = lambda k: makers[k[1]]().setPredictionCol(f"p{k[1]}").fit(rows.where(F.col("fold") != k[0]))
    keys = [(fold, i) for fold in range(folds) for i in range(len(makers))]
    with ThreadPoolExecutor(len(keys)) as pool:  # the fits are many short jobs
        models = dict(zip(keys, pool.map(fit, keys)))
    left_out = None
    for fold in range(folds):
        part = rows.where(F.col("fold") == fold)
        for i in range(len(makers)):
            model = models[fold, i]
            part = model.transform(part)
            on_test = model.setPredictionCol(f"t{i}_{fold}").transform(on_test)
        part = part.select("stars", "p0", "p1")
        left_out = part if left_out is None else left_out.unionByName(part)
    left_out = stage(left_out)
    rows.unpersist()
    mean = lambda i: (sum((F.col(f"t{i}_{k}") for k in range(folds)), F.lit(0.0)) / folds).alias(f"p{i}")
    return left_out, on_test.select(*key, mean(0), mean(1))
