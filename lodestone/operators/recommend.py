"""Item-based collaborative filtering with Pearson weights, blending, and the evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.functions.shuffle import is_small, salted_join, stage
from lodestone.operators.similarity import ordinals

NOTHING_KNOWN = 3.0


def ratings(df: DataFrame) -> DataFrame:
    """user, item, stars without rows that lack any of them."""
    return df.select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), F.col("stars").cast("double").alias("stars")).dropna()


def means(rated: DataFrame, key: str) -> DataFrame:
    """key, n_ratings, avg_stars over all rows."""
    return rated.groupBy(key).agg(F.count("*").alias("n_ratings"), F.avg("stars").alias("avg_stars"))


def single(rated: DataFrame) -> DataFrame:
    """One rating per user and item, the mean of repeated ones."""
    return rated.groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def pearson_weights(rated: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_1 <= item_2 and weight for each wanted pair (canonical, distinct).

    Over the users who rated both: Pearson's r with means over these users; 1 if either side is constant. Without such
    users: the smaller of the items' overall means by the larger. The less-rated item's users are looked up with the
    other item, so an item with a large share of all ratings costs no more than its partner.
    """
    one = single(rated)
    size = one.groupBy("item").agg(F.count("*").alias("n"))
    mean = means(rated, "item").select("item", "avg_stars")
    of = lambda df, k, c: df.select(F.col("item").alias(f"item_{k}"), *[F.col(x).alias(f"{x}_{k}") for x in c])
    sized = wanted.join(of(size, 1, ["n"]), "item_1").join(of(size, 2, ["n"]), "item_2")
    first = F.col("n_1") <= F.col("n_2")
    probe = sized.select("item_1", "item_2", F.when(first, F.col("item_1")).otherwise(F.col("item_2")).alias("few"), F.when(first, F.col("item_2")).otherwise(F.col("item_1")).alias("many"))
    x = one.select(F.col("item").alias("few"), "user", F.col("stars").alias("x"))
    y = one.select(F.col("item").alias("many"), "user", F.col("stars").alias("y"))
    co = probe.join(x, "few").join(y, ["many", "user"])
    found = wanted.join(_sums(co), ["item_1", "item_2"], "left").join(of(mean, 1, ["avg_stars"]), "item_1").join(of(mean, 2, ["avg_stars"]), "item_2")
    ratio = F.least("avg_stars_1", "avg_stars_2") / F.greatest("avg_stars_1", "avg_stars_2")
    return found.select("item_1", "item_2", F.when(F.col("n").isNull(), ratio).otherwise(_pearson()).alias("weight"))


def _sums(co: DataFrame) -> DataFrame:
    """item_1, item_2, n, xy, xx, yy over the users who rated both with x and y."""
    s = lambda e: F.sum(e)
    n, sx, sy = F.count("*"), s("x"), s("y")
    return co.groupBy("item_1", "item_2").agg(n.alias("n"), (s(F.col("x") * F.col("y")) - sx * sy / n).alias("xy"), (s(F.col("x") * F.col("x")) - sx * sx / n).alias("xx"), (s(F.col("y") * F.col("y")) - sy * sy / n).alias("yy"))


def _pearson() -> Column:
    """Pearson's r from xy, xx and yy; 1 if either side is constant."""
    return F.when((F.col("xx") < 1e-9) | (F.col("yy") < 1e-9), 1.0).otherwise(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))


def pearson_sharing(rated: DataFrame, least: int, most_items: int = 10_000) -> DataFrame:
    """item_1 < item_2 and weight, as in pearson_weights, for all pairs of items with at least `least` users in common.

    Each two ratings of a user are met once and summed by pair, so an item with a large share of all ratings costs its
    ratings and not those times its partners. Items are their ordinals until the end. Of the users with over most_items
    ratings an item leaves out its `least` - 1 most active ones, who cannot make a pair alone; pairs met by others get
    these users' ratings afterwards.
    """
    index = stage(ordinals(rated, "item"))
    small = is_small(index)
    coded = rated.join(F.broadcast(index), "item") if small else salted_join(rated, index, ["item"])
    rows = coded.select("user", F.col("ordinal").alias("item"), "stars").repartition("user").groupBy("user", "item").agg(F.avg("stars").alias("stars"))
    side = lambda r, k, x: r.select("user", F.col("item").alias(f"item_{k}"), F.col("stars").alias(x))
    met = lambda r: side(r, 1, "x").join(side(r, 2, "y"), "user").where(F.col("item_1") < F.col("item_2")).select("item_1", "item_2", "x", "y")
    active = stage(rated.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") > most_items))
    if least == 1 or active.isEmpty():
        co = met(rows)
    else:
        rows = stage(rows)
        order = Window.partitionBy("item").orderBy(F.desc("n"), "user")
        out = stage(rows.join(F.broadcast(active), "user").withColumn("k", F.row_number().over(order)).where(F.col("k") < least).drop("n", "k"))
        kept = rows.join(out, ["user", "item"], "left_anti")
        pairs = stage(met(kept).select("item_1", "item_2").distinct())
        first = pairs.join(side(out, 1, "x"), "item_1").join(side(rows, 2, "y"), ["user", "item_2"])
        second = pairs.join(side(out, 2, "y"), "item_2").join(side(kept, 1, "x"), ["user", "item_1"])
        co = met(kept).unionByName(first.drop("user")).unionByName(second.drop("user"))
    found = _sums(co).where(F.col("n") >= least).select("item_1", "item_2", _pearson().alias("weight"))
    for k in (1, 2):
        name = index.select(F.col("ordinal").alias(f"item_{k}"), F.col("item").alias(f"name_{k}"))
        found = found.join(F.broadcast(name) if small else name, f"item_{k}")
    return found.select(F.col("name_1").alias("item_1"), F.col("name_2").alias("item_2"), "weight")


def predictions(rated: DataFrame, targets: DataFrame, neighbours: int = 100) -> DataFrame:
    """user, item, prediction for the distinct (user, item) of targets.

    Unknown user and item: 3. Unknown user: the item's mean. Unknown item, or no neighbour of positive weight: the
    user's mean. Else the mean of the user's ratings weighted by the items' weights, over the `neighbours` largest,
    ties by item; the target itself is not left out. Null ids are unknown.
    """
    wanted = targets.select("user", "item").distinct()
    user_mean = means(rated, "user").select("user", F.col("avg_stars").alias("user_mean"))
    item_mean = means(rated, "item").select("item", F.col("avg_stars").alias("item_mean"))
    known = wanted.join(user_mean, "user", "left").join(item_mean, "item", "left")
    mine = single(rated).select("user", F.col("item").alias("other"), "stars")
    near = known.where(F.col("user_mean").isNotNull() & F.col("item_mean").isNotNull()).select("user", "item").join(mine, "user")
    near = near.withColumn("item_1", F.least("item", "other")).withColumn("item_2", F.greatest("item", "other"))
    weights = pearson_weights(rated, near.select("item_1", "item_2").distinct())
    best = Window.partitionBy("user", "item").orderBy(F.desc(F.round("weight", 9)), "other")
    top = near.join(weights, ["item_1", "item_2"]).where(F.col("weight") > 1e-9).withColumn("k", F.row_number().over(best)).where(F.col("k") <= neighbours)
    weighted = top.groupBy("user", "item").agg((F.sum(F.col("weight") * F.col("stars")) / F.sum(F.abs("weight"))).alias("weighted"))
    return known.join(weighted, ["user", "item"], "left").select("user", "item", F.coalesce("weighted", "user_mean", "item_mean", F.lit(NOTHING_KNOWN)).alias("prediction"))


def blended(first: DataFrame, second: DataFrame, share: float = 0.21) -> DataFrame:
    """user, item, prediction: share of the first and the rest of the second, for pairs that both have."""
    two = first.select("user", "item", F.col("prediction").alias("p1")).join(second.select("user", "item", F.col("prediction").alias("p2")), ["user", "item"])
    return two.select("user", "item", (share * F.col("p1") + (1 - share) * F.col("p2")).alias("prediction"))


def against_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """user, item, prediction, stars for the truth's rows that have a prediction."""
    return truth.select("user", "item", "stars").join(predicted.select("user", "item", "prediction"), ["user", "item"])


def rmse(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2))).alias("rmse"))


def error_histogram(judged: DataFrame) -> DataFrame:
    """bin 0 to 4 (4 and over), n_rows: absolute errors in steps of one."""
    return judged.groupBy(F.least(F.floor(F.abs(F.col("prediction") - F.col("stars"))), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n_rows"))


def unseen(targets: DataFrame, rated: DataFrame, key: str) -> DataFrame:
    """The distinct keys of targets that are not rated, null left out."""
    return targets.select(key).where(F.col(key).isNotNull()).distinct().join(rated.select(key).distinct(), key, "left_anti")
