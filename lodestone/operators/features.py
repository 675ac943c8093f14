"""Numbers from users and businesses for rating models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.similarity import ordinals

#: The attributes that count one where their text is "True".
TRUE_FLAGS = (
    "BusinessAcceptsCreditCards", "DogsAllowed", "DriveThru", "GoodForKids", "HasTV", "OutdoorSeating", "RestaurantsDelivery", "RestaurantsGoodForGroups",
    "RestaurantsReservations", "RestaurantsTableService", "RestaurantsTakeOut", "WheelchairAccessible", "ByAppointmentOnly", "HappyHour", "CoatCheck", "Caters",
)
CODED = ("RestaurantsAttire", "NoiseLevel", "Smoking", "Alcohol")
PARKING = ("street", "validated", "lot", "valet")
MEALS = ("dessert", "latenight", "lunch", "dinner", "brunch", "breakfast")


def code(c: Column) -> Column:
    """A number for a text, the same everywhere: the head of its MD5. Null gives 0."""
    return F.coalesce(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(0).cast("long"))


def flags_within(c: Column) -> Column:
    """A text that spells an object of flags, in JSON or Python notation, as a map; null if it spells none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '\\\\"', '"')
    t = F.regexp_replace(F.regexp_replace(t, "\\bu'", "'"), "'", '"')
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\\bTrue\\b", "true"), "\\bFalse\\b", "false"), "\\bNone\\b", "null")
    return F.from_json(t, "map<string,boolean>")


def attribute_columns(attributes: Column) -> list[Column]:
    """The 33 numbers of a map of attributes, by name; what is absent is 0."""
    a = lambda k: F.try_element_at(attributes, F.lit(k))
    flag = lambda c, name: F.coalesce(c.cast("int"), F.lit(0)).alias(name)
    inner = lambda k, members: [flag(F.try_element_at(flags_within(a(k)), F.lit(m)), f"{k}_{m}") for m in members]
    return [
        *[flag(a(k) == "True", k) for k in TRUE_FLAGS],
        *inner("BusinessParking", PARKING), *inner("GoodForMeal", MEALS),
        *[code(a(k)).alias(k) for k in CODED],
        F.coalesce(a("RestaurantsPriceRange2").try_cast("int"), F.lit(0)).alias("RestaurantsPriceRange2"),
        flag(a("WiFi") == "free", "WiFi"), flag(a("Music").isNotNull(), "Music"),
    ]


def category_code(categories: Column, trim: bool = False) -> Column:
    """1 for a list with the element Restaurants or Food, or for none at all; 2 for Health & Medical; else 0.

    The parts between commas are compared as they are; trim compares them without white space around.
    """
    parts = F.split(categories, ",")
    parts = F.transform(parts, lambda p: F.trim(p)) if trim else parts
    has = lambda x: F.array_contains(parts, x)
    return F.when(categories.isNull(), 1).when(has("Restaurants"), 1).when(has("Food"), 1).when(has("Health & Medical"), 2).otherwise(0)


def friend_count(friends: Column) -> Column:
    """Parts between commas; none for `None` and null."""
    return F.when(friends.isNull() | (friends == "None"), 0).otherwise(F.size(F.split(friends, ",")))


USER_COLUMNS = ("u_review_count", "u_since", "u_friends", "u_useful", "u_funny", "u_cool", "u_fans", "u_avg_stars", "u_photos")


def user_features(users: DataFrame) -> DataFrame:
    """user and nine numbers."""
    c = F.col
    return users.select(
        c("user_id").alias("user"), c("review_count").cast("double").alias("u_review_count"), code(c("yelping_since")).cast("double").alias("u_since"), friend_count(c("friends")).cast("double").alias("u_friends"), c("useful").cast("double").alias("u_useful"),
        c("funny").cast("double").alias("u_funny"), c("cool").cast("double").alias("u_cool"), c("fans").cast("double").alias("u_fans"), c("average_stars").alias("u_avg_stars"), c("compliment_photos").cast("double").alias("u_photos"),
    )


BUSINESS_COLUMNS = ("b_postal", "b_stars", "b_review_count", "b_open", "b_category")


def business_features(businesses: DataFrame) -> DataFrame:
    """item, five numbers, and the 33 of the attributes, as a_ columns."""
    c = F.col
    head = [c("business_id").alias("item"), code(c("postal_code")).cast("double").alias("b_postal"), c("stars").alias("b_stars"), c("review_count").cast("double").alias("b_review_count"), c("is_open").cast("double").alias("b_open"), category_code(c("categories")).cast("double").alias("b_category")]
    wide = businesses.select(*head, *attribute_columns(c("attributes")))
    rest = [x for x in wide.columns if x not in ("item", *BUSINESS_COLUMNS)]
    return wide.select("item", *BUSINESS_COLUMNS, *[c(x).cast("double").alias(f"a_{x}") for x in rest])


def joined_features(pairs: DataFrame, users: DataFrame, businesses: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """pairs with the features of their user and item; missing entities get means over the training rows' entities and else 0.

    trained are the rows whose means fill, pairs themselves if None. A missing business counts as category 1.
    """
    uf, bf = user_features(users), business_features(businesses)
    base = (pairs if trained is None else trained).select("user", "item")
    low = ("u_review_count", "u_avg_stars", "b_stars", "b_review_count")
    fill = base.join(uf, "user", "left").join(bf, "item", "left").agg(*[F.avg(x).alias(x) for x in low]).first()
    wide = pairs.join(uf, "user", "left").join(bf, "item", "left")
    numbers = {x: float(fill[x] or 0.0) for x in low} | {"b_category": 1.0}
    rest = {x: 0.0 for x in [*USER_COLUMNS, *bf.columns[1:]] if x not in numbers}
    return wide.fillna(numbers | rest)


def simple_features(pairs: DataFrame, rated: DataFrame, users: DataFrame, businesses: DataFrame, training: bool) -> DataFrame:
    """pairs with u_count, u_avg, b_count, b_avg, u_useful.

    For training rows counts and averages come from the ratings, for others from the entities; what is unknown has the
    means over all entities, and useful 0.
    """
    ue = users.select(F.col("user_id").alias("user"), F.col("review_count").cast("double").alias("u_count"), F.col("average_stars").alias("u_avg"), F.col("useful").cast("double").alias("u_useful"))
    be = businesses.select(F.col("business_id").alias("item"), F.col("review_count").cast("double").alias("b_count"), F.col("stars").alias("b_avg"))
    m = ue.agg(F.avg("u_count").alias("u_count"), F.avg("u_avg").alias("u_avg")).crossJoin(be.agg(F.avg("b_count").alias("b_count"), F.avg("b_avg").alias("b_avg"))).first()
    if training:
        ur = rated.groupBy("user").agg(F.count("*").cast("double").alias("u_count"), F.avg("stars").alias("u_avg"))
        br = rated.groupBy("item").agg(F.count("*").cast("double").alias("b_count"), F.avg("stars").alias("b_avg"))
        wide = pairs.join(ur, "user", "left").join(ue.select("user", "u_useful"), "user", "left").join(br, "item", "left")
    else:
        wide = pairs.join(ue, "user", "left").join(be, "item", "left")
    return wide.fillna({k: float(m[k] or 0.0) for k in ("u_count", "u_avg", "b_count", "b_avg")} | {"u_useful": 0.0})


def indexed(rows: DataFrame, rated: DataFrame, users: DataFrame) -> DataFrame:
    """rows with user_idx and business_idx: places among the sorted users of the table and among the sorted rated items; -1 for others."""
    ui = ordinals(users, "user_id").select(F.col("user_id").alias("user"), F.col("ordinal").cast("double").alias("user_idx"))
    bi = ordinals(rated, "item").select("item", F.col("ordinal").cast("double").alias("business_idx"))
    return rows.join(ui, "user", "left").join(bi, "item", "left").fillna({"user_idx": -1.0, "business_idx": -1.0})
