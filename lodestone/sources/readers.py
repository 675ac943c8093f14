"""File sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string"
BUSINESS_CITY = "business_id string, city string"
BUSINESS = "business_id string, stars double, review_count bigint, is_open int, postal_code string, categories string, attributes map<string,string>"
USER = "user_id string, review_count bigint, yelping_since string, friends string, useful bigint, funny bigint, cool bigint, fans bigint, average_stars double, compliment_photos bigint"
RATING = "user_id string, business_id string, stars double"
USER_BUSINESS = "user_id string, business_id string"
PREDICTION = "user_id string, business_id string, prediction double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; only the declared members are read, and a line that is no object fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated with a header line; a quoted comma belongs to its value."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One column, value."""
    return spark.read.text(path)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """basket, item from a quoted file of date, customer, three columns more, and product.

    A basket is a customer's day, `date-customer`; numbers lose their leading zeros.
    """
    raw = spark.read.schema("day string, customer string, c2 string, c3 string, c4 string, product string").option("header", True).csv(path)
    number = lambda c: F.trim(F.col(c)).cast("bigint").cast("string")
    return raw.select(F.concat_ws("-", F.trim("day"), number("customer")).alias("basket"), number("product").alias("item"))


def rating_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The training ratings, users and businesses of a folder of files."""
    return {"train": csv_table(spark, f"{folder}/yelp_train.csv", RATING), "user": json_lines(spark, f"{folder}/user.json", USER), "business": json_lines(spark, f"{folder}/business.json", BUSINESS)}


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from the program itself."""
    return spark.createDataFrame(rows, schema)
