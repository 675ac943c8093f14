"""File sinks: JSON documents, CSV, and the text layouts of itemsets, communities and edge values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_document(df: DataFrame) -> DataFrame:
    """The rows as one column of JSON texts; nulls are kept as members."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_document(df).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; values that hold a comma are quoted."""
    df.write.mode("overwrite").option("header", True).csv(path)


def quoted_members(items: Column) -> Column:
    """'a', 'b' of an array."""
    return F.concat_ws(", ", F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))))


def itemset_lines(sets: DataFrame, title: str) -> DataFrame:
    """line_no, value: a title, then one line a size with its sets in order, an empty line after each.

    sets has columns size and items; a size's line gathers that size's sets, which a report is small enough for.
    """
    one = F.concat(F.lit("("), quoted_members(F.col("items")), F.lit(")"))
    by_size = sets.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("items", one.alias("text")))).alias("s"))
    lines = by_size.select(F.explode(F.array(F.struct((F.col("size") * 2).alias("line_no"), F.array_join("s.text", ",").alias("value")), F.struct((F.col("size") * 2 + 1).alias("line_no"), F.lit("").alias("value")))).alias("l")).select("l.*")
    return sets.sparkSession.createDataFrame([(0, title)], "line_no int, value string").unionByName(lines).orderBy("line_no")


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """line_no, value: the section of the candidates and that of the frequent itemsets, each as itemset_lines."""
    first = itemset_lines(candidates, "Candidates:").withColumn("part", F.lit(0))
    both = first.unionByName(itemset_lines(frequent, "Frequent Itemsets:").withColumn("part", F.lit(1)))
    last = first.agg(F.max("line_no").alias("n")).scalar()
    return both.select((F.col("line_no") + F.col("part") * (last + 1)).alias("line_no"), "value").orderBy("line_no")


def pair_lines(pairs: DataFrame) -> DataFrame:
    """value: `record,record,similarity` lines with a header, sorted by the records."""
    body = pairs.orderBy("record_1", "record_2").select(F.concat_ws(",", "record_1", "record_2", F.col("similarity").cast("string")).alias("value"))
    return pairs.sparkSession.createDataFrame([("business_id_1,business_id_2,similarity",)], "value string").unionByName(body)


def community_lines(communities: DataFrame) -> DataFrame:
    """size, members, value: one line a community, the smallest first."""
    return communities.select(F.size("members").alias("size"), "members", quoted_members(F.col("members")).alias("value")).orderBy("size", "members")


def edge_lines(edges: DataFrame) -> DataFrame:
    """value: ('u', 'v'), x with x to five places, the largest first; order is by the unrounded value."""
    text = F.concat(F.lit("('"), F.col("src"), F.lit("', '"), F.col("dst"), F.lit("'), "), F.bround("betweenness", 5).cast("string"))
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(text.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A column `value`, one file, in the order given."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)
