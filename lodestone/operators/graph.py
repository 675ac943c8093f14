"""The overlap graph of records, label propagation on it, and the betweenness of its edges."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import is_small, spread, stage
from lodestone.operators.similarity import pairs_sharing


def overlap_edges(df: DataFrame, record: str, element: str, least: int) -> DataFrame:
    """src < dst: records that share at least `least` elements; others are no vertices."""
    return pairs_sharing(df, record, element, least).select(F.col("record_1").alias("src"), F.col("record_2").alias("dst"), "n_shared")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """vertex, label after some rounds in which each vertex takes its neighbours' most frequent label, ties the smallest."""
    links = stage(both_ways(edges).distinct())
    labels = links.select(F.col("src").alias("vertex")).distinct().withColumn("label", F.col("vertex"))
    for _ in range(rounds):
        seen = links.join(labels.select(F.col("vertex").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = seen.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        labels = stage(best.select(F.col("src").alias("vertex"), F.col("b.label").alias("label")))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """label, members, sorted."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("vertex")).alias("members"))


def credits_from(root, near: dict) -> dict:
    """What each edge carries of the shortest paths from root, each path counting one for its end."""
    depth, paths, order = {root: 0}, {root: 1.0}, [root]
    for v in order:
        for w in near[v]:
            if w not in depth:
                depth[w], paths[w] = depth[v] + 1, 0.0
                order.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
    credit, carried = dict.fromkeys(order, 1.0), {}
    for w in reversed(order[1:]):
        for v in near[w]:
            if depth.get(v) == depth[w] - 1:
                part = credit[w] * paths[v] / paths[w]
                carried[(v, w) if v < w else (w, v)] = part
                credit[v] += part
    return carried


def edge_betweenness(edges: DataFrame, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """src < dst, betweenness: shortest paths between pairs of vertices that use the edge, shared among equal ones.

    A graph of at most broadcast_bytes is held by each task, which walks from its share of the vertices; for a larger
    one the walks are made of joins, see betweenness_by_joins.
    """
    links = stage(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where(F.col("src") < F.col("dst")).distinct())
    if not is_small(links, broadcast_bytes):
        return betweenness_by_joins(links)
    near: dict = {}
    for r in links.collect():
        near.setdefault(r.src, []).append(r.dst)
        near.setdefault(r.dst, []).append(r.src)
    held = links.sparkSession.sparkContext.broadcast(near)
    kind = links.schema["src"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for root in b["vertex"]:
                for e, x in credits_from(root, held.value).items():
                    total[e] = total.get(e, 0.0) + x
        yield pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["src", "dst", "carried"])

    roots = spread(both_ways(links).select(F.col("src").alias("vertex")).distinct(), "vertex")
    parts = roots.mapInPandas(walk, f"src {kind}, dst {kind}, carried double")
    return parts.groupBy("src", "dst").agg((F.sum("carried") / 2).alias("betweenness"))


def betweenness_by_joins(edges: DataFrame, rows_at_once: int = 1_000_000_000) -> DataFrame:
    """The same by walks from many vertices at once: a level of the walks is a join of the frontier with the edges.

    The walks hold vertices times edges rows at worst, so they start from a part of the vertices at a time, of so many
    that these are about rows_at_once. A level's joins go on until there is no further level.
    """
    links = stage(both_ways(edges).distinct())
    vertices = stage(links.select(F.col("src").alias("root")).distinct())
    parts = max(1, math.ceil(vertices.count() * links.count() / rows_at_once))
    part = F.pmod(F.xxhash64("root"), F.lit(parts))
    sums = [stage(_carried(links, vertices.where(part == k))) for k in range(parts)]
    return reduce(DataFrame.unionByName, sums).groupBy("src", "dst").agg((F.sum("part") / 2).alias("betweenness"))


def _carried(links: DataFrame, roots: DataFrame) -> DataFrame:
    """src < dst, part: what the edges carry of the shortest paths from some roots."""
    levels = [stage(roots.select("root", F.col("root").alias("v"), F.lit(1.0).alias("paths")))]
    while True:  # a neighbour of a level lies in that level, the one before or the next
        step = levels[-1].join(links, levels[-1]["v"] == links["src"]).select("root", F.col("dst").alias("v"), "paths")
        new = step.groupBy("root", "v").agg(F.sum("paths").alias("paths"))
        for known in levels[-2:]:
            new = new.join(known.select("root", "v"), ["root", "v"], "left_anti")
        new = stage(new.select("root", "v", "paths"))
        if new.isEmpty():
            break
        levels.append(new)
    credit = levels[-1].select("root", "v", F.lit(1.0).alias("credit"))
    kind = links.schema["src"].dataType.simpleString()
    carried = [links.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, part double")]
    for depth in range(len(levels) - 1, 0, -1):
        low = levels[depth].join(credit, ["root", "v"]).select("root", F.col("v").alias("w"), F.col("paths").alias("pw"), "credit")
        high = levels[depth - 1].select("root", "v", F.col("paths").alias("pv"))
        used = low.join(links, F.col("w") == F.col("src")).select("root", "w", "pw", "credit", F.col("dst").alias("v")).join(high, ["root", "v"])
        used = stage(used.select("root", "v", "w", (F.col("credit") * F.col("pv") / F.col("pw")).alias("part")))
        carried.append(used.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"), "part"))
        if len(carried) > 50:
            carried = [stage(reduce(DataFrame.unionByName, carried).groupBy("src", "dst").agg(F.sum("part").alias("part")))]
        got = used.groupBy("root", "v").agg(F.sum("part").alias("got"))
        credit = stage(high.join(got, ["root", "v"], "left").select("root", "v", (1 + F.coalesce("got", F.lit(0.0))).alias("credit")))
    return reduce(DataFrame.unionByName, carried).groupBy("src", "dst").agg(F.sum("part").alias("part"))
