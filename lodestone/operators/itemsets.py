"""Baskets and their frequent itemsets: two-pass partition mining with an exact recount, and FP-growth."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import broadcast_if_small, stage


def baskets(df: DataFrame, key: str, item: str, larger_than: int = 0) -> DataFrame:
    """basket, items: each key's distinct items, sorted; only baskets of more than `larger_than` items.

    Null items are in no basket; the null key is a basket.
    """
    rows = df.select(F.col(key).alias("basket"), F.col(item).cast("string").alias("item")).where(F.col("item").isNotNull()).distinct()
    return rows.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > larger_than)


def support_count(df: DataFrame, share: float) -> int:
    """A share of the baskets as a number of baskets, at least 1."""
    return max(1, math.ceil(share * df.count()))


def grown(frequent: set[tuple]) -> set[tuple]:
    """Sets of one item more all of whose subsets are frequent; from singles, all pairs."""
    by_head: dict[tuple, list] = {}
    for s in frequent:
        by_head.setdefault(s[:-1], []).append(s[-1])
    out = set()
    for head, tails in by_head.items():
        for a, b in combinations(sorted(tails), 2):
            new = (*head, a, b)
            if all(c in frequent for c in combinations(new, len(new) - 1)):
                out.add(new)
    return out


def local_itemsets(sets: list[list[str]], support: float, longest: int | None = None) -> list[tuple]:
    """All itemsets in at least `support` of the sets, level by level until a level is empty or `longest` is reached.

    Each itemset has a bit for every set that holds it, so a level is counted from the one before.
    """
    counts = Counter(x for s in sets for x in s)
    held = {x: bytearray(len(sets) // 8 + 1) for x, n in counts.items() if n >= support}
    for i, s in enumerate(sets):
        for x in s:
            if x in held:
                held[x][i >> 3] |= 1 << (i & 7)
    level = {(x,): int.from_bytes(b, "little") for x, b in held.items()}
    found, size = [*level], 1
    while level and (longest is None or size < longest):
        size += 1
        both = ((c, level[c[:-1]] & level[(*c[:-2], c[-1])]) for c in grown({*level}))
        level = {c: bits for c, bits in both if bits.bit_count() >= support}
        found += level
    return found


def candidate_itemsets(basket_rows: DataFrame, support: int, total: int, longest: int | None = None, chunk: int = 20_000) -> DataFrame:
    """items, n_parts: the itemsets frequent in some chunk at the support scaled to its size, a superset of the frequent ones, and in how many chunks each is."""

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[str]] = []

        def out(sets: list[list[str]]) -> pd.DataFrame:
            return pd.DataFrame({"items": [[*s] for s in local_itemsets(sets, len(sets) / total * support, longest)]})

        for b in batches:
            held += [[*s] for s in b["items"]]
            while len(held) >= 2 * chunk:  # at least a chunk stays: in a few baskets almost every subset is frequent
                yield out(held[:chunk])
                held = held[chunk:]
        if held:
            yield out(held)

    parts = max(1, total // chunk)
    return basket_rows.select("items").repartition(parts).mapInPandas(mine, "items array<string>").groupBy("items").agg(F.count("*").alias("n_parts"))


def counted(basket_rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """items, size, n: in how many baskets each candidate is contained.

    A candidate meets only the baskets that hold its rarest item, and is tested there as a whole; so a hot item costs
    its own candidates and no others. The candidates are broadcast if their size allows it, so the baskets stay where
    they are.
    """
    named = candidates.select("items", F.posexplode("items").alias("at", "item"))
    held = basket_rows.select("items", F.explode("items").alias("item"))
    common = held.groupBy("item").agg(F.count("*").alias("k"))
    rarest = named.join(common, "item").groupBy("items").agg(F.min(F.struct("k", "item")).alias("r"))
    asked = broadcast_if_small(stage(rarest.select(F.col("items").alias("asked"), F.col("r.item").alias("item"))))
    inside = held.join(asked, "item").where(F.size(F.array_intersect("asked", "items")) == F.size("asked"))
    return inside.groupBy(F.col("asked").alias("items")).agg(F.count("*").alias("n")).select("items", F.size("items").alias("size"), "n")


def pairs_of(singles: DataFrame) -> DataFrame:
    """items: each pair of the frequent items, a column x; there are at most a basket's mean size by the support of them."""
    row = singles.agg(F.array_sort(F.collect_list("x")).alias("xs"))
    each = row.select("xs", F.posexplode("xs").alias("i", "x"))
    return each.select("x", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("y")).select(F.array("x", "y").alias("items"))


def frequent_itemsets(basket_rows: DataFrame, share: float, longest: int | None = None) -> DataFrame:
    """items, size, n of the itemsets, of up to `longest` items if given, in at least `share` of all baskets. Exact."""
    total = basket_rows.count()
    if not total:
        return basket_rows.select("items", F.lit(0).alias("size"), F.lit(0).cast("long").alias("n")).limit(0)
    support = max(1, math.ceil(share * total))
    return counted(basket_rows, candidate_itemsets(basket_rows, support, total, longest)).where(F.col("n") >= support)


def fpgrowth_itemsets(basket_rows: DataFrame, share: float) -> DataFrame:
    """The same by FP-growth, of any size. Half an item under the support keeps its rounding from moving the bound."""
    total = basket_rows.count()
    support = max(1, math.ceil(share * total))
    sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / max(1, total))).fit(basket_rows).freqItemsets
    return sets.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("n"))
