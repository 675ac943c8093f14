"""Problem 9: documents that carry passages of evaluation items, whole or in part.

A passage of `window` words with at most `changes` of them changed, dropped or joined by an added word keeps at least
window - 2 - 3 * changes of its three-word shingles, in order, within window + changes words of the document. Of a
document's shingles only those are kept that occur in some item and have that many such neighbours that close; this is
done as the documents are read. The items' shingles are ordered by their rarity among these; of each item window only
the rarest ones that are necessary (all but that number less one) form its prefix, and stretches of documents are
joined with items on prefix shingles. Candidates then need enough shared shingles within the stretch, and what is left
is verified word by word, over item-sized windows, on the stretch's words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.functions.shuffle import broadcast_if_small, is_small, on_all_cores, spread, stage

SHINGLE = 3


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits outside of tags and character entities; null gives none.

    Passes over the text are made only where their characters occur.
    """
    t = F.coalesce(text, F.lit(""))
    marked = F.contains(t, F.lit("<")) | F.contains(t, F.lit("&"))
    t = F.lower(F.when(marked, F.regexp_replace(t, "</?[A-Za-z][^<>]*>|&[A-Za-z]{2,8};|&#x?[0-9A-Fa-f]{1,6};", " ")).otherwise(t))
    t = F.when(F.octet_length(t) > F.length(t), F.regexp_replace(t, "[\\p{M}\\x{ad}\\x{200b}]", "")).otherwise(t)
    return F.regexp_extract_all(t, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def shingles(tokens: Column) -> Column:
    """Hashes of each three consecutive words, in order."""
    n = F.size(tokens) - (SHINGLE - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))


def held_within(words_of_item: list[str], doc: list[str], changes: int) -> bool:
    """Whether the words are in doc, in order, at an edit distance of words of at most `changes`."""
    n = len(doc)
    row = [0] * (n + 1)
    for i, w in enumerate(words_of_item):
        left = row[0]
        low = row[0] = i + 1
        for j in range(1, n + 1):
            up = row[j]
            best = left if doc[j - 1] == w else 1 + (left if left < up else up)
            if best > row[j - 1] + 1:
                best = row[j - 1] + 1
            left = up
            row[j] = best
            if best < low:
                low = best
        if low > changes:
            return False
    return min(row) <= changes


def dense(doc: np.ndarray, at: np.ndarray, need: int, width: int) -> np.ndarray:
    """Which of the places, sorted within each document, lie among `need` places of their document within `width`."""
    keep = np.zeros(len(at), dtype=bool)
    first = np.flatnonzero((doc[need - 1 :] == doc[: len(doc) - need + 1]) & (at[need - 1 :] - at[: len(at) - need + 1] <= width)) if len(at) >= need else np.zeros(0, int)
    for k in range(need):
        keep[first + k] = True
    return keep


def _dense_places(need: int, width: int):
    """dense() over a stream of doc_id, at, h in which a document's places follow each other."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            doc, at = b["doc_id"].to_numpy(), b["at"].to_numpy()
            # A document starts anew where its id changes or its places do not grow.
            run = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (at[1:] <= at[:-1])]) if len(b) else doc
            own = dense(run, at, need, width)
            # The last places of the last document may have neighbours in the next batch.
            open_from = len(b) and min(np.searchsorted(run, run[-1]) + np.searchsorted(at[run == run[-1]], at[-1] - width), len(b))
            seen = b["seen"].to_numpy() | own
            yield b.iloc[:open_from][seen[:open_from]][["doc_id", "at", "h"]]
            held = b.iloc[open_from:].assign(seen=seen[open_from:])
        if held is not None:
            yield held[held["seen"]][["doc_id", "at", "h"]]

    return keep


def _verified(window: int, changes: int):
    """Of each candidate stretch, the item windows around its shared shingles, checked until one holds.

    A passage's shingles lie at most `changes` diagonals apart, and a window needs `need` of them at different places.
    A passage is looked for in the stretch whose first half its first shared shingle is in.
    """
    per = window - (SHINGLE - 1)
    need = per - SHINGLE * changes

    def passes(item: list[str], doc: list[str], at: list[tuple[int, int]], end: int) -> bool:
        """at: (document place, item place) of shared shingles; end: where the stretch's first half ends."""
        at = sorted(set(at))
        tried = set()
        for k, (d, i) in enumerate(at):
            if d >= end:
                break
            near = [(x, y) for x, y in at[k : bisect_right(at, (d + window + changes, len(item)), k)] if abs((x - y) - (d - i)) <= changes]
            if len({x for x, _ in near}) < need:
                continue
            places = {y for _, y in near}
            for w in range(max(0, i - per + 1), min(i, len(item) - window) + 1):
                if (w, d - i) in tried or sum(w <= y < w + per for y in places) < need:
                    continue
                tried.add((w, d - i))
                lo = max(0, w + d - i - changes)
                if held_within(item[w : w + window], doc[lo : w + d - i + window + 2 * changes], changes):
                    return True
        return False

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [passes([*i], [*d], [(x - start, y) for x, y in zip(p, q)], end - start) for i, d, start, end, p, q in zip(b["item_words"], b["doc_words"], b["start"], b["end"], b["doc_at"], b["item_at"])]
            yield b.loc[ok, ["doc_id", "item_id"]]

    return check


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", window: int = 15, changes: int = 3) -> DataFrame:
    """doc_id, item_id: the documents that hold some `window` consecutive words of an item with at most `changes` word slips.

    Items under `window` words have no passage; null and empty texts hold none; rows with null ids are left out, and
    repeated rows give one pair. Whole documents are searched. items is a set of test items, of which only shingles
    and words are joined, as tables.
    """
    need, width = window - (SHINGLE - 1) - SHINGLE * changes, window + changes
    if need < 1:
        raise ValueError("a passage with so many changes may share no shingle with its item")
    it = stage(items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("item_words")).where(F.col("item_id").isNotNull() & (F.size("item_words") >= window)))
    spread_items = stage(it.select("item_id", F.posexplode(shingles(F.col("item_words"))).alias("at", "h")))
    known = stage(spread_items.select("h").distinct())
    small = is_small(known)
    given = on_all_cores(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull()))
    texts = given.select("doc_id", words(F.col("text")).alias("doc_words")).where(F.size("doc_words") >= window - changes)
    met = texts.select("doc_id", F.posexplode(shingles(F.col("doc_words"))).alias("at", "h")).join(F.broadcast(known) if small else known, "h", "left_semi").select("doc_id", "at", "h", F.lit(False).alias("seen"))
    if not small:  # the shuffled join has dealt the places of a document out
        met = met.repartition("doc_id").sortWithinPartitions("doc_id", "at")
    places = stage(met.mapInPandas(_dense_places(need, width), "doc_id long, at int, h long"))
    rarity = places.groupBy("h").agg(F.count("*").alias("df"))
    ranked = spread_items.join(rarity, "h", "left").select("item_id", "at", "h", F.coalesce("df", F.lit(0)).alias("df"))
    # A window's prefix: its shingles but the need - 1 most frequent. A shingle is needed if any window of 13 places needs it.
    per = window - (SHINGLE - 1)
    windows = ranked.withColumn("w", F.explode(F.sequence(F.greatest(F.col("at") - per + 1, F.lit(0)), F.col("at"))))
    order = Window.partitionBy("item_id", "w").orderBy("df", "h", "at")
    size = F.count("*").over(Window.partitionBy("item_id", "w"))
    prefix = windows.withColumn("k", F.row_number().over(order)).withColumn("size", size).where((F.col("size") == per) & (F.col("k") <= per - need + 1) & (F.col("df") > 0))
    prefix = broadcast_if_small(stage(prefix.select("item_id", "h").distinct()))
    # A passage lies whole within one of the stretches of two widths that start every width.
    both = F.explode(F.array(F.floor(F.col("at") / width).cast("int"), F.floor(F.col("at") / width).cast("int") - 1))
    candidates = places.join(prefix, "h").select("doc_id", "item_id", both.alias("stretch")).distinct()
    shared = places.join(broadcast_if_small(spread_items).select("item_id", F.col("at").alias("item_at"), "h"), "h").select("doc_id", "item_id", "at", "item_at", both.alias("stretch"))
    shared = shared.join(candidates, ["doc_id", "item_id", "stretch"], "left_semi")
    met = shared.groupBy("doc_id", "item_id", "stretch").agg(F.collect_list("at").alias("doc_at"), F.collect_list("item_at").alias("item_at"), F.count_distinct("at").alias("n"), F.min("at").alias("first")).where((F.col("n") >= need) & (F.col("first") < (F.col("stretch") + 1) * width))
    by_doc = stage(met.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "stretch", "doc_at", "item_at")).alias("m")))
    # Of the texts only those of candidates are read again and cut into words once; their ids alone are few and narrow.
    wanted = broadcast_if_small(stage(by_doc.select("doc_id")))
    again = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi").join(by_doc, "doc_id")
    start = F.greatest((F.col("m.stretch") - 1) * width, F.lit(0))
    cut = again.select("doc_id", words(F.col("text")).alias("w"), F.explode("m").alias("m"))
    cut = cut.select("doc_id", "m.item_id", start.alias("start"), ((F.col("m.stretch") + 1) * width).alias("end"), F.slice("w", start + 1, 4 * width).alias("doc_words"), "m.doc_at", "m.item_at")
    full = cut.join(broadcast_if_small(it), "item_id").select("doc_id", "item_id", "start", "end", "doc_words", "item_words", "doc_at", "item_at")
    return spread(full, "doc_id", "item_id", "start").mapInPandas(_verified(window, changes), "doc_id long, item_id long").distinct()


def leak_report(found: DataFrame, items: DataFrame, item_id: str = "item_id", suite: str = "suite") -> DataFrame:
    """Per item: its suite and the number of documents that carry a passage of it, 0 included."""
    n = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    return items.select(F.col(item_id).alias("item_id"), F.col(suite).alias("suite")).join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
