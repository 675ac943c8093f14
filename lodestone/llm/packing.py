"""Problem 8: documents put into containers of fixed capacity by minimum bin slack.

Sizes are counted in tokens of a public tokenizer whose file is a parameter. A text beyond the capacity alone is split
into full containers and a rest. The pieces are dealt by hash into pools of bounded size; in a pool, each container
starts with the longest piece left, and a bitset of the sums that the other lengths can make (one bit a token) gives
the fullest combination, which is then removed. Only a pool's last containers are short, so the unused space is about
one container in a pool of `pool_bins`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import on_all_cores, spread, stage
from lodestone.operators.sketches import numbered

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that byte-level BPE vocabularies of this kind split text with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(vocabulary: bytes):
    """A function from texts to token counts, for the bytes of a vocabulary file; null has none. Special tokens' strings are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [0 if t is None else len(own.encode_ordinary(t)) for t in texts]


def token_sizes(df: DataFrame, doc_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens; null and empty texts have none, rows with a null doc_id are left out.

    The vocabulary file, of a megabyte or so, is read where the query is made and sent along.
    """
    held = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = token_counter(held.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": counter(b["text"])})

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    return on_all_cores(rows).mapInPandas(count, "doc_id long, n_tokens long")


def fullest(counts: dict[int, int], space: int) -> list[int]:
    """Lengths, no more often than counted, whose sum is the largest within space."""
    if space <= 0:
        return []
    mask = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        left, times = min(counts[length], space // length), 1
        while left:
            k = min(times, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, times = left - k, times * 2
        if reach >> space & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * k
            total -= length * k
    return out


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of indices into lengths, all of which are in 1..capacity."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        by.setdefault(x, []).append(i)
    counts = {x: len(v) for x, v in by.items()}
    order, bins = sorted(counts), []

    def take(x: int) -> int:
        counts[x] -= 1
        if not counts[x]:
            del counts[x]
        return by[x].pop()

    while counts:
        while order[-1] not in counts:
            order.pop()
        top = order[-1]
        own = [take(top)]
        own += [take(x) for x in fullest(counts, capacity - top)]
        bins.append(own)
    return bins


_PLACED = "container_id long, doc_id long, piece int, token_start long, n_tokens long"


def _pack(capacity: int):
    def pack(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["n_tokens", "doc_id", "piece"]).reset_index(drop=True)
        some = pool[pool["n_tokens"] > 0].reset_index(drop=True)
        none = pool[pool["n_tokens"] == 0]
        bins = fill([*some["n_tokens"]], capacity) or [[]]
        home = pd.Series(-1, index=some.index)
        for k, own in enumerate(bins):
            home[own] = k
        base = int(pool["pool"].iloc[0]) * 10_000_000
        placed = pd.concat([some.assign(container_id=base + home), none.assign(container_id=base)])
        return placed[["container_id", "doc_id", "piece", "token_start", "n_tokens"]]

    return pack


def containers(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2_048, path: str = TOKENIZER, pool_bins: int = 512) -> DataFrame:
    """container_id, doc_id, piece, token_start, n_tokens: which tokens of which document lie in which container.

    A document of at most `capacity` tokens is one piece, 0. A longer one is cut every `capacity` tokens; its full
    pieces have containers of their own. Texts without tokens take no space and lie in a pool's first container.
    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    sizes = stage(token_sizes(df, doc_id, text, path).withColumn("row_no", F.monotonically_increasing_id()))
    total = sizes.agg(F.coalesce(F.sum(F.col("n_tokens") % capacity), F.lit(0)).alias("n")).first()["n"]
    pools = max(1, total // (capacity * pool_bins))
    last = F.greatest(F.floor((F.col("n_tokens") - 1) / capacity), F.lit(0)).cast("int")
    cut = sizes.select("doc_id", "row_no", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    cut = cut.select("doc_id", "row_no", "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("all") - start).alias("n_tokens"))
    full = cut.where(F.col("n_tokens") == capacity)
    rest = cut.where(F.col("n_tokens") < capacity).withColumn("pool", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(pools)))
    # Pools have ids from 0; the containers of full pieces are numbered from -1 down.
    alone = numbered(full, "row_no", "piece").select((-1 - F.col("seq")).alias("container_id"), "doc_id", "piece", "token_start", "n_tokens")
    return spread(rest, "pool").groupBy("pool").applyInPandas(_pack(capacity), _PLACED).unionByName(alone)


def fill_report(placed: DataFrame, capacity: int = 2_048) -> DataFrame:
    """One row: containers, the fewest that could hold the tokens, tokens, the fullest container, and the share of unused space."""
    each = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    total = each.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return total.select("n_containers", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), "n_tokens", "fullest", (1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("unused_share"))
