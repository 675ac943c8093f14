"""Boosted trees and forests grown within a task each, over rows whose features are codes of a few bits.

A value becomes the number of its bin (all values where there are few, else quantiles over all rows), and the bins of
several features share one number of up to 15 bits. A node's sums for all its features then take two tallies for each
such number in place of two for each feature, and of two children only the smaller one is tallied. A model is made by
one task over all of its rows, so rounds need no jobs; many models run side by side. Depth, rounds, step and seed are
those of the estimators of pyspark.ml, and trees follow its rules: the first boosted tree is fitted to the labels, the
others to twice the residuals.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.shuffle import on_all_cores, stage

#: Bits of a code, and the rows of a node up to which bins are tallied one feature at a time.
CODE_BITS, FEW = 15, 1_000
#: Poisson numbers of mean 1, as often as they are due among 2¹⁶.
DRAWN = np.repeat(np.arange(9, dtype=np.uint8), np.diff(np.round(65536 * np.cumsum([0, *(math.exp(-1) / math.factorial(k) for k in range(8)), 1])).clip(0, 65536).astype(int)))
#: Rows to a class from which sums are first made by class.
SHARED = 3
#: Rows whose values are counted at once.
COUNTED = 100_000


def cuts(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """For each column the midpoints between its values, or between its quantiles where it has more than bins values. NaN is left out.

    All rows count, but no value for more than a bin's fair share, so that a value of most rows leaves bins to the others.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tally() -> Iterator[pa.RecordBatch]:
            for k in range(len(columns)):
                v, n = np.unique(np.concatenate([b[k] for b in held]), return_counts=True)
                seen = ~np.isnan(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.sum(), k, np.int32)), pa.array(v[seen]), pa.array(n[seen])], ["k", "v", "n"])

        held, size = [], 0
        for b in batches:
            held.append(_numbers(b, columns))
            size += b.num_rows
            if size >= COUNTED:
                yield from tally()
                held, size = [], 0
        if size:
            yield from tally()

    each = on_all_cores(rows.select(*columns)).mapInArrow(counted, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    of, upto = Window.partitionBy("k"), Window.partitionBy("k").orderBy("v")
    placed = each.select("k", "v", "n", F.row_number().over(upto).alias("at"), F.count("*").over(of).alias("values"), F.least("n", F.sum("n").over(of) / bins).alias("share"))
    placed = placed.select("k", "v", "at", "values", (F.sum("share").over(upto) - F.col("share")).alias("before"), F.sum("share").over(of).alias("all"))
    ends = placed.groupBy("k", F.when(F.col("values") <= bins, F.col("at") - 1).otherwise(F.least(F.floor(F.greatest(F.col("before"), F.lit(0)) * bins / F.col("all")), F.lit(bins - 1))).alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    found: list[list[tuple[float, float]]] = [[] for _ in columns]
    for r in ends.orderBy("k", "bin").collect():  # at most as many rows as bins of each column
        found[r["k"]].append((r["low"], r["high"]))
    return [np.array([a[1] + (b[0] - a[1]) / 2 for a, b in zip(x, x[1:])]) for x in found]


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    """The columns as doubles, null as NaN."""
    return [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]


class Codes:
    """Which bits of which code hold a feature's bin; features of one value take none.

    sides: for each feature the kind of thing that it describes; a code has features of one side only.
    """

    def __init__(self, edges: list[np.ndarray], sides: list[str] | None = None):
        sides = sides or [""] * len(edges)
        self.edges = edges
        bits = [len(e).bit_length() for e in edges]
        if max(bits, default=0) > CODE_BITS:
            raise ValueError(f"more than {1 << CODE_BITS} bins")
        self.groups: list[list[int]] = []
        for f in sorted((f for f, b in enumerate(bits) if b), key=lambda f: (-bits[f], f)):
            free = next((g for g in self.groups if sides[g[0]] == sides[f] and sum(bits[x] for x in g) + bits[f] <= CODE_BITS), None)
            self.groups.append(free := []) if free is None else None
            free.append(f)
        self.bits, self.width = bits, 1 << max(bits, default=0)
        self.size = [1 << sum(bits[f] for f in g) for g in self.groups]
        self.place = {f: (k, sum(bits[x] for x in g[i + 1 :]), (1 << bits[f]) - 1) for k, g in enumerate(self.groups) for i, f in enumerate(g)}
        self.sides = [[k for k, g in enumerate(self.groups) if sides[g[0]] == x] for x in sorted({sides[g[0]] for g in self.groups})]
        self.used = np.array([*self.place], np.int64)
        self.at, self.shift, self.mask = (np.array([p[i] for p in self.place.values()], t) for i, t in enumerate((np.int64, np.uint16, np.uint16)))

    def binned(self, values: list[np.ndarray]) -> np.ndarray:
        """Bins, a row for each feature; NaN is in the last one."""
        return np.array([np.searchsorted(e, v) for e, v in zip(self.edges, values)], np.uint16).reshape(len(self.edges), -1)

    def packed(self, binned: np.ndarray) -> np.ndarray:
        """Codes, a row for each group of features."""
        out = np.zeros((len(self.groups), binned.shape[1]), np.uint16)
        for f, (g, shift, _) in self.place.items():
            out[g] |= binned[f] << shift
        return out

    def unpacked(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.edges), codes.shape[1]), np.uint16)
        for f, (g, shift, mask) in self.place.items():
            out[f] = codes[g] >> shift & mask
        return out

    def _share(self, tally: np.ndarray, features: list[int], out: np.ndarray) -> None:
        """Adds a tally over codes up for each feature within them."""
        if len(features) == 1:
            out[features[0], : len(tally)] = tally
            return
        half = len(features) // 2
        grid = tally.reshape(-1, 1 << sum(self.bits[f] for f in features[half:]))
        self._share(grid.sum(1), features[:half], out)
        self._share(grid.sum(0), features[half:], out)

    def classes(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each side its rows' classes, which have all codes of the side in common, and the classes' codes; None if there are too many to be of use."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for groups in self.sides:
            of, number = np.zeros(codes.shape[1], np.int64), 1
            for g in groups:
                if number * self.size[g] >= 1 << 62:
                    values, of = np.unique(of, return_inverse=True)
                    number = len(values)
                of = of * self.size[g] + codes[g]
                number *= self.size[g]
            _, first, of = np.unique(of, return_index=True, return_inverse=True)
            out.append((of.astype(np.int32), codes[:, first]) if SHARED * len(first) <= len(of) else None)
        return out

    def tallied(self, codes: np.ndarray, at: np.ndarray | None, *weights: np.ndarray | None, classes: list | None = None) -> list[np.ndarray]:
        """For each of the weights (None: one a row) its sums over the rows at, by feature and bin; over classes first where the rows are many to a class."""
        out = [np.zeros((len(self.edges), self.width)) for _ in weights]
        of = [w if w is None or at is None else w.take(at) for w in weights]
        if at is not None and len(at) <= FEW:
            cell = ((codes[:, at][self.at] >> self.shift[:, None] & self.mask[:, None]) + (self.used * out[0].shape[1])[:, None]).ravel()
            return [np.bincount(cell, None if w is None else np.tile(w, len(self.used)), x.size).reshape(x.shape).astype(float) for w, x in zip(of, out)]
        for groups, shared in zip(self.sides, classes or [None] * len(self.sides)):
            mine, where, each = of, at, codes
            if shared and SHARED * shared[1].shape[1] <= (codes.shape[1] if at is None else len(at)):
                ids = (shared[0] if at is None else shared[0].take(at)).astype(np.intp)
                mine, where, each = [np.bincount(ids, w, shared[1].shape[1]) for w in of], None, shared[1]
            for g in groups:
                code = (each[g] if where is None else each[g].take(where)).astype(np.intp)
                for w, x in zip(mine, out):
                    self._share(np.bincount(code, w, self.size[g]), self.groups[g], x)
        return out


class Grown:
    """Trees of one depth: the feature and the last bin to the left at each inner node, numbered from 1, and the leaves' values."""

    def __init__(self, trees: int, depth: int):
        self.depth = depth
        self.feature, self.cut = np.zeros((trees, 1 << depth), np.int64), np.full((trees, 1 << depth), 0xFFFF, np.uint16)
        self.value = np.zeros((trees, 1 << depth))

    def summed(self, binned: np.ndarray) -> np.ndarray:
        n = binned.shape[1]
        flat, row, out = binned.ravel(), np.arange(n), np.zeros(n)
        for feature, cut, value in zip(self.feature * n, self.cut, self.value):
            node = np.ones(n, np.int64)
            for _ in range(self.depth):
                right = flat.take(feature.take(node) + row) > cut.take(node)
                node += node
                node += right
            out += value.take(node - (1 << self.depth))
        return out


def _best(sums: np.ndarray, counts: np.ndarray, s: float, n: float, allowed: np.ndarray | None) -> tuple | None:
    """Feature, last bin to the left, and the left's sum and count where the variance falls most; None if it falls nowhere."""
    left, many = sums.cumsum(1)[:, :-1], counts.cumsum(1)[:, :-1]
    rest = n - many
    open_ = (many > 0.5) & (rest > 0.5)
    if allowed is not None:
        open_ &= allowed[:, None]
    gain = np.where(open_, left * left / np.maximum(many, 0.5) + (s - left) ** 2 / np.maximum(rest, 0.5), -np.inf)
    if not gain.size or not gain.flat[k := int(gain.argmax())] - s * s / n > 1e-10 * n:
        return None
    return *divmod(k, gain.shape[1]), left.flat[k], many.flat[k]


def grow(out: Grown, t: int, codes: np.ndarray, places: Codes, y: np.ndarray, rows: np.ndarray | None = None, weight: np.ndarray | None = None, counts: np.ndarray | None = None, allow: Callable | None = None, classes: list | None = None, fitted: np.ndarray | None = None, step: float = 1.0) -> None:
    """Tree t of out, fitted to y (already times weight) over rows, None for all. fitted: gets step times the tree's values added.

    counts: the root's, where they are known. allow: makes the features that a node may use.
    """
    tables = lambda at: places.tallied(codes, at, y, weight, classes=classes)
    size = len(y) if rows is None else len(rows)
    first = tables(rows) if counts is None else [*places.tallied(codes, rows, y, classes=classes), counts]
    total = y.sum() if rows is None else y.take(rows).sum()
    number = size if weight is None else (weight if rows is None else weight.take(rows)).sum()
    todo = [(1, 0, rows, first, float(total), float(number))]

    def leaf(node: int, level: int, s: float, n: float) -> float:
        out.value[t, (node << (out.depth - level)) - (1 << out.depth)] = step * s / n
        return step * s / n

    def add(at: np.ndarray | None, x) -> None:
        if fitted is not None:
            fitted[slice(None) if at is None else at] += x

    while todo:
        node, level, at, (sums, number), s, n = todo.pop()
        found = _best(sums, number, s, n, allow and allow()) if level < out.depth else None
        if found is None:
            add(at, leaf(node, level, s, n))
            continue
        f, cut, s_left, n_left = found
        out.feature[t, node], out.cut[t, node] = f, cut
        sides = ((2 * node, s_left, n_left), (2 * node + 1, s - s_left, n - n_left))
        last = level + 1 == out.depth
        if last and fitted is None:
            for k, a, b in sides:
                leaf(k, level + 1, a, b)
            continue
        g, shift, mask = places.place[f]
        right = ((codes[g] if at is None else codes[g].take(at)) >> shift & mask) > cut
        if last:
            low, high = (leaf(k, level + 1, a, b) for k, a, b in sides)
            add(at, np.where(right, high, low))
            continue
        ats = [np.flatnonzero(~right), np.flatnonzero(right)]
        ats = ats if at is None else [at.take(x) for x in ats]
        small = int(len(ats[1]) < len(ats[0]))
        made = tables(ats[small])
        rest = [sums - made[0], number - made[1]]
        rest[0][rest[1] < 0.5] = 0.0  # what is left of rounding where no rows are
        for k in (small, 1 - small):
            todo.append((sides[k][0], level + 1, ats[k], made if k == small else rest, *sides[k][1:]))


class Boosting(NamedTuple):
    trees: int
    depth: int
    step: float


class Forest(NamedTuple):
    trees: int
    depth: int
    seed: int


def asked(model: GBTRegressor | RandomForestRegressor) -> Boosting | Forest:
    """What an estimator asks for, without its engine's object."""
    if isinstance(model, GBTRegressor):
        return Boosting(model.getMaxIter(), model.getMaxDepth(), model.getStepSize())
    return Forest(model.getNumTrees(), model.getMaxDepth(), model.getSeed())


def boosted_trees(model: Boosting, codes: np.ndarray, places: Codes, y: np.ndarray) -> Grown:
    out, fitted = Grown(model.trees, model.depth), np.zeros(len(y))
    counts, classes = places.tallied(codes, None, None)[0], places.classes(codes)
    for t in range(model.trees):
        grow(out, t, codes, places, y - fitted, counts=counts, classes=classes, fitted=fitted, step=2 * model.step if t else 1.0)
    return out


def forest_trees(model: Forest, codes: np.ndarray, places: Codes, y: np.ndarray, which: range, fold: int) -> Grown:
    """The forest's trees of these numbers: rows drawn as often as a Poisson number of mean 1, a third of the features at a node."""
    out, features = Grown(len(which), model.depth), len(places.edges)
    some = -(-features // 3) if model.trees > 1 else features
    classes = places.classes(codes)
    for k, t in enumerate(which):
        rng = np.random.default_rng([model.seed & 0xFFFFFFFF, fold, t])
        weight = DRAWN.take(rng.integers(0, len(DRAWN), len(y), np.uint16)).astype(np.float64)
        rows = np.flatnonzero(weight)
        rows = rows if len(rows) else np.arange(len(y))
        weight = weight if weight.any() else np.ones(len(y))
        allow = lambda: np.isin(np.arange(features), rng.permutation(features)[:some])  # noqa: E731, B023
        grow(out, k, codes, places, weight * y, rows, weight, allow=allow, classes=classes)
    out.value /= model.trees
    return out


def bytes_a_row(places: Codes) -> int:
    """What a task holds for a row at most: its codes twice as they arrive, and 16 numbers besides."""
    return 4 * len(places.groups) + 16 * 8


CHUNKS = "fold int, part int, at int, codes binary, stars binary"


def chunks(rows: DataFrame, columns: list[str], places: Codes) -> DataFrame:
    """rows (the columns, stars, fold) as codes and stars, some thousand rows of one fold in one; staged."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            fold, stars = b.column("fold").to_numpy(), b.column("stars").cast(pa.float64()).to_numpy()
            codes = places.packed(places.binned(_numbers(b, columns)))
            folds = np.unique(fold)
            of = [np.flatnonzero(fold == x) for x in folds]
            yield pa.RecordBatch.from_arrays([pa.array(folds.astype(np.int32)), *(pa.array([x] * len(folds), pa.int32()) for x in (part, k)), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in ([codes[:, x] for x in of], [stars[x] for x in of]))], ["fold", "part", "at", "codes", "stars"])

    return stage(on_all_cores(rows.select(*columns, "stars", "fold")).mapInArrow(coded, CHUNKS))


def _opened(codes: bytes, stars: bytes, places: Codes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(codes, np.uint16).reshape(len(places.groups), -1) if places.groups else np.zeros((0, len(stars) // 8), np.uint16), np.frombuffer(stars, np.float64)


def fits(coded: DataFrame, places: Codes, folds: int, boost: Boosting, forest: Forest, parts: int = 2) -> dict[tuple[int, int], list[Grown]]:
    """By fold and model (0 boosted, 1 forest): trees fitted to the other folds' chunks, a task each, a forest in parts; the boosted ones, which take longest, start first."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, task = [], None
        for b in batches:
            for task, *order, codes, stars in zip(*(b.column(c).to_pylist() for c in ("task", "part", "at", "fold", "codes", "stars"))):
                got.append((order, codes, stars))
        if task is None:
            return
        got.sort(key=lambda x: x[0])  # the same sums and draws however the chunks arrive
        each = [_opened(c, s, places) for _, c, s in got]
        codes, y = np.concatenate([c for c, _ in each], 1), np.concatenate([s for _, s in each])
        del got, each
        part, fold = divmod(task, folds)
        made = forest_trees(forest, codes, places, y, range((part - 1) * forest.trees // parts, part * forest.trees // parts), fold) if part else boosted_trees(boost, codes, places, y)
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([part], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], ["fold", "part", "trees"])

    tasks = folds * (1 + parts)
    dealt = coded.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).where(F.col("task") % folds != F.col("fold"))
    out: dict[tuple[int, int], list[Grown]] = {}
    for r in sorted(dealt.repartitionById(tasks, "task").mapInArrow(fitted, "fold int, part int, trees binary").collect(), key=lambda r: r["part"]):
        out.setdefault((r["fold"], min(r["part"], 1)), []).append(pickle.loads(r["trees"]))
    if len(out) != 2 * folds:
        raise ValueError("a fold has all of the rows")
    return out


def of_left_out(coded: DataFrame, places: Codes, models: dict) -> DataFrame:
    """stars, p0, p1: the chunks' rows as the models of their own fold, which have not seen them, predict them."""
    held = coded.sparkSession.sparkContext.broadcast(models)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold, codes, stars in zip(*(b.column(c).to_pylist() for c in ("fold", "codes", "stars"))):
                codes, y = _opened(codes, stars, places)
                binned = places.unpacked(codes)
                yield pa.RecordBatch.from_arrays([pa.array(y), *(pa.array(sum(m.summed(binned) for m in held.value[fold, i])) for i in (0, 1))], ["stars", "p0", "p1"])

    return on_all_cores(coded).mapInArrow(predicted, "stars double, p0 double, p1 double")


def of_new(rows: DataFrame, key: list[str], columns: list[str], places: Codes, models: dict, folds: int) -> DataFrame:
    """The key, p0, p1: the mean over folds of what each model predicts."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            binned = places.binned(_numbers(b, columns))
            means = [sum(m.summed(binned) for k in range(folds) for m in held.value[k, i]) / folds for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), *map(pa.array, means)], [*key, "p0", "p1"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key), "p0 double, p1 double"])
    return on_all_cores(rows.select(*key, *columns)).mapInArrow(predicted, schema)
