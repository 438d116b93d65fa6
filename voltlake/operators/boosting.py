"""Gradient boosting of regression trees on binned features, for squared error.

A round needs sums of gradients by node, feature and bin, and nothing else of the rows. They are
sums of whole numbers, and rows are drawn by a hash of what they hold: so trees do not depend on
how rows are ordered or dealt out, and are the same from one process as from many tasks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import filled, signed_log
from ..session import cut, shared_dir, ship

#: Gradients are rounded to a whole number of these parts.
PARTS = float(1 << 24)
#: A split must lower the loss by more.
LEAST_GAIN = 1e-6
#: Bins of a feature, at most: a bin is a byte.
BINS = 256
#: Rounds between checkpoints of the rows' scores, if many tasks hold them.
KEPT_EVERY = 25


@dataclass
class Block:
    """Rows of the training set, in columns."""

    key: np.ndarray
    label: np.ndarray
    score: np.ndarray
    bins: np.ndarray


@dataclass
class Tree:
    """By node: the feature and the last bin of the left side (feature -1: a leaf), the children, the value
    of a row that ends there and the gain of the split."""

    column: np.ndarray
    upto: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def cuts_of(values: np.ndarray) -> np.ndarray:
    """The largest value of each bin but the last: of every distinct value, else of 256 equal shares."""
    v = values[~np.isnan(values)]
    found = np.unique(v)
    if len(found) > BINS:
        found = np.unique(np.quantile(v, np.linspace(0, 1, BINS), method="inverted_cdf"))
    return found[:-1]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """NaN is in the last bin."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8)


def route(bins: np.ndarray, column, upto, left, right) -> np.ndarray:
    """The node that each row ends in."""
    column, upto, left, right = (np.asarray(x) for x in (column, upto, left, right))
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows := rows[column[at[rows]] >= 0]):
        node = at[rows]
        at[rows] = np.where(bins[rows, column[node]] <= upto[node], left[node], right[node])
    return at


def values(bins: np.ndarray, t: Tree) -> np.ndarray:
    return t.value[route(bins, t.column, t.upto, t.left, t.right)]


def drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a round takes: a hash (splitmix64) of the row's and the round's."""
    z = key + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) < share * 2.0**53


@dataclass
class Draw:
    """What a round looks at: rows by seed and share, features, and where a feature's bins begin."""

    seed: int
    share: float
    columns: np.ndarray
    starts: np.ndarray
    width: int

    def tally(self, b: Block, shape: tuple, nodes: list[int]) -> np.ndarray:
        """Sums of gradients and rows by node and bin."""
        at = route(b.bins, *shape)
        slot = np.full(len(shape[0]), -1)
        slot[nodes] = np.arange(len(nodes))
        rows = np.flatnonzero((slot[at] >= 0) & drawn(b.key, self.seed, self.share))
        grad = np.rint((b.score[rows] - b.label[rows]) * PARTS)
        cell = (slot[at[rows]] * self.width)[:, None] + self.starts + b.bins[rows][:, self.columns]
        size = len(nodes) * self.width
        sums = np.bincount(cell.ravel(), np.repeat(grad, len(self.columns)), size), np.bincount(cell.ravel(), minlength=size)
        return np.stack(sums).astype(np.int64).reshape(2, len(nodes), self.width)


class Here:
    """The training set in one process."""

    def __init__(self, block: Block):
        self.block = block

    def tally(self, draw: Draw, shape: tuple, nodes: list[int]) -> np.ndarray:
        return draw.tally(self.block, shape, nodes)

    def advance(self, t: Tree) -> None:
        self.block.score += values(self.block.bins, t)

    def close(self) -> None:
        pass


class Spread:
    """The training set in blocks over Spark's partitions."""

    def __init__(self, blocks: DataFrame):
        shared_dir(blocks.sparkSession)
        self.rdd, self.old, self.rounds = blocks.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK), None, 0

    def tally(self, draw: Draw, shape: tuple, nodes: list[int]) -> np.ndarray:
        def part(blocks):
            total = None
            for b in blocks:
                sums = draw.tally(b, shape, nodes)
                total = sums if total is None else total + sums
            return [] if total is None else [total]

        out = self.rdd.mapPartitions(part).treeReduce(np.add)
        if self.old is not None:  # the new scores are made by now
            self.old.unpersist()
            self.old = None
        return out

    def advance(self, t: Tree) -> None:
        self.old, self.rounds = self.rdd, self.rounds + 1
        self.rdd = self.old.map(lambda b: Block(b.key, b.label, b.score + values(b.bins, t), b.bins)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % KEPT_EVERY == 0:
            self.rdd.checkpoint()

    def close(self) -> None:
        for r in (self.rdd, self.old):
            if r is not None:
                r.unpersist()


@dataclass
class BoostedModel:
    """Boosted trees on the signed logarithm of the price; options have the names of pyspark.ml
    where it has them. A tree splits the leaf of largest gain first, until it has `leaves` leaves,
    or all leaves, if there is no such limit. Each round draws rows and features. A training set of
    up to `here_rows` rows is fitted in one task, a larger one in many, one job for each
    level of a tree, on bins that end at approximate percentiles. All rows are used at any size."""

    columns: list[str]
    maxIter: int = 300
    stepSize: float = 0.05
    maxDepth: int | None = 6
    leaves: int | None = None
    minInstancesPerNode: int = 3
    subsamplingRate: float = 0.8
    featureSubsetStrategy: str = "0.8"
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 42
    here_rows: int = 100_000
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def fit(self, df: DataFrame) -> BoostedModel:
        data = filled(df, self.columns).withColumn("label", signed_log(F.col("spot"))).where("label is not null")
        data = data.select("label", F.xxhash64("label", *self.columns).alias("key"), *self.columns)
        n, total = data.agg(F.count("*"), F.sum(F.rint(F.col("label") * PARTS).cast("bigint"))).first()
        self.base, self.cuts, self.trees = (total or 0) / PARTS / max(n, 1), [], []
        if n > self.here_rows:
            self._boost(self._spread(data))
        elif n:
            self.cuts, self.trees = self._fit_in_task(data)
        return self

    def _fit_in_task(self, data: DataFrame) -> tuple[list, list]:
        ship(data.sparkSession)
        model = replace(self, cuts=[], trees=[])

        def one(frames):
            rows = pd.concat(frames, ignore_index=True)  # `here_rows` rows at most
            model.cuts = [cuts_of(rows[c].to_numpy(float)) for c in model.columns]
            model._boost(Here(model._block(rows)))
            yield pd.DataFrame({"state": [pickle.dumps((model.cuts, model.trees))]})

        return pickle.loads(data.repartition(1).mapInPandas(one, "state binary").collect()[0][0])

    def _block(self, rows: pd.DataFrame) -> Block:
        label = rows["label"].to_numpy(float)
        return Block(rows["key"].to_numpy(np.int64).view(np.uint64), label, np.full(len(rows), self.base), binned(rows[self.columns].to_numpy(float), self.cuts))

    def _spread(self, data: DataFrame) -> Spread:
        ship(data.sparkSession)
        shares = data.approxQuantile(self.columns, np.linspace(0, 1, BINS).tolist(), 0.0005)
        self.cuts = [np.unique(v)[:-1] for v in shares]
        block = self._block

        def pack(frames):
            for rows in frames:
                if len(rows):
                    yield pd.DataFrame({"block": [pickle.dumps(block(rows))]})

        return Spread(cut(data.mapInPandas(pack, "block binary"), "boost"))

    def _boost(self, rows: Here | Spread) -> None:
        p = len(self.columns)
        for i in range(self.maxIter):
            some = np.sort(np.random.default_rng((self.seed, i)).choice(p, max(1, round(float(self.featureSubsetStrategy) * p)), replace=False))
            widths = np.array([len(self.cuts[j]) + 1 for j in some])
            draw = Draw(self.seed * 1_000_003 + i, self.subsamplingRate, some, np.cumsum(widths) - widths, int(widths.sum()))
            self.trees.append(self._grow(draw, widths, lambda shape, nodes: rows.tally(draw, shape, nodes)))
            rows.advance(self.trees[-1])
        rows.close()

    def _strength(self, grad: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and twice the loss taken off by nodes with such sums, with L1 and L2 penalties."""
        g = grad / PARTS
        g = np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0)
        bottom = np.maximum(n + self.l2, 1e-12)
        return -g / bottom, g * g / bottom

    def _grow(self, draw: Draw, widths: np.ndarray, tally: Callable) -> Tree:
        """All leaves that may be split next are tallied at once, as if their children had no gain;
        then growth is played again with what is known, until nothing unknown is met. Of two
        children the smaller is tallied; the other's sums are what it leaves of the parent's."""
        column, upto, left, right, depth, value, size = [-1], [0], [-1], [-1], [0], [0.0], [0]
        most, least = self.leaves or np.inf, max(1, self.minInstancesPerNode)
        found: dict[int, tuple] = {}
        sums = {0: tally((column, upto, left, right), [0])[:, 0]}
        value[0] = float(self._strength(*sums[0][:, : widths[0]].sum(1))[0])
        new = [0]
        while new:
            found |= zip(new, self._splits(np.stack([sums[i] for i in new], 1), draw, widths, least))
            new, small, order, heap = [], {}, [], [(-found[0][0], 0)]
            while heap and len(order) + 1 < most and -heap[0][0] > LEAST_GAIN:
                node = heapq.heappop(heap)[1]
                order.append(node)
                if column[node] < 0:
                    _, column[node], upto[node], worth, sizes = found[node]
                    left[node], right[node] = len(column), len(column) + 1
                    for v, n in zip(worth, sizes):
                        if depth[node] + 1 == self.maxDepth or n < 2 * least:
                            found[len(column)] = (0.0,)
                        for x, at_start in ((column, -1), (upto, 0), (left, -1), (right, -1), (depth, depth[node] + 1), (value, v), (size, n)):
                            x.append(at_start)
                for child in (left[node], right[node]):
                    if child in found:
                        heapq.heappush(heap, (-found[child][0], child))
                    else:
                        new.append(child)
                        small[node] = min(left[node], right[node], key=size.__getitem__)
            if small:
                got = tally((column, upto, left, right), list(small.values()))
                for k, (node, child) in enumerate(small.items()):
                    sums[child] = got[:, k]
                    sums[left[node] + right[node] - child] = sums.pop(node) - got[:, k]
        # Without the nodes that were looked at and not reached in the end.
        nodes = [0, *(c for node in order for c in (left[node], right[node]))]
        place, inner = {node: k for k, node in enumerate(nodes)}, set(order)
        pick = lambda f, other: np.array([f(i) if i in inner else other for i in nodes])
        return Tree(
            pick(column.__getitem__, -1), pick(upto.__getitem__, 0), pick(lambda i: place[left[i]], -1), pick(lambda i: place[right[i]], -1),
            self.stepSize * np.array([value[i] for i in nodes]), pick(lambda i: found[i][0], 0.0))

    def _splits(self, sums: np.ndarray, draw: Draw, widths: np.ndarray, least: int) -> list[tuple]:
        """Of each node the best split: gain, feature, last bin on the left, the sides' values and rows."""
        whole = sums[:, :, : widths[0]].sum(2, keepdims=True)
        low = np.cumsum(sums, 2) - whole * np.repeat(np.arange(len(widths)), widths)
        high = whole - low
        gain = self._strength(*low)[1] + self._strength(*high)[1] - self._strength(*whole)[1]
        gain[(low[1] < least) | (high[1] < least)] = 0.0
        out = []
        for k, at in enumerate(gain.argmax(1)):
            j = int(np.searchsorted(draw.starts, at, "right")) - 1
            sides = [x[:, k, at] for x in (low, high)]
            out.append((float(gain[k, at]), int(draw.columns[j]), int(at - draw.starts[j]), [float(self._strength(*s)[0]) for s in sides], [int(s[1]) for s in sides]))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        columns, base, cuts, trees = self.columns, self.base, self.cuts, self.trees
        ship(df.sparkSession)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            z = np.full(len(x), base)
            if trees:
                bins = binned(x[columns].to_numpy(float), cuts)
                for t in trees:
                    z += values(bins, t)
            return pd.Series(np.sign(z) * np.expm1(np.abs(z)))

        return df.withColumn("prediction", score(F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))))

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of all gains, falling."""
        total = np.zeros(len(self.columns))
        for t in self.trees:
            np.add.at(total, t.column[t.column >= 0], t.gain[t.column >= 0])
        return sorted(zip(self.columns, (total / (total.sum() or 1.0)).tolist()), key=lambda x: (-x[1], x[0]))
