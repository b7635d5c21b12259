"""Boosted trees over one written table, with the splits of MLlib's GBTClassifier.

Numbers are cut once into ranges of about equal counts, a category is its slot and
is asked one level against the rest. A level of a tree is one pass: tasks sum
rows and residuals per node, input and bin, the driver picks the splits. Of two
siblings only the one with fewer rows is summed, the other is the parent's rest.
Residuals are added as whole numbers, so a tree does not depend on the dealing
of the rows. Sums have (nodes x bins) numbers whatever the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .ordered import prefix

#: Rows of a block; parts of a residual's unit; trees between two states that are worked out from the table anew.
BLOCK, UNIT, ANEW = 65_536, float(1 << 28), 45
#: Partitions whose sums the driver adds by itself.
DIRECT = 64

Block = tuple[list[np.ndarray], np.ndarray, np.ndarray]  # bins of every input, label as -1 or 1, margin


def cut_points(rows: DataFrame, numeric: list[str], bins: int) -> list[np.ndarray]:
    """Per input the borders of at most ``bins`` ranges, between neighbouring values: all of them where there are few.

    Otherwise the k-th border lies where the running count comes closest to k strides, and after the border before.
    """
    total = rows.count()
    bins = min(bins, total)
    if not total or not numeric:
        return [np.zeros(0) for _ in numeric]
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_f"), F.col(c).alias("_x")) for i, c in enumerate(numeric)])))
    counts = long.groupBy("_f", "_x").agg(F.count("*").alias("_n"))
    placed = materialize(prefix(counts, [F.col("_x")], by=["_f"], sums=["_n"], rank="_rank", totals={"_values": None}))
    stride = total / bins
    targets = np.cumsum(np.full(bins + 1, stride))
    # strides passed half-way from the value before to this one; the added-up targets settle ties
    middle, near = F.col("cum__n") - F.col("_n") / 2, F.array(*[F.lit(float(t)) for t in targets])
    base = F.floor(middle / stride).cast("int")
    over = (F.element_at(near, base + 1) < middle).cast("int") - F.when((base > 0) & (F.element_at(near, F.greatest(base, F.lit(1))) >= middle), 1).otherwise(0)
    passed = F.when(F.col("_rank") > 1, base + over).otherwise(0)
    first: dict[int, dict[int, int]] = {}
    values: dict[int, int] = {}
    for r in placed.groupBy("_f", passed.alias("_k")).agg(F.min("_rank").alias("_rank"), F.max("_values").alias("_values")).collect():  # at most bins rows per input
        first.setdefault(r["_f"], {})[r["_k"]] = r["_rank"]
        values[r["_f"]] = r["_values"]
    ends: dict[int, list[int]] = {}
    for f, n in values.items():
        if n <= bins:
            ends[f] = list(range(2, n + 1))
            continue
        at, last = 1, []
        for k in range(1, max(first[f]) + 1):
            at = max(at + 1, min(rank for q, rank in first[f].items() if q >= k))
            if at <= n:
                last.append(at)
        ends[f] = last
    wanted = sorted({(f, rank - back) for f, ranks in ends.items() for rank in ranks for back in (0, 1)})
    if not wanted:
        return [np.zeros(0) for _ in numeric]
    asked = F.broadcast(rows.sparkSession.createDataFrame(wanted, "_f int, _rank bigint"))  # two per border
    x = {(r["_f"], r["_rank"]): r["_x"] for r in placed.join(asked, ["_f", "_rank"]).select("_f", "_rank", "_x").collect()}
    return [np.array([(x[f, rank - 1] + x[f, rank]) / 2 for rank in ends.get(f, [])], dtype=float) for f in range(len(numeric))]


@dataclass
class Tree:
    """Nodes by level, the children of i are 2 i + 1 and 2 i + 2; a node without an input is a leaf."""

    depth: int
    numbers: int  # so many inputs come first that are cut; the others are asked for one slot
    inputs: np.ndarray
    places: np.ndarray
    values: np.ndarray

    @classmethod
    def empty(cls, depth: int, numbers: int) -> Tree:
        inner = 2**depth - 1
        return cls(depth, numbers, np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(2 * inner + 1))

    def split(self, bins: list[np.ndarray], levels: int) -> dict[int, np.ndarray]:
        """Rows by the node that they reach within ``levels`` splits."""
        out, going = {}, {0: np.arange(len(bins[0]))}
        for _ in range(levels):
            further = {}
            for node, rows in going.items():
                f = self.inputs[node]
                if f < 0:
                    out[node] = rows
                    continue
                own = bins[f][rows]
                left = own <= self.places[node] if f < self.numbers else own == self.places[node]
                further[2 * node + 1], further[2 * node + 2] = rows[left], rows[~left]
            going = further
        return out | going

    def scores(self, bins: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(bins[0]))
        for node, rows in self.split(bins, self.depth).items():
            out[rows] = self.values[node]
        return out


def residuals(sign: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """Slope of the log loss in units, or the labels where there is no tree yet."""
    if margin is None:
        return sign * UNIT
    with np.errstate(over="ignore"):
        return np.rint(4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)) * UNIT)


def summed(blocks: Iterator[Block], tree: Tree, level: int, nodes: list[int], starts: list[int], start: bool) -> Iterator[np.ndarray]:
    """Rows and residuals per node and bin, over the blocks of a task."""
    total, k = np.zeros((2, len(nodes), starts[-1]), np.int64), len(nodes)
    for bins, sign, margin in blocks:
        if level:
            reached = tree.split(bins, level)
            groups = [reached[n] for n in nodes]
            rows, node = np.concatenate(groups), np.repeat(np.arange(k), [len(g) for g in groups])
        else:
            rows, node = slice(None), 0
        r = residuals(sign[rows], None if start else margin[rows])
        for own, a, b in zip(bins, starts, starts[1:]):
            at = own[rows] + node * (b - a)
            total[0, :, a:b] += np.bincount(at, minlength=k * (b - a)).reshape(k, -1)
            total[1, :, a:b] += np.bincount(at, r, k * (b - a)).astype(np.int64).reshape(k, -1)
    yield total


@dataclass
class Boosted:
    """Fitted trees; the first counts whole, the others at the learning rate."""

    numeric: list[str]
    cuts: list[np.ndarray]
    slots: list[tuple[str, int]]
    rounds: int
    rate: float
    depth: int = 5
    least: int = 30
    trees: list[Tree] = field(default_factory=list)

    def starts(self) -> list[int]:
        """Where the bins of each input begin; a category has a last one for levels that training has not seen."""
        return [0, *(int(n) for n in np.cumsum([*[len(c) + 1 for c in self.cuts], *[k + 1 for _, k in self.slots]]))]

    def weights(self) -> list[float]:
        return [1.0, *[self.rate] * (len(self.trees) - 1)]

    def blocks(self, rows: DataFrame) -> RDD:
        """The written rows as blocks of bins, with margins of zero."""
        numeric, cuts, slots = self.numeric, self.cuts, self.slots

        def packed(held: list) -> pa.RecordBatch:
            bins, sign = [np.concatenate(c) for c in zip(*[b for b, _ in held])], np.concatenate([s for _, s in held])
            return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps((bins, sign, np.zeros(len(sign))), protocol=5)], pa.binary())})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    sign = np.where(batch.column("label").to_numpy(zero_copy_only=False) > 0, 1, -1).astype(np.int8)
                    held.append((binned(batch, numeric, cuts, slots), sign))
                    n += batch.num_rows
                if n >= BLOCK:
                    yield packed(held)
                    held, n = [], 0
            if held:
                yield packed(held)

        ship_package(rows.sparkSession)
        return rows.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0]))

    def grown(self, blocks: RDD, since: int) -> RDD:
        """The blocks with the trees from ``since`` on added to their margins; kept until the next tree is there."""
        some = list(zip(self.trees, self.weights()))[since:]

        def run(parts: Iterator[Block]) -> Iterator[Block]:
            for bins, sign, margin in parts:
                for tree, weight in some:
                    margin = margin + weight * tree.scores(bins)
                yield bins, sign, margin

        return blocks.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)

    def chosen(self, sums: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        """(input, place, sums of the left side and of the right) of the split that lowers the squared error most."""
        starts = self.starts()
        left, whole = sums.copy(), sums[:, :starts[1]].sum(axis=1, keepdims=True)
        for f, (a, b) in enumerate(zip(starts, starts[1:])):
            if f < len(self.numeric):
                left[:, a:b] = np.cumsum(left[:, a:b], axis=1)
            left[0, b - 1] = 0  # the last range has nothing beside it, unseen levels are not asked for
        right = whole - left
        good = (left[0] >= self.least) & (right[0] >= self.least)
        n, m = np.where(good, left[0], 1), np.where(good, right[0], 1)
        gain = np.where(good, n * (m / float(whole[0, 0])) * (left[1] / n - right[1] / m) ** 2, 0.0)
        at = int(gain.argmax())
        if not gain[at] > 0:
            return None
        f = int(np.searchsorted(starts, at, "right")) - 1
        return f, at - starts[f], np.stack([left[:, at], right[:, at]])

    def grow(self, state: RDD) -> Tree:
        """One more tree, level by level."""
        tree, starts, first, wide = Tree.empty(self.depth, len(self.numeric)), self.starts(), not self.trees, state.getNumPartitions() > DIRECT
        known, asked = {}, [0]
        for level in range(self.depth):
            job = state.mapPartitions(lambda parts, level=level, asked=asked: summed(parts, tree, level, asked, starts, first))
            found = job.treeReduce(lambda a, b: a + b, 2 if wide else 1)
            sums = {n: found[:, i] for i, n in enumerate(asked)}
            if not level:
                n, total = sums[0][:, :starts[1]].sum(axis=1)
                tree.values[0] = total / n / UNIT
            for n in asked if level else []:  # the sibling is what is left of the parent
                sums[n + 1 if n % 2 else n - 1] = known[(n - 1) // 2] - sums[n]
            known, asked = sums, []
            for node in sorted(sums):
                best = self.chosen(sums[node])
                if best is None:
                    continue
                tree.inputs[node], tree.places[node], sides = best
                for child, (n, total) in zip((2 * node + 1, 2 * node + 2), sides):
                    tree.values[child] = total / n / UNIT
                asked.append(2 * node + (1 if sides[0, 0] <= sides[1, 0] else 2))
            if not asked:
                break
        return tree

    def fit(self, rows: DataFrame) -> Boosted:
        base = self.blocks(rows)
        state = self.grown(base, 0)
        self.trees.append(self.grow(state))
        while len(self.trees) < self.rounds:
            # now and then from the table with all trees, so that a lost task has few steps to repeat
            done = len(self.trees)
            further = self.grown(base, 0) if done % ANEW == 0 else self.grown(state, done - 1)
            tree = self.grow(further)
            state.unpersist()
            state = further
            self.trees.append(tree)
        state.unpersist()
        return self

    def probabilities(self, df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
        """The ``keep`` columns and the probabilities of label 0 and 1."""
        numeric, cuts, slots, trees, weights = self.numeric, self.cuts, self.slots, self.trees, self.weights()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, margin = binned(batch, numeric, cuts, slots), np.zeros(batch.num_rows)
                for tree, weight in zip(trees, weights):
                    margin += weight * tree.scores(bins)
                with np.errstate(over="ignore"):
                    one = 1.0 / (1.0 + np.exp(-2.0 * margin))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(1.0 - one), pa.array(one)], names=[*keep, *names])

        ship_package(df.sparkSession)
        types = dict(df.dtypes)
        schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"`{n}` double" for n in names]])
        return df.select(*dict.fromkeys([*keep, *numeric, *[c for c, _ in slots]])).mapInArrow(run, schema)


def binned(batch: pa.RecordBatch, numeric: list[str], cuts: list[np.ndarray], slots: list[tuple[str, int]]) -> list[np.ndarray]:
    """Place of every number among its cuts, a value on a cut before it, and the slots of the categories."""
    numbers = [np.searchsorted(c, batch.column(n).to_numpy(zero_copy_only=False), "left").astype(np.uint8 if len(c) < 256 else np.int32) for n, c in zip(numeric, cuts)]
    return [*numbers, *[batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint8 if k < 256 else np.int32) for c, k in slots]]


def fit(rows: DataFrame, numeric: list[str], slots: list[tuple[str, int]], rounds: int = 180, rate: float = 0.05, bins: int = 255) -> Boosted:
    """Trees for the 0/1 ``label`` of the written rows; numbers without gaps, categories as slots with their counts."""
    return Boosted(numeric, cut_points(rows, numeric, bins), slots, rounds, rate).fit(rows)
