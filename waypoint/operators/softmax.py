"""Softmax regressions of several training sets and input sets over one written table.

All models of a study read the same rows, so they are fitted side by side: one
pass returns every model's loss, slope and curvature, summed in the tasks, and the
driver solves for its Newton step. Sums have (classes x inputs) squared numbers
per model whatever the rows, and a fit takes a few passes where a first-order
solver takes a hundred. The penalty is the one of ``models.logistic``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true, number
from ..session import materialize, ship_package
from .models import Features, check_inputs, fit_features, training_stats

#: Classes x inputs of one model, at most: the sums hold about half its square.
MAX_PARAMETERS = 1_000
BLOCK, CHUNK = 8_192, 2_048


@dataclass
class Training:
    """One training set: which rows it has, and their preparation in plain numbers for the tasks."""

    features: Features
    mark: str
    numeric: list[str]
    stats: np.ndarray  # median, mean, spread of each number
    slots: list[tuple[str, int]]

    def design(self, x: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Numbers and slots of this training set as ``Features.transform`` lays them out, and a column of ones."""
        n = len(self.numeric)
        median, mean, spread = self.stats.T
        out = np.zeros((len(x), n + sum(k for _, k in self.slots) + 1))
        out[:, :n] = (np.where(np.isnan(x), median, x) - mean) / np.where(spread > 0, spread, 1.0)
        at = n
        for (_, k), slot in zip(self.slots, slots.T, strict=True):
            known = np.flatnonzero(slot < k)
            out[known, at + slot[known]] = 1.0
            at += k
        out[:, -1] = 1.0
        return out


def columns(batch: pa.RecordBatch, names: list[str], kind: type) -> np.ndarray:
    """The named columns side by side; a missing number is NaN."""
    out = np.empty((batch.num_rows, len(names)), kind)
    for i, c in enumerate(names):
        out[:, i] = batch.column(c).to_numpy(zero_copy_only=False)
    return out


@dataclass
class Softmax:
    """One model: weights of its inputs and a last column of intercepts, one line per class that occurs in training."""

    training: str
    inputs: str
    places: list[int]
    rows: int
    live: list[int]
    weights: np.ndarray
    penalty: float
    history: list[float] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray, y: np.ndarray, curved: bool) -> np.ndarray:
        """Summed loss, slope per class and, if asked for, curvature per pair of classes."""
        k, d = self.weights.shape
        pairs = list(combinations(range(k), 2)) if curved else []
        loss, slope, curve = 0.0, np.zeros((k, d)), np.zeros((len(pairs), d, d))
        for a in range(0, len(x), CHUNK):
            own = x[a:a + CHUNK]
            p = self.probabilities(own)
            hit = y[a:a + CHUNK, None] == np.array(self.live)
            loss -= np.log(np.maximum(p[hit], 1e-300)).sum()
            slope += (p - hit).T @ own
            root = np.sqrt(p)
            for i, (b, c) in enumerate(pairs):
                z = own * (root[:, b] * root[:, c])[:, None]
                curve[i] += z.T @ z
        return np.concatenate([[loss], slope.ravel(), curve.ravel()])

    def unpacked(self, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(objective, its slope, curvature blocks per pair of classes), averaged over the rows."""
        k, d = self.weights.shape
        mean = sums / self.rows
        w = self.weights.copy()
        w[:, -1] = 0.0  # intercepts are free
        return mean[0] + self.penalty / 2 * (w * w).sum(), mean[1:1 + k * d].reshape(k, d) + self.penalty * w, mean[1 + k * d:].reshape(-1, d, d)

    def step(self, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
        k, d = slope.shape
        h = np.zeros((k, d, k, d))
        for (b, c), block in zip(combinations(range(k), 2), curve, strict=True):
            h[b, :, b, :] += block
            h[c, :, c, :] += block
            h[b, :, c, :] -= block
            h[c, :, b, :] -= block
        for c in range(k):
            h[c, range(d - 1), c, range(d - 1)] += self.penalty
        h[:, -1, :, -1] += 1.0 / k  # one number added to all intercepts changes nothing: steps keep their sum
        return -np.linalg.solve(h.reshape(k * d, k * d), slope.ravel()).reshape(k, d)


@dataclass
class Study:
    """The written rows, the training sets over them and the models to fit."""

    rows: DataFrame
    trainings: dict[str, Training]
    models: list[Softmax]
    classes: int

    def blocks(self) -> RDD:
        """The rows of any training set as blocks of numbers, marks, labels and slots; kept until the fits are done."""
        trainings = list(self.trainings.values())
        marks, slots, numeric = [t.mark for t in trainings], [[s for s, _ in t.slots] for t in trainings], trainings[0].numeric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    block = columns(batch, numeric, float), columns(batch, marks, bool), columns(batch, ["_label"], np.int16)[:, 0], [columns(batch, s, np.int32) for s in slots]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})

        ship_package(self.rows.sparkSession)
        own = self.rows.where(" OR ".join(marks)).select("_label", *marks, *numeric, *[s for t in slots for s in t])
        return own.mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def _passed(self, blocks: RDD, models: list[Softmax], curved: bool) -> list[np.ndarray]:
        """The sums of the given models over their training rows, one pass for all; added up in a tree of tasks."""
        trainings = self.trainings

        def run(packed: Iterator[bytes]) -> Iterator[np.ndarray]:
            totals = None
            for x, marks, label, slots in map(pickle.loads, packed):
                sums = []
                for i, (name, t) in enumerate(trainings.items()):
                    if not any(m.training == name for m in models):
                        continue
                    own = np.flatnonzero(marks[:, i])
                    full, y = t.design(x[own], slots[i][own]), label[own]
                    for m in models:
                        if m.training == name:
                            part = full if len(m.places) == full.shape[1] else np.ascontiguousarray(full[:, m.places])
                            sums.append(m.sums(part, y, curved))
                totals = sums if totals is None else [a + b for a, b in zip(totals, sums, strict=True)]
            if totals is not None:
                yield np.concatenate(totals)

        total = blocks.mapPartitions(run).treeReduce(lambda a, b: a + b)
        sizes = [m.weights.size + 1 + (len(m.live) * (len(m.live) - 1) // 2 * m.weights.shape[1] ** 2 if curved else 0) for m in models]
        return np.split(total, np.cumsum(sizes)[:-1])

    def fit(self, max_iter: int, tol: float = 1e-10) -> list[float]:
        """Newton steps, halved where the objective would rise, until the expected gain is below ``tol``.

        Returns per model its largest score equation, from a last pass over the rows; zero at the optimum.
        """
        blocks = self.blocks()
        going = {i: None for i in range(len(self.models))}  # the last step taken
        while going:
            passed = self._passed(blocks, [self.models[i] for i in going], True)
            for i, sums in zip(list(going), passed, strict=True):
                m, last = self.models[i], going[i]
                value, slope, curve = m.unpacked(sums)
                if m.history and not value <= m.history[-1] + 1e-12:
                    going[i] = last / 2
                    m.weights = m.weights - going[i]
                    if np.abs(going[i]).max() < 1e-12:
                        raise RuntimeError("the fit found no smaller objective")
                    continue
                m.history.append(float(value))
                step = m.step(slope, curve)
                if -(slope * step).sum() / 2 <= tol:
                    del going[i]
                elif len(m.history) > max_iter:
                    raise RuntimeError(f"the fit stopped at its limit of {max_iter} iterations")
                else:
                    going[i], m.weights = step, m.weights + step
        gaps = [float(np.abs(m.unpacked(s)[1][:, :-1]).max(initial=0.0)) for m, s in zip(self.models, self._passed(blocks, self.models, False), strict=True)]
        blocks.unpersist()
        return gaps

    def scored(self, test: dict[str, Column], keep: list[str]) -> DataFrame:
        """The ``keep`` columns and per model ``_prob_<i>``, its probabilities by class; NULL outside the training set's test rows.

        One pass scores all models, and its rows are written.
        """
        trainings, models, classes = self.trainings, self.models, self.classes
        marked = self.rows.withColumns({f"_s_{t.mark}": is_true(test[n]) for n, t in trainings.items()})
        marks = [f"_s_{t.mark}" for t in trainings.values()]
        needed = list(dict.fromkeys([*keep, *marks, *[c for t in trainings.values() for c in [*t.numeric, *[s for s, _ in t.slots]]]]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = {c: batch.column(c) for c in keep}
                found = {}
                for name, t in trainings.items():
                    own = np.flatnonzero(batch.column(f"_s_{t.mark}").to_numpy(zero_copy_only=False))
                    some = batch.take(pa.array(own))
                    found[name] = own, t.design(columns(some, t.numeric, float), columns(some, [s for s, _ in t.slots], np.int32))
                for i, m in enumerate(models):
                    own, x = found[m.training]
                    p = np.zeros((len(own), classes))
                    p[:, m.live] = m.probabilities(x[:, m.places])
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * classes, pa.int32()), pa.array(p.ravel()))
                    at = np.full(batch.num_rows, -1)
                    at[own] = np.arange(len(own))
                    out[f"_prob_{i}"] = values.take(pa.array(at, mask=at < 0))
                yield pa.RecordBatch.from_pydict(out)

        ship_package(self.rows.sparkSession)
        chosen = marked.select(*needed).where(" OR ".join(marks))
        types = dict(chosen.dtypes)
        schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"_prob_{i} array<double>" for i in range(len(models))]])
        return materialize(chosen.mapInArrow(run, schema))

    def audit(self, i: int, max_iter: int) -> dict:
        """As ``models.audit_row``."""
        m = self.models[i]
        falling = all(b <= a + 1e-12 for a, b in zip(m.history, m.history[1:], strict=False))
        return {"training_rows": m.rows, "iterations": len(m.history) - 1, "max_iterations": max_iter, "converged": True,
                "first_objective": m.history[0], "last_objective": m.history[-1], "falling": falling, "inputs": len(m.places) - 1}


def prepare(df: DataFrame, label: Column, classes: int, trainings: dict[str, Column], input_sets: dict[str, list[str]], numeric: list[str], categorical: list[str], keep: list[str], strength: float = 1.0) -> Study | None:
    """A study of every training set with every input set; None where a model has more than MAX_PARAMETERS.

    The table is written once: the numbers as they are, and per training set the
    mark of its rows and the slots of its levels.
    """
    check_inputs([*numeric, *categorical])
    stats = training_stats(df, numeric, trainings)
    fitted = {n: fit_features(df.where(where), numeric, categorical, stats[n]) for n, where in trainings.items()}
    if max(len(f.places()) + 1 for f in fitted.values()) * classes > MAX_PARAMETERS:
        return None
    rows = df.withColumns({"_label": label.cast("int"), **{f"_t{i}": is_true(where) & label.isNotNull() for i, where in enumerate(trainings.values())}})
    sets = {}
    for i, (n, f) in enumerate(fitted.items()):
        rows = f.slots(rows, f"_i{i}_")
        stats = np.array([f.stats[c] for c in numeric], dtype=float).reshape(-1, 3)
        sets[n] = Training(f, f"_t{i}", [f"_n_{c}" for c in numeric], stats, [(f"_i{i}_{c}", f.sizes[c][0]) for c in categorical])
    slots = [s for t in sets.values() for s, _ in t.slots]
    written = materialize(rows.select(*keep, "_label", *[t.mark for t in sets.values()], *[number(F.col(c).cast("double")).alias(f"_n_{c}") for c in numeric], *[F.col(s).cast("int").alias(s) for s in slots]))
    counts = written.groupBy("_label").agg(*[F.sum(F.col(t.mark).cast("bigint")).alias(t.mark) for t in sets.values()]).collect()  # a row per class
    models = []
    for n, t in sets.items():
        t.features = None  # tasks need the numbers only
        own = {r["_label"]: r[t.mark] for r in counts if r["_label"] is not None and r[t.mark]}
        total, live = sum(own.values()), sorted(own)
        if not total:
            raise ValueError(f"the training set {n} has no rows")
        share = np.log([own[k] / total for k in live])
        for name, inputs in input_sets.items():
            places = [*fitted[n].places(inputs), len(fitted[n].places())]
            start = np.zeros((len(live), len(places)))
            start[:, -1] = share - share.mean()
            models.append(Softmax(n, name, places, total, live, start, 1.0 / (strength * total)))
    return Study(written, sets, models, classes)
