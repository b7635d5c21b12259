"""Cluster bootstraps.

A replicate weight is a Poisson(1) draw that depends only on (seed, replicate,
cluster), so it is the same wherever a cluster is processed. Sums are linear in
the weights: cases are first summed per cluster, and each task multiplies its
block of clusters with the weights of all replicates and emits one row per
replicate, whatever its number of clusters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .metrics import TERMS, ratios
from .ordered import scalars

PRIME = 2_147_483_647
BLOCK = 256
#: Clusters whose draws are made at once: the work stays in the processor's cache.
TILE = 32
#: Cells of one piece of a score order: 2 ** PIECE_BITS at most, whatever the size of the written partitions.
PIECE_BITS = 16


def poisson_steps(size: int = 18) -> np.ndarray:
    """Cumulative Poisson(1) probabilities, to below the step of the hash."""
    return np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(size)])


def whole_steps(steps: np.ndarray) -> list[np.uint32]:
    """The smallest whole h with h / PRIME at or above each step."""
    out = []
    for step in steps:
        h = int(step * PRIME)
        while h / PRIME >= step:
            h -= 1
        while h / PRIME < step:
            h += 1
        out.append(np.uint32(h))
    return out


def multipliers(seed: str, reps: int) -> np.ndarray:
    """Two hash multipliers per replicate, in [1, PRIME - 1]."""
    out = np.empty((2, reps), dtype=np.int64)
    for r in range(reps):
        digest = hashlib.sha256(f"{seed}:{r}".encode()).hexdigest()
        out[0, r] = int(digest[:8], 16) % (PRIME - 1) + 1
        out[1, r] = int(digest[8:16], 16) % (PRIME - 1) + 1
    return out


def cluster_keys(key: str) -> list[Column]:
    digest = F.sha2(F.col(key).cast("string"), 256)
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % (PRIME - 1) + 1)
    return [part(1).alias("_k1"), part(9).alias("_k2")]


def weights(k1: np.ndarray, k2: np.ndarray, m: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Clusters x replicates matrix of Poisson(1) weights.

    The remainder by 2^31 - 1 takes shifts only, and the draw is held against the
    steps as a whole number. Keys with missing ones among them come as floats; a
    cluster without a key weighs nothing.
    """
    if k1.dtype.kind == "f" or k2.dtype.kind == "f":
        x = (k1[:, None] * m[0][None, :] + k2[:, None] * m[1][None, :]) % PRIME / float(PRIME)
        return sum((x >= step for step in steps), np.zeros(x.shape))
    out, limits = np.empty((len(k1), m.shape[1])), whole_steps(steps)
    for at in range(0, len(k1), TILE):
        own = slice(at, at + TILE)
        v = k1[own, None] * m[0][None, :]
        v += k2[own, None] * m[1][None, :]
        for _ in range(2):
            high = v >> 31
            v &= PRIME
            v += high
        h = v.astype(np.uint32)
        h[h >= PRIME] -= np.uint32(PRIME)
        count = np.zeros(h.shape, np.uint8)
        for limit in limits:
            reached = h >= limit
            if not reached.any():
                break
            count += reached.view(np.uint8)
        out[own] = count
    return out


def weight_table(clusters: DataFrame, key: str, reps: int, seed: str) -> DataFrame:
    """(key, rep, weight) rows, for inspection and tests."""
    steps, m = poisson_steps(), multipliers(seed, reps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at:at + BLOCK]
                w = weights(part["_k1"].to_numpy(), part["_k2"].to_numpy(), m, steps)
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), reps), "rep": np.tile(np.arange(reps), len(part)), "weight": w.ravel().astype(np.int64)})

    ship_package(clusters.sparkSession)
    kind = dict(clusters.dtypes)[key]
    return clusters.select(key, *cluster_keys(key)).mapInPandas(run, f"{key} {kind}, rep bigint, weight bigint")


def weight_moments(clusters: DataFrame, key: str, mark: Column, reps: int, seed: str) -> DataFrame:
    """Per replicate: clusters, sum of weights and of their squares, and sum of weight x mark.

    A task adds up blocks of clusters and emits one row per replicate.
    """
    steps, m = poisson_steps(), multipliers(seed, reps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, reps))
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at:at + BLOCK]
                w = weights(part["_k1"].to_numpy(), part["_k2"].to_numpy(), m, steps)
                total += np.stack([np.full(reps, len(part)), w.sum(0), (w * w).sum(0), part["_mark"].to_numpy(dtype=float) @ w])
        yield pd.DataFrame({"rep": np.arange(reps), **dict(zip(("clusters", "weight", "square", "keyed"), total.astype(np.int64), strict=True))})

    ship_package(clusters.sparkSession)
    rows = clusters.select(*cluster_keys(key), mark.cast("double").alias("_mark"))
    parts = rows.mapInPandas(run, "rep bigint, clusters bigint, weight bigint, square bigint, keyed bigint")
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("clusters", "weight", "square", "keyed")])


def replicate_sums(per_cluster: DataFrame, key: str, sums: list[str], reps: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """Weighted totals of every sum per replicate (and label)."""
    by = by or []
    steps, m = poisson_steps(), multipliers(seed, reps)
    label = F.concat_ws("\u0001", *[F.col(b).cast("string") for b in by]) if by else F.lit("")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, rows in b.groupby("_label", sort=False):
                x = rows[sums].to_numpy(dtype=float)
                k1, k2 = rows["_k1"].to_numpy(), rows["_k2"].to_numpy()
                acc = total.setdefault(name, np.zeros((reps, len(sums))))
                for at in range(0, len(x), BLOCK):
                    acc += weights(k1[at:at + BLOCK], k2[at:at + BLOCK], m, steps).T @ x[at:at + BLOCK]
        for name, acc in total.items():
            yield pd.DataFrame({"_label": name, "rep": np.arange(reps), **{s: acc[:, i] for i, s in enumerate(sums)}})

    ship_package(per_cluster.sparkSession)
    rows = per_cluster.select(label.alias("_label"), *cluster_keys(key), *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums])
    schema = "_label string, rep bigint, " + ", ".join(f"{s} double" for s in sums)
    parts = rows.mapInPandas(run, schema).groupBy("_label", "rep").agg(*[F.sum(s).alias(s) for s in sums])
    pieces = F.split("_label", "\u0001")
    return parts.select(*[pieces[i].alias(b) for i, b in enumerate(by)], "rep", *sums)


def policy_cluster_sums(decisions: DataFrame, cluster: str, by: list[str], terms: dict[str, Column]) -> DataFrame:
    rows = decisions.select(cluster, *by, *[c.alias(n) for n, c in terms.items()])
    return rows.groupBy(cluster, *by).agg(*[F.sum(n).alias(n) for n in TERMS])


def replicate_metrics(per_cluster: DataFrame, cluster: str, by: list[str], reps: int, seed: str) -> DataFrame:
    """The policy metrics of every replicate."""
    return replicate_sums(per_cluster, cluster, TERMS, reps, seed, by).select(*by, "rep", *ratios())


def intervals(replicates: DataFrame, metrics: list[str], by: list[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval, mean and standard error per metric over the defined replicates."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    long = replicates.select(*by, F.inline(rows)).where(F.col("x").isNotNull())
    return long.groupBy(*by, "metric").agg(
        F.count("*").alias("replicates"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("se"),
        F.percentile("x", F.lit(alpha / 2)).alias("lower"), F.percentile("x", F.lit(1 - alpha / 2)).alias("upper"))


def paired_intervals(deltas: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Interval and sign shares of replicate differences (column ``delta``)."""
    x = F.col("delta")
    return deltas.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("replicates"), F.avg(x).alias("mean"), F.percentile(x, F.lit(alpha / 2)).alias("lower"), F.percentile(x, F.lit(1 - alpha / 2)).alias("upper"),
        F.avg((x < 0).cast("int")).alias("p_below"), F.avg((x > 0).cast("int")).alias("p_above"))


def mean_interval(df: DataFrame, cluster: str, value: Column, reps: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """Cluster bootstrap of a mean as a ratio of weighted cluster totals."""
    by = by or []
    per = df.select(cluster, *by, value.alias("x")).groupBy(cluster, *by).agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    r = replicate_sums(per, cluster, ["x", "n"], reps, seed, by).withColumn("value", F.try_divide(F.col("x"), F.col("n")))
    i = intervals(r, ["value"], by).drop("metric", "mean", "se")
    point = per.groupBy(*by).agg(F.count("*").alias("clusters"), (F.sum("x") / F.sum("n")).alias("estimate"))
    if by:
        return i.join(point, by)
    return i.withColumn("_p", scalars(point)).select(*i.columns, "_p.clusters", "_p.estimate")


def rate_difference(df: DataFrame, cluster: str, selected: Column, high: Column, unsafe: Column, reps: int, seed: str) -> DataFrame:
    """Unsafe rate of selected high-value cases minus that of selected low-value ones, with its interval."""
    one = lambda c: F.sum(c.cast("bigint"))
    per = df.groupBy(cluster).agg(one(selected & ~high).alias("nl"), one(selected & high).alias("nh"), one(selected & ~high & unsafe).alias("ul"), one(selected & high & unsafe).alias("uh"))
    diff = F.try_divide(F.col("uh").cast("double"), F.col("nh").cast("double")) - F.try_divide(F.col("ul").cast("double"), F.col("nl").cast("double"))
    r = replicate_sums(per, cluster, ["nl", "nh", "ul", "uh"], reps, seed).withColumn("value", diff)
    i = intervals(r, ["value"], []).drop("metric", "mean", "se")
    point = per.agg(*[F.sum(c).alias(c) for c in ("nl", "nh", "ul", "uh")]).select(diff.alias("estimate"))
    return i.select("*", point.scalar().alias("estimate"))


# ---- AUROC and average precision -------------------------------------------------------------
def _ranked_cells(df: DataFrame, cluster: str, scores: dict[str, str], positive: str) -> DataFrame:
    """Rows of equal (score, cluster) added up and written in the order of falling scores, with their place."""
    pairs = F.array(*[F.struct(F.lit(n).alias("which"), F.col(c).cast("double").alias("_s")) for n, c in scores.items()])
    long = df.select(F.col(cluster).alias("_c"), F.col(positive).cast("bigint").alias("_y"), F.inline(pairs)).where("_s is not null and _y is not null")
    cells = long.groupBy("which", "_s", "_c").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    keyed = cells.select("which", "_s", *cluster_keys("_c"), "_pos", "_neg")
    placed = materialize(keyed.orderBy("which", F.desc("_s"), "_k1", "_k2").withColumn("_seq", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_seq", PIECE_BITS))


def curve_replicates(df: DataFrame, cluster: str, scores: dict[str, str], positive: str, reps: int, seed: str) -> DataFrame:
    """(which, rep, auroc, average_precision) of every score; replicate -1 is the unweighted one.

    Both curves need what stands above a score in each replicate. Cells of
    (score, cluster) are range-partitioned by score. In a first pass a task adds
    up its range per replicate: its first and its last score apart, everything
    between as one piece. Running totals over these pieces give every piece its
    start, equal scores that span tasks become one, and a second pass streams
    the pieces from their starts. So a score that very many rows share is spread
    over tasks, and a task keeps a few values per replicate and one range of
    cells, 2 ** PIECE_BITS at most however large the written partitions are. All
    scores go through the same two passes.
    """
    steps, m = poisson_steps(), multipliers(seed, reps)
    rep = np.arange(-1, reps)

    def blocks(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores, (positives, negatives) and weights of each block of cells."""
        s, k1, k2, y = b["_s"].to_numpy(), b["_k1"].to_numpy(), b["_k2"].to_numpy(), b[["_pos", "_neg"]].to_numpy(dtype=float).T
        for at in range(0, len(b), BLOCK):
            own = slice(at, at + BLOCK)
            w = weights(k1[own], k2[own], m, steps)
            yield s[own], y[:, own], np.concatenate([np.ones((len(w), 1)), w], axis=1)

    def per_score(runs: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted sum of y over each run of equal scores."""
        if len(runs) > BLOCK // 8:
            return np.add.reduceat(w * y[:, None], runs, axis=0)
        spread = np.zeros((len(runs), len(y)))
        spread[np.repeat(np.arange(len(runs)), np.diff(runs, append=len(y))), np.arange(len(y))] = y
        return spread @ w

    def pieces(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_seq")
        s = b["_s"].to_numpy()
        top, low = s == s[0], s == s[-1]
        out = []
        for place, mask in ((0, top), (1, ~top & ~low), (2, low & ~top)):
            if mask.any():
                p, n = sum((y @ w for _, y, w in blocks(b[mask])), np.zeros((2, reps + 1)))
                body = place == 1
                out.append(pd.DataFrame({"which": key[1], "part": key[0] if body else -1, "body": body, "hi": s[mask][0], "rep": rep, "p": p, "n": n}))
        return pd.concat(out)

    def walk(key: tuple, b: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if b.empty or starts.empty:
            # a piece of one or two scores has no inside: no rows, but with the types of the schema
            return pd.DataFrame({"which": pd.Series([], dtype=object), "rep": rep[:0], "area": np.zeros(0), "precision": np.zeros(0)})
        b, starts = b.sort_values("_seq"), starts.sort_values("rep")
        s = b["_s"].to_numpy()
        inner = (s != s[0]) & (s != s[-1])
        b, s = b[inner], s[inner]
        ends = np.append(s[1:] != s[:-1], True)
        p, n = starts["p_above"].to_numpy(), starts["n_above"].to_numpy()
        closed, area, precision, at = (p, n), np.zeros(reps + 1), np.zeros(reps + 1), 0
        for own, y, w in blocks(b):
            runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            cp, cn = (above + np.cumsum(per_score(runs, of, w), axis=0) for above, of in ((p, y[0]), (n, y[1])))
            # only the last score of a block may go on in the next one
            stop = np.arange(len(runs) if ends[at + len(own) - 1] else len(runs) - 1)
            if len(stop):
                ep, en = cp[stop], cn[stop]
                bp, bn = np.vstack([closed[0], ep[:-1]]), np.vstack([closed[1], en[:-1]])
                area += ((en - bn) * (bp + ep) / 2).sum(0)
                precision += ((ep - bp) * ep / np.maximum(ep + en, 1)).sum(0)
                closed = ep[-1], en[-1]
            p, n, at = cp[-1], cn[-1], at + len(own)
        return pd.DataFrame({"which": key[1], "rep": rep, "area": area, "precision": precision})

    ship_package(df.sparkSession)
    cells = _ranked_cells(df, cluster, scores, positive)
    parts = cells.groupBy("_part", "which").applyInPandas(pieces, "which string, part bigint, body boolean, hi double, rep bigint, p double, n double")
    # the pieces of one score that several tasks hold are one
    merged = parts.groupBy("which", "rep", "hi", "part", "body").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = Window.partitionBy("which", "rep").orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0.0))
    merged = materialize(merged.select("*", start("p").alias("p_above"), start("n").alias("n_above")))
    bodies = merged.where("body").select(F.col("part").alias("_part"), "which", "rep", "p_above", "n_above")
    inside = cells.groupBy("_part", "which").cogroup(bodies.groupBy("_part", "which")).applyInPandas(walk, "which string, rep bigint, area double, precision double")
    p, n = F.col("p_above") + F.col("p"), F.col("n_above") + F.col("n")
    single = merged.where("not body").select("which", "rep", (F.col("n") * (F.col("p_above") + p) / 2).alias("area"), F.coalesce(F.try_divide(F.col("p") * p, p + n), F.lit(0.0)).alias("precision"))
    sums = inside.unionByName(single).groupBy("which", "rep").agg(F.sum("area").alias("area"), F.sum("precision").alias("precision"))
    totals = merged.groupBy("which", "rep").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return totals.join(sums, ["which", "rep"]).select(
        "which", "rep", F.try_divide(F.col("area"), F.col("p") * F.col("n")).alias("auroc"), F.try_divide(F.col("precision"), F.col("p")).alias("average_precision")
    )


def auroc_replicates(df: DataFrame, cluster: str, score: str, positive: str, reps: int, seed: str) -> DataFrame:
    """Weighted AUROC (ties half) of every replicate; replicate -1 is the unweighted one."""
    return curve_replicates(df, cluster, {"score": score}, positive, reps, seed).select("rep", "auroc")


def paired_curves(df: DataFrame, cluster: str, a: str, b: str, positive: str, reps: int, seed: str) -> DataFrame:
    """AUROC and average precision of score b minus score a with their cluster intervals, one row per metric."""
    both = curve_replicates(df, cluster, {"a": a, "b": b}, positive, reps, seed)
    of = lambda w, m: F.max(F.when(F.col("which") == w, F.col(m)))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b")) for m in ("auroc", "average_precision")])
    wide = both.groupBy("rep").agg(*[of(w, m).alias(f"{w}_{m}") for w in "ab" for m in ("auroc", "average_precision")])
    j = materialize(wide.select("rep", F.inline(rows)).withColumn("delta", F.col("b") - F.col("a")))
    point = j.where("rep = -1").select("metric", "a", "b", F.col("delta").alias("estimate"))
    return paired_intervals(j.where("rep >= 0"), ["metric"]).join(point, "metric")
