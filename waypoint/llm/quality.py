"""Quality classifier: hashed word n-grams, logistic regression, FTRL-Proximal.

Words and runs of signs are hashed, and so are pairs of neighbours; a word
that repeats the one before it, or is written in capitals, is also seen by its
form. A document is a sparse vector of n-gram counts over their number (and a prior), scaled.
Follow-the-regularised-leader updates run over bounded shards of a bounded
sample of labelled rows, each shard in its own task; the shards' weights are
averaged by index, and further rounds start from the average. The model is one
array of 2^BITS weights, broadcast; a score is a sparse dot product, made in
one pass over the texts.

Defined cases: null and empty texts have no n-grams and get the score of the
bias alone; rows without a label, or with a null one, do not train; a document
with two labels trains on both; without any label the score is 0.5 everywhere;
repeated rows get equal scores; an empty table gives an empty result; further
columns of the input are ignored, and columns named like an output replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypoint.session import ship_package

from .common import columns_of, hold, kept_table, small_batches, stage

BITS = 18
#: The classifier is fitted on at most about this many labelled rows.
SAMPLE = 24_000
SHARDS = 6
ROUNDS = 3
PASSES = 2
SCALE = 12.0
#: Added to a text's number of n-grams: short texts lean to the bias.
PRIOR = 24
# The learner's settings.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
THRESHOLD = 0.7

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x5851F42D4C957F2D)
_CACHE: dict[bytes, int] = kept_table()


def _code(token: bytes) -> int:
    code = _CACHE.get(token)
    if code is None:
        if len(_CACHE) > 100_000:
            _CACHE.clear()
        low = token.lower()
        # the lowest bit tells capitals, the next one signs
        code = _CACHE[token] = crc32(low) << 2 | (len(token) > 1 and token.isupper()) | (not token[:1].isalnum() and token[0] < 0x80) << 1
    return code


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed indices of a text's n-grams, repeats included."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_code, tokens), np.uint64, len(tokens))
    form = codes & np.uint64(3)
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    shape = form | again.astype(np.uint64) << np.uint64(2)
    pairs = codes[:-1] * _MIX ^ codes[1:]
    pairs[again[1:]] = _REPEAT
    shapes = (shape[:-1] << np.uint64(3) | shape[1:]) + np.uint64(1 << 40)
    grams = np.concatenate([codes, pairs, shapes])
    grams = (grams ^ grams >> np.uint64(29)) * _MIX
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def dot(index: np.ndarray, weights: np.ndarray) -> float:
    """The document's vector times the weights; the last weight is the bias."""
    return float(weights[-1] + (SCALE * weights[index].sum() / (len(index) + PRIOR) if len(index) else 0.0))


def follow_leader(rows: list[tuple[np.ndarray, int]], start: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """FTRL-Proximal over the rows in order, beginning at ``start``; the new weights."""
    w = start.copy()
    n = np.zeros(len(w))
    # z is set so that the closed form gives the starting weights
    z = -w * (BETA / ALPHA + L2) - np.sign(w) * L1
    for _ in range(passes):
        for index, label in rows:
            at, count = np.unique(index, return_counts=True)
            at = np.append(at, len(w) - 1)
            x = np.append(SCALE * count / (len(index) + PRIOR), 1.0)
            p = _sigmoid(float(w[at] @ x))
            g = (p - label) * x
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w[at]
            n[at] = now
            zt = z[at]
            w[at] = np.where(np.abs(zt) <= L1, 0.0, -(zt - np.sign(zt) * L1) / ((BETA + np.sqrt(now)) / ALPHA + L2))
    return w


def held_out(doc_id: Column) -> Column:
    """Rows that must not train: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(text, label, shard) of at most about ``bound`` labelled rows, by a hash of the id."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = usable.count()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    cut = int((1 << 30) * min(1.0, bound / max(rows, 1)))
    chosen = usable.where(slot < cut)
    # the sample is bounded, so its ids may be broadcast and the texts stay in place
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.select("text", "label", F.xxhash64("doc_id").alias("order"), (F.pmod(F.xxhash64("doc_id"), F.lit(1009)) % SHARDS).cast("int").alias("shard"))


def _shard_learner(start):
    def fit(part):
        part = part.sort_by([("order", "ascending"), ("grams", "ascending")])
        data = [(np.frombuffer(g.as_py(), np.int32), y.as_py()) for g, y in zip(part["grams"], part["label"], strict=True)]
        w = follow_leader(data, start.value)
        at = np.flatnonzero(w)
        return pa.table({"at": at.astype(np.int32), "w": w[at]})

    return fit


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the model; the last one is the bias."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    chosen = sample(docs, labels, bound)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_CACHE)
        for b in batches:
            index = [features(t.as_py()).astype(np.int32).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.binary()), b.column(1), b.column(2), b.column(3)], ["grams", "label", "order", "shard"])

    rows = stage(chosen.mapInArrow(hashed, "grams binary, label int, order long, shard int"), "quality-sample")
    weights = np.zeros((1 << BITS) + 1)
    for _ in range(rounds):
        fit = _shard_learner(spark.sparkContext.broadcast(weights))
        fitted = rows.groupBy("shard").applyInArrow(fit, "at int, w double")
        mean = columns_of(fitted.groupBy("at").agg(F.sum("w").alias("w")))
        used = max(1, rows.select("shard").distinct().count())
        weights = np.zeros((1 << BITS) + 1)
        weights[mean["at"]] = mean["w"] / used
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of good quality, and drops the text."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights.astype(np.float32))
    rest = [c for c in docs.columns if c not in (text, "score")]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_CACHE)
        w = model.value
        for b in batches:
            out = [float(_sigmoid(dot(features(t.as_py() or b""), w))) for t in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(out, pa.float64())], [*rest, "score"])

    return docs.select(*rest, F.col(text).cast("binary").alias(text)).mapInArrow(work, schema)


def accepted(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows that the model accepts, all columns: scored and filtered in one pass, nothing is moved."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights.astype(np.float32))
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_CACHE)
        for b in batches:
            keep = [_sigmoid(dot(features((t.as_py() or "").encode()), model.value)) >= THRESHOLD for t in b.column(place)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
