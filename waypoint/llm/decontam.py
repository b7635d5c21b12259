"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Seeds are ordered triples of words out of four consecutive ones, with at most
one word left out, so they survive where every third word of a copy is
exchanged, dropped or followed by a new one; no run of equal words is asked
for. All triples of the test items go into a bitmap of fixed size, which the
tasks hold while they read the texts. Where a text has as many hits within SPAN
words as a copy of the shortest item would leave, it gives a region: the words
around these hits.

Equal regions are one. An item's copy shares at least ``needed`` seeds with
its region, so one of them is left when the needed - 1 most frequent seeds of a
region are put aside: regions and items are joined on the rarer seeds of each
region only, however frequent these are elsewhere. Pairs with enough common
seeds, and enough common words to reach the threshold, are aligned as a whole,
once per distinct (region, item): matching words score 1, others and gaps cost
GAP. The score over the item's words decides; of several places the best one is
named, the first of equal ones. Memory is bounded by the bitmap and the longest
text; no pair of texts is ever compared without a shared seed.

Tests measure the recall against the alignment of all pairs, at random and
regular exchanges and drops down to the threshold.

Defined cases: a null or empty text or item matches nothing; items shorter than
a triple are seeds of their length when the text holds them whole; equal items
are all reported; repeated rows give one result per (key, item); a null key is
reported as null; ``kept_rows`` drops by the text and not by the key; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypoint.session import ship_package

from .common import attach, columns_of, drop_keys, hold, kept_table, small_batches, stage

GRAM = 3
#: Word offsets of the seeds that begin at a place.
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
BITS = 24
#: Words within which the hits of a copy are counted.
SPAN = 32
#: Hits that are asked of a region, at most.
ENOUGH = 4
#: Words kept on either side of a hit, and the gap that parts two regions.
PAD = 64
GAP = 0.5
THRESHOLD = 0.5

_TOKEN = re.compile(r"\w+")
_codes: dict[str, int] = kept_table()
_B = np.uint64(0x94D049BB133111EB)
# odd factors: one per place in a seed, and others for shorter seeds
_FACTORS = {n: [np.uint64((0x9E3779B97F4A7C15 * (8 * n + i + 1) | 1) % 2**64) for i in range(n)] for n in range(1, GRAM + 1)}


def _code(word: str) -> int:
    code = _codes.get(word)
    if code is None:
        if len(_codes) > 100_000:
            _codes.clear()
        code = _codes[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
    return code


def words(text: str | None) -> np.ndarray:
    """Hashed lower-case words in order."""
    found = _TOKEN.findall((text or "").lower())
    return np.fromiter(map(_code, found), np.uint64, len(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _B
    return x ^ x >> np.uint64(32)


def seeds_of(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the seeds of n words; below GRAM the words are consecutive."""
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    parts = [codes * f for f in _FACTORS[n]]
    places, hashes = [], []
    for offsets in TRIPLES if n == GRAM else (tuple(range(n)),):
        count = len(codes) - offsets[-1]
        if count > 0:
            places.append(np.arange(count))
            hashes.append(_mixed(sum(part[o : o + count] for part, o in zip(parts, offsets, strict=True))))
    return np.concatenate(places), np.concatenate(hashes)


def needed(words: int) -> int:
    """Common seeds that a copy of an item of so many words has at least, at the threshold."""
    return max(1, (words - GRAM) // 3)


def alignment(item: np.ndarray, text: np.ndarray, gap: float = GAP) -> tuple[float, int]:
    """Best local alignment score of two word lists and the place in ``text`` where it ends."""
    if not len(item) or not len(text):
        return 0.0, 0
    steps = np.arange(len(text)) * gap
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for word in item:
        fit = row[:-1] + np.where(text == word, 1.0, -gap)
        top = np.maximum(np.maximum(fit, row[1:] - gap), 0.0)
        # a gap in the item: the best earlier value less its distance
        row[1:] = np.maximum.accumulate(top + steps) - steps
        high = int(row.argmax())
        if row[high] > best:
            best, end = float(row[high]), high
    return best, end


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, codes = batch.column(0), [words(t.as_py()) for t in batch.column(1)]
        hashes = [np.unique(seeds_of(c, min(GRAM, len(c)))[1]) if len(c) else c for c in codes]
        yield pa.RecordBatch.from_arrays([ids, pa.array([c.view(np.int64) for c in codes], pa.list_(pa.int64())), pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))], ["item_id", "words", "grams"])


def regions_of(codes: np.ndarray, bits: np.ndarray, sizes: tuple[int, ...], enough: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, words, seeds) of the stretches of a text where the bitmap's seeds stand close enough."""
    places, found = [], []
    for n in sizes:
        at, hashed = seeds_of(codes, n)
        slot = hashed >> np.uint64(64 - BITS)
        hit = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
        at, hashed = at[hit], hashed[hit]
        if n == GRAM and enough > 1 and len(at):
            order = np.argsort(at, kind="stable")
            at, hashed = at[order], hashed[order]
            if len(at) < enough:
                continue
            starts = np.flatnonzero(at[enough - 1 :] - at[: len(at) - enough + 1] < SPAN)
            close = np.zeros(len(at) + 1, np.int64)
            np.add.at(close, starts, 1)
            np.add.at(close, starts + enough, -1)
            near = np.cumsum(close[:-1]) > 0
            at, hashed = at[near], hashed[near]
        places.append(at), found.append(hashed)
    if not places or not any(len(p) for p in places):
        return []
    at, seeds = np.concatenate(places), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    at, seeds = at[order], seeds[order]
    cuts = np.flatnonzero(np.diff(at) > PAD) + 1
    out = []
    for part, own in zip(np.split(at, cuts), np.split(seeds, cuts), strict=True):
        first = max(0, int(part[0]) - PAD)
        out.append((first, codes[first : int(part[-1]) + GRAM + 1 + PAD], np.unique(own)))
    return out


def _scanner(bits, sizes: tuple[int, ...], enough: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_codes)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                rows += [(i, *region) for region in regions_of(words(text.as_py()), bits.value, sizes, enough)]
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
            stamp = [blake2b(r[2].tobytes(), digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([r[1] for r in rows], pa.int32()), pa.array(stamp, pa.binary()), pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64()))],
                ["key", "first", "stamp", "words", "seeds"],
            )

    return work


def most_score(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment of the two word lists scores more: each match uses up a word of either."""
    words, wanted = np.unique(item, return_counts=True)
    place = np.minimum(np.searchsorted(words, text), len(words) - 1)
    held = np.bincount(place[words[place] == text], minlength=len(words))
    return int(np.minimum(wanted, held).sum())


def _aligner(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stamp, item_id, item, text = (batch.column(i) for i in range(4))
            rows = []
            for i in range(len(stamp)):
                a, b = np.asarray(item[i].values, np.int64), np.asarray(text[i].values, np.int64)
                if most_score(a, b) / len(a) < threshold:
                    continue
                score, end = alignment(a, b)
                if score / len(a) >= threshold:
                    rows.append((i, score / len(a), end))
            take = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([stamp.take(take), item_id.take(take), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], ["stamp", "item_id", "score", "end"])

    return work


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_id, score, end_word) of every document that holds a copy of a test item."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    kind = dict(items.dtypes)[item_id]
    listed = stage(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_rows, f"item_id {kind}, words array<long>, grams array<long>").where(F.size("words") > 0), "items")

    # the items' seeds as 2^BITS bits: at most 2^(BITS-6) rows reach the driver
    slot = F.shiftrightunsigned("gram", 64 - BITS)
    marked = listed.select(F.explode("grams").alias("gram")).select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    found = columns_of(marked.groupBy("word").agg(F.bit_or("bit").alias("mask")))
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[found["word"]] = found["mask"].view(np.uint64)
    sizes = tuple(sorted(r[0] for r in listed.select(F.least(F.size("words"), F.lit(GRAM))).distinct().collect()))  # at most GRAM rows

    shortest = listed.where(F.size("words") >= GRAM).agg(F.min(F.size("words"))).first()[0]
    enough = min(ENOUGH, needed(shortest or GRAM))

    held = spark.sparkContext.broadcast(bits)
    bodies = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_kind = dict(bodies.dtypes)["key"]
    scanned = bodies.mapInArrow(_scanner(held, sizes or (GRAM,), enough), f"key {key_kind}, first int, stamp binary, words array<long>, seeds array<long>")
    regions = stage(scanned, "regions")
    whole = stage(regions.select("stamp", "words", "seeds").dropDuplicates(["stamp"]), "distinct-regions")

    # a region's hits without its enough - 1 most frequent ones; those of short items all stay
    hits = whole.select("stamp", F.explode("seeds").alias("gram"))
    often = stage(hits.groupBy("gram").agg(F.count("*").alias("n")), "seed-counts")
    ranked = attach(hits, often.withColumn("often", F.col("n")), ["gram"], "n")
    common = Window.partitionBy("stamp").orderBy(F.desc("often"), "gram")
    rare = ranked.withColumn("_r", F.row_number().over(common)).where(F.col("_r") >= enough).select("stamp", "gram")
    listed_seeds = listed.select("item_id", F.size("words").alias("m"), F.explode("grams").alias("gram")).distinct()
    short = hits.join(listed_seeds.where(F.col("m") < GRAM), "gram").select("stamp", "item_id")
    pairs = rare.join(listed_seeds.where(F.col("m") >= GRAM), "gram").select("stamp", "item_id").unionByName(short).distinct()
    ready = pairs.join(whole, "stamp").join(listed.select("item_id", F.col("words").alias("item"), "grams"), "item_id")
    asked = F.greatest(F.lit(1), F.floor((F.size("item") - GRAM) / 3))
    ready = ready.where(F.size(F.array_intersect("grams", "seeds")) >= asked).select("stamp", "item_id", "item", F.col("words").alias("region"))
    aligned = stage(ready.mapInArrow(_aligner(threshold), f"stamp binary, item_id {kind}, score double, end long"), "aligned")
    placed = regions.select("key", "first", "stamp").join(aligned, "stamp").select("key", "item_id", "score", (F.col("first") + F.col("end")).alias("end_word"))
    best = placed.groupBy("key", "item_id").agg(F.max(F.struct("score", (-F.col("end_word")).alias("_place"))).alias("b"))
    return best.select("key", "item_id", "b.score", (-F.col("b._place")).alias("end_word"))


def kept_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no test item, all columns; each row is judged by its own text, whatever its key."""
    digest = "_waypoint_text"
    rows = docs.withColumn(digest, F.sha2(F.col(text), 256))
    found = stage(contaminated(rows, items, digest, text).select(F.col("key").alias(digest)).distinct(), "contaminated")
    return drop_keys(rows, digest, found.where(F.col(digest).isNotNull())).select(*docs.columns)
