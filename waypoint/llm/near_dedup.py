"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct word shingles. For a signature every
shingle draws a random permutation of the slots and offers slot p(j) the value
j + u(j), u uniform; a slot keeps its smallest offer. The offers of one shingle
are a permutation, hence correlated, which lowers the variance of the estimate
against independent minima. Offers of step j + 1 cannot beat a value below
j + 1, so a document stops as soon as all its slots hold one: long texts need
one or two steps. Bands of slots give bucket keys. Documents that share a
bucket are compared on their full sets, and links are joined by union-find.

Large buckets are never expanded into pairs. Equal sets are one class from the
start. In each bucket one member is compared with all others, and the links
are grouped; this is done again with other members while it joins many. What
remains are buckets with members of different groups, mostly outliers beside a
large group. Any link between those must show in a prefix: when shingles are
ordered from rare to frequent, two similar sets share one of their first
n - ceil(n * similarity) + 1 shingles, early enough for the overlap they need.
Only members of different groups with such a shingle are compared. So every
pair of a bucket is compared, or in one group, or cannot be similar.

Defined cases: null and empty texts have no shingles and link with nothing;
rows that share a doc_id are one document and pool their links; rows with a
null doc_id take the component of their equals, or null; ``kept_rows`` judges
such rows one by one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.session import ship_package

from .common import columns_of, drop_keys, hold, keep_keys, kept_table, small_batches, stage
from .components import connected

SLOTS, ROWS = 128, 4
WORDS = 5
PERCENT = 80
#: Rounds of leaders before the prefix search, at most.
ROUNDS = 4
#: Pairs per bucket row that are left to the prefix search without such a round.
FEW = 8
#: Slots in which shingle counts are kept to order shingles from rare to frequent.
COUNT_BITS = 20
#: Shingles that one call of the signature code takes together.
CHUNK = 200_000

_words: dict[bytes, int] = kept_table()
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


def _word(word: bytes) -> int:
    code = _words.get(word)
    if code is None:
        if len(_words) > 100_000:
            _words.clear()
        code = _words[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return code


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    parts = text.lower().split()
    n = min(words, len(parts))
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_word, parts), np.uint64, len(parts))
    count = len(parts) - n + 1
    out = np.full(count, np.uint64(n))
    for i in range(n):
        out = _mix(out * _C + codes[i : i + count])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row per set; inf in all slots of an empty set."""
    best = np.full((len(sets), slots), np.inf)
    flat = best.reshape(-1)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = first = None
    for step in range(slots):
        if not len(items):
            break
        drawn = _mix(items + np.uint64(int(_C) * (step + 1) % 2**64))
        value = (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + step
        k = (_mix(drawn + _A) % np.uint64(slots - step)).astype(np.int64) + step
        if step == 0:
            place = first = k
        elif step == 1:
            place = second = np.where(k == first, 0, k)
            swap = k
        else:
            rows = np.arange(len(items))
            if places is None:  # the permutations so far, for the few sets that come this far
                places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(items), 1))
                places[rows, first] = 0
                places[:, 0] = first
                places[rows, swap] = places[:, 1]
                places[:, 1] = second
            place = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, step]
            places[:, step] = place
        np.minimum.at(flat, owner * slots + place, value)
        going = best.max(axis=1) >= step + 1
        stay = going[owner]
        if not stay.all():
            items, owner = items[stay], owner[stay]
            first = first[stay]
            if step >= 1:
                second, swap = second[stay], swap[stay]
            if places is not None:
                places = places[stay]
    return best


def band_keys(best: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; the band's number is part of it."""
    bits = best.view(np.uint64).reshape(len(best), -1, rows)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        out = _mix(out * _C + bits[:, :, i])
    return out.view(np.int64)


def _signer(words: int, slots: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_words)
        for batch in batches:
            sets = [shingles(t.as_py() or b"", words) for t in batch.column(1)]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = np.empty((len(sets), slots // rows), np.int64)
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK, sizes.sum() + CHUNK, CHUNK))
            edges = sorted({0, len(sets), *(int(c) for c in cuts if c < len(sets))})
            for a, b in zip(edges, edges[1:], strict=False):
                keys[a:b] = band_keys(signatures(sets[a:b], slots), rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
            digests = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), digests, lists], ["doc_id", "n", "digest", "bands"])

    return work


def _setter(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_words)
        for batch in batches:
            sets = [shingles(t.as_py() or b"", words) for t in batch.column(1)]
            ends = np.cumsum([0, *(len(s) for s in sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            digests = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "digest", "items"])

    return work


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_y"))
    both = pairs.join(left, "a").where(F.size("_x") > 0).join(right, "b")
    small, big = F.least(F.size("_x"), F.size("_y")), F.greatest(F.size("_x"), F.size("_y"))
    both = both.where(small * 100 >= big * percent).withColumn("_n", F.size(F.array_intersect("_x", "_y")))
    return both.where(F.col("_n") * 100 >= (F.size("_x") + F.size("_y") - F.col("_n")) * percent).select("a", "b")


def _count_slots(items: np.ndarray) -> np.ndarray:
    return (_mix(items.view(np.uint64) + _C) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(_count_slots(batch.column(0).flatten().to_numpy()), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["slot", "n"])


def _prefixer(counts, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(4)]
            for i, listed in enumerate(batch.column(2)):
                items = listed.values.to_numpy()
                often = counts.value[_count_slots(items)]
                n = len(items)
                order = np.lexsort((items, often))[: n - -(-n * percent // 100) + 1]
                # a count of 1 is exact: no other set holds that shingle
                place = np.flatnonzero(often[order] > 1)
                for column, values in zip(rows, (np.full(len(place), i), np.full(len(place), n), place, items[order[place]]), strict=True):
                    column.append(values)
            owner, n, place, item = (np.concatenate(c) if c else np.empty(0, np.int64) for c in rows)
            take = pa.array(owner.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(n.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(item.astype(np.int64))], ["id", "component", "n", "place", "item"])

    return work


def prefix_pairs(sets: DataFrame, named: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of different components that can still be similar, from (id, component).

    The order of shingles comes from hashed counts over all the sets, an array
    of fixed size; any order is right, this one keeps prefixes apart.
    """
    held = stage(sets.join(named, "id").select("id", "component", "items"), "held")
    tally = held.select("items").mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    tally = columns_of(tally.select(F.col("slot").cast("int"), F.least("n", F.lit(255)).cast("short").alias("n")))
    counts = np.zeros(1 << COUNT_BITS, np.uint8)
    counts[tally["slot"]] = tally["n"]
    rows = held.mapInArrow(_prefixer(held.sparkSession.sparkContext.broadcast(counts), percent), "id long, component long, n long, place long, item long")
    rows = stage(rows, "prefixes")
    sizes = rows.groupBy("item", "component").agg(F.count("*").alias("k"))
    # of each shingle's groups the largest is not compared with itself
    mixed = sizes.groupBy("item").agg(F.count("*").alias("parts"), F.max(F.struct("k", "component")).alias("most")).where("parts > 1")
    mixed = stage(mixed.select("item", F.col("most.component").alias("main")), "mixed")
    small = rows.join(mixed, "item").where("component <> main").drop("main")
    other = rows.select("item", *[F.col(c).alias(f"{c}_") for c in ("id", "component", "n", "place")])
    met = small.join(other, "item").where("component <> component_")
    overlap = F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"))
    met = met.where(overlap * (100 + percent) >= (F.col("n") + F.col("n_")) * percent)
    return met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).where("a <> b").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    bodies = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    signed = stage(bodies.mapInArrow(_signer(words, slots, rows), "doc_id long, n long, digest binary, bands array<long>"), "signatures")

    # equal sets are one class, named by its smallest doc_id
    full = signed.where("n > 0")
    classes = stage(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.where("rep is not null").select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("rep").alias("leader")).where("_n > 1").drop("_n")
    members = stage(banded.join(buckets, "bucket"), "members")

    # the shingle sets of documents that share a bucket, read again from their texts
    ids = stage(members.select(F.col("rep").alias("id")).distinct(), "ids")
    wanted = keep_keys(bodies.withColumnRenamed("doc_id", "id"), "id", ids).select("id", "text")
    sets = wanted.mapInArrow(_setter(words), "id long, digest binary, items array<long>")
    sets = stage(sets.groupBy("id", "digest").agg(F.first("items").alias("items")).select("id", "items"), "sets")

    # documents of several rows with different sets pool their links
    split = full.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi and doc_id is not null").select("doc_id")
    pooled = full.join(split, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    asked = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = stage(verified(asked, sets, percent).unionByName(pooled), "links")
    groups = connected(links)

    limit, before, rest = members.count(), None, members.select("bucket", "rep", "leader")
    for turn in range(ROUNDS):
        named = rest.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        apart = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("parts > 1")
        apart = stage(apart.select("bucket", ((F.col("n") * F.col("n") - F.col("squares")) / 2).cast("long").alias("pairs")), "apart")
        left = apart.agg(F.sum("pairs")).first()[0] or 0
        rest = stage(named.join(apart.select("bucket"), "bucket", "left_semi"), "rest")
        if left <= FEW * limit or before and left > 0.7 * before or turn == ROUNDS - 1:
            break
        before, draw = left, F.xxhash64(F.col("rep"), F.lit(turn))
        leads = rest.groupBy("bucket").agg(F.min(draw).alias("draw"))
        lead = rest.withColumn("draw", draw).join(leads, ["bucket", "draw"]).groupBy("bucket").agg(F.min("rep").alias("leader"), F.min("component").alias("theirs"))
        led = rest.drop("leader").join(lead, "bucket").where("component <> theirs")
        asked = led.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
        links = stage(links.unionByName(verified(asked, sets, percent)), "links")
        groups = connected(links)
        rest = rest.select("bucket", "rep", "leader")
    if left:
        # a pair that its bucket's first leader has been compared with is compared again: links stay the same
        asked = prefix_pairs(sets, rest.select(F.col("rep").alias("id"), "component").distinct(), percent)
        links = stage(links.unionByName(verified(asked, sets, percent)), "links")
        groups = connected(links)

    named = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    roots = classes.select("digest", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    roots = stage(roots.select("digest", F.coalesce("component", "rep").alias("root")), "roots")
    out = named.where("digest is not null").join(roots, "digest").select("doc_id", "n", "root")
    out = out.unionByName(named.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("root")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("root")).alias("kept"))


def kept_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns: of each group the one with the smallest id, once.

    Where ids are missing or repeated, rows get numbers and are grouped by
    these, so that each row is judged by its own text.
    """
    ids = docs.groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if ids.where("n > 1 or id is null").isEmpty():
        decided = stage(near_groups(docs, words, percent, key, text), "near")
        return drop_keys(docs, key, decided.where("not kept").select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key)))
    row = "_waypoint_row"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    decided = stage(near_groups(rows, words, percent, row, text).select(F.col("doc_id").alias(row), "component_id"), "near")
    order = F.struct(F.col(key).isNull(), F.col(key), F.col(row))
    named = stage(decided.join(rows.select(row, key), row).select("component_id", row, order.alias("place")), "places")
    first = named.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = named.join(stage(first, "firsts"), "component_id").where(F.col("place") > F.col("first")).select(row)
    return drop_keys(rows, row, stage(dropped, "dropped")).select(*docs.columns)
