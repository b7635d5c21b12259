"""Document fingerprints from prefix polynomial hashes.

A text is read as code points c_0 c_1 ... For each of two bases b the prefix
array holds the sums of (c_j + 1) * b^j for j < i, modulo 2^31 - 1. The hash of
any span is the difference of two prefixes, divided by the power of its start,
so equal spans of any two texts are found equal in constant time (both bases),
and the longest common extension of two places by binary search over lengths.

The fingerprint of a text is a sketch of its spans of 16 code points, and for
texts below SHORT code points also of its spans of 4 (see LANES). Repeated
spans count as often as they occur. Span hashes are dealt into bins, each bin
keeps its least hash, and one byte of that is written, 00 for an empty bin. Two
fingerprints agree in about as many bins as the span sets have in common;
``likeness`` turns that share of the union into the share of the two sets
(Dice), which is 0.75 when a quarter of a text is exchanged. Equal texts
have equal fingerprints, and a fingerprint has the same length for all texts.

``edited`` compares each document with an edited text: its last quarter gives
way to the beginning of the document that follows. Documents are sorted by
range partitions and stream through each task with one neighbour in hand; the
first and last document of each partition are written with their texts and
matched afterwards. The kept part of a text is hashed once for both.

Defined cases: null is the empty text; empty texts have the fingerprint of no
spans, are alike with likeness 1 and unlike all others with 0; bytes that are
not UTF-8 become replacement characters; documents are ordered by doc_id (null
first), then by a hash of the text, so repeated rows follow each other; the
last is followed by the first, also when it is the only one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.session import ship_package

from .common import small_batches, stage

#: (code points in a span, bins) of the two parts of a fingerprint.
LANES = ((16, 96), (4, 64))
#: Texts from this length on have no spans of the second kind.
SHORT = 256
#: Bins that both fingerprints need to be compared by the first kind.
ENOUGH = 24
_P = (1 << 31) - 1
_BASES = (1_000_003, 998_244_353)
_NONE = np.uint64(2**64 - 1)


def _lower(x: np.ndarray) -> np.ndarray:
    """A number equal to x modulo 2^31 - 1 and below 2^33, for x below 2^63."""
    return (x & np.uint64(_P)) + (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = _lower(_lower(x))
    x -= np.uint64(_P) * (x >= np.uint64(_P))
    return x


class _Powers:
    """Powers of a base and of its inverse, longer when needed."""

    def __init__(self, base: int):
        self.base = base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            up, down = pow(self.base, m, _P), pow(self.base, -m, _P)
            self.up = np.concatenate([self.up, _fold(self.up * np.uint64(up))])
            self.down = np.concatenate([self.down, _fold(self.down * np.uint64(down))])


_powers = [_Powers(b) for b in _BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Spans:
    """The prefix arrays of a text."""

    def __init__(self, codes: np.ndarray, shared: Spans | None = None, kept: int = 0):
        """Of ``codes``; its first ``kept`` code points may be those of ``shared``."""
        self.n = len(codes)
        tail = codes[kept:].astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for lane, powers in enumerate(_powers):
            powers.reach(self.n + 1)
            terms = _lower(tail * powers.up[kept : self.n])
            if kept:
                head = shared.prefix[lane][: kept + 1]
                self.prefix.append(np.concatenate([head, _fold(np.cumsum(terms) + head[-1])]))
            else:
                self.prefix.append(np.concatenate([np.zeros(1, np.uint64), _fold(np.cumsum(terms))]))

    def hashes(self, start: int, end: int, length: int) -> np.ndarray:
        """Hashes, by the first base, of the spans of ``length`` that begin at start, ..., end - 1."""
        prefix = self.prefix[0]
        gap = prefix[start + length : end + length] + np.uint64(_P) - prefix[start:end]
        return _fold(gap * _powers[0].down[start:end])

    def equal(self, at: int, other: Spans, there: int, length: int) -> bool:
        """Whether the spans of ``length`` at the two places have equal hashes; each is raised to the other's place."""
        for own, its, powers in zip(self.prefix, other.prefix, _powers, strict=True):
            here, far = own.item(at + length) - own.item(at), its.item(there + length) - its.item(there)
            if (here * powers.up.item(there) - far * powers.up.item(at)) % _P:
                return False
        return True

    def extension(self, at: int, other: Spans, there: int) -> int:
        """Length of the longest common span that begins at the two places."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            half = (low + high + 1) // 2
            if self.equal(at, other, there, half):
                low = half
            else:
                high = half - 1
        return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Mixed hashes in which the first, second, ... occurrence of a span differ."""
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return _mix(hashes)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    number = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    mixed, again = _mix(ordered), np.flatnonzero(number)
    mixed[again] = _mix(mixed[again] + number[again].astype(np.uint64))
    return mixed


def lane_hashes(spans: Spans, shared: list[np.ndarray] | None = None, kept: int = 0) -> list[np.ndarray]:
    """Per lane the hashes of all spans; those inside the first ``kept`` code points may be taken from ``shared``."""
    out = []
    for lane, (width, _) in enumerate(LANES):
        if spans.n < width or lane and spans.n >= SHORT:
            out.append(np.empty(0, np.uint64))
            continue
        ready = shared[lane][: max(kept - width + 1, 0)] if shared else ()
        new = spans.hashes(len(ready), spans.n - width + 1, width)
        out.append(np.concatenate([ready, new]) if len(ready) else new)
    if 0 < spans.n < LANES[-1][0]:
        out[-1] = spans.hashes(0, 1, spans.n)
    return out


def written(hashes: list[np.ndarray]) -> str:
    """The fingerprint: per bin one byte of its least hash, 01 to ff, or 00."""
    parts = []
    for (_, bins), lane in zip(LANES, hashes, strict=True):
        best = np.full(bins, _NONE)
        mixed = _numbered(lane)
        np.minimum.at(best, ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), mixed)
        byte = (best & np.uint64(0xFFFFFFFF)) % np.uint64(255) + np.uint64(1)
        parts.append(np.where(best == _NONE, np.uint64(0), byte).astype(np.uint8).tobytes())
    return b"".join(parts).hex()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f), np.uint8) for f in (a, b))
    first = LANES[0][1]
    long = min(np.count_nonzero(x[:first]), np.count_nonzero(y[:first])) >= ENOUGH
    x, y = (x[:first], y[:first]) if long else (x[first:], y[first:])
    either = np.count_nonzero((x > 0) | (y > 0))
    share = int(np.count_nonzero((x == y) & (x > 0))) / int(either) if either else 0.0
    return 2 * share / (1 + share)


def fingerprint(text: str) -> str:
    return written(lane_hashes(Spans(code_points(text))))


class _Doc:
    """A document in hand: its text, code points, prefix arrays, span hashes and fingerprint."""

    def __init__(self, key, text: bytes | None):
        self.key, self.text = key, (text or b"").decode("utf-8", "replace")
        self.codes = code_points(self.text)
        self.spans = Spans(self.codes)
        self.cut = self.spans.n // 4
        self.hashes = lane_hashes(self.spans)
        self.mark = written(self.hashes)

    def against(self, after: _Doc) -> tuple:
        """What is returned of this document when ``after`` follows it."""
        text, spans, mark = self.text, self.spans, self.mark
        if self.cut:
            kept = self.spans.n - self.cut
            text = self.text[:kept] + after.text[: self.cut]
            spans = Spans(np.concatenate([self.codes[:kept], after.codes[: self.cut]]), self.spans, kept)
            mark = written(lane_hashes(spans, self.hashes, kept))
        return (
            self.key, self.spans.n, sha256(text.encode()).hexdigest(), self.mark, mark, likeness(self.mark, mark), likeness(self.mark, after.mark),
            self.spans.extension(0, spans, 0), self.spans.extension(0, after.spans, 0),
        )


#: Columns of ``edited``: shared_edited and shared_next are the longest common beginnings with the edited and the next text.
COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_edited", "shared_next"]
_TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 2]
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited long, shared_next long"


def _stream(key_type: pa.DataType):
    """Sorted (key, text) rows to results; the partition's first and last document come with their texts."""
    names = ["key", *COLUMNS, "part", "edge", "text"]
    types = [key_type, *_TYPES, pa.int32(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), None, None
        blank = (None,) * len(COLUMNS)
        for rows in batches:
            out = []
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                raw = text.as_py()
                doc = _Doc(key, raw)
                if before is None:
                    out.append((key, *blank, part, "first", raw or b""))
                else:
                    out.append((*before.against(doc), part, None, None))
                before, last = doc, (key, raw or b"")
            if out:
                yield batch(out)
        if last is not None:
            yield batch([(last[0], *blank, part, "last", last[1])])

    return work


def _pairs(key_type: pa.DataType):
    """(key, text, following text) rows to results."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = [_Doc(k, a.as_py()).against(_Doc(None, b.as_py())) for k, a, b in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [key_type, *_TYPES], strict=True)], ["key", *COLUMNS])

    return work


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and COLUMNS."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    key_sql, key_type = rows.schema["key"].dataType.simpleString(), pa.int64()
    if key_sql != "bigint":
        raise ValueError("the key has to be a 64-bit integer")
    # the third column only spreads rows that are equal in key and text
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.xxhash64(F.monotonically_increasing_id())]
    ordered = rows.withColumns({"tie": order[1], "spread": order[2]})
    names = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("spread")]
    ordered = ordered.repartitionByRange(*names).sortWithinPartitions(*names).select("key", "text")
    done = stage(ordered.mapInArrow(_stream(key_type), f"key bigint, {_SCHEMA}, part int, edge string, text binary"), "fingerprints")

    edges = done.where("edge is not null")
    # one number per partition of the sort
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())
    inside = done.where("edge is null").select("key", *COLUMNS)
    if not parts:
        return inside
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after int")
    heads = edges.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    tails = edges.where("edge = 'last'").select("key", "text", "part")
    pairs = tails.join(follows, "part").join(heads, "after").select("key", "text", "following")
    return inside.unionByName(pairs.mapInArrow(_pairs(key_type), f"key bigint, {_SCHEMA}"))
