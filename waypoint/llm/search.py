"""Ranked lexical search: Block-Max MaxScore over block-compressed posting lists.

``build_index`` cuts the documents into segments as they are read; nothing is
shuffled. A segment numbers its documents by length and holds, per term, the
list of (document, occurrences) in blocks of BLOCK postings: gaps and counts in
bytes of seven bits, and per block its first and last document, its size and
its greatest count. As numbers ascend with length, the first document of a
block is its shortest, so greatest count and first document bound every score
in the block closely, whatever the statistics of the corpus turn out to be.

``search`` gives each segment all items. Per item the lists are ordered by
their greatest possible score. Lists are read from the top while documents that
occur in the remaining ones alone could still reach the k-th best score so far
(essential lists); the rest are only looked up. A candidate that its sums and
the block bounds of the remaining lists cannot lift to that score is rejected
before any of those blocks is decompressed. Blocks are decompressed once per
segment. The best k of each segment are then merged; equal scores go by
ascending doc_id.

Items are searched in blocks of bounded size, each sent to the tasks; segments
are bounded in documents and bytes, so a term that all documents hold is spread
over the segments.

Defined cases: null and empty texts hold no terms and are never found; an item
is a distinct pair of item_id and text, and several texts of one item_id are
ranked each by itself; null items and items without terms find nothing; rows
that repeat a doc_id are ranked as different documents; a null doc_id comes
before others of its score; an empty table finds nothing; further columns are
ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypoint.session import ship_package

from .common import columns_of, small_batches, stage

TOP = 20
#: Postings in a block.
BLOCK = 64
#: A segment is closed at this many documents (at most 2^16) or bytes of text.
SEGMENT_DOCS, SEGMENT_BYTES = 1 << 16, 24 << 20
#: Terms of items that are searched together, about.
QUERY_TERMS = 1_000_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "segment long, term binary, df long, total long, postings binary, blocks binary"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERM).split()


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in bytes of seven bits, low bits first, and the end of each value."""
    length = 1 + sum((values >= (1 << 7 * i)).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - length
    for i in range(5):
        has = np.flatnonzero(length > i)
        if not len(has):
            break
        more = (length[has] > i + 1).astype(np.int64) << 7
        out[starts[has] + i] = values[has] >> 7 * i & 127 | more
    return out, ends


def _unpack(data: np.ndarray) -> np.ndarray:
    if not (data & 128).any():
        return data.astype(np.int64)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


class _Segment:
    """Documents of one segment while they are read."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.sizes, self.kinds = [], [], []
        self.terms, self.counts = [], []
        self.bytes = 0

    def add(self, key: int | None, text: bytes) -> None:
        parts = terms(text)
        if not parts:
            return
        found = Counter(parts)
        self.ids.append(key)
        self.sizes.append(len(parts))
        self.kinds.append(len(found))
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int64, len(found)))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.bytes >= SEGMENT_BYTES

    def rows(self, number: int) -> pa.RecordBatch:
        """The segment as rows of INDEX; the row without a term holds its documents."""
        sizes = np.array(self.sizes, np.int64)
        by_size = np.argsort(sizes, kind="stable")
        place = np.empty_like(by_size)
        place[by_size] = np.arange(len(sizes))
        term, doc, tf = np.concatenate(self.terms), np.repeat(place, self.kinds), np.concatenate(self.counts)
        order = np.argsort(term << 16 | doc)
        term, doc, tf = term[order], doc[order], tf[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(starts, len(term)))

        per_list = -(-df // BLOCK)
        first = np.cumsum(per_list) - per_list
        begin = np.repeat(starts, per_list) + BLOCK * (np.arange(per_list.sum()) - np.repeat(first, per_list))
        end = np.append(begin[1:], len(term))
        size = end - begin
        gap = np.concatenate([[0], np.diff(doc)])
        gap[begin] = 0
        values = np.empty(2 * len(term), np.int64)
        at = np.arange(len(term)) + np.repeat(begin, size)
        values[at], values[at + np.repeat(size, size)] = gap, tf
        packed, ends = _pack(values)
        bytes_end = ends[2 * end - 1]
        list_end = bytes_end[first + per_list - 1]
        list_start = np.concatenate([[0], list_end[:-1]])
        blocks = np.stack([bytes_end - np.repeat(list_start, per_list), doc[begin], doc[end - 1], np.maximum.reduceat(tf, begin)], axis=1).astype(np.uint32)

        words = np.array(list(self.vocabulary), object)[term[starts]]
        missing = np.array([i is None for i in self.ids])[by_size]
        ids = np.array([i or 0 for i in self.ids], np.int64)[by_size]
        parts = (
            [number] * (len(df) + 1), [None, *words], [len(sizes), *df], [sizes.sum(), *np.add.reduceat(tf, starts)],
            [ids.tobytes() + missing.astype(np.uint8).tobytes(), *_cut(packed, list_end)], [sizes[by_size].tobytes(), *_cut(blocks.reshape(-1).view(np.uint8), 16 * (first + per_list))],
        )
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, types, strict=True)], ["segment", "term", "df", "total", "postings", "blocks"])


def _cut(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, edges = data.tobytes(), [0, *ends.tolist()]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, segment = TaskContext.get().partitionId() << 32, _Segment()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            segment.add(key, text.as_py() or b"")
            if segment.full():
                yield from _slices(segment.rows(number))
                number, segment = number + 1, _Segment()
    if segment.ids:
        yield from _slices(segment.rows(number))


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, 20_000):
        yield rows.slice(at, 20_000)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of all documents, columns INDEX."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return stage(rows.mapInArrow(_indexer, INDEX), "index")


class _List:
    """One term's postings in one segment; blocks are decompressed when they are needed."""

    def __init__(self, df: int, postings: bytes, blocks: bytes, charge: np.ndarray):
        meta = np.frombuffer(blocks, np.uint32).reshape(-1, 4).astype(np.int64)
        self.data = np.frombuffer(postings, np.uint8)
        self.end, self.first, self.last, most = meta.T
        self.size = np.full(len(meta), BLOCK)
        self.size[-1] = df - BLOCK * (len(meta) - 1)
        self.bound = 1_000_000_000 * most // (1000 * most + charge[self.first])
        self.best = int(self.bound.max())
        self.charge = charge
        # a block that is still packed shows its last document, so the array is sorted at all times
        self.docs = np.repeat(self.last, self.size)
        self.scores = np.zeros(df, np.int64)
        self.ready = np.zeros(len(meta), bool)

    def open(self, wanted: np.ndarray | None = None) -> None:
        """Decompresses the wanted blocks (all, if None) that are still packed."""
        new = np.flatnonzero(~self.ready) if wanted is None else wanted[~self.ready[wanted]]
        if not len(new):
            return
        starts = np.where(new > 0, self.end[new - 1], 0)
        data = self.data if len(new) == len(self.ready) else np.concatenate([self.data[a:b] for a, b in zip(starts, self.end[new], strict=True)])
        values = _unpack(data)
        size = self.size[new]
        begin = np.cumsum(size) - size
        spread = np.repeat(begin, size)
        at = np.arange(size.sum()) + spread
        gap, tf = values[at], values[at + np.repeat(size, size)]
        run = np.cumsum(gap)
        docs = run - run[spread] + np.repeat(self.first[new], size)
        to = np.arange(size.sum()) - spread + np.repeat(new * BLOCK, size)
        self.docs[to] = docs
        self.scores[to] = 1_000_000_000 * tf // (1000 * tf + self.charge[docs])
        self.ready[new] = True


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th greatest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_in(lists: list[tuple[int, _List]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment that can be among its k best, and their whole scores; ``lists`` are (weight, list)."""
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda p: p[0] * p[1].best)
    # what the first i lists can give together
    reach = np.concatenate([[0], np.cumsum([w * x.best for w, x in lists])]).astype(np.int64)
    sums, floor, left = np.zeros(n_docs, np.int64), 0, len(lists)
    while left and (not floor or reach[left] >= floor):
        left -= 1
        weight, top = lists[left]
        top.open()
        sums[top.docs] += weight * top.scores
        floor = max(floor, _kth(sums[sums > 0], k))
    found = np.flatnonzero((sums > 0) & (sums + reach[left] >= floor))
    if left and len(found):
        places, bounds = [], np.zeros((left + 1, len(found)), np.int64)
        for i, (weight, x) in enumerate(lists[:left]):
            block = np.searchsorted(x.last, found)
            inside = block < len(x.last)
            block[~inside] = 0
            inside &= x.first[block] <= found
            places.append(np.where(inside, block, -1))
            bounds[i + 1] = bounds[i] + np.where(inside, weight * x.bound[block], 0)
        places = np.stack(places)
        for i in range(left - 1, -1, -1):
            keep = sums[found] + bounds[i + 1] >= floor
            found, places, bounds = found[keep], places[:, keep], bounds[:, keep]
            weight, x = lists[i]
            here = places[i] >= 0
            if here.any():
                x.open(np.unique(places[i][here]))
                at = np.minimum(np.searchsorted(x.docs, found), len(x.docs) - 1)
                hit = here & (x.docs[at] == found)
                sums[found[hit]] += weight * x.scores[at[hit]]
                floor = max(floor, _kth(sums[found], k))
    kept = found[sums[found] >= max(floor, 1)]
    return kept, sums[kept]


_RESULT = "item_id long, tag long, doc_id long, score long"


def _searcher(sent, n: int, total: int, k: int):
    def work(table: pa.Table) -> pa.Table:
        items: dict[tuple, list[tuple[bytes, int]]] = sent.value
        rows, docs = {}, None
        for term, df, postings, blocks in zip(*(table.column(c).to_pylist() for c in ("term", "df", "postings", "blocks")), strict=True):
            if term is None:
                docs = df, postings, np.frombuffer(blocks, np.int64)
            else:
                rows[term] = df, postings, blocks
        n_docs, packed, sizes = docs
        ids, missing = np.frombuffer(packed, np.int64, n_docs), np.frombuffer(packed, np.uint8, n_docs, 8 * n_docs)
        charge = 12 * (100 - 25 + 25 * sizes * n // total)
        opened = {t: _List(*r, charge) for t, r in rows.items()}
        out = [[], [], [], []]
        for (item, tag), weights in items.items():
            found, scores = best_in([(w, opened[t]) for t, w in weights if t in opened], n_docs, k)
            order = np.lexsort((ids[found], 1 - missing[found], -scores))[:k]
            out[0] += [item] * len(order)
            out[1] += [tag] * len(order)
            out[2] += [None if missing[d] else int(ids[d]) for d in found[order]]
            out[3] += scores[order].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], ["item_id", "tag", "doc_id", "score"])

    return work


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for item, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for term, times in Counter(terms(text.as_py())).items():
                for column, value in zip(out, (item, tag, term, times), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["item_id", "tag", "term", "times"])


def search(index: DataFrame, items: DataFrame, k: int = TOP, item: str = "item_id", text: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    asked = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text")).distinct()
    asked = stage(asked.select("item_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(_item_terms, "item_id long, tag long, term binary, times long"), "item-terms")
    held = index.where("term is null").agg(F.sum("df").alias("n"), F.sum("total").alias("total")).first()
    if not held.n:
        return _ranked(asked.select("item_id", "tag", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false"), k)
    n, total = held.n, held.total

    vocabulary = asked.select("term").distinct()
    df = index.where("term is not null").select("term", "df").join(vocabulary, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    asked = stage(asked.join(df.select("term", weight.alias("weight")), "term").select("item_id", "tag", "term", (F.col("weight") * F.col("times")).alias("weight")), "item-weights")

    blocks = asked.count() // QUERY_TERMS + 1
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "tag"), F.lit(blocks)) == block)
        columns = columns_of(own)
        sent: dict[tuple, list] = {}
        for row in zip(*(columns[c].tolist() for c in ("item_id", "tag", "term", "weight")), strict=True):
            sent.setdefault(row[:2], []).append(row[2:])
        lists = index.join(own.select("term").distinct(), "term", "left_semi").unionByName(index.where("term is null"))
        work = _searcher(index.sparkSession.sparkContext.broadcast(sent), n, total, k)
        parts.append(stage(lists.groupBy("segment").applyInArrow(work, _RESULT), "found"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _ranked(every, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item_id", "tag").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
