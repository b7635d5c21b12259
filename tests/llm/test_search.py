"""Ranked search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import TEXTS, documents, no_documents

from waypoint.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(rows, items, k=20):
    docs = [(key, w) for key, t in rows if (w := words(t))]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    counted = [(key, len(w), Counter(w)) for key, w in docs]
    out = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        scored = []
        for key, size, tf in counted:
            m = 100 - 25 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if s > 0:
                scored.append((-s, key is not None, key or 0))
        out += [(item, rank, key if known else None, -s) for rank, (s, known, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, items, k=20):
    asked = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in items], "item_id long, text string, rank string, term string, doc_id string")
    result = search.search(search.build_index(documents(spark, rows)), asked, k)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in result.collect()), key=str)


ITEMS = [(1, "The FIRST line, one one ONE"), (1, "another text of one item"), (2, None), (None, "lost"), (3, "..."), (4, "nothing like it exists"), (5, "größe café 😀"), (6, "w1x1 w2x2 w3x3 w4x4 tail"), (6, "w1x1 w2x2 w3x3 w4x4 tail")]


def test_edge_rows_match_a_plain_version(spark):
    assert found(spark, TEXTS, ITEMS) == plain(TEXTS, ITEMS)


def test_empty_tables_find_nothing(spark):
    assert found(spark, TEXTS, ITEMS[2:5]) == []
    result = search.search(search.build_index(no_documents(spark)), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert result.columns == ["item_id", "rank", "doc_id", "score"] and result.collect() == []


@pytest.mark.parametrize("block, docs", [(2, 16), (64, 1 << 16)])
def test_skewed_terms_ties_and_many_segments(spark, monkeypatch, block, docs):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SEGMENT_DOCS", docs)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    rng = random.Random(block)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 20, 200])))) for i in range(500)]
    rows += [(i, "the same few words w1 w2 w3") for i in range(1000, 1300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(12)] + [(50, "the same few words")]
    assert found(spark, rows, items, 7) == plain(rows, items, 7)


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << rng.integers(1, 33, 5000))
    packed, ends = search._pack(values)
    assert (search._unpack(packed) == values).all() and ends[-1] == len(packed)


def test_blocks_are_rejected_before_they_are_decompressed():
    segment = search._Segment()
    rng = random.Random(2)
    for i in range(20_000):
        segment.add(i, b"common " + (b"rare rare " if i % 1000 == 7 else b"") + b"filler " * rng.randint(0, 400))
    rows = {r["term"]: r for r in segment.rows(0).to_pylist()}
    sizes = np.frombuffer(rows[None]["blocks"], np.int64)
    charge = 12 * (75 + 25 * sizes * len(sizes) // sizes.sum())
    lists = {t: search._List(rows[t]["df"], rows[t]["postings"], rows[t]["blocks"], charge) for t in (b"common", b"rare")}
    docs, scores = search.best_in([(50, lists[b"common"]), (9000, lists[b"rare"])], len(sizes), 10)
    assert len(docs) >= 10 and lists[b"rare"].ready.all()
    assert lists[b"common"].ready.mean() < 0.1
