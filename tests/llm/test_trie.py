"""The conversation trie against a plain version."""

import random
import zlib
from hashlib import sha256

import pytest

from waypoint.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, chars string, band string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
        saved[node] = sum(saved[k] for k in kids.get(node, [])) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node],
         sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


EDGES = [
    (None, 1, "user", "lost"), (0, None, "user", "a"), (0, 1, None, None), (0, 2, "user", "😀é"), (0, 2, "user", "😀é"), (0, 2, "tool", ""),
    (1, 1, "user", "b"), (2, 1, "user", "a"), (2, 2, None, None), (-3, 4, "user", "a"), (-103, 4, "user", "a"), (250, 1, "user", "no base"), (251, 1, "user", "x" * 100_000),
    (299, 3, "user", "last"), (299, 1, "user", None), (7, 0, "", ""), (8, 0, "", ""),
]


def test_edge_rows_match_a_plain_version(spark):
    assert found(trie.conversation_trie(frame(spark, EDGES))) == plain(EDGES)


def test_an_empty_table_has_no_nodes(spark):
    assert found(trie.conversation_trie(frame(spark, []))) == []
    assert found(trie.conversation_trie(frame(spark, EDGES[:1]))) == []


@pytest.mark.parametrize("height", [1 + 1, 3])
def test_deep_and_wide_tries_in_small_bands(spark, monkeypatch, height):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(height)
    rows = []
    for c in rng.sample(range(500), 60):
        rows += [(c, t, "user", rng.choice("ab")) for t in range(rng.choice([1, 2, 5, 9]))]
    rows += [(900, t, "user", str(t)) for t in range(70)]  # one long conversation, and many copies of one
    rows += [(c, t, "user", "same") for c in range(1000, 1090) for t in range(7)]
    assert found(trie.conversation_trie(frame(spark, rows), height=height)) == plain(rows)
