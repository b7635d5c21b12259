"""Near-duplicate groups against all-pairs comparison, and components against plain union-find."""

import random
import re
from collections import Counter

import numpy as np
from helpers import TEXTS, documents, no_documents

from waypoint.llm import components, near_dedup


def plain_sets(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def plain_groups(rows, words, percent):
    """Row number to (size, component), every pair compared; rows of one id pool their links."""
    sets = [plain_sets(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (100 * same >= percent * (len(sets[i]) + len(sets[j]) - same) or rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids, default=None) if sets[i] else key))
    return Counter(out)


def edited(draw, base, rate):
    return " ".join(f"new{draw.randrange(10**6)}" if draw.random() < rate else w for w in base)


def corpus(seed=2):
    draw = random.Random(seed)
    rows, key = list(TEXTS), 100
    for size, copies in ((8, 6), (60, 40), (200, 12)):
        base = [f"v{draw.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            rows.append((key, edited(draw, base, draw.choice([0, 0.01, 0.02, 0.04, 0.06]))))
            key += 1
    return rows


def test_groups_equal_those_of_all_pairs(spark):
    rows = corpus()
    got = near_dedup.near_groups(documents(spark, rows), words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.kept_rows(documents(spark, rows), words=4)
    assert kept.columns == documents(spark).columns
    ids = Counter(r.doc_id for r in kept.collect() if r.text and r.text.strip() and r.doc_id is not None)
    assert ids == Counter({r.doc_id: 1 for r in got if r.kept and r.n_shingles and r.doc_id is not None})


def test_near_dedup_of_an_empty_table(spark):
    assert near_dedup.near_groups(no_documents(spark)).count() == 0


def test_prefix_search_finds_every_similar_pair(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(62) for _ in range(100)]
    sets = {i: sorted({draw.getrandbits(62) if draw.random() < draw.choice([0, 0.05, 0.1, 0.3]) else x for x in base}) for i in range(60)}
    frame = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, items array<long>")
    named = spark.createDataFrame([(i, i) for i in sets], "id long, component long")
    found = {(r.a, r.b) for r in near_dedup.prefix_pairs(frame, named).collect()}
    true = {(i, j) for i in sets for j in sets if i < j and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert true and true <= found and len(found) < 60 * 59 / 2
    assert {(r.a, r.b) for r in near_dedup.verified(spark.createDataFrame(sorted(found), "a long, b long"), frame).collect()} == true


def test_signatures_estimate_similarity_with_lower_variance():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(150):
        pool = draw.integers(0, 2**63, 60, dtype=np.uint64)
        best = near_dedup.signatures([np.unique(pool[:45]), np.unique(pool[15:])])
        errors.append((best[0] == best[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.012 and np.var(errors) < 0.25 / near_dedup.SLOTS
    one = near_dedup.signatures([np.array([5], np.uint64), np.empty(0, np.uint64)])
    assert sorted(np.floor(one[0])) == list(range(near_dedup.SLOTS)) and np.isinf(one[1]).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(70, 71), (71, 70), (72, 72), (39, 70)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = {i: 100 for i in range(101, 161)} | {x: 1 for x in [*range(2, 40), 70, 71]}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
