"""Prefix hashes, extensions, fingerprints and edited neighbours against plain versions."""

import random
from hashlib import sha256

import pytest
from helpers import TEXTS, documents, no_documents
from pyspark.sql import functions as F

from waypoint.llm import fingerprints as fp


def spans(text):
    return fp.Spans(fp.code_points(text))


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_span_equality_and_extensions_match_the_texts():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab\x00é😀") for _ in range(rng.randint(0, 40))) for _ in "ab")
        x, y = spans(a), spans(b)
        for _ in range(40):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            assert x.extension(i, y, j) == lcp(a[i:], b[j:])


def test_a_shared_beginning_gives_the_same_arrays():
    a, b = "x" * 300 + "the end", "x" * 300 + "another one"
    whole, grown = spans(b), fp.Spans(fp.code_points(b), spans(a), 300)
    assert all((p == q).all() for p, q in zip(whole.prefix, grown.prefix, strict=True))
    assert fp.written(fp.lane_hashes(grown, fp.lane_hashes(spans(a)), 300)) == fp.fingerprint(b)


def bag(text, width):
    seen, out = {}, set()
    for i in range(len(text) - width + 1):
        w = text[i : i + width]
        seen[w] = seen.get(w, 0) + 1
        out.add((w, seen[w]))
    return out


def test_likeness_estimates_the_common_share():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    errors = []
    for _ in range(80):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(60, 300)))
        b = a[: rng.randint(0, len(a))] + " ".join(rng.choice(words) for _ in range(60))
        x, y = bag(a, 16), bag(b, 16)
        errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - 2 * len(x & y) / (len(x) + len(y)))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.03


def test_ends_of_the_scale():
    same = fp.fingerprint("the same text")
    assert len({len(fp.fingerprint(t or "")) for _, t in TEXTS}) == 1
    assert fp.likeness(same, same) == 1.0 and fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1.0
    assert fp.likeness(same, fp.fingerprint("")) == 0.0
    # a repeated line counts as often as it stands there
    line = "one line of text, repeated.\n" * 40
    assert 0.6 < fp.likeness(fp.fingerprint(line), fp.fingerprint(line[:-280] + "".join(chr(200 + i) for i in range(280)))) < 0.9


def plain(rows, tie):
    order = sorted(((k is not None, k or 0, tie[t or ""], t or "") for k, t in rows))
    out = []
    for (known, k, _, t), (*_, after) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        a, b, c = map(fp.fingerprint, (t, e, after))
        out.append((k if known else None, len(t), sha256(e.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c), lcp(t, e), lcp(t, after)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], [(5, "again")] * 40, [(i % 7, f"text {i} " * (i % 9)) for i in range(60)]])
def test_edited_matches_a_plain_version(spark, rows):
    texts = spark.createDataFrame([(t or "",) for _, t in set(rows)], "t string")
    tie = {r.t: r.h for r in texts.select("t", F.xxhash64(F.col("t").cast("binary")).alias("h")).collect()}
    found = fp.edited(documents(spark, rows))
    assert found.columns == ["key", *fp.COLUMNS]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, tie)


def test_an_empty_table(spark):
    assert fp.edited(no_documents(spark)).collect() == []
