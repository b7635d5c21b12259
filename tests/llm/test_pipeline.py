"""The pipeline against a plain version of each stage, on a small table and on odd rows."""

import struct

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from helpers import documents, no_documents
from test_native import normal
from test_near import plain_sets

from waypoint.llm import bpe, decontam, near_dedup, quality
from waypoint.llm.common import stage, table, tokenizer
from waypoint.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain_exact(rows):
    best = {}
    for key, text in rows:
        at = (-len(text or ""), key)
        if normal(text) not in best or at < best[normal(text)][0]:
            best[normal(text)] = (at, text)
    return [(at[1], text) for at, text in best.values()]


def plain_near(rows):
    sets, root = [plain_sets(t, 5) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                root[top(i)] = top(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        smallest[top(i)] = min(key, smallest.get(top(i), key))
    return [r for i, r in enumerate(rows) if smallest[top(i)] == r[0]]


def plain_clean(rows, items):
    codes = [decontam.words(t) for t in items]
    held = lambda t: any(decontam.alignment(c, decontam.words(t))[0] >= 0.5 * len(c) for c in codes)
    return [r for r in rows if not held(r[1])]


def test_run_equals_the_plain_version(spark):
    docs = table(spark, DATA, "documents")
    weights = quality.train(docs, table(spark, DATA, "labels"))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    p = lambda t: 1 / (1 + np.exp(-quality.dot(quality.features((t or "").encode()), weights.astype(np.float32))))
    kept = plain_clean(plain_near(plain_exact([r for r in rows if p(r[1]) >= quality.THRESHOLD])), [r.text for r in table(spark, DATA, "benchmark").collect()])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer()[0]), special_tokens={})
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == {k for k, _ in kept} and 0 < len(got) < len(rows)
    for key, text in kept:
        assert got[key] == struct.pack(f"<{len(got[key]) // 4}I", *library.encode_ordinary(text))


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    docs, plain = documents(spark), documents(spark).columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = stage(function(spark, docs, DATA), "test")
        assert out.columns == plain, name
        assert 0 < out.count() <= docs.count()
        assert function(spark, no_documents(spark), DATA).count() == 0
    name, function = corpus_pipeline.STAGES[-1]
    assert function(spark, docs, DATA).count() == docs.count()
    assert function(spark, no_documents(spark), DATA).count() == 0


def test_every_operator_is_registered_once():
    names = [n for n in QUERIES if n != "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    assert set(SQL) <= set(QUERIES) and (corpus_pipeline.ORACLE_SQL is None) == ("pipeline" not in SQL)


def test_rows_without_or_with_repeated_ids_are_judged_by_their_own_text(spark):
    item = " ".join(f"q{i}" for i in range(40))
    base = [f"v{i}" for i in range(200)]
    texts = [" ".join(base), " ".join([*base, "one"]), " ".join([*base, "two"])]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, "a text of its own that no other row shares"), (5, "and another text of its own under the same id"), (6, f"a {item} b"), (6, "a clean text under the id of a copy"), (None, f"c {item}"), (None, "a clean text without an id"), (None, None)]
    near = sorted(r.text or "" for r in near_dedup.kept_rows(documents(spark, rows)).collect())
    # of the near copies the row with the smallest id stays, and any id goes before none
    assert near == sorted(t or "" for _, t in rows if t not in (*texts[:2], f"c {item}"))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = sorted(r.text or "" for r in decontam.kept_rows(documents(spark, rows), items).collect())
    assert clean == sorted(t or "" for _, t in rows if item not in (t or ""))
