"""Quality classifier, URL filter and decontamination: plain versions and held-out checks."""

import random
import zlib

import numpy as np
import pytest
from helpers import TEXTS, documents, no_documents
from pyspark.sql import functions as F

from waypoint.llm import decontam, quality, url_filter
from waypoint.llm.common import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))


def test_held_out_rows_are_told_apart(spark, model):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    out = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    out = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in out)
    assert len(out) > 50 and right / len(out) > 0.95


def test_training_never_sees_held_out_rows(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    held = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    texts = {r.text for r in docs.collect() if r.doc_id in held} - {r.text for r in docs.collect() if r.doc_id not in held}
    seen = {bytes(r.text).decode() for r in quality.sample(docs, labels).collect()}
    assert seen and not seen & texts


def test_score_equals_the_plain_dot_product(spark, model):
    got = quality.score(documents(spark).select("doc_id", "text"), model).collect()
    want = sorted(float(1 / (1 + np.exp(-quality.dot(quality.features((t or "").encode()), model.astype(np.float32))))) for _, t in TEXTS)
    assert np.allclose(sorted(r.score for r in got), want)
    assert quality.score(no_documents(spark), model).count() == 0
    kept = quality.accepted(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == sum(x >= quality.THRESHOLD for x in want)


def test_no_labels_give_one_half(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    weights = quality.train(documents(spark), none)
    assert {r.score for r in quality.score(documents(spark).select("doc_id", "text"), weights).collect()} == {0.5}


def test_leader_updates_start_where_they_stopped():
    draw = np.random.default_rng(1)
    rows = [(draw.integers(0, 50, 20), 1) for _ in range(60)] + [(draw.integers(50, 100, 20), 0) for _ in range(60)]
    start = np.zeros(101)
    w = quality.follow_leader(rows, start, passes=3)
    assert w[:50].mean() > 0 > w[50:100].mean() and not start.any()
    assert np.allclose(quality.follow_leader([], w, passes=1), w)


URLS = [
    (1, "http://EXAMPLE.org/es/1"), (2, "https://a.example.org/en/12?x"), (3, "https://example.org/en/2"), (4, "http://x.com/fr/"), (5, "http://x.com/de/a#b"), (6, "http://com/fr/1"),
    (7, "http://notcom/fr/1"), (8, "http://x.org"), (9, "http://x.org?/"), (10, None), (11, "no scheme.org/es/"), (12, "ftp://u:p@Ünï.org:80/É?q"), (13, "a://b.org/x://c.com/de/"), (14, ""), (15, "http://x.net/" + "p" * 5000), (1, "http://EXAMPLE.org/es/1"),
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r, _ in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rules_match_the_plain_reading(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in URLS], "page_id long, url string, host string, score string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(URLS)
    plain = {k: plain_rule(u) for k, u in URLS}
    for r in got:
        assert (r.host, r.path, r.rule) == plain[r.key]
        assert r.rule is None or r.verdict == dict(url_filter.RULES)[r.rule]
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0


def test_models_equal_plain_counting_and_separate_the_kinds(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"http://www.{word()}.{'org' if i % 2 else 'com/fr'}/{word()}/{i}") for i in range(300)] + [(300 + i, f"http://win-casino{word()}.net/bonus/{i}") for i in range(300)]
    rows += [(600 + i, f"http://www.{word()}.net/{word()}/{i}") for i in range(50)] + [(700 + i, f"http://win-cash{word()}.net/bonus/{i}") for i in range(50)]
    got = {r.key: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert np.mean([got[k].verdict == "allow" for k in range(600, 650)]) > 0.9
    assert np.mean([got[k].verdict == "block" for k in range(700, 750)]) > 0.9
    judged = spark.createDataFrame([(u.encode(), int(k < 300)) for k, u in rows[:600]], "body binary, label int")
    seen, total, kinds = url_filter.train(judged)[1]
    assert seen.sum() == total.sum() == sum((len(u) + 1) * (url_filter.ORDER + 1) for k, u in rows[:300])
    contexts, pairs = url_filter.slots(b"http")
    p = 1 / 256
    for order in range(url_filter.ORDER + 1):
        c, q = contexts[order][2], pairs[order][2]
        p = (seen[q] + (kinds[c] + 1) * p) / (total[c] + kinds[c] + 1)
    one = url_filter.log_likelihood(contexts[:, 2:3], pairs[:, 2:3], (seen, total, kinds))
    assert abs(one - np.log(p)) < 1e-5


def plain_alignment(a, b, gap=0.5):
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -gap), rows[i - 1][j] - gap, rows[i][j - 1] - gap)
    return max(map(max, rows))


def test_alignment_equals_the_plain_recurrence():
    draw = np.random.default_rng(7)
    for _ in range(200):
        a, b = draw.integers(0, 5, draw.integers(1, 12)), draw.integers(0, 5, draw.integers(1, 25))
        assert abs(decontam.alignment(a, b)[0] - plain_alignment(a, b)) < 1e-9


def test_edited_copies_are_found_and_clean_texts_left_alone(spark):
    draw = random.Random(3)
    words = [f"q{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(draw.choice(words) for _ in range(draw.randint(14, 60)))) for k in range(12)] + [("none", None), ("empty", ""), ("short", "zig zag"), ("i0 again", "")]
    filler = lambda n: " ".join(f"z{draw.randrange(10**6)}" for _ in range(n))
    rows, want = list(TEXTS), set()
    for n, (name, text) in enumerate(items[:12]):
        parts = text.split()
        swapped = [w if i % 7 else "swapped" for i, w in enumerate(parts)]
        dropped = [w for i, w in enumerate(parts) if i % 9 != 4]
        for kind, body in enumerate((parts, swapped, dropped)):
            rows.append((1000 + 10 * n + kind, f"{filler(300)} {' '.join(body).upper()}, {filler(200)}"))
            want.add((1000 + 10 * n + kind, name))
        rows.append((5000 + n, f"{filler(100)} {' '.join(parts[: len(parts) // 4])} {filler(100)}"))
    rows += [(6000 + i, f"{filler(30)} {items[1][1]}") for i in range(60)] + [(7000, "said zig zag twice")]
    want |= {(6000 + i, "i1") for i in range(60)} | {(7000, "short")}
    table_ = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.contaminated(documents(spark, rows), table_).collect()
    assert {(r.key, r.item_id) for r in got} == want
    kept = decontam.kept_rows(documents(spark, rows), table_)
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(rows) - len({k for k, _ in want})
    assert decontam.contaminated(no_documents(spark), table_).count() == 0
    assert decontam.contaminated(documents(spark), table_.where("item_id = 'none'")).count() == 0


@pytest.mark.parametrize("copies", [20, 2000])
def test_an_exact_copy_does_not_hide_edited_ones(spark, copies):
    item = [f"v{i}" for i in range(40)]
    edited = " ".join("swapped" if i % 6 == 3 else w for i, w in enumerate(item))
    rows = [(1, f"before {' '.join(item)} after")] + [(10 + i, f"before{i} {edited} after{i}") for i in range(copies)] + [(9999, "said v0 v1 v2 v3 and no more")]
    items = spark.createDataFrame([("one", " ".join(item))], "item_id string, text string")
    got = decontam.contaminated(documents(spark, rows), items).collect()
    assert {r.key for r in got} == {k for k, _ in rows} - {9999}
    want = plain_alignment(item, edited.split()) / 40
    assert all(abs(r.score - (1 if r.key == 1 else want)) < 1e-9 for r in got)


def _edits(parts, draw):
    """Copies of an item with regular and random exchanges, drops and insertions."""
    for k in (2, 3, 4, 5, 6, 9):
        for at in range(k):
            yield "swap", [w if i % k != at else "xx" for i, w in enumerate(parts)]
            yield "drop", [w for i, w in enumerate(parts) if i % k != at]
        yield "insert", [x for i, w in enumerate(parts) for x in ([w, "xx"] if i % k == k - 1 else [w])]
    for share in (0.1, 0.2, 0.25, 0.3, 0.33):
        yield "swap", [w if draw.random() > share else f"x{draw.randrange(99)}" for w in parts]
        yield "drop", [w for w in parts if draw.random() > share]
        yield "swap", [w if draw.random() > share / 2 else "xx" for w in parts if draw.random() > share / 2]


def test_recall_against_the_alignment_of_all_pairs(spark):
    draw = random.Random(21)
    words = [f"q{i}" for i in range(300)]
    items = [(k, " ".join(draw.choice(words) for _ in range(m))) for k, m in enumerate((15, 16, 20, 25, 30, 38, 40, 60))]
    rows, found_by_all, kinds = [], set(), {}
    filler = lambda n: [f"z{draw.randrange(10**6)}" for _ in range(n)]
    for k, text in items:
        parts = text.split()
        for kind, body in _edits(parts, draw):
            key = len(rows)
            rows.append((key, " ".join(filler(80) + body + filler(40))))
            if decontam.alignment(decontam.words(text), decontam.words(" ".join(body)))[0] >= 0.5 * len(parts):
                found_by_all.add((key, k))
                kinds[(key, k)] = kind
    table_ = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.key, r.item_id) for r in decontam.contaminated(documents(spark, rows), table_).collect()}
    assert got <= found_by_all
    for kind in ("swap", "drop", "insert"):
        wanted = {p for p in found_by_all if kinds[p] == kind}
        assert len(wanted) > 30 and len(got & wanted) >= 0.9 * len(wanted), kind
    assert len(got) >= 0.97 * len(found_by_all)


def test_the_best_place_of_an_item_is_named_and_the_first_of_equal_ones(spark):
    item = [f"v{i}" for i in range(40)]
    far = [f"z{i}" for i in range(200)]
    rows = [(1, " ".join([*item[:26], *far, *item])), (2, " ".join([*item, *far, *item])), (3, " ".join(["a", *item, *far])), (4, " ".join(["a", *item, *far]))]
    items = spark.createDataFrame([("one", " ".join(item)), ("same", " ".join(item))], "item_id string, text string")
    got = {(r.key, r.item_id): (r.score, r.end_word) for r in decontam.contaminated(documents(spark, rows), items).collect()}
    assert got == {(k, i): (1.0, end) for k, end in ((1, 266), (2, 40), (3, 41), (4, 41)) for i in ("one", "same")}


def test_no_alignment_scores_more_than_the_common_words():
    draw = np.random.default_rng(8)
    for _ in range(200):
        a, b = draw.integers(0, 9, draw.integers(1, 12)), draw.integers(0, 9, draw.integers(1, 25))
        common = sum(min((a == w).sum(), (b == w).sum()) for w in set(a.tolist()))
        assert decontam.most_score(a, b) == common >= decontam.alignment(a, b)[0]


def test_contexts_never_share_a_slot_and_judge_equals_the_plain_likelihood(spark):
    draw = np.random.default_rng(4)
    codes = {}
    for _ in range(3000):  # far more contexts and pairs than 2^18 and 2^20 slots keep apart
        url = draw.integers(0, 256, 120).astype(np.uint8).tobytes()
        text = [256] * url_filter.ORDER + list(url) + [257]
        for order, (contexts, pairs) in enumerate(zip(*(x.tolist() for x in url_filter.slots(url)), strict=True)):
            for at, (c, p) in enumerate(zip(contexts, pairs, strict=True)):
                own = (order, *text[at + url_filter.ORDER - order : at + url_filter.ORDER])
                assert codes.setdefault(c, own) == own and codes.setdefault((p,), (*own, text[at + url_filter.ORDER])) == (*own, text[at + url_filter.ORDER])
    assert len(codes) > 2**20
    rows = [(i, f"http://www.a{i % 7}.{'org' if i % 2 else 'com/fr'}/p/{i}") for i in range(40)] + [(100 + i, f"http://b{i}.com/de/q{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host = url_filter.host_and_path(F.col("url"))
    full = pages.withColumn("host", host[0]).withColumn("path", host[1])
    says = url_filter.rule_of(F.col("host"), F.col("path"))[1]
    full = full.withColumn("label", F.when(says == "allow", 1).when(says == "block", 0)).withColumn("body", url_filter.model_text(F.col("url"), F.col("host")).cast("binary"))
    taught = full.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(url_filter.HOLD)) != 0))
    rejected, accepted = url_filter.train(taught.select("body", "label"))
    got = {r.key: r.score for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows)
    for r in full.where("page_id in (3, 4, 101)").collect():
        codes = url_filter.slots(bytes(r.body))
        want = (url_filter.log_likelihood(*codes, accepted) - url_filter.log_likelihood(*codes, rejected)) / (len(r.body) + 1)
        assert abs(got[r.page_id] - want) < 1e-9
