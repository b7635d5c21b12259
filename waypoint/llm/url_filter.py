"""URL filter: rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov models of accepted and rejected
URLs. Contexts of 0 to ORDER characters are counted over every URL that a rule
judges or whose host holds a listed word; each order is smoothed by the one
below it in proportion to the number of different characters seen after the
context (Witten-Bell), so long contexts speak only where they were seen. The
difference of the two log-likelihoods over the URL's length is compared with a
threshold calibrated on judged URLs that did not train. The models read the
host without its top-level label, the path and what follows: the label is what
rules decide by, and one that only rejected URLs have would speak against all.

Counts are exact and live in written tables that grow with the URLs; nothing
is hashed together and no count reaches the driver. A place of a URL is told
by its last ORDER characters and the next one. Each chunk of URLs sends its
distinct places once, each distinct place of all chunks meets the counts of
its six orders in joins (the lowest orders, bounded in number, are broadcast),
and what it says comes back to the chunks, which add up their URLs.

Defined cases: a null URL and one without "://" have an empty host and path,
fit no rule and are scored as the text they have (null: empty); repeated rows
count and are judged each; without judged URLs of both kinds the threshold is
0 and all else is allowed; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypoint.session import ship_package

from .common import columns_of, small_batches, stage

# The rules (rule, verdict); a rule is a host and the start of a path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
# Words of hosts that count as rejected when the models train.
WORDS = ["casino", "poker", "pills", "viagra", "porn", "bets", "spam", "ads"]
ORDER = 5
#: A symbol is a byte, the start or the end of a URL.
SYMBOL = 9
_START, _END = 256, 257
#: Contexts up to this order are few whatever the input: 1 + 258 with at most 66,822 pairs.
LOW = 1
#: URLs of one partition that are scored together, 2 to this power.
CHUNK = 9
#: One URL in so many calibrates the threshold and does not train.
HOLD = 5
BIN = 0.01
#: Share of the accepted URLs that the calibrated threshold has to keep.
KEEP = 0.98


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.when(known, F.translate(F.regexp_extract(url, pattern, 1), upper, lower)).otherwise("")
    return host, F.when(known, F.regexp_extract(url, pattern, 2)).otherwise("")


def model_text(url: Column, host: Column) -> Column:
    """What the models read of a URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.regexp_replace(host, r"\.[^.]*$", ""), rest)).otherwise(F.coalesce(url, F.lit("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule list is short: one test each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def slots(url: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of contexts and pairs: one row per order, one column per character and the end.

    A context's code is its order and its characters, a pair's code the
    context's and the next character: exact, in 57 bits.
    """
    codes = np.concatenate([np.full(ORDER, _START), np.frombuffer(url, np.uint8), [_END]]).astype(np.int64)
    n = len(codes) - ORDER
    contexts = np.zeros((ORDER + 1, n), np.int64)
    for order in range(1, ORDER + 1):
        contexts[order] = contexts[order - 1] | codes[ORDER - order : ORDER - order + n] << SYMBOL * (order - 1)
    contexts |= np.arange(ORDER + 1)[:, None] << SYMBOL * ORDER
    return contexts, contexts << SYMBOL | codes[ORDER:]


def log_likelihood(contexts: np.ndarray, pairs: np.ndarray, model: tuple[Counts, Counts, Counts]) -> float:
    """Of one URL, the plain way: each order is interpolated with the one below, the lowest with 1/256."""
    seen, total, kinds = model
    p = np.full(contexts.shape[1], 1.0 / 256)
    for c, q in zip(contexts, pairs, strict=True):
        p = (seen[q] + (kinds[c] + 1.0) * p) / (total[c] + kinds[c] + 1.0)
    return float(np.log(p).sum())


class Counts:
    """A written table (code, n) that is asked for a few codes; absent ones count 0."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sum(self) -> int:
        return self.rows.agg(F.sum("n")).first()[0] or 0

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        asked = np.unique(codes)
        found = {r.code: r.n for r in self.rows.where(F.col("code").isin(asked.tolist())).collect()}
        return np.array([found.get(c, 0) for c in asked.tolist()], np.float64)[np.searchsorted(asked, codes)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for which in (0, 1):
            keys = [slots(batch.column(0)[i].as_py() or b"")[1].reshape(-1) for i in np.flatnonzero(label == which).tolist()]
            if keys:
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n * (which == 0)), pa.array(n * (which == 1))], ["pair", "n0", "n1"])


def counts(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (url, label 0 or 1): how often each pair was seen by label, and each context's total and kinds."""
    counted = judged.mapInArrow(_counter, "pair long, n0 long, n1 long").groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pairs = stage(counted, "url-pairs")
    sums = [x for i in "01" for x in (F.sum(f"n{i}").alias(f"total{i}"), F.sum((F.col(f"n{i}") > 0).cast("long")).alias(f"kinds{i}"))]
    return pairs, stage(pairs.groupBy(F.shiftright("pair", SYMBOL).alias("context")).agg(*sums), "url-contexts")


def train(judged: DataFrame) -> list[tuple[Counts, Counts, Counts]]:
    """Models (seen, total, kinds) of the rejected and the accepted URLs from (url, label 0 or 1)."""
    pairs, contexts = counts(judged)
    view = lambda rows, code, n: Counts(rows.select(F.col(code).alias("code"), F.col(n).alias("n")).where("n > 0"))
    return [(view(pairs, "pair", f"n{i}"), view(contexts, "context", f"total{i}"), view(contexts, "context", f"kinds{i}")) for i in (0, 1)]


def _placer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk in np.unique(chunks).tolist():
            keys = [slots(batch.column(1)[i].as_py() or b"")[1][ORDER] for i in np.flatnonzero(chunks == chunk).tolist()]
            found = np.unique(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found)], ["chunk", "place"])


def place_scores(places: DataFrame, pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(place, score): what each distinct place adds to the difference of the two log-likelihoods."""
    body = F.col("place").bitwiseAND(F.lit((1 << SYMBOL * (ORDER + 1)) - 1))
    suffix = lambda order: body.bitwiseAND(F.lit((1 << SYMBOL * (order + 1)) - 1)).bitwiseOR(F.lit(order << SYMBOL * (ORDER + 1)))
    wide = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), suffix(k).alias("pair")) for k in range(ORDER + 1)]))
    rows = stage(places.select("place", wide.alias("_")).select("place", "_.order", "_.pair"), "url-orders").withColumn("context", F.shiftright("pair", SYMBOL))
    low = F.shiftright("pair", SYMBOL * (ORDER + 1)) <= LOW
    low_context = F.shiftright("context", SYMBOL * ORDER) <= LOW
    few = rows.where(F.col("order") <= LOW).join(F.broadcast(pairs.where(low)), "pair", "left").join(F.broadcast(contexts.where(low_context)), "context", "left")
    many = rows.where(F.col("order") > LOW).join(pairs.where(~low), "pair", "left").join(contexts.where(~low_context), "context", "left")
    found = ["n0", "total0", "kinds0", "n1", "total1", "kinds1"]
    both = few.unionByName(many).select("place", F.struct("order", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in found]).alias("step"))
    steps = both.groupBy("place").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    step = lambda i: lambda p, x: (x[f"n{i}"] + (x[f"kinds{i}"] + 1.0) * p) / (x[f"total{i}"] + x[f"kinds{i}"] + 1.0)
    said = [F.log(F.aggregate("steps", F.lit(1.0 / 256), step(i))) for i in (0, 1)]
    return steps.select("place", (said[1] - said[0]).alias("score"))


def _adder(urls: pa.Table, scores: pa.Table) -> pa.Table:
    place, score = scores.column("place").to_numpy(), scores.column("score").to_numpy()
    order = np.argsort(place)
    place, score = place[order], score[order]
    out = []
    for url in urls.column("body"):
        own = slots(url.as_py() or b"")[1][ORDER]
        out.append(float(score[np.searchsorted(place, own)].sum()) / len(own))
    return urls.drop_columns(["chunk", "body"]).append_column("score", pa.array(out, pa.float64()))


def scores(rows: DataFrame, pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The rows with ``score`` in place of their ``body``: log-likelihood accepted less rejected, over the length."""
    chunked = stage(rows.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK)), "url-chunks")
    sent = stage(chunked.select("chunk", "body").mapInArrow(_placer, "chunk long, place long").distinct(), "url-places")
    known = stage(place_scores(sent.select("place").distinct(), pairs, contexts), "url-place-scores")
    back = sent.join(known, "place").select("chunk", "place", "score")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("body").dtypes) + ", score double"
    return chunked.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_adder, schema)


def threshold(scored: DataFrame) -> float:
    """The cut that blocks most rejected URLs among those that keep the share KEEP of the accepted ones.

    From (score, label) by a histogram; the middle of equally good cuts.
    """
    edge = F.floor(F.col("score") / BIN).cast("long")
    bins = scored.where("label is not null").groupBy(edge.alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("all"))
    bins = columns_of(bins.orderBy("bin"))
    good, bad = bins["good"].astype(float), (bins["all"] - bins["good"]).astype(float)
    if not good.sum() or not bad.sum():
        return 0.0
    kept = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    blocked = np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    edges = np.append(bins["bin"], bins["bin"][-1] + 1) * BIN
    worth = np.where(kept >= KEEP, kept + blocked, -1.0)
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    return float((edges[best[0]] + edges[best[-1]]) / 2)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, words: list[str] = WORDS, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, verdict, score, threshold."""
    spark = pages.sparkSession
    ship_package(spark)
    small_batches(spark)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    listed = F.col("host").rlike("(?:^|[.-])(?:" + "|".join(words) + ")") if words else F.lit(False)
    label = F.when(F.col("says") == "allow", 1).when((F.col("says") == "block") | listed, 0)
    rows = rows.withColumn("rule", rule).withColumn("says", says).withColumn("label", label.cast("int"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HOLD)) == 0).withColumn("body", model_text(F.col("url"), F.col("host")).cast("binary"))
    models = counts(rows.where("label is not null and not held").select("body", "label"))
    columns = ["key", "host", "path", "rule", "says", "label", "held"]
    scored = stage(scores(rows.select("body", *columns), *models), "url-scores")
    cut = threshold(scored.where("held"))
    verdict = F.coalesce("says", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("key", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(cut).alias("threshold"))
