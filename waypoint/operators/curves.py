"""Risk-coverage curves and score discrimination, all built on prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true
from .ordered import count_if, percentiles, prefix, prefix_by_value, small


def risk_curve(df: DataFrame, score: str, unique: str, unsafe: str, value: str, by: list[str]) -> DataFrame:
    """Every prefix of the score order (highest first) as an execution set."""
    rows = df.select(*by, unique, F.col(score).alias("threshold"), is_true(F.col(unsafe)).cast("bigint").alias("u"),
                     F.coalesce(F.abs(value), F.lit(0.0)).alias("v"))
    rows = rows.withColumn("uv", F.col("u") * F.col("v"))
    c = prefix(rows, [F.col("threshold").desc_nulls_last(), F.col(unique)], by=by, sums=["u", "v", "uv"], totals={"n_cases": None})
    return c.withColumns({
        "coverage": F.col("rank") / F.col("n_cases"),
        "unsafe_rate": F.col("cum_u") / F.col("rank"),
        "weighted_unsafe_rate": F.try_divide(F.col("cum_uv"), F.when(F.col("cum_v") != 0, F.col("cum_v"))),
    })


def area_under(curve: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid areas; the previous point is read off a row's own running sums."""
    before = F.when(F.col("rank") > 1, (F.col("cum_u") - F.col("u")) / (F.col("rank") - 1))
    v0 = F.col("cum_v") - F.col("v")
    w_before = F.when((F.col("rank") > 1) & (v0 > 1e-9), (F.col("cum_uv") - F.col("uv")) / F.when(v0 > 1e-9, v0))
    step = F.lit(1.0) / F.col("n_cases")
    return curve.groupBy(*by).agg(
        F.sum(step * (F.col("unsafe_rate") + before) / 2).alias("aurc"),
        F.sum(step * (F.col("weighted_unsafe_rate") + w_before) / 2).alias("weighted_aurc"))


def at_coverages(curve: DataFrame, by: list[str], targets: list[float]) -> DataFrame:
    """Point nearest each coverage target, the earlier one on ties.

    Only the two ranks around the target can be nearest, so just those are kept.
    """
    rows = curve.withColumn("coverage_target", F.explode(F.array(*[F.lit(t) for t in targets])))
    at = F.col("coverage_target") * F.col("n_cases")
    near = (F.col("rank") >= F.greatest(F.lit(1), F.floor(at))) & (F.col("rank") <= F.greatest(F.lit(1), F.floor(at) + 1))
    fields = ["rank", "coverage", "threshold", "unsafe_rate", "weighted_unsafe_rate"]
    best = F.min_by(F.struct(*fields), F.struct(F.abs(F.col("coverage") - F.col("coverage_target")), F.col("rank")))
    return rows.where(near).groupBy(*by, "coverage_target").agg(best.alias("p")).select(*by, "coverage_target", "p.*")


def at_risk_caps(curve: DataFrame, by: list[str], caps: list[float]) -> DataFrame:
    """Largest coverage with risk at most the cap; a zero row where none qualifies."""
    fields = ["rank", "coverage", "threshold", "unsafe_rate"]
    one = curve.groupBy(*by).agg(*[F.max(F.when(F.col("unsafe_rate") <= F.lit(c), F.struct(*fields))).alias(f"c{i}") for i, c in enumerate(caps)])
    rows = F.array(*[F.struct(F.lit(c).alias("risk_cap"), F.col(f"c{i}").alias("p")) for i, c in enumerate(caps)])
    return one.select(*by, F.inline(rows)).select(
        *by, "risk_cap", F.coalesce("p.rank", F.lit(0)).alias("selected"), F.coalesce("p.coverage", F.lit(0.0)).alias("coverage"),
        F.col("p.threshold").alias("threshold"), F.col("p.unsafe_rate").alias("unsafe_rate"))


def curve_summary(df: DataFrame, curve: DataFrame, score: str, unsafe: str, value: str, by: list[str]) -> DataFrame:
    v, u = F.coalesce(F.abs(value), F.lit(0.0)), is_true(F.col(unsafe))
    base = df.groupBy(*by).agg(
        F.count("*").alias("n_cases"), count_if(u).alias("unsafe_cases"), F.avg(u.cast("int")).alias("unsafe_prevalence"),
        count_if(F.col(value).isNull()).alias("missing_value"), F.try_divide(F.sum(F.when(u, v).otherwise(0.0)), F.sum(v)).alias("full_weighted_rate"),
        F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    return base.join(percentiles(df, score, {"median_score": 0.5}, by), by).join(area_under(curve, by), by)


def score_points(df: DataFrame, score: str, positive: Column, by: list[str], weight: Column | None = None) -> DataFrame:
    """Per distinct score, highest first: own and running positives and negatives."""
    w = F.lit(1) if weight is None else weight
    pos = is_true(positive)
    rows = df.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("score"), F.when(pos, w).otherwise(0).alias("pos"), F.when(~pos, w).otherwise(0).alias("neg"))
    return prefix_by_value(rows, "score", ["pos", "neg"], by, totals={"all_pos": "pos", "all_neg": "neg"})


def roc_pr_points(points: DataFrame, by: list[str]) -> DataFrame:
    return points.select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos").cast("double")).alias("tpr"),
                    F.try_divide(F.col("cum_neg").cast("double"), F.col("all_neg").cast("double")).alias("fpr"),
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))


def discrimination(points: DataFrame, by: list[str]) -> DataFrame:
    """AUROC with ties counted half and average precision as a step sum."""
    pairs = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return points.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.try_divide(pairs, p * n).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * precision), p).alias("average_precision"))


def ks_distance(df: DataFrame, value: str, group_a: Column, group_b: Column, by: list[str]) -> DataFrame:
    """Largest gap between the two groups' cumulative shares."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("x"), is_true(group_a).cast("bigint").alias("a"), is_true(group_b).cast("bigint").alias("b"))
    c = prefix_by_value(rows.where((F.col("a") + F.col("b")) > 0), "x", ["a", "b"], by, descending=False, totals={"ta": "a", "tb": "b"})
    gap = F.abs(F.try_divide(F.col("cum_a").cast("double"), F.col("ta").cast("double")) - F.try_divide(F.col("cum_b").cast("double"), F.col("tb").cast("double")))
    return c.groupBy(*by).agg(F.max(gap).alias("ks"))


def mean_difference(df: DataFrame, value: str, group_a: Column, group_b: Column, by: list[str]) -> DataFrame:
    """Standardised mean difference; equal means over no spread give 0, unequal ones infinity."""
    x = F.col(value)
    one = lambda g: [F.count(F.when(g, x)), F.avg(F.when(g, x)), F.var_samp(F.when(g, x))]
    (na, ma, va), (nb, mb, vb) = one(is_true(group_a)), one(is_true(group_b))
    d = df.groupBy(*by).agg(na.alias("n_a"), nb.alias("n_b"), ma.alias("mean_a"), mb.alias("mean_b"), va.alias("_va"), vb.alias("_vb"))
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    diff = F.col("mean_a") - F.col("mean_b")
    smd = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), F.lit(None)).when(pooled == 0, F.when(diff == 0, 0.0).otherwise(float("inf"))).otherwise(diff / F.when(pooled != 0, pooled))
    return d.withColumn("smd", smd).drop("_va", "_vb")


def quantile_overlap(df: DataFrame, value: str, inner: Column, outer: Column, by: list[str]) -> DataFrame:
    """Share of the inner group inside the outer group's p05-p95 and p01-p99 ranges."""
    q = percentiles(df.where(is_true(outer)), value, {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}, by)
    q, x = small(q), F.col(value)
    rows = df.where(is_true(inner) & x.isNotNull()).join(q, by, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x.between(F.col("p05"), F.col("p95")).cast("int")).alias("inside_p05_p95"),
                                 F.avg(x.between(F.col("p01"), F.col("p99")).cast("int")).alias("inside_p01_p99"))


def _average_rank(pairs: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    p = prefix_by_value(pairs.select(*by, value, F.col("w")), value, ["w"], by, descending=False, totals={"_n": "w"})
    return p.select(*by, value, ((F.col("cum_w") - (F.col("w") - 1) / 2) / F.col("_n")).alias(name))


def rank_agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson, Spearman and percentile-rank shift of two scores, from distinct score pairs."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("w"))
    j = pairs.join(_average_rank(pairs, a, by, "ra"), [*by, a]).join(_average_rank(pairs, b, by, "rb"), [*by, b])
    w = F.col("w")

    def corr(x: Column, y: Column) -> Column:
        n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
        cov = F.sum(w * x * y) / n - sx * sy / n / n
        vx, vy = F.sum(w * x * x) / n - sx * sx / n / n, F.sum(w * y * y) / n - sy * sy / n / n
        return F.try_divide(cov, F.sqrt(vx * vy))

    shift = F.abs(F.col("ra") - F.col("rb"))
    one = j.groupBy(*by).agg(F.sum(w).alias("n"), corr(F.col(a), F.col(b)).alias("pearson"), corr(F.col("ra"), F.col("rb")).alias("spearman"), (F.sum(w * shift) / F.sum(w)).alias("mean_shift"))
    return one.join(percentiles(j, shift, {"p90_shift": 0.9, "p99_shift": 0.99}, by, weight=w), by)


def plateau_map(df: DataFrame, raw: str, cal: str, positive: Column, by: list[str]) -> DataFrame:
    """Per calibrated value: rows, raw range, distinct raw values and positive rate."""
    per = df.groupBy(*by, cal, raw).agg(F.count("*").alias("k"), count_if(positive).alias("y"))
    return per.groupBy(*by, cal).agg(F.sum("k").alias("n_rows"), F.min(raw).alias("raw_min"), F.max(raw).alias("raw_max"), F.count("*").alias("raw_unique"), (F.sum("y") / F.sum("k")).alias("positive_rate"))


def compression(plateaus: DataFrame, by: list[str]) -> DataFrame:
    d = plateaus.groupBy(*by).agg(
        F.max("n_rows").alias("largest_plateau"), (F.max("n_rows") / F.sum("n_rows")).alias("largest_share"), F.max("raw_unique").alias("max_raw_per_value"),
        F.count("*").alias("calibrated_values"))
    return d.join(percentiles(plateaus, "n_rows", {"median_rows": 0.5}, by), by)


# ---- class metrics ------------------------------------------------------------------------
def confusion(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, classes: list[str], by: list[str]) -> DataFrame:
    return counts.groupBy(*by, "actual").agg(*[F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes])


def class_report(counts: DataFrame, classes: list[str], by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0."""
    rows = F.array(*[F.struct(
        F.lit(c).alias("class"), F.when((F.col("actual") == c) & (F.col("predicted") == c), F.col("n")).otherwise(0).alias("tp"),
        F.when(F.col("actual") == c, F.col("n")).otherwise(0).alias("support"), F.when(F.col("predicted") == c, F.col("n")).otherwise(0).alias("chosen")) for c in classes])
    s = counts.select(*by, F.inline(rows)).groupBy(*by, "class").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "chosen")])
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, sup, ch = F.col("tp"), F.col("support"), F.col("chosen")
    return s.select(*by, "class", zero(tp, ch).alias("precision"), zero(tp, sup).alias("recall"), zero(2 * tp, sup + ch).alias("f1"), "support", "tp")


def overall_report(report: DataFrame, by: list[str]) -> DataFrame:
    sup = F.col("support")
    present = sup > 0
    return report.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * sup) / F.sum("support")).alias("weighted_f1"))


def log_loss(probability_of_truth: Column) -> Column:
    eps = 2.220446049250313e-16
    return -F.avg(F.log(F.least(F.greatest(probability_of_truth, F.lit(eps)), F.lit(1 - eps))))


def brier(actual: Column, classes: list[str], probs: list[Column]) -> Column:
    total = F.lit(0.0)
    for c, p in zip(classes, probs):
        d = p - is_true(actual == c).cast("double")
        total = total + d * d
    return F.avg(total)


def calibration_error(df: DataFrame, p: Column, positive: Column, bins: int, by: list[str]) -> DataFrame:
    """Equal-width bins, the last one closed; weighted absolute gap of rate and mean score."""
    b = df.select(*by, p.alias("p"), is_true(positive).cast("double").alias("y"))
    b = b.groupBy(*by, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("k"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    return b.groupBy(*by).agg((F.sum(F.col("k") * F.abs(F.col("my") - F.col("mp"))) / F.sum("k")).alias("ece"))
