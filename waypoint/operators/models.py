"""Fitting, calibrating and scoring safety and action models with MLlib."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SAFE, is_true, number
from ..session import materialize
from . import boosting, isotonic
from .ordered import SMALL_ROWS, prefix, weighted_percentiles

RARE, MISSING = "__RARE__", "__MISSING__"
MIN_FREQUENCY = 5

# Feature groups of the safety model over the case state.
VALUE_FEATURES = ["po_value_initial_eur", "invoice_value_t0_eur", "latest_gr_value_before_t0_eur", "transaction_exposure_eur"]
MISMATCH_FEATURES = ["inv_po_abs_rel_diff", "inv_gr_abs_rel_diff"]
PROCESS_FEATURES = [
    "n_goods_receipts_before_t0", "n_cancel_gr_before_t0", "n_cancel_invoice_before_t0", "n_price_change_before_t0",
    "n_quantity_change_before_t0", "n_set_payment_block_before_t0", "n_remove_payment_block_before_t0",
    "gr_available_at_t0", "vendor_invoice_seen_at_t0", "po_created_at_t0", "had_gr_cancellation_before_t0",
    "had_invoice_cancellation_before_t0", "had_price_change_before_t0", "had_quantity_change_before_t0", "had_payment_block_before_t0",
]
CATEGORY_FEATURES = ["item_category"]
FEATURE_SETS = {
    "FULL": [*VALUE_FEATURES, *MISMATCH_FEATURES, *PROCESS_FEATURES],
    "NO_MISMATCH": [*VALUE_FEATURES, *PROCESS_FEATURES],
    "PROCESS_ONLY": PROCESS_FEATURES,
}
# The published inputs of the safety models at the decision (t0) and at the evidence (t1).
EVENT_ROLES = [
    "goods_receipts", "cancel_gr", "invoice_receipts", "cancel_invoice", "price_change", "quantity_change", "set_payment_block",
    "remove_payment_block", "service_entry", "delete_po", "block_po", "reactivate_po", "change_approval", "release_po",
]
CASE_CATEGORIES = [
    "company", "source_system", "document_type", "document_category", "item_type", "item_category", "spend_classification",
    "spend_area", "sub_spend_area", "gr_based_invoice_verification", "goods_receipt_required",
]
HISTORY_CATEGORIES = ["gr_cancellation", "invoice_cancellation", "price_change", "quantity_change", "payment_block"]
T0_NUMERIC = [
    "po_value_initial_eur", "invoice_value_t0_eur", "latest_gr_value_before_t0_eur", "events_available_at_t0",
    *[f"n_{r}_at_t0_history" if r == "invoice_receipts" else f"n_{r}_before_t0" for r in EVENT_ROLES],
    "po_to_invoice_days", "vendor_invoice_to_recorded_invoice_days", "last_gr_to_invoice_days",
]
T0_CATEGORIES = [*CASE_CATEGORIES, "gr_available_at_t0", "vendor_invoice_seen_at_t0", "po_created_at_t0", *[f"had_{h}_before_t0" for h in HISTORY_CATEGORIES]]
T1_NUMERIC = [
    "po_value_initial_eur", "invoice_value_t0_eur", "latest_gr_value_at_t1_eur", "first_gr_value_at_t1_eur",
    "events_available_at_t0_exact", "events_between_t0_t1_inclusive_t1", "events_available_at_t1_exact",
    *[f"n_{r}_by_t1" for r in EVENT_ROLES], *[f"between_n_{r}" for r in EVENT_ROLES],
    "elapsed_t0_to_t1_days", "po_to_t1_days", "vendor_invoice_to_t1_days", "last_gr_to_t1_days",
]
T1_CATEGORIES = [*CASE_CATEGORIES, "gr_available_at_t1", "vendor_invoice_seen_at_t1", "po_created_at_t1", *[f"had_{h}_by_t1" for h in HISTORY_CATEGORIES], "between_any_non_gr_event"]
# Outcomes and whole-trace counts are never inputs.
FUTURE_COLUMNS = ("outcome_", "events_total", "events_future", "events_after", "time_to_", "time_t1_to", "first_future", "latest_future", "after_t1", "post_gather")


def numeric_stats(train: DataFrame, numeric: list[str]) -> DataFrame:
    """Train median of each input, and mean and population spread after filling with it."""
    return training_stats(train, numeric, {"train": F.lit(True)})["train"]


def training_stats(df: DataFrame, numeric: list[str], trainings: dict[str, Column]) -> dict[str, DataFrame]:
    """``numeric_stats`` of several training sets over the same rows, which are counted and sorted once for all."""
    marks = {n: f"_m{i}" for i, n in enumerate(trainings)}
    marked = df.withColumns({marks[n]: is_true(where).cast("bigint") for n, where in trainings.items()}).where(" + ".join(marks.values()) + " > 0")
    rows = F.array(*[F.struct(F.lit(i).alias("_f"), number(F.col(c).cast("double")).alias("x")) for i, c in enumerate(numeric)])
    # equal values are counted once, for the sums as for the median; inputs go by their number until then
    counts = materialize(marked.select(*marks.values(), F.inline(rows)).groupBy("_f", "x").agg(*[F.sum(m).alias(m) for m in marks.values()]))
    x = F.col("x")
    med = weighted_percentiles(counts, "x", {"median": 0.5}, ["_f"], {m: F.col(m) for m in marks.values()})
    base = counts.groupBy("_f").agg(*[a for m, w in ((m, F.col(m)) for m in marks.values()) for a in (
        F.sum(w).alias(f"n{m}"), F.coalesce(F.sum(F.when(x.isNotNull(), w)), F.lit(0)).alias(f"k{m}"), F.sum(x * w).alias(f"s{m}"), F.sum(x * x * w).alias(f"q{m}"))])
    j = materialize(base.join(med, "_f", "left")) if len(marks) > 1 else base.join(med, "_f", "left")
    j = j.withColumn("feature", F.element_at(F.array(*[F.lit(c) for c in numeric]), F.col("_f") + 1))
    out = {}
    for name, m in marks.items():
        median, n = F.coalesce(F.col(f"median{m}"), F.lit(0.0)), F.col(f"n{m}")
        gap = n - F.col(f"k{m}")
        mean = (F.coalesce(f"s{m}", F.lit(0.0)) + gap * median) / n
        square = (F.coalesce(f"q{m}", F.lit(0.0)) + gap * median * median) / n
        own = j.where(n > 0)
        out[name] = own.select("feature", median.alias("median"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("spread"))
    return out


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def level_dictionary(train: DataFrame, categorical: list[str], min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """(feature, level, n, slot): frequent levels numbered from 0 in order, the rare ones of a column share the next number.

    Levels are counted before the shuffle and numbered by prefix offsets, so a
    column may have more levels than a task or the driver holds.
    """
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), _text(c).alias("level")) for c in categorical])))
    counts = materialize(long.groupBy("feature", "level").agg(F.count("*").alias("n")))
    frequent = counts.where(F.col("n") >= min_frequency)
    if counts.count() <= SMALL_ROWS:
        frequent = frequent.withColumn("slot", F.row_number().over(Window.partitionBy("feature").orderBy("level")).cast("bigint") - 1)
    else:
        frequent = prefix(frequent, [F.col("level")], by=["feature"], rank="slot").withColumn("slot", F.col("slot") - 1)
    sizes = frequent.groupBy("feature").agg(F.count("*").alias("slot"))
    rare = counts.where(F.col("n") < min_frequency).join(F.broadcast(sizes), "feature", "left")  # one row per column
    return materialize(frequent.unionByName(rare.withColumn("slot", F.coalesce("slot", F.lit(0).cast("bigint"))).select(*frequent.columns)))


#: Levels of one column that are looked up by broadcast, at most, when the dictionary is larger than SMALL_ROWS.
HOT_LEVELS = 10_000


def with_slot(rows: DataFrame, column: str, levels: DataFrame, count: int, total: int, out: str) -> DataFrame:
    """Adds the slot of ``column``'s level, NULL for a level the dictionary lacks.

    ``levels`` has level, n and slot. A small dictionary is broadcast. Of a large
    one the levels above a HOT_LEVELS-th of the training rows are, and rows
    that they settle do not gather under one join key.
    """
    known = lambda d: d.select(F.col("level").alias("_level"), F.col("slot").alias("_slot"))
    if count <= SMALL_ROWS:
        return rows.join(F.broadcast(known(levels)), _text(column) == F.col("_level"), "left").withColumnRenamed("_slot", out).drop("_level")
    hot = F.broadcast(known(levels.where(F.col("n") > total // HOT_LEVELS)))
    first = rows.join(hot, _text(column) == F.col("_level"), "left").withColumnRenamed("_slot", "_hot").drop("_level")
    # a settled row gets a key of its own that no level has
    key = F.when(F.col("_hot").isNull(), _text(column)).otherwise(F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    both = first.withColumn("_key", key).join(known(levels.where(F.col("n") <= total // HOT_LEVELS)), F.col("_key") == F.col("_level"), "left")
    return both.withColumn(out, F.coalesce("_hot", "_slot")).drop("_hot", "_slot", "_key", "_level")


@dataclass
class Features:
    """Fitted preparation: fill, scale, fold rare levels, one-hot.

    The driver knows per input a few numbers; levels stay in a written table.
    """

    numeric: list[str]
    categorical: list[str]
    stats: dict[str, tuple[float, float, float]]
    levels: DataFrame | None
    sizes: dict[str, tuple[int, int]]
    rows: int
    encoder: PipelineModel | None = None

    def slots(self, df: DataFrame, prefix: str = "_i_") -> DataFrame:
        """Adds the slot of every category; the last one stands for levels that training has not seen and is encoded as all zeros."""
        out = df
        for c in self.categorical:
            slots, known = self.sizes[c]
            own = self.levels.where(F.col("feature") == c)
            out = with_slot(out, c, own, known, self.rows, f"{prefix}{c}")
            out = out.withColumn(f"{prefix}{c}", F.coalesce(F.col(f"{prefix}{c}"), F.lit(slots)).cast("double"))
        return out

    def plain(self, df: DataFrame) -> DataFrame:
        out = self.slots(df)
        filled = {}
        for c in self.numeric:
            median, mean, spread = self.stats[c]
            filled[f"_n_{c}"] = (F.coalesce(number(F.col(c).cast("double")), F.lit(median)) - mean) / (spread if spread > 0 else 1.0)
        return out.withColumns(filled) if filled else out

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.plain(df)
        out = self.encoder.transform(p)
        return out.drop(*[c for c in out.columns if c.startswith(("_n_", "_i_", "_o_"))])

    def places(self, inputs: list[str] | None = None) -> list[int]:
        """Places of the inputs (all, if not given) in the feature vector."""
        at, out = 0, []
        for c in [*self.numeric, *self.categorical]:
            width = self.sizes[c][0] if c in self.sizes else 1
            if inputs is None or c in inputs:
                out += range(at, at + width)
            at += width
        return out

    def named(self, spark) -> DataFrame:
        """(place, feature, level): what stands where in the vector; rare levels are one row."""
        numbers = [(i, c) for i, c in enumerate(self.numeric)]
        starts, at = [], len(self.numeric)
        for c in self.categorical:
            starts.append((c, at))
            at += self.sizes[c][0]
        out = spark.createDataFrame(numbers, "place bigint, feature string").withColumn("level", F.lit(None).cast("string")) if numbers else None
        if not starts:
            return out
        offsets = F.broadcast(spark.createDataFrame(starts, "feature string, start bigint"))
        rare = F.when(F.col("n") < MIN_FREQUENCY, RARE).otherwise(F.col("level"))
        named = self.levels.join(offsets, "feature").select((F.col("start") + F.col("slot")).alias("place"), "feature", rare.alias("level")).distinct()
        return named if out is None else out.unionByName(named)


def check_inputs(names: list[str]) -> None:
    bad = [n for n in names if n.startswith(FUTURE_COLUMNS)]
    if bad:
        raise ValueError(f"columns known only after the decision: {', '.join(bad)}")


def fit_features(train: DataFrame, numeric: list[str], categorical: list[str], known: DataFrame | None = None) -> Features:
    """``known``: the statistics of the inputs, if they are worked out already."""
    check_inputs([*numeric, *categorical])
    # one row per input column reaches the driver
    found = known if known is not None else numeric_stats(train, numeric) if numeric else None
    stats = {r["feature"]: (r["median"], r["mean"], r["spread"]) for r in found.collect()} if found is not None else {}
    levels, sizes, rows = None, {}, 0
    stages = []
    if categorical:
        levels = level_dictionary(train, categorical)
        found = levels.groupBy("feature").agg((F.max("slot") + 1).alias("slots"), F.count("*").alias("levels"), F.sum("n").alias("rows")).collect()
        sizes = {r["feature"]: (r["slots"], r["levels"]) for r in found}
        rows = max((r["rows"] for r in found), default=0)
        # the encoder only needs the number of slots: one row that holds the last slot of every column
        last = train.sparkSession.range(1).select(*[F.lit(float(sizes[c][0])).alias(f"_i_{c}") for c in categorical])
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=True).fit(last))
    stages.append(VectorAssembler(inputCols=[*[f"_n_{c}" for c in numeric], *[f"_o_{c}" for c in categorical]], outputCol="features"))
    return Features(numeric, categorical, stats, levels, sizes, rows, PipelineModel(stages))


def logistic(rows: int, strength: float = 1.0, max_iter: int = 500, tol: float = 1e-6, family: str = "auto") -> LogisticRegression:
    """L2 logistic regression; MLlib averages the loss, so the summed-loss penalty is 1 / (C n)."""
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (strength * rows), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol, family=family, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")


def probabilities(model: Model, df: DataFrame, names: list[str]) -> DataFrame:
    out = model.transform(df).withColumn("_p", vector_to_array("_prob"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]).drop("features")


@dataclass
class Calibrator:
    """Isotonic map of one score, clipped to the fitted range."""

    fitted: isotonic.Isotonic

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        return self.fitted.apply(df, {0: score}, {0: name})


def fit_isotonic(df: DataFrame, score: str, positive: Column) -> Calibrator:
    return Calibrator(isotonic.fit(df, {0: score}, {0: positive}))


def calibrate_classes(fit: DataFrame, target: DataFrame, classes: list[str], label: str, raw: str = "p_raw_", cal: str = "p_cal_") -> DataFrame:
    """One-vs-rest isotonic maps, fitted in one pass and scaled to sum to one; a row of zeros keeps its raw scores."""
    scores = {i: f"{raw}{c}" for i, c in enumerate(classes)}
    maps = isotonic.fit(fit, scores, {i: F.col(label) == c for i, c in enumerate(classes)})
    out = maps.apply(target, scores, {i: f"_u_{c}" for i, c in enumerate(classes)})
    total = sum((F.col(f"_u_{c}") for c in classes[1:]), F.col(f"_u_{classes[0]}"))
    scaled = {f"{cal}{c}": F.when(total > 1e-15, F.col(f"_u_{c}") / F.when(total > 1e-15, total)).otherwise(F.col(f"{raw}{c}")) for c in classes}
    return out.withColumns(scaled).drop(*[f"_u_{c}" for c in classes])


def value_bin(value: Column, cuts: list[float]) -> Column:
    """0-based right-closed bin of the value."""
    out = F.lit(0)
    for c in cuts:
        out = out + is_true(value > F.lit(c)).cast("int")
    return out


def calibrate_by_value(fit: DataFrame, target: DataFrame, score: str, positive: Column, value: str, cuts: list[float], name: str) -> DataFrame:
    """An isotonic map per value bin, the pooled one where a bin has no fitting case.

    Bins and the pooled map (group -1) are fitted in the same pass.
    """
    bins = list(range(len(cuts) + 1))
    marked = fit.withColumn("_bin", value_bin(F.abs(value), cuts)).withColumn("_bin", F.explode(F.array(F.lit(-1), "_bin")))
    maps = isotonic.fit(marked, {g: score for g in (-1, *bins)}, {g: positive for g in (-1, *bins)}, F.col("_bin"))
    present = {r["grp"] for r in maps.blocks.select("grp").distinct().collect()}  # at most len(cuts) + 2 rows
    own = value_bin(F.abs(value), cuts)
    used = F.lit(-1)
    for g in bins:
        if g in present:
            used = F.when(own == g, F.lit(g)).otherwise(used)
    return maps.apply(target, {g: score for g in (-1, *bins)}, {g: name for g in (-1, *bins)}, used)


def converged(est: LogisticRegression, prepared: DataFrame) -> Model:
    """The fitted model; a fit that stops at its iteration limit is an error, not a result."""
    model = est.fit(prepared)
    if model.summary.totalIterations >= est.getMaxIter():
        raise RuntimeError(f"the fit stopped at its limit of {est.getMaxIter()} iterations")
    return model


def score_gaps(model: Model, prepared: DataFrame) -> dict[int, list[float]]:
    """Per class and place of the vector: mean of residual x value, less the penalty's slope; all zero at the optimum.

    Residuals are split by sign, as weights of a vector sum must not be negative.
    """
    raw, classes = vector_to_array(F.col("_prob")), range(model.numClasses)
    gap = {k: is_true(F.col("label") == k).cast("double") - raw[k] for k in classes}
    scored = model.transform(prepared).select("features", *[gap[k].alias(f"_r{k}") for k in classes])
    total = Summarizer.metrics("sum")
    chosen = [1] if model.numClasses == 2 and model.coefficientMatrix.numRows == 1 else list(classes)
    sums = scored.agg(F.count("*").alias("n"), *[total.summary(F.col("features"), F.greatest(s * F.col(f"_r{k}"), F.lit(0.0))).alias(f"{w}{k}") for k in chosen for w, s in (("up", 1.0), ("down", -1.0))]).first()
    weight = model.coefficientMatrix.toArray()
    slope = model.getRegParam()
    out = {}
    for i, k in enumerate(chosen):
        mean = (sums[f"up{k}"]["sum"].toArray() - sums[f"down{k}"]["sum"].toArray()) / sums["n"]
        out[k] = [float(x) for x in mean - slope * weight[i]]
    return out


def audit_row(model: Model | boosting.Boosted, rows: int) -> dict:
    """What a fit took: rows, iterations, first and last objective, whether it converged and never rose."""
    s = getattr(model, "summary", None)
    n = s.totalIterations if s is not None else len(model.trees)
    limit = model.getOrDefault("maxIter") if s is not None else model.rounds
    steps = [float(x) for x in s.objectiveHistory] if s is not None else []
    falling = all(b <= a + 1e-12 for a, b in zip(steps, steps[1:], strict=False))
    return {"training_rows": rows, "iterations": int(n), "max_iterations": int(limit), "converged": s is None or n < limit,
            "first_objective": steps[0] if steps else None, "last_objective": steps[-1] if steps else None, "falling": falling}


@dataclass
class Matrix:
    """One written table of feature vectors and labels; models of any subset of the inputs are fitted to it."""

    features: Features
    rows: DataFrame

    def masked(self, inputs: list[str] | None, where: Column | None = None) -> DataFrame:
        """The rows with only the given inputs in their vectors."""
        df = self.rows if where is None else self.rows.where(where)
        if inputs is None:
            return df
        own = VectorSlicer(inputCol="features", outputCol="_masked", indices=self.features.places(inputs)).transform(df)
        return own.drop("features").withColumnRenamed("_masked", "features")


def matrix(df: DataFrame, fit_on: Column, numeric: list[str], categorical: list[str], keep: list[str]) -> Matrix:
    """Vectors of all rows, prepared as the rows ``fit_on`` ask for; ``keep`` columns stay beside them."""
    f = fit_features(df.where(fit_on), numeric, categorical)
    return Matrix(f, materialize(f.transform(df).select(*keep, "features")))


def fit_masked(m: Matrix, label: Column, train: Column, inputs: list[str] | None, family: str = "auto", max_iter: int = 500) -> tuple[Model, DataFrame, dict]:
    """(model, all rows with its probabilities in ``_prob``, audit) of one subset of the inputs; an unconverged fit raises."""
    rows = m.masked(inputs).withColumn("label", label)
    own = rows.where(train & F.col("label").isNotNull())
    n = own.count()
    model = converged(logistic(n, max_iter=max_iter, family=family), own)
    return model, model.transform(rows), audit_row(model, n)


@dataclass
class SafetyModel:
    features: Features
    model: Model | boosting.Boosted
    calibrator: Calibrator
    rows: int
    prepared: DataFrame

    def score(self, df: DataFrame, raw: str = "p_safe_raw", cal: str = "p_safe_cal") -> DataFrame:
        out = safety_scores(self.features, self.model, df, ["_p0", raw]).drop("_p0")
        return self.calibrator.apply(out, raw, cal)

    def audit(self) -> dict:
        return audit_row(self.model, self.rows)

    def equations(self) -> DataFrame:
        """(feature, level, gap): the score equation of every input."""
        spark = self.prepared.sparkSession
        gaps = spark.createDataFrame(list(enumerate(score_gaps(self.model, self.prepared)[1])), "place bigint, gap double")
        return self.features.named(spark).join(gaps, "place").select("feature", "level", "gap")


def safety_scores(features: Features, model: Model | boosting.Boosted, df: DataFrame, names: list[str]) -> DataFrame:
    if isinstance(model, boosting.Boosted):
        return model.probabilities(features.plain(df), df.columns, names)
    return probabilities(model, features.transform(df), names)


def fit_safety(train: DataFrame, calibration: DataFrame, label: str, numeric: list[str], categorical: list[str], kind: str = "logistic", rounds: int = 180) -> SafetyModel:
    """Train on resolved train cases, calibrate on resolved calibration cases."""
    train = train.withColumn("label", is_true(F.col(label) == SAFE).cast("double"))
    f = fit_features(train, numeric, categorical)
    if kind == "logistic":
        prepared = materialize(f.transform(train).select("features", "label"))
        rows = prepared.count()
        model = converged(logistic(rows), prepared)
    else:
        numbers, slots = [f"_n_{c}" for c in numeric], [(f"_i_{c}", f.sizes[c][0]) for c in categorical]
        prepared = materialize(f.plain(train).select("label", *numbers, *[c for c, _ in slots]))
        rows = prepared.count()
        model = boosting.fit(prepared, numbers, slots, rounds)
    raw = safety_scores(f, model, calibration, ["_p0", "_p1"])
    return SafetyModel(f, model, fit_isotonic(raw, "_p1", F.col(label) == SAFE), rows, prepared)


@dataclass
class ActionModel:
    features: Features
    model: Model
    classes: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        return probabilities(self.model, self.features.transform(df), [f"p_raw_{c}" for c in self.classes])


def fit_action(train: DataFrame, label: str, classes: list[str], numeric: list[str], categorical: list[str]) -> ActionModel:
    code = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        code = F.when(F.col(label) == c, float(i)).otherwise(code)
    f = fit_features(train, numeric, categorical)
    prepared = materialize(f.transform(train.withColumn("label", code)).select("features", "label"))
    return ActionModel(f, converged(logistic(prepared.count(), max_iter=2000, family="multinomial"), prepared), classes)
