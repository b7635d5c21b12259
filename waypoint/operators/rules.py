"""Comparisons of fixed execution rules and threshold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as D
from ..functions.scalars import AMBIGUOUS, UNSAFE, is_true, left_closed_bin
from . import envelope
from .metrics import rule_metrics
from .ordered import at_thresholds, count_if, grid_column
from .ranking import best_row


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def threshold_table(df: DataFrame, score: str, unsafe: str, thresholds: list[float], by: list[str]) -> DataFrame:
    u = is_true(F.col(unsafe))
    t = at_thresholds(df, F.col(score), thresholds, {"n": F.lit(1).cast("bigint"), "bad": u.cast("bigint")}, by)
    good = F.col("n") - F.col("bad")
    return t.select(
        *by, "threshold", F.col("all_n").alias("cases"), F.col("n").alias("selected"), ratio(F.col("n"), F.col("all_n")).alias("coverage"), F.col("bad").alias("unsafe"),
        ratio(F.col("bad"), F.col("n")).alias("unsafe_rate"), ratio(good, F.col("n")).alias("precision"), ratio(good, F.col("all_n") - F.col("all_bad")).alias("recall"))


def conditional_calibration(df: DataFrame, score: str, unsafe: str, edges: list[float], labels: list[str], high: Column) -> DataFrame:
    return df.groupBy(left_closed_bin(F.col(score), edges, labels, "MISSING").alias("band"), is_true(high).alias("high_value")).agg(
        F.count("*").alias("n"), F.avg(is_true(F.col(unsafe)).cast("int")).alias("unsafe_rate"), (1 - F.avg(score)).alias("expected_rate"))


def dangerous_errors(counts: DataFrame, by: list[str]) -> DataFrame:
    esc, ex = F.col("actual") == "ESCALATE", F.col("predicted") == "EXECUTE"
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(n(esc).alias("escalate_cases"), n(esc & ex).alias("escalate_executed"), ratio(n(esc & ex), n(esc)).alias("rate"))


def consequence_modes(df: DataFrame, by: list[str], tau: float, beta: float, c_h: float = 0.1) -> DataFrame:
    linear = F.abs("transaction_exposure_eur") / F.col("p90")
    modes = F.array(F.struct(F.lit("LOG").alias("mode"), F.col("c").alias("cm")), F.struct(F.lit("LINEAR").alias("mode"), linear.alias("cm")), F.struct(F.lit("CAPPED").alias("mode"), F.least(linear, F.lit(10.0)).alias("cm")))
    d = df.select(*by, "u", "s", "gate", F.inline(modes))
    ex = D.short_rule(F.col("gate") == "VALID", F.col("s"), F.col("cm"), tau, beta, c_h)
    d = d.withColumn("ex", ex)
    return d.groupBy(*by, "mode").agg(count_if(F.col("ex")).alias("executed"), F.avg(F.when(F.col("ex"), is_true(F.col("u")).cast("double") * F.col("cm")).otherwise(c_h)).alias("mean_loss"))


def paired(df: DataFrame, rules: dict[str, Column], pairs: list[tuple[str, str]], keep: list[str], c_h: float = 0.1) -> DataFrame:
    """Per case and comparison: execution difference and loss difference of two rules."""
    used = sorted({x for p in pairs for x in p})
    base = df.select(*keep, "u", "c", *[rules[n].alias(f"_r_{n}") for n in used])
    bad = is_true(F.col("u")).cast("double") * F.col("c")
    loss = lambda n: F.when(F.col(f"_r_{n}"), bad).otherwise(c_h)
    rows = F.array(*[F.struct(F.lit(f"{a} minus {b}").alias("comparison"), (F.col(f"_r_{a}").cast("int") - F.col(f"_r_{b}").cast("int")).alias("d"), (loss(a) - loss(b)).alias("delta")) for a, b in pairs])
    return base.select(*keep, "u", "c", F.inline(rows))


def break_even(df: DataFrame, rules: dict[str, Column], pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """Human cost at which two fixed decision sets lose the same."""
    p = paired(df, rules, pairs, by)
    u = is_true(F.col("u")).cast("int")
    removed = -F.sum("d")
    return p.groupBy(*by, "comparison").agg(removed.alias("removed"), (-F.sum(F.col("d") * u)).alias("unsafe_removed"), F.try_divide(-F.sum(F.col("d") * u * F.col("c")), removed.cast("double")).alias("break_even"))


def loss_concentration(df: DataFrame, rules: dict[str, Column], pairs: list[tuple[str, str]], unique: str) -> DataFrame:
    """How much of a loss difference hangs on its largest cases.

    Only the five largest rows per comparison are ranked, limited before the shuffle.
    """
    p = paired(df, rules, pairs, [unique])
    benefit = F.greatest(-F.col("delta"), F.lit(0.0))
    total = p.groupBy("comparison").agg(
        F.count("*").alias("n"), count_if(F.abs("delta") > 1e-14).alias("changed_cases"), F.sum("delta").alias("total_difference"),
        F.max(F.abs("delta")).alias("largest_abs_case"), F.sum(benefit).alias("benefit"))

    def top(order: Column, what: Column, name: str) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("comparison").orderBy(order.desc(), F.col(unique))
        five = p.select("comparison", what.alias("x"), F.row_number().over(w).alias("pos")).where(F.col("pos") <= 5)
        return five.groupBy("comparison").agg(F.sum(F.when(F.col("pos") == 1, F.col("x"))).alias(f"{name}1"), F.sum("x").alias(f"{name}5"))

    j = total.join(top(F.abs("delta"), F.col("delta"), "abs"), "comparison").join(top(benefit, benefit, "ben"), "comparison")
    return j.select(
        "comparison", "changed_cases", "total_difference", "largest_abs_case",
        F.try_divide(F.col("ben1"), F.col("benefit")).alias("benefit_top1_share"), F.try_divide(F.col("ben5"), F.col("benefit")).alias("benefit_top5_share"),
        F.try_divide(F.col("total_difference") - F.col("abs1"), F.col("n") - 1).alias("without_largest"),
        F.try_divide(F.col("total_difference") - F.col("abs5"), F.col("n") - 5).alias("without_largest5"))


def group_concentration(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    from pyspark.sql import Window

    per = df.groupBy(*by, group).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy(F.col("k").desc(), F.col(group))
    five = per.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 5).groupBy(*by).agg(F.max("k").alias("_m"), F.sum("k").alias("_s5"))
    total = per.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("k").alias("_n"), F.sum(F.col("k").cast("double") * F.col("k")).alias("_q"))
    n = F.col("_n")
    return total.join(five, by).select(*by, "groups", (F.col("_m") / n).alias("top_share"), (F.col("_s5") / n).alias("top5_share"), (n.cast("double") * n / F.col("_q")).alias("effective_groups"))


def cost_curves(df: DataFrame, tau: float, beta: float, costs: list[float], by: list[str], other_tau: float | None = None) -> DataFrame:
    """Loss difference of the short rule against the plain score rule over human costs.

    Fixed decisions need three sums. Re-decided ones change only at a row's own
    risk, so rows are counted per step between the costs.
    """
    s, c, u = F.col("s"), F.col("c"), is_true(F.col("u")).cast("double")
    g = F.col("gate") == "VALID"
    risk = (1 - s) * c
    fixed, other = D.short_rule(g, s, c, tau, beta, 0.1), is_true(s >= (other_tau or tau))
    can = is_true(g & (s >= tau) & (risk <= beta))
    d = df.select(*by, (-risk).alias("_s"), fixed.cast("int").alias("fx"), other.cast("int").alias("ot"), can.cast("int").alias("can"), (u * c).alias("bad"))
    one = lambda x: x.cast("double")
    sums = {
        "one": F.lit(1.0), "dfx": one(F.col("fx") - F.col("ot")), "bfx": (F.col("fx") - F.col("ot")) * F.col("bad"),
        "ot": one(F.col("ot")), "bot": F.col("ot") * F.col("bad"), "rt": one(F.col("can")), "brt": F.col("can") * F.col("bad")}
    t = at_thresholds(d, F.col("_s"), [-x for x in costs], sums, by)
    k = -F.col("threshold")
    n = F.col("all_one")
    retuned = (F.col("brt") + k * (n - F.col("rt"))) - (F.col("all_bot") + k * (n - F.col("all_ot")))
    return t.select(*by, (k + F.lit(0.0)).alias("c_h"), ((F.col("all_bfx") - k * F.col("all_dfx")) / n).alias("fixed_difference"), (retuned / n).alias("retuned_difference"))


def ambiguity_bounds(df: DataFrame, executed: Column, by: list[str], c_h: float = 0.1) -> DataFrame:
    amb = F.col("target") == AMBIGUOUS
    rows = F.array(F.struct(F.lit("ambiguous_safe").alias("convention"), (F.col("target") == UNSAFE).alias("lab")),
                   F.struct(F.lit("ambiguous_unsafe").alias("convention"), ((F.col("target") == UNSAFE) | amb).alias("lab")))
    d = df.select(*by, "c", is_true(executed).alias("ex"), amb.alias("amb"), F.inline(rows))
    ex, lab = F.col("ex"), F.col("lab").cast("double")
    return d.groupBy(*by, "convention").agg(
        F.count("*").alias("cases"), count_if(F.col("amb") & ex).alias("ambiguous_executed"), F.avg(ex.cast("int")).alias("coverage"),
        F.avg(F.when(ex, lab)).alias("unsafe_rate"), F.avg(F.when(ex, lab * F.col("c")).otherwise(c_h)).alias("mean_loss"))


def retention(df: DataFrame, by: list[str]) -> DataFrame:
    natural = F.col("family") == "NATURAL"
    ref = natural & (F.col("expected_action_reference") == "EXECUTE")
    return df.groupBy(*by).agg(count_if(natural).alias("natural_cases"), count_if(ref).alias("reference_execute"),
                               count_if(ref & (F.col("gate") == "VALID")).alias("gate_passed"), count_if(ref & (F.col("action") == "EXECUTE")).alias("executed"))


def predicted_vs_outcome(df: DataFrame, score: str, budget: float, c_h: float, by: list[str]) -> DataFrame:
    ex, loss = F.col("ex"), (1 - F.col(score)) * F.col("c")
    rate = F.avg(ex.cast("int"))
    return df.groupBy(*by).agg(
        F.count("*").alias("episodes"), count_if(ex).alias("executed"), F.avg(F.when(ex, loss).otherwise(c_h)).alias("mean_predicted"),
        F.avg(F.when(ex, F.col("unsafe").cast("double") * F.col("c")).otherwise(c_h)).alias("mean_outcome"),
        (rate * budget + (1 - rate) * c_h).alias("upper_bound"), F.max(F.when(ex, loss)).alias("max_predicted"))


def step_counts(df: DataFrame, score: str, tau: float, beta: float, by: list[str]) -> DataFrame:
    s = F.col(score)
    g = (F.col("gate") == "VALID") & (s >= tau)
    per = df.groupBy(*by, score).agg(count_if(g & ((1 - s) * F.col("c") > beta)).alias("rem"), count_if(g & (F.col("transaction_exposure_eur") > F.col("p90"))).alias("high"))
    return per.groupBy(*by).agg(F.count("*").alias("distinct_values"), count_if(s >= tau).alias("above_threshold"), F.sum("rem").alias("budget_removals"), F.sum("high").alias("gated_above_p90"))


def human_cost_grid(df: DataFrame, c_h: list[float], rho: list[float], p: D.Params) -> DataFrame:
    """Executions and mean loss at every (c_H, rho_H), rows counted by kind and not copied."""
    points = [{"c_h": float(h), "rho_h": float(x)} for h in c_h for x in rho]
    c = F.col("c")
    decide = lambda q: D.decide(F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), c, q, F.col("gather_policy_eligible"), F.col("gate"), allow_gather=False)[0]
    cells = envelope.kinds(df, [envelope.letter(decide(p.but(**x))) for x in points], {"bad": is_true(F.col("unsafe")).cast("int") * c, "all_c": c})
    act, n = F.col("act"), F.col("n")
    escalate = F.col("c_h") * n + F.col("rho_h") * F.col("all_c")
    loss = F.when(act == "E", F.col("bad")).when(act == "H", escalate).otherwise(F.lit(float(p.c_a)) * n)
    return envelope.on_grid(cells, points).groupBy("c_h", "rho_h").agg(
        envelope.count_of("E").alias("executed"), (F.sum(loss) / F.sum("n")).alias("loss"), (F.sum(escalate) / F.sum("n")).alias("always_escalate"))


def consequence_only(df: DataFrame, p: D.Params, by: list[str]) -> DataFrame:
    """Decide on one consequence scale, always score on the logarithmic one."""
    rows = F.array(F.struct(F.lit("UNIFORM").alias("decision_mode"), F.lit(1.0).alias("cd")), F.struct(F.lit("LOG_TRAIN_P90").alias("decision_mode"), F.col("c").alias("cd")))
    d = df.select(*by, "p_safe_t0_cal", "p_safe_t1_primary", "gather_policy_eligible", "gate", "unsafe", "c", F.inline(rows))
    a, _ = D.decide(F.col("p_safe_t0_cal"), F.col("p_safe_t1_primary"), F.col("cd"), p, F.col("gather_policy_eligible"), F.col("gate"), allow_gather=False)
    d = d.withColumn("a", a)
    return d.groupBy(*by, "decision_mode").agg(count_if(F.col("a") == "EXECUTE").alias("executed"), F.avg(D.loss_b(F.col("a"), F.col("unsafe"), F.col("c"), p)).alias("loss"))


def monotonicity(df: DataFrame, rules: dict[str, Column], by: list[str]) -> DataFrame:
    """Stricter rules execute no more cases and no more value; contrasts equal differences of means."""
    from .checks import check_rows

    m = rule_metrics(df, by, rules, F.col("u"), F.col("transaction_exposure_eur"), F.col("c"))
    wide = m.groupBy(*by).agg(*[F.max(F.when(F.col("policy") == n, F.struct("executed", "executed_value_per_1000", "mean_loss"))).alias(n.replace(" ", "_").replace("-", "_")) for n in rules])
    pair = paired(df, rules, [("Gate safety", "Safety")], by).groupBy(*by).agg(F.avg("delta").alias("_d"))
    wide = wide.join(pair, by)
    le = lambda a, b: (F.col(a)["executed"] <= F.col(b)["executed"]) & (F.col(a)["executed_value_per_1000"] <= F.col(b)["executed_value_per_1000"] + 1e-6)
    less = lambda a, b: F.col(b)["executed"] - F.col(a)["executed"]
    return check_rows(wide, {
        "gate_safety_within_safety": (le("Gate_safety", "Safety"), less("Gate_safety", "Safety")), "reference_within_gate_safety": (le("Reference", "Gate_safety"), less("Reference", "Gate_safety")),
        "v04_contrast_is_difference": (F.abs(F.col("_d") - (F.col("Gate_safety")["mean_loss"] - F.col("Safety")["mean_loss"])) < 1e-9, F.col("_d"))})
