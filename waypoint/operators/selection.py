"""Risk-controlled choice of thresholds on a calibration half.

Every procedure reduces the cases to counts per candidate first; tests, stopping
rules and picks run on candidate rows. Certificates hold for independent cases.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_true, steps_reached
from ..functions.stats import binomial_tail, exact_interval
from ..session import materialize, ship_package
from .ordered import at_thresholds, count_if, hash_ranks, prefix, small

# Fixed values.
TAUS = [0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99]
BETAS = [0.01, 0.02, 0.03, 0.05, 0.075, 0.10]
CAPS = [0.02, 0.03, 0.05, 0.10]
STARTS = [0.80, 0.85, 0.90, 0.92, 0.94, 0.95, 0.97, 0.99]


def by_seed(df: DataFrame, key: str, seeds: list[str]) -> DataFrame:
    """One copy of the calibration rows per seed with its hash half (0 fits, 1 selects)."""
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    digits = F.substring(F.sha2(F.concat("seed", F.col(key).cast("string")), 256), 1, 8)
    return rows.withColumn("half", (F.conv(digits, 16, 10).cast("bigint") % 2).cast("int"))


def seed_bits(key: str, seeds: list[str]) -> Column:
    """The hash halves of a row as one number, one bit per seed."""
    digits = lambda s: F.substring(F.sha2(F.concat(F.lit(s), F.col(key).cast("string")), 256), 1, 8)
    bits = [F.shiftleft(F.conv(digits(s), 16, 10).cast("bigint") % 2, k) for k, s in enumerate(seeds)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def seed_counts(df: DataFrame, key: str, seeds: list[str], cells: list[str], flags: dict[str, Column], halves: str | None = None) -> DataFrame:
    """(seed, half, cells, flags): per seed and hash half the flagged rows of every cell, without a copy of a row per seed.

    A row's halves are one bit per seed, ``seed_bits`` of the key or the column ``halves`` that
    holds them. A cell counts each flag once in all and once per bit; what is not in half 1 is
    in half 0. Only cells meet the seeds.
    """
    bits = seed_bits(key, seeds) if halves is None else F.col(halves)
    marked = df.select(*cells, bits.alias("_halves"), *[is_true(c).cast("bigint").alias(f) for f, c in flags.items()])
    in_one = lambda k: F.shiftright("_halves", k).bitwiseAND(F.lit(1).cast("bigint"))
    sums = [F.sum(f).alias(f) for f in flags] + [F.sum(F.col(f) * in_one(k)).alias(f"{f}_{k}") for f in flags for k in range(len(seeds))]
    wide = marked.groupBy(*cells).agg(*sums)
    rows = [F.struct(F.lit(s).alias("seed"), F.lit(half).alias("half"), *[(F.col(f"{f}_{k}") if half else F.col(f) - F.col(f"{f}_{k}")).alias(f) for f in flags]) for k, s in enumerate(seeds) for half in (0, 1)]
    return wide.select(*cells, F.inline(F.array(*rows)))


def gate_counts(df: DataFrame, key: str, seeds: list[str], gate_ok: Column) -> DataFrame:
    """(seed, policy, half, s, k, n, u): rows, selectable and unsafe selectable rows per score, ungated and gated."""
    u, g = is_true(F.col("u")), is_true(gate_ok)
    counts = seed_counts(df, key, seeds, ["s"], {"k": F.lit(True), "su": u, "gn": g, "gu": g & u})
    rows = F.array(F.struct(F.lit("Safety").alias("policy"), F.col("k").alias("n"), F.col("su").alias("u")), F.struct(F.lit("Gate safety").alias("policy"), F.col("gn").alias("n"), F.col("gu").alias("u")))
    return counts.select("seed", "half", "s", "k", F.inline(rows)).where("k > 0")


def both_gates(df: DataFrame, gate_ok: Column) -> DataFrame:
    """Copies for the ungated and the gated variant of a rule; ``ok`` marks selectable rows."""
    rows = F.array(F.struct(F.lit("Safety").alias("policy"), F.lit(True).alias("ok")), F.struct(F.lit("Gate safety").alias("policy"), is_true(gate_ok).alias("ok")))
    return df.select("*", F.inline(rows))


def tested(counts: DataFrame, caps: list[float]) -> DataFrame:
    """Exact lower-tail p-value of (n, u) at each risk cap."""
    ship_package(counts.sparkSession)
    t = counts.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    return t.withColumn("p_value", binomial_tail(F.col("u"), F.col("n"), F.col("cap")))


def best(passed: DataFrame, by: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    return passed.groupBy(*by).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("b")).select(*by, "b.*")


def learn_then_test(df: DataFrame, score: str, thresholds: list[float], caps: list[float], by: list[str], delta: float = 0.05) -> DataFrame:
    """Bonferroni over a fixed threshold grid, then most selected, lowest threshold."""
    t = at_thresholds(df, F.col(score), thresholds, {"n": F.col("ok").cast("bigint"), "u": (F.col("ok") & F.col("u")).cast("bigint")}, by)
    t = tested(t.select(*by, "threshold", "n", "u"), caps)
    ok = (F.col("n") > 0) & (F.col("p_value") <= delta / len(thresholds))
    return best(t.where(ok), [*by, "cap"], ["threshold", "n", "u", "p_value"], [-F.col("n"), F.col("threshold")])


def conformal_control(df: DataFrame, score: str, thresholds: list[float], caps: list[float], by: list[str]) -> DataFrame:
    """(u + 1) / (cases + 1) at most the cap: controls the unsafe share of all cases."""
    t = at_thresholds(df, F.col(score), thresholds, {"n": F.lit(1).cast("bigint"), "u": F.col("u").cast("bigint")}, by)
    t = t.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).withColumn("corrected", (F.col("u") + 1) / (F.col("all_n") + 1))
    return best(t.where(F.col("corrected") <= F.col("cap")), [*by, "cap"], ["threshold", "n", "u", "corrected"], [-F.col("n"), F.col("threshold")])


def _steps(taus: list[float], betas: list[float], c_h: float) -> tuple[Column, Column]:
    """Steps of tau that a row's score reaches, and budgets that its risk exceeds."""
    risk = (1 - F.col("s")) * F.col("c")
    return steps_reached(F.col("s"), taus), reduce(lambda a, b: a + b, [is_true(risk > F.lit(min(b, c_h))).cast("int") for b in betas])


def _on_nodes(cells: DataFrame, by: list[str], sums: dict[str, str], taus: list[float], betas: list[float]) -> DataFrame:
    """Sums of the cells (i, j) that lie inside every (tau, beta) node."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ti"), F.lit(t).alias("tau"), F.lit(j).alias("bj"), F.lit(b).alias("beta")) for i, t in enumerate(taus) for j, b in enumerate(betas)])
    nodes = cells.select(*by, "i", "j", *sums.values(), F.inline(rows))
    inside = (F.col("i") >= F.col("ti")) & (F.col("j") <= F.col("bj"))
    return nodes.groupBy(*by, "tau", "beta", "bj").agg(*[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(n) for n, c in sums.items()])


def node_counts(df: DataFrame, by: list[str], taus: list[float] = TAUS, betas: list[float] = BETAS, c_h: float = 0.1) -> DataFrame:
    """(n, u) of the gated short rule at every (tau, beta) node from one small count table."""
    i, j = _steps(taus, betas, c_h)
    cells = df.where(is_true(F.col("g"))).select(*by, i.alias("i"), j.alias("j"), "u")
    cells = cells.groupBy(*by, "i", "j").agg(F.count("*").alias("k"), count_if(F.col("u")).alias("b"))
    return _on_nodes(cells, by, {"n": "k", "u": "b"}, taus, betas)


def seed_node_counts(df: DataFrame, key: str, seeds: list[str], by: list[str] | None = None, taus: list[float] = TAUS, betas: list[float] = BETAS, c_h: float = 0.1, halves: str | None = None) -> DataFrame:
    """``node_counts`` of half 1 of every seed, from one pass over the rows.

    ``halves`` names a column of ``seed_bits`` that the rows already hold, so copies of a row share its hashes.
    """
    by = by or []
    i, j = _steps(taus, betas, c_h)
    marked = df.select(key if halves is None else halves, *by, i.alias("i"), j.alias("j"), is_true(F.col("g")).alias("g"), is_true(F.col("u")).alias("u"))
    # gate and label are part of the cell: one count per seed, and rows that the gate blocks keep their cell, so every group has its nodes
    cells = seed_counts(marked, key, seeds, [*by, "i", "j", "g", "u"], {"rows": F.lit(True)}, halves).where("half = 1 and rows > 0")
    cells = cells.withColumns({"k": F.when(F.col("g"), F.col("rows")).otherwise(0), "b": F.when(F.col("g") & F.col("u"), F.col("rows")).otherwise(0)})
    return _on_nodes(cells, [*by, "seed"], {"n": "k", "u": "b"}, taus, betas)


def stop_at_first_failure(tests: DataFrame, chain: list[str], position: str, passed: Column) -> DataFrame:
    """Tests before the first failure of their chain."""
    failed = tests.groupBy(*chain).agg(F.min(F.when(~is_true(passed), F.col(position))).alias("_stop"))
    return tests.join(failed, chain).where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")


def graph_selection(nodes: DataFrame, caps: list[float], by: list[str], delta: float = 0.05, chains: int = len(TAUS)) -> DataFrame:
    """One chain per tau, budgets increasing, delta shared equally; most selected node that passed."""
    t = tested(nodes, caps)
    ok = (F.col("n") > 0) & (F.col("p_value") <= delta / chains)
    kept = stop_at_first_failure(t, [*by, "cap", "tau"], "bj", ok)
    return best(kept, [*by, "cap"], ["tau", "beta", "n", "u"], [-F.col("n"), F.col("tau"), F.col("beta")])


def empirical_selection(nodes: DataFrame, caps: list[float], by: list[str]) -> DataFrame:
    """Most selected node whose observed unsafe rate is within the cap (no certificate)."""
    t = nodes.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    ok = (F.col("n") > 0) & is_true(F.try_divide(F.col("u").cast("double"), F.col("n").cast("double")) <= F.col("cap"))
    return best(t.where(ok), [*by, "cap"], ["tau", "beta", "n", "u"], [-F.col("n"), F.col("tau"), F.col("beta")])


def bonferroni_selection(nodes: DataFrame, caps: list[float], by: list[str], family: int, delta: float = 0.05) -> DataFrame:
    t = tested(nodes, caps)
    ok = (F.col("n") > 0) & (F.col("p_value") <= delta / family)
    return best(t.where(ok), [*by, "cap"], ["tau", "beta", "n", "u"], [-F.col("n"), F.col("tau"), F.col("beta")])


def knot_counts(fit: DataFrame, sel: DataFrame, by: list[str], starts: list[float] | None = None) -> DataFrame:
    """Running (n, u) of the selection half at every knot of the fitted score, highest first.

    ``fit`` and ``sel`` hold counts (n, u) per ``by`` and score ``s``.
    """
    zero = F.lit(0).cast("bigint")
    knots = fit.select(*by, "s").distinct().select(*by, "s", F.lit(1).alias("knot"), zero.alias("n"), zero.alias("u"))
    rows = knots.unionByName(sel.select(*by, "s", F.lit(0).alias("knot"), "n", "u"))
    if starts:
        extra = fit.select(*by).distinct().withColumn("s", F.explode(F.array(*[F.lit(x) for x in starts]))).select(*by, "s", F.lit(0).alias("knot"), zero.alias("n"), zero.alias("u"))
        rows = rows.unionByName(extra)
    merged = rows.groupBy(*by, "s").agg(F.max("knot").alias("knot"), F.sum("n").alias("n"), F.sum("u").alias("u"))
    p = prefix(merged, [F.col("s").desc()], by=by, sums=["n", "u"])
    return p.select(*by, F.col("s").alias("threshold"), "knot", "rank", F.col("cum_n").alias("n"), F.col("cum_u").alias("u"))


def fixed_sequence(knots: DataFrame, caps: list[float], by: list[str], start: DataFrame | None = None, delta: float = 0.05) -> DataFrame:
    """Test knots from the strictest down, stop at the first failure, keep the largest passing set."""
    t = tested(knots.where("knot = 1").select(*by, "threshold", "rank", "n", "u"), caps)
    if start is not None:
        t = t.join(start, [*by, "cap"], "left").where(F.col("start").isNull() | (F.col("threshold") <= F.col("start")))
    kept = stop_at_first_failure(t, [*by, "cap"], "rank", F.col("p_value") <= delta)
    return best(kept.where("n > 0"), [*by, "cap"], ["threshold", "n", "u"], [-F.col("n"), F.col("threshold")])


def learned_start(fit_knots: DataFrame, caps: list[float], by: list[str]) -> DataFrame:
    """Starting knot chosen on the fitting half: a heuristic, not a certificate."""
    t = tested(fit_knots.where("knot = 1").select(*by, "threshold", "n", "u"), caps)
    ok = t.where((F.col("n") > 0) & (F.col("p_value") <= 0.05))
    return best(ok, [*by, "cap"], ["threshold"], [-F.col("n"), F.col("threshold")]).withColumnRenamed("threshold", "start")


def eight_starts(knots: DataFrame, caps: list[float], by: list[str], starts: list[float] = STARTS, delta: float = 0.05) -> DataFrame:
    """Eight descending chains, each its start and the knots below it, delta / 8 each."""
    t = tested(knots.select(*by, "threshold", "knot", "rank", "n", "u"), caps)
    t = t.withColumn("start", F.explode(F.array(*[F.lit(x) for x in starts])))
    t = t.where((F.col("threshold") == F.col("start")) | ((F.col("knot") == 1) & (F.col("threshold") < F.col("start"))))
    kept = stop_at_first_failure(t, [*by, "cap", "start"], "rank", F.col("p_value") <= delta / len(starts))
    return best(kept.where("n > 0"), [*by, "cap"], ["threshold", "start", "n", "u"], [-F.col("n"), F.col("threshold"), F.col("start")])


def apply_choice(test: DataFrame, chosen: DataFrame, seeds: list[str], caps: list[float], taus: list[float] = TAUS, betas: list[float] = BETAS, c_h: float = 0.1) -> DataFrame:
    """Metrics of the chosen (tau, beta) of every seed and cap on untouched test rows; no choice means no execution.

    The test rows are reduced to the nodes of the grid once; choices only pick nodes.
    """
    i, j = _steps(taus, betas, c_h)
    loss = F.when(is_true(F.col("g")), F.col("u").cast("double") * F.col("c"))
    cells = test.select(i.alias("i"), j.alias("j"), is_true(F.col("g")).cast("bigint").alias("k"), is_true(F.col("g") & F.col("u")).cast("bigint").alias("b"), loss.alias("x"))
    cells = cells.groupBy("i", "j").agg(F.count("*").alias("rows"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    nodes = _on_nodes(cells, [], {"executed": "k", "unsafe": "b", "loss": "x"}, taus, betas).drop("bj")
    whole = cells.agg(F.sum("rows").alias("cases"))
    asked = whole.select("cases", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")).select("*", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    picked = asked.join(chosen.select("seed", "cap", "tau", "beta"), ["seed", "cap"], "left").join(nodes, ["tau", "beta"], "left").fillna(0, ["executed", "unsafe"]).fillna(0.0, ["loss"])
    return picked.select(
        "seed", "cap", "cases", "executed", "unsafe", (F.col("executed") / F.col("cases")).alias("coverage"),
        ((F.col("loss") + 0.1 * (F.col("cases") - F.col("executed"))) / F.col("cases")).alias("mean_loss"))


def repeat_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Share certified and median, lowest and highest coverage over repeats (one row per repeat)."""
    return results.groupBy(*by).agg(
        F.count("*").alias("repetitions"), F.avg(F.col("certified").cast("int")).alias("certification_fraction"),
        F.percentile("coverage", F.lit(0.5)).alias("coverage_median"), F.min("coverage").alias("coverage_min"), F.max("coverage").alias("coverage_max"))


def exact_intervals(df: DataFrame, n: str, u: str, alpha: float = 0.05) -> DataFrame:
    ship_package(df.sparkSession)
    return df.withColumn("_i", exact_interval(F.col(u), F.col(n), alpha)).select(*df.columns, F.col("_i.lower").alias("lower"), F.col("_i.upper").alias("upper"))


#: Rounds of the keyed permutation, and the modulus of its coin.
ROUNDS, COIN = 24, 2_147_483_647


def round_keys(seed: str) -> list[tuple[int, int, int]]:
    """(shift, factor, addend) of every round of a seed's permutation."""
    out = []
    for r in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}{r}".encode()).hexdigest()
        out.append((int(digest[:12], 16), int(digest[12:20], 16) % (COIN - 1) + 1, int(digest[20:28], 16) % COIN))
    return out


def keyed_place(place: Column, size: Column, seed: str) -> Column:
    """A seeded bijection of 0, ..., size - 1: in each round a place may be swapped with its mirror image.

    The mirror of x is shift - x modulo size; both of a pair see the same coin, so
    every round maps the places onto themselves, whatever the size.
    """
    keys = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("kab", key, strict=True)]) for key in round_keys(seed)])

    def swap(x: Column, key: Column) -> Column:
        mirror = F.pmod(key["k"] - x, size)
        coin = F.pmod(F.pmod(F.greatest(x, mirror), F.lit(COIN)) * key["a"] + key["b"], F.lit(COIN)) % 2
        return F.when(coin == 1, mirror).otherwise(x)

    return F.aggregate(keys, place.cast("bigint"), swap)


def permuted_all(df: DataFrame, unique: str, value: str, seeds: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """One copy of the rows per seed, column ``permutation``, with the values dealt anew within ``by``.

    Rows are ranked once; every seed is a bijection of the ranks, so the set of
    values stays. Only rank and value of a row meet the seeds.
    """
    by = by or []
    ranked = hash_ranks(df, F.sha2(F.col(unique).cast("string"), 256), unique, by, rank="_rk")
    ranked = materialize(ranked.withColumn("_rk", F.col("_rk") - 1))
    sizes = small(ranked.groupBy(*by).agg(F.count("*").alias("_n")))
    held = ranked.join(sizes, by) if by else ranked.withColumn("_n", sizes.scalar())
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("permutation"), keyed_place(F.col("_rk"), F.col("_n"), s).alias("_to")) for s in seeds]))
    dealt = held.select(*by, F.col(value).alias(name), arms.alias("_a")).select(*by, name, "_a.permutation", F.col("_a._to").alias("_rk"))
    return ranked.join(dealt, [*by, "_rk"]).drop("_rk")


def permuted(df: DataFrame, unique: str, value: str, seed: str, name: str) -> DataFrame:
    """The values of a column dealt to other rows by a seeded permutation; the set of values stays."""
    return permuted_all(df, unique, value, [seed], name).drop("permutation")
