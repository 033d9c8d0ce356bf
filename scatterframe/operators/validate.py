"""Which metrics deserve trust: bootstrap, leave-one-out, null calibration, stability, status.

Inputs are per-block correlations (condition, block, metric, m, rho) or cells;
both are small next to the trials.  Resampling reweights stored per-block z
values instead of recomputing correlations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import settle
from ..functions.numeric import EPS, as_col, atanh_clipped, big, finite, hash32
from ..functions.rank import avg_rank_small, percentiles
from .assoc import CB, fisher_combine, spearman_by_block

THRESHOLD = 0.30


def passes(rho: Column, threshold: float = THRESHOLD) -> Column:
    """|rho| reaches the threshold; rounded so that an exact tie counts."""
    return F.abs(F.round(rho, 12)) >= threshold


def score(combined: DataFrame, keys: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Mean |rho| over conditions (absolute value inside each) and the number that pass."""
    keys = keys or ["metric"]
    return combined.groupBy(*keys).agg(
        F.count("*").alias("n_cond"), F.avg(F.abs("rho")).alias("mean_abs"), F.sum(passes(F.col("rho"), threshold).cast("bigint")).alias("pass"))


def block_picks(per_block: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """Bootstrap weights: how often each draw picks each block of a condition, the same for all metrics."""
    blocks = per_block.select(*CB).distinct()
    w = Window.partitionBy("condition")
    blocks = blocks.select("*", (F.row_number().over(w.orderBy("block")) - 1).alias("slot"), F.count("*").over(w).alias("nb"))
    picks = blocks.select("condition", "slot", "nb", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = picks.select("condition", "draw", (hash32(F.lit(seed), "condition", "draw", "slot") % F.col("nb")).alias("slot"))
    times = picks.groupBy("condition", "draw", "slot").agg(F.count("*").alias("times"))
    return times.join(blocks.select(*CB, big("slot").alias("slot")), ["condition", "slot"]).select(*CB, "draw", "times")


def block_bootstrap(per_block: DataFrame, draws: int = 5000, seed: int = 42) -> DataFrame:
    """(condition, metric, draw, rho) over resampled blocks."""
    z = per_block.select(*CB, "metric", (F.col("m") - 3).cast("double").alias("w"), atanh_clipped("rho").alias("z"))
    j = z.join(block_picks(per_block, draws, seed), CB)
    tw = F.col("times") * F.col("w")
    return j.groupBy("condition", "metric", "draw").agg(F.tanh(F.sum(tw * F.col("z")) / F.sum(tw)).alias("rho"))


def bootstrap_intervals(boot: DataFrame, reference: str) -> DataFrame:
    """95 % limits of |rho| and of |rho| over the reference metric's, draws pooled over conditions."""
    ref = boot.where(F.col("metric") == reference).select("condition", "draw", F.abs("rho").alias("ref"))
    j = boot.join(ref, ["condition", "draw"]).select(
        "metric", F.round(F.abs("rho"), 12).alias("a"), F.round(F.abs("rho") / F.greatest("ref", F.lit(EPS)), 12).alias("q"))
    ci = percentiles(j, ["metric"], "a", {"ci_lo": 2.5, "ci_hi": 97.5}, small=True).drop("n")
    return ci.join(percentiles(j, ["metric"], "q", {"ratio_lo": 2.5, "ratio_hi": 97.5}, small=True).drop("n"), "metric")


def scorecard(per_block: DataFrame, spread: DataFrame, between: DataFrame, trial: DataFrame, reference: str, draws: int = 5000,
              threshold: float = THRESHOLD) -> DataFrame:
    """One row per metric: mean |rho|, trial and between values, spread, intervals, pass count, ratio to reference."""
    s = score(fisher_combine(per_block, ["condition", "metric"]), threshold=threshold)
    ref = s.where(F.col("metric") == reference).select(F.col("mean_abs")).scalar()
    mean = lambda df, c, name, absolute: df.groupBy("metric").agg(F.avg(F.abs(c) if absolute else F.col(c)).alias(name))
    parts = [
        mean(trial, "rho", "trial", True), mean(between, "rho", "between", False), mean(spread, "median", "med_block", False),
        mean(spread, "iqr", "iqr_block", False), bootstrap_intervals(settle(block_bootstrap(per_block, draws)), reference),
    ]
    d = s.withColumnRenamed("mean_abs", "cell").withColumn("ratio_to_ref", F.col("cell") / ref)
    for p in parts:
        d = d.join(p, "metric", "left")
    return d.select("metric", "cell", "trial", "between", F.col("med_block").alias("med_len"), F.col("iqr_block").alias("IQR_len"),
                    "ci_lo", "ci_hi", "pass", F.col("n_cond").alias("nCond"), "ratio_to_ref", "ratio_lo", "ratio_hi")


def heldout_parameter(rhos: DataFrame) -> DataFrame:
    """Per statistic the parameter with the best mean |rho| on the selection grid, reported on the other.

    Input (stat, param, side, rho); side is select or report.
    """
    m = rhos.groupBy("stat", "param").agg(
        F.avg(F.when(F.col("side") == "select", F.abs("rho"))).alias("chosen_on"),
        F.avg(F.when(F.col("side") == "report", F.abs("rho"))).alias("reported"))
    best = F.max_by(F.struct("param", "chosen_on", "reported"), F.struct(F.round("chosen_on", 12), F.col("param")))
    return m.groupBy("stat").agg(best.alias("b")).select("stat", F.col("b.param").alias("param"), "b.chosen_on", "b.reported")


def variants(trials: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Tag every trial with the variants it belongs to: (variant, target, ...), from one scan.

    ``rules`` maps a variant to a row filter and the name of its outcome column.
    """
    tags = F.array(*[F.when(cond, F.struct(F.lit(v).alias("variant"), F.col(t).cast("double").alias("target"))) for v, (cond, t) in rules.items()])
    return trials.select("*", F.inline(F.filter(tags, lambda s: s.isNotNull())))


def leave_one_out(long: DataFrame, group: str = "method") -> DataFrame:
    """Fisher-combined rho per condition and metric with each value of ``group`` left out in turn.

    ``long`` holds cells; the list of group values is bounded by the design and
    travels inside each row, so no join pairs cells with groups.
    """
    names = long.agg(F.array_sort(F.collect_set(group)).alias("g")).scalar()
    d = long.withColumn("left_out", F.explode(names)).where(F.col("left_out") != F.col(group))
    pb = spearman_by_block(d, ["left_out", *CB, "metric"])
    return fisher_combine(pb, ["left_out", "condition", "metric"])


def leave_one_out_range(loo: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    s = score(loo, ["metric", "left_out"], threshold)
    return s.groupBy("metric").agg(
        F.count("*").alias("left_outs"), F.min("mean_abs").alias("lowest"), F.max("mean_abs").alias("highest"),
        F.min("pass").alias("pass_min"), F.max("pass").alias("pass_max"))


def null_draws(cells: DataFrame, metrics: list[str], draws: int, seed: int = 42) -> DataFrame:
    """|rho| under three kinds of noise: (kind, metric, draw, condition, rho).

    shared: a random value per (method, block), the same in every condition;
    independent: drawn per condition; shuffled: each metric's own values dealt
    anew to the methods of a block.  The first two concern no metric and have ''
    there.  ``cells`` needs condition, block, method, y and the metrics; cells
    that lack one of them take no part.
    """
    ok = cells
    for c in [*metrics, "y"]:
        ok = ok.where(F.col(c).isNotNull())
    base = ok.withColumns({
        **{f"r_{c}": avg_rank_small(CB, c) for c in [*metrics, "y"]},
        "place": F.row_number().over(Window.partitionBy(*CB).orderBy("method")), "m": F.count("*").over(Window.partitionBy(*CB))})
    base = settle(base.select(*CB, "method", *[f"r_{c}" for c in [*metrics, "y"]], "place", "m"))
    d = base.select(*CB, "method", "r_y", "m", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    order = lambda h: F.row_number().over(Window.partitionBy(*CB, "draw").orderBy(h, "method"))
    d = d.withColumns({
        "shared": order(hash32(F.lit(seed), "draw", "block", "method")),
        "independent": order(hash32(F.lit(seed), "draw", "condition", "block", "method")),
        "deal": order(hash32(F.lit(seed), F.lit("deal"), "draw", "block", "method"))})
    d = d.join(base.select(*CB, F.col("place").alias("deal"), *[f"r_{c}" for c in metrics]), [*CB, "deal"])
    kinds = {("shared", ""): "shared", ("independent", ""): "independent"} | {("shuffled", c): f"r_{c}" for c in metrics}
    pb = d.groupBy("draw", *CB).agg(F.max("m").alias("m"), *[F.corr(c, "r_y").alias(c) for c in kinds.values()])
    one = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.col(c).alias("rho")) for (kind, metric), c in kinds.items()])
    long = pb.where(F.col("m") >= 5).select("draw", *CB, "m", F.inline(one))
    return fisher_combine(long, ["kind", "metric", "draw", "condition"])


def null_limits(nulls: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Upper quantiles of mean |rho| over draws and the largest pass count, per kind and metric."""
    by = ["kind", "metric"]
    s = score(nulls, [*by, "draw"], threshold).withColumn("mean_abs", F.round("mean_abs", 12))
    q = percentiles(s, by, "mean_abs", {"p95": 95, "p99": 99, "p999": 99.9}, small=True, rule="linear").drop("n")
    return q.join(s.groupBy(*by).agg(F.count("*").alias("draws"), F.max("mean_abs").alias("highest"), F.max("pass").alias("max_pass")), by)


def subset_stability(per_block: DataFrame, sizes: list[int], draws: int, limit: float = 0.15, seed: int = 42) -> DataFrame:
    """Spread of per-block rho over random block subsets: median over draws and share above the limit."""
    names = per_block.select("block").distinct()
    d = names.select("block", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    rank = F.row_number().over(Window.partitionBy("draw").orderBy(hash32(F.lit(seed), "draw", "block"), "block"))
    d = d.withColumn("rank", rank).withColumn("size", F.explode(F.array(*[F.lit(k).cast("bigint") for k in sizes]))).where(F.col("rank") <= F.col("size"))
    j = per_block.select(*CB, "metric", F.round("rho", 12).alias("rho")).join(d, "block")
    q = percentiles(j, ["size", "draw", "condition", "metric"], "rho", {"p25": 25, "p75": 75}, small=True)
    m = q.groupBy("size", "draw", "metric").agg(F.round(F.avg(F.col("p75") - F.col("p25")), 12).alias("iqr"))
    med = percentiles(m, ["size", "metric"], "iqr", {"median_iqr": 50}, small=True).drop("n")
    return med.join(m.groupBy("size", "metric").agg(F.avg((F.col("iqr") > limit).cast("double")).alias("p_above")), ["size", "metric"])


def band_spread(per_block: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """Mean interquartile range of per-block rho by half-open block band (lo, hi]."""
    tags = F.array(*[F.when((F.col("block") > lo) & (F.col("block") <= hi), F.lit(f"({lo},{hi}]")) for lo, hi in bands])
    d = per_block.select(*CB, "metric", F.round("rho", 12).alias("rho"), F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("band"))
    q = percentiles(d, ["band", "condition", "metric"], "rho", {"p25": 25, "p75": 75}, small=True)
    return q.groupBy("band", "metric").agg(F.max("n").alias("blocks"), F.avg(F.col("p75") - F.col("p25")).alias("iqr"))


def threshold_sweep(scores: DataFrame, least_pass: int) -> DataFrame:
    """Bands of the spread threshold within which the set of recommended metrics stays the same.

    ``scores`` has one row per metric (metric, pass, iqr); its size is the metric list.
    """
    live = scores.where(F.col("pass") >= least_pass).select("metric", F.round("iqr", 12).alias("iqr"))
    at = live.groupBy("iqr").agg(F.array_sort(F.collect_list("metric")).alias("joins"))
    w = Window.partitionBy(F.lit(0)).orderBy("iqr")
    sets = at.select("iqr", F.lead("iqr").over(w).alias("hi"),
                     F.array_sort(F.flatten(F.collect_list("joins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).alias("s"))
    bands = sets.select(F.col("iqr").alias("lo"), "hi", big(F.size("s")).alias("n"), F.array_join("s", ",").alias("recommended"))
    first = live.agg(F.min("iqr").alias("hi")).select(F.lit(0.0).alias("lo"), "hi", F.lit(0).cast("bigint").alias("n"), F.lit("").alias("recommended"))
    return first.unionByName(bands)


def status(pass_: Column, n: Column) -> Column:
    """recommended from 75 % of conditions, moderate from one, otherwise discarded."""
    return F.when(pass_ >= 0.75 * n, "recommended").when(pass_ > 0, "moderate").otherwise("discarded")


def sign_stability(combined: DataFrame) -> DataFrame:
    s = F.signum(F.round("rho", 12))
    return combined.groupBy("metric").agg(
        F.count("*").alias("n_cond"), F.min(s).alias("lo"), F.max(s).alias("hi")).select(
        "metric", "n_cond", "lo", "hi", ((F.col("lo") == F.col("hi")) & (F.col("lo") != 0)).alias("constant_sign"))


def discrimination_ratio(trials: DataFrame, metrics: list[str]) -> DataFrame:
    """Between-method variance over within-cell variance, and the trials needed to tell methods apart."""
    one = F.array(*[F.struct(F.lit(m).alias("metric"), finite(m).alias("x")) for m in metrics])
    long = trials.select(*CB, "method", "bin", F.inline(one))
    # merging partial moments leaves a trace of rounding where all values are one
    spread = lambda c: F.when((F.count(c) > 1) & (F.min(c) == F.max(c)), 0.0).otherwise(F.var_samp(c))
    cell = long.groupBy("metric", *CB, "method", "bin").agg(F.count("x").alias("n"), F.sum("x").alias("total"), spread("x").alias("v"))
    cell = settle(cell)
    within = cell.groupBy("condition", "metric").agg(F.avg("v").alias("within_var"))
    meth = cell.groupBy("condition", "metric", "block", "method").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    between = meth.groupBy("condition", "metric", "block").agg(spread("mean").alias("v")).groupBy("condition", "metric").agg(F.avg("v").alias("between_var"))
    d = between.join(within, ["condition", "metric"])
    ratio = F.when(F.col("within_var") > 0, F.col("between_var") / F.col("within_var")).when(F.col("between_var") > 0, F.lit(float("inf")))
    return d.withColumn("ratio", ratio).withColumn(
        "trials_needed", F.when(F.col("ratio") >= 1000, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.round(1 / F.greatest("ratio", F.lit(EPS)), 9)))).cast("bigint"))


def rank_stability(long: DataFrame, least_blocks: int = 4, least_methods: int = 8) -> tuple[DataFrame, DataFrame]:
    """How steady each method's rank is over blocks, and its correlation with the outcome's steadiness and level."""
    keys = [*CB, "metric"]
    ok = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys))
    r = ok.withColumns({"rx": avg_rank_small(keys, "x") / n, "ry": avg_rank_small(keys, "y") / n, "_n": n}).where(F.col("_n") >= 3)
    steady = lambda c: 1 - F.least(F.stddev_samp(c) / 0.5, F.lit(1.0))
    s = r.groupBy("condition", "metric", "method").agg(
        F.count("*").alias("blocks"), steady("rx").alias("stability"), steady("ry").alias("outcome_stability"), F.avg("y").alias("outcome"))
    s = s.where(F.col("blocks") >= least_blocks)
    k = ["condition", "metric"]
    rounded = s.withColumns({c: F.round(c, 10) for c in ("stability", "outcome_stability")})
    ranks = rounded.withColumns({f"_{c}": avg_rank_small(k, c) for c in ("stability", "outcome_stability", "outcome")})
    c = ranks.groupBy(*k).agg(
        F.count("*").alias("methods"), F.corr("_stability", "_outcome_stability").alias("with_stability"),
        F.corr("_stability", "_outcome").alias("with_outcome"), (F.min("stability") != F.max("stability")).alias("_v"))
    return s, c.where((F.col("methods") >= least_methods) & F.col("_v")).drop("_v")


def anchor_check(got: DataFrame, expected: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Recomputed against expected values; a missing row counts as a failure."""
    j = expected.select(*keys, F.col(value).alias("expected")).join(got.select(*keys, F.col(value).alias("got")), keys, "left")
    d = F.abs(F.col("got") - F.col("expected"))
    return j.withColumns({"diff": d, "ok": F.coalesce(d <= tol, F.lit(False))})


def reference_table(trials: DataFrame, cols: list[str], cell: list[str]) -> DataFrame:
    """Cell means, averaged over the cells of a condition, then over conditions; with a balance check."""
    c = trials.groupBy("condition", "method", *cell).agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in cols])
    per = c.groupBy("condition", "method").agg(F.count("*").alias("cells"), F.min("n").alias("lo"), F.max("n").alias("hi"), *[F.avg(x).alias(x) for x in cols])
    return per.groupBy("method").agg(
        F.count("*").alias("conditions"), (F.min("cells") == F.max("cells")).alias("same_cells"),
        (F.min("lo") == F.max("hi")).alias("balanced"), *[F.avg(x).alias(x) for x in cols])


def campaign_matrix(scores: DataFrame, campaigns: list[str], least_pass: int) -> DataFrame:
    """Metric by campaign: 'rho / IQR', with a mark where too few conditions pass."""
    text = F.concat(F.format_string("%.3f", F.round("mean_abs", 3)), F.when(F.col("pass") < least_pass, "*").otherwise(""), F.lit(" / "),
                    F.format_string("%.3f", F.round("iqr", 3)))
    return scores.select("metric", "campaign", text.alias("t")).groupBy("metric").pivot("campaign", campaigns).agg(F.max("t"))


def column_identity(df: DataFrame, keys: list[str], a: str, b: str, block: str, subset: Column | None = None) -> DataFrame:
    """Are two columns the same, and does the first separate methods at one block?

    Distinct values are counted at 1e-12 after rounding; the block with most
    rows (the smallest on ties) is inspected.  ``subset`` marks rows that are
    counted once more on their own.
    """
    va, vb = F.round(finite(a), 12), F.round(finite(b), 12)
    per = settle(df.groupBy(*keys, block, va.alias("va"), vb.alias("vb")).agg(F.count("*").alias("n"), F.max(F.abs(finite(a) - finite(b))).alias("d"), F.max(F.lit(True) if subset is None else subset).alias("s")))
    whole = per.groupBy(*keys).agg(F.max("d").alias("max_diff"), F.count_distinct("va").alias("n_a"), F.count_distinct("vb").alias("n_b"),
                                   *[F.count_distinct(F.when(F.col("s"), F.col(f"v{c}"))).alias(f"n_{c}_subset") for c in "ab"])
    at = per.groupBy(*keys, block).agg(F.sum("n").alias("n"), F.count_distinct("va").alias("n_a_block"), F.count_distinct("vb").alias("n_b_block"))
    top = at.groupBy(*keys).agg(F.max_by(F.struct(block, "n_a_block", "n_b_block"), F.struct(F.col("n"), -F.col(block))).alias("t"))
    d = whole.join(top, keys).select(*keys, "max_diff", "n_a", "n_b", "n_a_subset", "n_b_subset", F.col(f"t.{block}").alias("block"), "t.n_a_block", "t.n_b_block")
    return d.withColumn("verdict", F.when(F.col("max_diff") == 0, "identical").when(F.col("n_a_block") <= 1, "constant within block")
                        .when(F.col("n_a_block") > 2, "separates").otherwise("mixed"))


def within_trial_invariance(trials: DataFrame, trial: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """Spread of a metric over the methods of one trial, relative to its level, and its distinct values."""
    x = as_col(value)
    return trials.groupBy(*trial).agg(
        F.count("*").alias("methods"), (F.max(x) - F.min(x)).alias("spread"), F.avg(F.abs(x)).alias("level"),
        F.count_distinct(F.round(x, 12)).alias("distinct"),
    ).withColumn("invariant", F.col("spread") / F.greatest("level", F.lit(EPS)) < tol)




def discarded_rest(scores: DataFrame, shown: list[str]) -> DataFrame:
    """What the metrics that a campaign matrix leaves out reach at most: number, |rho| and conditions passed."""
    rest = scores.where(~F.col("metric").isin(shown))
    return rest.groupBy("campaign").agg(F.count("*").alias("metrics"), F.max("mean_abs").alias("rho_max"), F.max("pass").cast("bigint").alias("pass_max"))
