"""Composite KPIs of trials: recovery, efficiency, their z-scores and what follows from them.

Standardisation is per condition.  Per-condition constants are aggregated once,
size-checked and broadcast (``with_totals``); no window ever holds a condition.
Tables with one row per method are bounded, so ranks over them use windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import attach, settle, with_totals
from ..functions.numeric import EPS, as_col, big, finite
from ..functions.rank import avg_rank_small


def kpi_core(df: DataFrame) -> DataFrame:
    """be, cr_raw, c_nn, cr and effectiveness from lengths, densities and error rates."""
    be = F.col("enc_len") / F.col("int_len")
    raw = F.greatest(F.lit(0.0), 1 - F.col("err") / (F.col("err_base") + EPS))
    c_nn = F.col("actual") / (F.col("target") + EPS)
    return df.withColumns({"be": be, "cr_raw": raw, "c_nn": c_nn, "cr": raw * c_nn, "effectiveness": raw * c_nn * be})


def zscore(df: DataFrame, keys: list[str], cols: list[str], scope: Column | None = None, eps: float = EPS) -> DataFrame:
    """Add <col>_z; mean and deviation come from the rows in ``scope`` (all rows by default)."""
    pick = lambda c: F.col(c) if scope is None else F.when(scope, F.col(c))
    aggs = [f(pick(c)).alias(f"_{n}_{c}") for c in cols for n, f in (("mu", F.avg), ("sd", F.stddev_samp))]
    out = with_totals(df, keys, *aggs)
    out = out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + eps) for c in cols})
    return out.drop(*[f"_{n}_{c}" for c in cols for n in ("mu", "sd")])


def normal_weights(w1: float, w2: float | None = None) -> tuple[float, float]:
    return (w1, w2) if w2 is not None and abs(w1 + w2 - 1) < 1e-12 else (w1, 1 - w1)


def res_composite(df: DataFrame, w1: float = 0.5, w2: float | None = None) -> DataFrame:
    a, b = normal_weights(w1, w2)
    return df.withColumn("res", a * F.col("cr_z") + b * F.col("be_z"))


def method_filter(df: DataFrame, methods: DataFrame, keep: bool = True) -> DataFrame:
    """Keep or drop the named methods, before anything is standardised."""
    return attach(df, methods.select("method").distinct(), "method", "left_semi" if keep else "left_anti")


def moments(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """n, mean and sample variance per group; small, and mergeable by ``merged``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_samp))])


def merged(cells: DataFrame, keys: list[str], cols: list[str]) -> list[Column]:
    """Mean and deviation of all rows of ``keys`` rebuilt from per-cell moments."""
    w = Window.partitionBy(*keys)
    out = []
    for c in cols:
        n = F.sum("n").over(w)
        mu = F.sum(F.col("n") * F.col(f"m_{c}")).over(w) / n
        inner = F.sum((F.col("n") - 1) * F.coalesce(F.col(f"v_{c}"), F.lit(0.0))).over(w)
        square = F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")).over(w) - n * mu * mu
        out += [mu.alias(f"mu_{c}"), F.sqrt((inner + square) / (n - 1)).alias(f"sd_{c}")]
    return out


KPI = ["cr", "be", "effectiveness"]


def kpi_summary(core: DataFrame, keys: list[str], w1: float = 0.5) -> DataFrame:
    """Per-method means with z-scored means and RES, from one scan of the trials."""
    cells = moments(core, [*keys, "method"], KPI)
    s = cells.select("*", *merged(cells, keys, ["cr", "be"]))
    s = s.withColumns({f"{c}_z": (F.col(f"m_{c}") - F.col(f"mu_{c}")) / (F.col(f"sd_{c}") + EPS) for c in ("cr", "be")})
    return s.select(*keys, "method", "n", *[F.col(f"m_{c}").alias(c) for c in KPI], "cr_z", "be_z",
                    (w1 * F.col("cr_z") + (1 - w1) * F.col("be_z")).alias("res"))


def weight_scenarios(summary: DataFrame, keys: list[str], step: float = 0.05, lo: float = 0.10, hi: float = 0.90) -> DataFrame:
    """RES and both contributions over a grid of weights."""
    n = round((hi - lo) / step)
    grid = F.array(*[F.lit(round(lo + i * step, 10)) for i in range(n + 1)])
    d = summary.select(*keys, "method", "cr_z", "be_z", F.explode(grid).alias("w"))
    return d.select(*keys, "method", "w", (F.col("w") * F.col("cr_z")).alias("cr_part"),
                    ((1 - F.col("w")) * F.col("be_z")).alias("be_part"),
                    (F.col("w") * F.col("cr_z") + (1 - F.col("w")) * F.col("be_z")).alias("res"))


def kpi_by(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("cr", "be", "effectiveness", "res")])


def rank_desc(keys: list[str], value, tie: str = "method") -> Column:
    """Rank of methods by a mean rounded to 9 decimals, the name deciding ties."""
    return big(F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(as_col(value), 9).desc(), tie)))


def res_decomposition(summary: DataFrame, keys: list[str], w1: float = 0.5) -> DataFrame:
    a, b = w1 * F.col("cr_z"), (1 - w1) * F.col("be_z")
    d = summary.select(*keys, "method", "res", a.alias("cr_part"), b.alias("be_part"))
    d = d.withColumns({"rank_res": rank_desc(keys, "res"), "rank_cr": rank_desc(keys, "cr_part")})
    total = F.abs("cr_part") + F.abs("be_part")
    return d.select(
        *keys, "method", "res", "cr_part", "be_part", "rank_res", "rank_cr", (F.col("rank_res") - F.col("rank_cr")).alias("moved"),
        (F.abs("be_part") / F.greatest(total, F.lit(EPS))).alias("rate_share"),
        (F.abs(F.col("res") - F.col("cr_part") - F.col("be_part")) <= 1e-9).alias("adds_up"))


def rank_moves(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Ranks of every method before and after, its shift, and the largest shift of its group."""
    d = pairs.select(*keys, "method", F.col(before).alias("before"), F.col(after).alias("after"))
    d = d.withColumns({"rank_before": rank_desc(keys, "before"), "rank_after": rank_desc(keys, "after")})
    return d.withColumns({"moved": F.col("rank_before") != F.col("rank_after"),
                          "max_shift": F.max(F.abs(F.col("after") - F.col("before"))).over(Window.partitionBy(*keys))})


def kappa() -> Column:
    """Realised over target density on the transmitted frame."""
    return F.col("actual") * F.col("int_len") / (F.col("enc_len") * F.col("target"))


def kappa_by_bin(df: DataFrame, keys: list[str]) -> DataFrame:
    plain = F.col("int_len") == F.col("enc_len")
    return df.groupBy(*keys, "bin").agg(F.count(F.when(plain, 1)).alias("n"), F.avg(F.when(plain, kappa())).alias("kappa"))


def kappa_free(core: DataFrame, keys: list[str], scope: Column, w1: float = 0.5) -> DataFrame:
    """Trials with RES as stored and as rebuilt from CR / kappa, both on the in-scope scale."""
    k = kappa()
    d = core.withColumn("cr_free", F.when(k > 0, F.col("cr") / k).otherwise(F.col("cr")))
    d = zscore(d, keys, ["cr", "be", "cr_free"], scope)
    return d.withColumns({"res": w1 * F.col("cr_z") + (1 - w1) * F.col("be_z"),
                          "res_free": w1 * F.col("cr_free_z") + (1 - w1) * F.col("be_z")})


def fit_weights(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of RES on (CR_z, BE_z) by its normal equations, and the largest residual."""
    a, b, y = F.col("cr_z"), F.col("be_z"), F.col("res")
    s = scored.groupBy(*keys).agg(
        F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * y).alias("ay"), F.sum(b * y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    w = s.select(*keys, ((F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det).alias("w1"),
                 ((F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det).alias("w2"))
    r = attach(scored, w, keys)
    return r.groupBy(*keys).agg(F.max("w1").alias("w1"), F.max("w2").alias("w2"),
                                F.max(F.abs(y - F.col("w1") * a - F.col("w2") * b)).alias("max_residual"))


def affine_groupings(scored: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Largest residual of z = a*x + b fitted per group, for each candidate grouping.

    One pass fits all candidates as grouping sets, a second takes all residuals.
    """
    cols = list(dict.fromkeys(k for keys in candidates.values() for k in keys))
    number = {name: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keys) for name, keys in candidates.items()}
    sets = {number[name]: keys for name, keys in candidates.items()}
    fits = settle(scored.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *[F.col(c) for c in cols]).agg(
        F.grouping_id(*cols).alias("_set"), F.regr_slope("cr_z", "cr").alias("a"), F.regr_intercept("cr_z", "cr").alias("b")))
    r = scored.select(*cols, "cr", "cr_z")
    for i, keys in sets.items():
        r = attach(r, fits.where(F.col("_set") == i).select(*keys, F.col("a").alias(f"a{i}"), F.col("b").alias(f"b{i}")), keys)
    worst = [F.max(F.abs(F.col("cr_z") - F.col(f"a{i}") * F.col("cr") - F.col(f"b{i}"))).alias(f"w{i}") for i in sets]
    one = r.agg(F.greatest(F.lit(1.0), F.max(F.abs("cr_z"))).alias("scale"), *worst)
    rows = F.array(*[F.struct(F.lit(name).alias("grouping"), F.col(f"w{i}").alias("worst")) for name, i in number.items()])
    return one.select("scale", F.inline(rows)).select("grouping", "worst", (F.col("worst") < 1e-6 * F.col("scale")).alias("affine"))


def population_fit(scored: DataFrame, keys: list[str], scope: Column, cell: list[str]) -> DataFrame:
    """Largest error of rebuilt z-scores for each candidate population behind the scale."""
    d = scored.withColumn("_in", scope)
    rows_in = F.when(F.col("_in"), F.col("cr"))
    stats = d.groupBy(*keys).agg(
        F.avg(rows_in).alias("mi"), F.stddev_samp(rows_in).alias("si"), F.stddev_pop(rows_in).alias("pi"),
        F.avg("cr").alias("ma"), F.stddev_samp("cr").alias("sa"), F.stddev_pop("cr").alias("pa"))
    cells = d.groupBy(*cell).agg(F.avg("cr").alias("v"), F.max("_in").alias("in"))
    cin = F.when(F.col("in"), F.col("v"))
    cstats = cells.groupBy(*keys).agg(F.avg(cin).alias("mci"), F.stddev_samp(cin).alias("sci"),
                                      F.avg("v").alias("mca"), F.stddev_samp("v").alias("sca"))
    r = attach(d.select(*keys, "cr", "cr_z"), stats.join(cstats, keys), keys)
    names = {"rows in scope, n-1": ("mi", "si"), "rows in scope, n": ("mi", "pi"), "all rows, n-1": ("ma", "sa"),
             "all rows, n": ("ma", "pa"), "cells in scope, n-1": ("mci", "sci"), "cells all, n-1": ("mca", "sca")}
    err = F.array(*[F.struct(F.lit(n).alias("population"), F.col(f"e{i}").alias("worst")) for i, n in enumerate(names)])
    one = r.groupBy(*keys).agg(*[
        F.max(F.abs((F.col("cr") - F.col(m)) / F.col(s) - F.col("cr_z"))).alias(f"e{i}") for i, (m, s) in enumerate(names.values())])
    return one.select(*keys, F.inline(err))


def bandwidth_extension(df: DataFrame, keys: list[str]) -> DataFrame:
    """Worst length ratio per method and the smallest length at which it occurs."""
    b = df.groupBy(*keys, "method").agg(F.min(F.struct((F.col("enc_len") / F.col("int_len")).alias("be"), "enc_len", "int_len")).alias("b"))
    return b.select(*keys, "method", "b.be", "b.enc_len", "b.int_len")


def density_ratio(df: DataFrame, keys: list[str], is_reference: Column) -> DataFrame:
    """Realised density of each (method, length) over reference rows of the same length."""
    cells = df.groupBy(*keys, "enc_len", "method").agg(
        F.count("*").alias("n"), F.avg(F.col("enc_len") / F.col("int_len")).alias("be"),
        F.avg("actual").alias("density"), F.avg(F.col("actual") / F.col("target")).alias("over_target"))
    ref = df.where(is_reference).groupBy(*keys, "enc_len").agg(F.avg("actual").alias("ref_density"))
    return cells.join(ref, [*keys, "enc_len"]).withColumn("ratio", F.try_divide("density", "ref_density")).withColumn(
        "residual", F.abs(F.col("ratio") - F.col("be")))


def efficiency_tradeoff(per_method: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """(RES - min RES) / runtime, scaled to [0, 1] inside each group of methods."""
    w = Window.partitionBy(*keys)
    d = per_method.withColumn("efficiency", (F.col("res") - F.min("res").over(w)) / (F.col("runtime") + eps))
    lo, hi = F.min("efficiency").over(w), F.max("efficiency").over(w)
    return d.withColumn("norm", F.when(hi > lo, (F.col("efficiency") - lo) / (hi - lo)).otherwise(F.lit(1.0)))


def minmax_normalize(per_method: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Each metric of a method profile scaled to [0, 1], 0.5 where it is constant."""
    w = Window.partitionBy(*keys)

    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.5))

    return per_method.withColumns({c: scaled(c) for c in metrics})


def top_correlated(corr: DataFrame, keys: list[str], k: int = 6, floor: float = 0.15) -> DataFrame:
    """Strongest k metrics whose |r| exceeds the floor, per group of a correlation table."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.round("r", 9)).desc(), "metric")
    return corr.where(F.abs("r") > floor).withColumn("rank", big(F.row_number().over(w))).where(F.col("rank") <= k)


def runtime_mean(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(col).alias("n"), (F.sum(col) / F.count(col)).alias("runtime"))


def metric_mean_finite(df: DataFrame, keys: list[str], metrics: dict[str, Column], higher_is_better: dict[str, bool]) -> DataFrame:
    """Means over finite values only, ranked so that 1 is best for each metric's polarity."""
    s = df.groupBy(*keys).agg(*[F.avg(finite(c)).alias(m) for m, c in metrics.items()])
    long = s.unpivot(keys, list(metrics), "metric", "mean")
    sign = F.element_at(F.create_map(*[x for m, h in higher_is_better.items() for x in (F.lit(m), F.lit(-1.0 if h else 1.0))]), F.col("metric"))
    w = Window.partitionBy("metric").orderBy(F.round(sign * F.col("mean"), 9), *keys)
    return long.withColumn("rank", big(F.row_number().over(w)))


def noise_discretize(df: DataFrame, value, levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``noise_cat``: the number of the nearest level of the row's key, by midpoints; a midpoint goes to the higher level.

    ``levels`` is (keys, level).  Between the lowest and the highest midpoint of a
    key the line is cut into four buckets a level; an interval meets the values
    of the buckets that it touches.  NULL values and keys without levels get NULL.
    """
    by = keys or ["_g"]
    if not keys:
        df, levels = df.withColumn("_g", F.lit(0)), levels.withColumn("_g", F.lit(0))
    w = Window.partitionBy(*by).orderBy("level")
    before = F.lag("level").over(w)
    d = levels.select(*by, F.col("level").cast("double").alias("level")).where(F.col("level").isNotNull()).distinct()
    d = d.select(*by, big(F.row_number().over(w)).alias("noise_cat"), (before + (F.col("level") - before) / 2).alias("_lo"))
    d = d.withColumn("_hi", F.lead("_lo").over(Window.partitionBy(*by).orderBy("noise_cat")))
    shape = d.groupBy(*by).agg(F.min("_lo").alias("_first"), (4.0 * F.count("*")).alias("_cuts"), (F.max("_lo") - F.min("_lo")).alias("_range"))

    def bucket(v):
        width = F.when(F.col("_range") > 0, F.col("_range") / F.col("_cuts")).otherwise(1.0)
        place = F.floor(F.least((v - F.col("_first")) / width, F.col("_cuts"))) + 1
        return F.when(F.col("_first").isNull(), 0).otherwise(F.greatest(F.lit(0), place)).cast("bigint")

    ends = F.sequence(F.when(F.col("_lo").isNull(), F.lit(0).cast("bigint")).otherwise(bucket(F.col("_lo"))),
                      F.when(F.col("_hi").isNull(), big(F.col("_cuts")) + 1).otherwise(bucket(F.col("_hi"))))
    intervals = attach(d, shape, by).select(*by, "noise_cat", "_lo", "_hi", F.explode(ends).alias("_bucket"))
    v = as_col(value).cast("double")
    rows = attach(df, shape, by, "left").withColumn("_bucket", F.when(v.isNotNull() & F.col("_cuts").isNotNull(), bucket(v)))
    met = attach(rows, intervals, [*by, "_bucket"], "left")
    inside = (F.col("_lo").isNull() | (v >= F.col("_lo"))) & (F.col("_hi").isNull() | (v < F.col("_hi")))
    return met.where(F.col("noise_cat").isNull() | inside).drop("_first", "_cuts", "_range", "_bucket", "_lo", "_hi", *([] if keys else ["_g"]))


def kappa_rank_agreement(free: DataFrame, keys: list[str], block: str, least: int = 3) -> DataFrame:
    """Spearman per block of the methods' mean RES as stored and as rebuilt: least and median over blocks."""
    c = free.groupBy(*keys, block, "method").agg(F.round(F.avg("res"), 12).alias("a"), F.round(F.avg("res_free"), 12).alias("b"))
    r = c.select(*keys, block, avg_rank_small([*keys, block], "a").alias("a"), avg_rank_small([*keys, block], "b").alias("b"))
    per = r.groupBy(*keys, block).agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho")).where(F.col("n") >= least)
    return per.groupBy(*keys).agg(F.count("*").alias("blocks"), F.min("rho").alias("rho_min"), F.median("rho").alias("rho_median"))
