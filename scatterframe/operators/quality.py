"""Data-quality checks of an experiment table before anything is concluded from it.

A check returns its numbers and a ``ok`` flag per condition.  Blocking checks
(H0-H6) stop the campaign; advisory ones only caution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import attach, settle
from ..functions.numeric import EPS, as_col, big
from ..functions.rank import percentiles


def condition_inventory(files: DataFrame, expected: int) -> DataFrame:
    """Copies of every condition, and whether the number of conditions is as planned."""
    c = files.groupBy("condition").agg(F.count("*").alias("copies"))
    total = c.agg(F.sum("copies").alias("t")).scalar()
    return c.select("condition", "copies", total.alias("present"), ((F.col("copies") == 1) & (total == expected)).alias("ok"))


def cell_occupancy(trials: DataFrame, keys: list[str], factors: list[str], runs: int | None = None) -> DataFrame:
    """Every combination of the factors present with the same number of replicates."""
    cells = settle(trials.groupBy(*keys, *factors).agg(F.count("*").alias("n")))
    want = F.lit(runs) if runs is not None else F.max("n")
    s = cells.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.min("n").alias("fewest"), F.max("n").alias("most"), big(want).alias("runs"),
        *[F.count_distinct(f).alias(f"n_{f}") for f in factors])
    full = F.lit(1).cast("bigint")
    for f in factors:
        full = full * F.col(f"n_{f}")
    s = s.select(*keys, "cells", full.alias("expected"), "fewest", "most", "runs")
    if runs is None:
        bad = attach(cells, s.select(*keys, "runs"), keys).groupBy(*keys).agg(F.sum((F.col("n") != F.col("runs")).cast("bigint")).alias("off_count"))
    else:
        bad = cells.groupBy(*keys).agg(F.sum((F.col("n") != runs).cast("bigint")).alias("off_count"))
    s = s.join(bad, keys)
    return s.select(*keys, "cells", "expected", (F.col("expected") - F.col("cells")).alias("missing"), "fewest", "most", "off_count",
                    ((F.col("expected") == F.col("cells")) & (F.col("off_count") == 0)).alias("ok"))


def pairing(trials: DataFrame, keys: list[str], trial: list[str], same: list[str]) -> DataFrame:
    """Every method meets the same trial: one row per method, one value of each shared column."""
    methods = trials.groupBy(*keys).agg(F.count_distinct("method").alias("n_methods"))
    t = trials.groupBy(*keys, *trial).agg(
        F.count("*").alias("rows"), F.count_distinct("method").alias("m"),
        *[(F.min(c) != F.max(c)).cast("bigint").alias(f"diff_{c}") for c in same])
    j = attach(t, methods, keys)
    whole = (F.col("rows") == F.col("n_methods")) & (F.col("m") == F.col("n_methods"))
    s = j.groupBy(*keys).agg(
        F.max("n_methods").alias("methods"), F.count("*").alias("trials"), F.sum((~whole).cast("bigint")).alias("incomplete"),
        *[F.sum(f"diff_{c}").alias(f"diff_{c}") for c in same])
    ok = F.col("incomplete") == 0
    for c in same:
        ok = ok & (F.col(f"diff_{c}") == 0)
    return s.withColumn("ok", ok)


def length_resolution(trials: DataFrame, keys: list[str], length: str, intended: int | None) -> DataFrame:
    """Distinct lengths against the design; without a design nothing can be claimed."""
    s = trials.groupBy(*keys).agg(F.count_distinct(length).alias("lengths"))
    want = F.lit(intended).cast("bigint")
    return s.select(*keys, "lengths", want.alias("intended"), F.coalesce(F.col("lengths") >= want, F.lit(False)).alias("ok"))


def field_integrity(trials: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """NULL or NaN and infinite values per field."""
    one = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    x = F.col("x")
    s = trials.select(*keys, F.inline(one)).groupBy(*keys, "field").agg(
        F.count("*").alias("n"), F.sum((x.isNull() | F.isnan(x)).cast("bigint")).alias("n_nan"),
        F.sum(F.coalesce((F.abs(x) == float("inf")), F.lit(False)).cast("bigint")).alias("n_inf"))
    return s.withColumn("ok", (F.col("n_nan") == 0) & (F.col("n_inf") == 0))


def kpi_reconstruction(trials: DataFrame, keys: list[str], w1: float = 0.5, tol: float = 1e-9, rel: float = 1e-8) -> DataFrame:
    """Is stored CR reproduced, and on which set of methods is stored RES standardised?

    RES must be affine in CR and BE; its coefficients then reveal the scale.
    Candidate scales leave out no, one or two methods; their moments come from
    per-method sums, so the trials are not read again.  Needs cr, cr_again, be,
    res and method.
    """
    c, b, r = F.col("cr"), F.col("be"), F.col("res")
    fit = trials.groupBy(*keys).agg(
        F.max(F.abs(F.col("cr") - F.col("cr_again"))).alias("err_cr"), F.avg(c).alias("mc"), F.avg(b).alias("mb"), F.avg(r).alias("mr"),
        F.var_samp(c).alias("cc"), F.var_samp(b).alias("bb"), F.covar_samp("cr", "be").alias("cb"),
        F.covar_samp("cr", "res").alias("cr_"), F.covar_samp("be", "res").alias("br_"))
    det = F.col("cc") * F.col("bb") - F.col("cb") * F.col("cb")
    fit = fit.withColumns({"a1": (F.col("cr_") * F.col("bb") - F.col("br_") * F.col("cb")) / det,
                           "a2": (F.col("br_") * F.col("cc") - F.col("cr_") * F.col("cb")) / det})
    fit = settle(fit.withColumn("a0", F.col("mr") - F.col("a1") * F.col("mc") - F.col("a2") * F.col("mb")))
    resid = attach(trials.select(*keys, "cr", "be", "res"), fit.select(*keys, "a0", "a1", "a2"), keys).groupBy(*keys).agg(
        F.max(F.abs(r - F.col("a0") - F.col("a1") * c - F.col("a2") * b)).alias("err_fit"))
    per = trials.groupBy(*keys, "method").agg(
        F.count("*").cast("double").alias("n"), F.sum(c).alias("s1"), F.sum(c * c).alias("q1"), F.sum(b).alias("s2"), F.sum(b * b).alias("q2"))
    sums = ["n", "s1", "q1", "s2", "q2"]
    arr = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("method", *sums))).alias("ms"), *[F.sum(x).alias(f"t_{x}") for x in sums])
    # The methods of a condition are few: candidates are index pairs of one small array.
    k = F.size("ms")
    zero = F.lit(0)
    picks = F.concat(
        F.array(F.struct(zero.alias("i"), zero.alias("j"))),
        F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(i.alias("i"), zero.alias("j"))),
        F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: F.transform(
            F.filter(F.sequence(F.lit(1), k), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    cand = arr.select("*", F.posexplode(picks).alias("rank", "p"))
    part = lambda x: (F.col(f"t_{x}") - F.when(F.col("p.i") > 0, F.get("ms", F.col("p.i") - 1)[x]).otherwise(0.0)
                      - F.when(F.col("p.j") > 0, F.get("ms", F.col("p.j") - 1)[x]).otherwise(0.0))
    name = lambda i: F.when(F.col(f"p.{i}") > 0, F.get("ms", F.col(f"p.{i}") - 1)["method"])
    cand = cand.select(*keys, "rank", F.concat_ws(",", name("i"), name("j")).alias("left_out"), *[part(x).alias(x) for x in sums])
    n = F.col("n")
    cand = cand.where(n >= 2).withColumns({"mu1": F.col("s1") / n, "mu2": F.col("s2") / n}).withColumns({
        "v1": (F.col("q1") - n * F.col("mu1") * F.col("mu1")) / (n - 1), "v2": (F.col("q2") - n * F.col("mu2") * F.col("mu2")) / (n - 1)})
    cand = cand.where((F.col("v1") > 0) & (F.col("v2") > 0)).join(fit.select(*keys, "a0", "a1", "a2"), keys)
    b1, b2 = w1 / F.sqrt("v1"), (1 - w1) / F.sqrt("v2")
    b0 = -(b1 * F.col("mu1") + b2 * F.col("mu2"))
    off = F.greatest(*[F.abs(x - F.col(a)) / (F.abs(F.col(a)) + EPS) for x, a in ((b1, "a1"), (b2, "a2"), (b0, "a0"))])
    hit = cand.where(off < rel).groupBy(*keys).agg(F.min_by(F.struct("left_out", "mu1", "mu2", "v1", "v2"), "rank").alias("h"))
    found = hit.select(*keys, "h.*")
    rebuilt = attach(trials.select(*keys, "cr", "be", "res"), found, keys)
    err = F.max(F.abs(w1 * (c - F.col("mu1")) / (F.sqrt("v1") + EPS) + (1 - w1) * (b - F.col("mu2")) / (F.sqrt("v2") + EPS) - r))
    err_res = rebuilt.groupBy(*keys).agg(err.alias("err_res"), F.max("left_out").alias("left_out"))
    d = fit.select(*keys, "err_cr").join(resid, keys).join(err_res, keys, "left")
    return d.select(*keys, "err_cr", "err_fit", "err_res", "left_out",
                    F.coalesce((F.col("err_cr") < tol) & (F.col("err_fit") < tol) & (F.col("err_res") < tol), F.lit(False)).alias("ok"))


def method_field(trials: DataFrame, keys: list[str]) -> DataFrame:
    s = trials.groupBy(*keys).agg(F.array_sort(F.collect_set("method")).alias("m"))
    return s.select(*keys, big(F.size("m")).alias("n_methods"), F.array_join("m", ",").alias("methods"))


def noise_fairness(trials: DataFrame, keys: list[str], trial: list[str], actual: str, length: str) -> DataFrame:
    """Implied error count constant over the methods of a trial; how far the densities differ."""
    e = F.col(actual) * F.col(length)
    t = trials.groupBy(*keys, *trial).agg(
        F.min(e).alias("lo"), F.max(e).alias("hi"), F.round(F.avg(e)).alias("m"),
        ((F.max(actual) - F.min(actual)) / (F.avg(actual) + EPS)).alias("spread"))
    t = t.select(*keys, F.greatest(F.abs(F.col("lo") - F.col("m")), F.abs(F.col("hi") - F.col("m"))).alias("dev"), F.round("spread", 12).alias("spread"))
    t = settle(t)
    s = t.groupBy(*keys).agg(F.count("*").alias("trials"), F.max("dev").alias("worst_count"), F.max("spread").alias("max_spread"))
    med = percentiles(t, keys, "spread", {"median_spread": 50}).drop("n")
    return s.join(med, keys).withColumn("flag", F.col("worst_count") > 0.5)


def variance_ratio(trials: DataFrame, keys: list[str], cell: list[str], value: str, limit: float = 4.0) -> DataFrame:
    """Largest over smallest mean within-cell variance among methods."""
    v = trials.groupBy(*keys, "method", *cell).agg(F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    m = v.groupBy(*keys, "method").agg(F.avg("v").alias("v")).where(F.col("v") > 0)
    s = m.groupBy(*keys).agg(F.max_by("method", F.struct("v", "method")).alias("widest"), F.min_by("method", F.struct("v", "method")).alias("narrowest"),
                             (F.max("v") / F.greatest(F.min("v"), F.lit(EPS))).alias("ratio"))
    return s.withColumn("flag", F.col("ratio") > limit)


def outliers(trials: DataFrame, keys: list[str], cell: list[str], value: str, limit_pct: float = 2.0, least: int = 10) -> DataFrame:
    """Share of trials outside the 1.5 IQR fences of their own cell; not reported when a cell is smaller than ``least``."""
    ck = [*keys, *cell]
    q = percentiles(trials, ck, value, {"q1": 25, "q3": 75})
    j = attach(trials.select(*ck, as_col(value).alias("v")), q, ck)
    iq = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("v") < F.col("q1") - iq) | (F.col("v") > F.col("q3") + iq)
    s = j.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("n").alias("smallest"), F.sum(out.cast("bigint")).alias("out"))
    enough = F.col("smallest") >= least
    pct = F.when(enough, 100.0 * F.col("out") / F.col("rows"))
    return s.select(*keys, "rows", "smallest", F.when(enough, F.col("out")).alias("outside"), pct.alias("pct"), F.coalesce(pct > limit_pct, F.lit(False)).alias("flag"))


def block_count(trials: DataFrame, keys: list[str], block: str, least: int = 20) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count_distinct(block).alias("blocks")).withColumn("flag", F.col("blocks") < least)


def residual_shape(trials: DataFrame, keys: list[str], cell: list[str], value: str) -> DataFrame:
    """Skewness and kurtosis of residuals from cell means.

    Central moments of the cells are merged, so residuals are never formed.  The
    scale is the sample deviation (n - 1), as in the check being reproduced.
    """
    v = F.col(value)
    c = trials.groupBy(*keys, *cell).agg(F.count("*").alias("n"), F.var_pop(v).alias("m2"), F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku"))
    n, m2 = F.col("n"), F.col("m2")
    some = m2 > 0
    s = c.groupBy(*keys).agg(
        F.sum(n).alias("N"), F.sum(n * m2).alias("s2"), F.sum(F.when(some, n * F.col("sk") * m2 * F.sqrt(m2)).otherwise(0.0)).alias("s3"),
        F.sum(F.when(some, n * (F.col("ku") + 3) * m2 * m2).otherwise(0.0)).alias("s4"))
    sd = F.sqrt(F.col("s2") / (F.col("N") - 1))
    return s.select(*keys, F.col("N").alias("n"), (F.col("s3") / F.col("N") / F.pow(sd, 3)).alias("skewness"), (F.col("s4") / F.col("N") / F.pow(sd, 4)).alias("kurtosis"))


def verdict(checks: DataFrame) -> DataFrame:
    """(check, condition, blocking, ok) to one verdict per condition."""
    s = checks.groupBy("condition").agg(
        F.count("*").alias("checks"), F.sum((F.col("blocking") & ~F.col("ok")).cast("bigint")).alias("failed"),
        F.sum((~F.col("blocking") & ~F.col("ok")).cast("bigint")).alias("cautions"))
    v = F.when(F.col("failed") > 0, "NOT QUOTABLE").when(F.col("cautions") > 0, "QUOTABLE WITH CAVEATS").otherwise("QUOTABLE")
    return s.withColumn("verdict", v)


def length_coverage(trials: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Lengths each method covers and lacks against the lengths any method of its group saw."""
    seen = trials.groupBy(*keys, "method", length).agg(F.count("*").alias("n"))
    total = trials.groupBy(*keys).agg(F.count_distinct(length).alias("total"))
    s = seen.groupBy(*keys, "method").agg(F.count("*").alias("lengths"), F.sum("n").alias("rows"))
    d = attach(s, total, keys)
    return d.select(*keys, "method", "lengths", "rows", (F.col("total") - F.col("lengths")).alias("lacking"), (F.col("total") == F.col("lengths")).alias("complete"))


def missing_lengths(trials: DataFrame, expected: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Expected (method, length) cells without a trial.  ``expected`` is (keys, method, length)."""
    return expected.join(trials.select(*keys, "method", length).distinct(), [*keys, "method", length], "left_anti")


# Declared thresholds of the method screen.
SCREEN = {"confined": 0.25, "censored": 0.20, "over": 0.50, "fixed": 0.50}


def method_screen(kpi: DataFrame, structure: DataFrame, w1: float = 0.5, limits: dict[str, float] | None = None) -> DataFrame:
    """Flags per method from its KPI parts and its permutation.

    ``kpi``: method, res, cr_z, be_z, zero_share; ``structure``: method,
    widest_share, reach, fixed_share, over_share, max_load.
    """
    t = {**SCREEN, **(limits or {})}
    d = kpi.join(structure, "method", "left").withColumns({"cr_part": w1 * F.col("cr_z"), "be_part": (1 - w1) * F.col("be_z")})
    wide = F.col("widest_share")
    flags = {
        "CONFINED": wide < t["confined"], "CENSORED": F.col("zero_share") > t["censored"],
        "RATE-LIMITED": (F.col("res") < 0) & (F.round("be_part", 12) < 0) & (F.abs(F.round("be_part", 12)) > F.abs(F.round("cr_part", 12))),
        "CAPACITY-EXCEEDED": (F.col("over_share") > t["over"]) & (wide >= t["confined"]), "DEGENERATE": F.col("fixed_share") > t["fixed"]}
    text = F.concat_ws(" + ", *[F.when(c, F.lit(n)) for n, c in flags.items()])
    v = F.when(wide.isNull(), "not screened").when(text == "", "in scope").otherwise(text)
    return d.withColumn("screen", v)


