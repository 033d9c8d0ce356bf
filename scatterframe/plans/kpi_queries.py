"""K1-K25 over line items as trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import kpi as kp
from ..sources.tables import SQL_KPI_IN, SQL_OBS, kpi_in, obs
from .registry import register

OUT = ["Brand#1", "Brand#2", "Brand#3"]
IN_SQL = "method NOT IN ('Brand#1', 'Brand#2', 'Brand#3')"
E = "2.220446049250313e-16::DOUBLE"

SQL_CORE = f"""{SQL_KPI_IN}, c0 AS (SELECT *, enc_len / int_len AS be, greatest(0, 1 - err / (err_base + {E})) AS cr_raw,
  actual / (target + {E}) AS c_nn FROM kpi_in), core AS (SELECT *, cr_raw * c_nn AS cr, cr_raw * c_nn * be AS effectiveness FROM c0)"""


def sql_z(scope: str = "true", src: str = "core", name: str = "z", cols=("cr", "be")) -> str:
    agg = ", ".join(f"avg({c}) FILTER ({scope}) AS mu_{c}, stddev_samp({c}) FILTER ({scope}) AS sd_{c}" for c in cols)
    z = ", ".join(f"({c} - mu_{c}) / (sd_{c} + {E}) AS {c}_z" for c in cols)
    return f"mm_{name} AS (SELECT condition, {agg} FROM {src} GROUP BY condition), {name} AS (SELECT {src}.*, {z} FROM {src} JOIN mm_{name} USING (condition))"


SQL_Z = f"{SQL_CORE}, {sql_z()}, s AS (SELECT *, 0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z AS res FROM z)"
SQL_ZS = f"{SQL_CORE}, {sql_z(IN_SQL)}, s AS (SELECT *, 0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z AS res FROM z)"
SQL_SUM = f"""{SQL_Z}, su AS (SELECT condition, method, count(*) AS n, avg(cr) AS cr, avg(be) AS be, avg(effectiveness) AS effectiveness,
  avg(cr_z) AS cr_z, avg(be_z) AS be_z, avg(res) AS res FROM s GROUP BY ALL)"""


def core(spark, sf):
    return kp.kpi_core(kpi_in(spark, sf))


def in_scope():
    return ~F.col("method").isin(OUT)


def scored(spark, sf, scope=None):
    return kp.res_composite(kp.zscore(core(spark, sf), ["condition"], ["cr", "be"], scope))


def summary(spark, sf):
    return kp.kpi_summary(core(spark, sf), ["condition"])


def R(*cols, d=9):
    return [rnd(c, d).alias(c) for c in cols]


def rs(*cols, d=9):
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols)


@register("K1_kpi_core", f"WITH {SQL_CORE} SELECT condition, method, bin, {rs('be', 'cr_raw', 'c_nn', 'cr', 'effectiveness')} FROM core")
def k1(spark, sf):
    return core(spark, sf).select("condition", "method", "bin", *R("be", "cr_raw", "c_nn", "cr", "effectiveness"))


@register("K2_zscore_all", f"WITH {SQL_Z} SELECT condition, method, bin, {rs('cr_z', 'be_z', d=8)} FROM s")
def k2(spark, sf):
    return scored(spark, sf).select("condition", "method", "bin", *R("cr_z", "be_z", d=8))


@register("K3_zscore_in_scope", f"WITH {SQL_ZS} SELECT condition, method, bin, {rs('cr_z', 'be_z', d=8)} FROM s")
def k3(spark, sf):
    return scored(spark, sf, in_scope()).select("condition", "method", "bin", *R("cr_z", "be_z", d=8))


@register("K4_res_composite", f"WITH {SQL_Z} SELECT condition, method, bin, round(0.8::DOUBLE * cr_z + 0.2::DOUBLE * be_z, 8) AS res FROM s")
def k4(spark, sf):
    z = kp.zscore(core(spark, sf), ["condition"], ["cr", "be"])
    return kp.res_composite(z, 0.8, 0.5).select("condition", "method", "bin", *R("res", d=8))


SUMS = ["cr", "be", "effectiveness", "cr_z", "be_z", "res"]


@register("K5_kpi_summary", f"WITH {SQL_SUM} SELECT condition, method, n, {rs(*SUMS, d=8)} FROM su")
def k5(spark, sf):
    s = summary(spark, sf).orderBy("condition", F.col("res").desc())
    return s.select("condition", "method", "n", *R(*SUMS, d=8))


@register("K6_method_filter", f"""WITH {SQL_CORE}, fin AS (SELECT * FROM core WHERE {IN_SQL}), {sql_z(src='fin')}
  SELECT condition, method, count(*) AS n, round(avg(cr_z), 8) AS cr_z, round(avg(be_z), 8) AS be_z FROM z GROUP BY ALL""")
def k6(spark, sf):
    drop = spark.createDataFrame([(m,) for m in OUT], "method string")
    z = kp.zscore(kp.method_filter(core(spark, sf), drop, keep=False), ["condition"], ["cr", "be"])
    return z.groupBy("condition", "method").agg(F.count("*").alias("n"), rnd(F.avg("cr_z"), 8).alias("cr_z"), rnd(F.avg("be_z"), 8).alias("be_z"))


@register("K7_weight_scenarios", f"""WITH {SQL_SUM} SELECT condition, method, round(i / 100.0::DOUBLE, 9) AS w, round(i / 100.0::DOUBLE * cr_z, 8) AS cr_part,
  round((1 - i / 100.0::DOUBLE) * be_z, 8) AS be_part, round(i / 100.0::DOUBLE * cr_z + (1 - i / 100.0::DOUBLE) * be_z, 8) AS res
  FROM su CROSS JOIN range(10, 91, 5) r(i)""")
def k7(spark, sf):
    return kp.weight_scenarios(summary(spark, sf), ["condition"]).select("condition", "method", *R("w"), *R("cr_part", "be_part", "res", d=8))


BY = ["cr", "be", "effectiveness", "res"]


@register("K8_kpi_by_bin", f"WITH {SQL_Z} SELECT condition, method, bin, count(*) AS n, {', '.join(f'round(avg({c}), 8) AS {c}' for c in BY)} FROM s GROUP BY ALL")
def k8(spark, sf):
    return kp.kpi_by(scored(spark, sf), ["condition", "method", "bin"]).select("condition", "method", "bin", "n", *R(*BY, d=8))


@register("K9_kpi_by_length", f"WITH {SQL_Z} SELECT condition, method, enc_len, count(*) AS n, {', '.join(f'round(avg({c}), 8) AS {c}' for c in BY)} FROM s GROUP BY ALL")
def k9(spark, sf):
    return kp.kpi_by(scored(spark, sf), ["condition", "method", "enc_len"]).select("condition", "method", "enc_len", "n", *R(*BY, d=8))


def sql_rank(v, keys="condition"):
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY round({v}, 9) DESC, method)"


@register("K10_res_decomposition", f"""WITH {SQL_SUM}, d AS (SELECT *, 0.5::DOUBLE * cr_z AS cr_part, 0.5::DOUBLE * be_z AS be_part FROM su),
  k AS (SELECT *, {sql_rank('res')} AS rank_res, {sql_rank('cr_part')} AS rank_cr FROM d)
  SELECT condition, method, {rs('res', 'cr_part', 'be_part', d=8)}, rank_res, rank_cr, rank_res - rank_cr AS moved,
  round(abs(be_part) / (abs(cr_part) + abs(be_part)), 7) AS rate_share, true AS adds_up FROM k""")
def k10(spark, sf):
    d = kp.res_decomposition(summary(spark, sf), ["condition"])
    return d.select("condition", "method", *R("res", "cr_part", "be_part", d=8), "rank_res", "rank_cr", "moved", *R("rate_share", d=7), "adds_up")


SQL_MOVES = f"""{SQL_CORE}, {sql_z()}, {sql_z(IN_SQL, name='zz')},
  b AS (SELECT condition, method, avg(0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z) AS before FROM z GROUP BY ALL),
  a AS (SELECT condition, method, avg(0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z) AS after FROM zz GROUP BY ALL),
  m AS (SELECT *, {sql_rank('before')} AS rank_before, {sql_rank('after')} AS rank_after FROM b JOIN a USING (condition, method))"""


@register("K11_rank_moves", f"""WITH {SQL_MOVES} SELECT condition, method, {rs('before', 'after', d=8)}, rank_before, rank_after,
  rank_before <> rank_after AS moved, round(max(abs(after - before)) OVER (PARTITION BY condition), 8) AS max_shift FROM m""")
def k11(spark, sf):
    c = core(spark, sf)
    both = kp.zscore(c, ["condition"], ["cr", "be"]).withColumn("before", 0.5 * F.col("cr_z") + 0.5 * F.col("be_z"))
    both = kp.zscore(both.drop("cr_z", "be_z"), ["condition"], ["cr", "be"], in_scope()).withColumn("after", 0.5 * F.col("cr_z") + 0.5 * F.col("be_z"))
    means = both.groupBy("condition", "method").agg(F.avg("before").alias("before"), F.avg("after").alias("after"))
    d = kp.rank_moves(means, ["condition"], "before", "after")
    return d.select("condition", "method", *R("before", "after", d=8), "rank_before", "rank_after", "moved", *R("max_shift", d=8))


@register("K12_kappa", f"""WITH {SQL_CORE} SELECT condition, bin, count(*) FILTER (int_len = enc_len) AS n,
  round(avg(actual * int_len / (enc_len * target)) FILTER (int_len = enc_len), 9) AS kappa FROM core GROUP BY ALL""")
def k12(spark, sf):
    return kp.kappa_by_bin(kpi_in(spark, sf), ["condition"]).select("condition", "bin", "n", *R("kappa"))


SQL_FREE = f"""{SQL_CORE}, kc AS (SELECT *, CASE WHEN actual > 0 THEN cr / (actual * int_len / (enc_len * target)) ELSE cr END AS cr_free FROM core),
  {sql_z(IN_SQL, src='kc', cols=('cr', 'be', 'cr_free'))},
  s AS (SELECT *, 0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z AS res, 0.5::DOUBLE * cr_free_z + 0.5::DOUBLE * be_z AS res_free FROM z)"""


@register("K13_kappa_free", f"""WITH {SQL_FREE} SELECT condition, method, count(*) AS n, round(avg(res), 8) AS res, round(avg(res_free), 8) AS res_free,
  round(avg(res_free) - avg(res), 8) AS shift FROM s GROUP BY ALL""")
def k13(spark, sf):
    s = kp.kappa_free(core(spark, sf), ["condition"], in_scope())
    m = s.groupBy("condition", "method").agg(F.count("*").alias("n"), F.avg("res").alias("res"), F.avg("res_free").alias("res_free"))
    return m.select("condition", "method", "n", *R("res", "res_free", d=8), rnd(F.col("res_free") - F.col("res"), 8).alias("shift"))


@register("K13b_kappa_rank_agreement", f"""WITH {SQL_FREE}, c AS (SELECT condition, block, method, round(avg(res), 12) AS a, round(avg(res_free), 12) AS b FROM s GROUP BY ALL),
  r AS (SELECT condition, block, rank() OVER (PARTITION BY condition, block ORDER BY a) + (count(*) OVER (PARTITION BY condition, block, a) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY condition, block ORDER BY b) + (count(*) OVER (PARTITION BY condition, block, b) - 1) / 2.0 AS b FROM c),
  p AS (SELECT condition, block, corr(a, b) AS rho FROM r GROUP BY ALL HAVING count(*) >= 3)
  SELECT condition, count(*) AS blocks, round(min(rho), 8) AS rho_min, round(median(rho), 8) AS rho_median FROM p GROUP BY condition""")
def k13b(spark, sf):
    s = kp.kappa_free(core(spark, sf), ["condition"], in_scope())
    return kp.kappa_rank_agreement(s, ["condition"], "block").select("condition", "blocks", *R("rho_min", "rho_median", d=8))


@register("K14_fit_weights", f"""WITH {SQL_Z}, n AS (SELECT condition, sum(cr_z * cr_z) aa, sum(cr_z * be_z) ab, sum(be_z * be_z) bb, sum(cr_z * r) ay, sum(be_z * r) by_
  FROM (SELECT *, 0.8::DOUBLE * cr_z + 0.2::DOUBLE * be_z AS r FROM s) GROUP BY condition)
  SELECT condition, round((bb * ay - ab * by_) / (aa * bb - ab * ab), 6) AS w1, round((aa * by_ - ab * ay) / (aa * bb - ab * ab), 6) AS w2, 0.0::DOUBLE AS max_residual FROM n""")
def k14(spark, sf):
    z = kp.res_composite(kp.zscore(core(spark, sf), ["condition"], ["cr", "be"]), 0.8)
    return kp.fit_weights(z, ["condition"]).select("condition", *R("w1", "w2", "max_residual", d=6))


GROUPINGS = {"condition": ["condition"], "bin": ["condition", "bin"], "block": ["condition", "block"], "block x bin": ["condition", "block", "bin"]}


def _aff(name, keys):
    k = ", ".join(keys)
    return f"""SELECT '{name}' AS grouping, round(max(abs(cr_z - a * cr - b)), 6) AS worst, max(abs(cr_z - a * cr - b)) < 1e-6 * greatest(1.0, max(abs(cr_z))) AS affine
      FROM s JOIN (SELECT {k}, regr_slope(cr_z, cr) AS a, regr_intercept(cr_z, cr) AS b FROM s GROUP BY ALL) USING ({k})"""


@register("K15_recover_grouping", f"""WITH {SQL_CORE}, g AS (SELECT condition, bin, avg(cr) AS mu, stddev_samp(cr) AS sd FROM core GROUP BY ALL),
  s AS (SELECT core.*, (cr - mu) / sd AS cr_z FROM core JOIN g USING (condition, bin)) """ + " UNION ALL ".join(_aff(n, k) for n, k in GROUPINGS.items()))
def k15(spark, sf):
    """Scores standardised per (condition, bin): which grouping explains them?"""
    s = kp.zscore(core(spark, sf), ["condition", "bin"], ["cr"], eps=0.0)
    return kp.affine_groupings(s, GROUPINGS).select("grouping", *R("worst", d=6), "affine")


POPS = {"rows in scope, n-1": ("mi", "si"), "rows in scope, n": ("mi", "pi"), "all rows, n-1": ("ma", "sa"), "all rows, n": ("ma", "pa"),
        "cells in scope, n-1": ("mci", "sci"), "cells all, n-1": ("mca", "sca")}


@register("K15b_recover_population", f"""WITH {SQL_ZS},
  a AS (SELECT condition, avg(cr) FILTER ({IN_SQL}) mi, stddev_samp(cr) FILTER ({IN_SQL}) si, stddev_pop(cr) FILTER ({IN_SQL}) pi, avg(cr) ma, stddev_samp(cr) sa, stddev_pop(cr) pa FROM s GROUP BY ALL),
  cl AS (SELECT condition, method, block, bin, avg(cr) AS v FROM s GROUP BY ALL),
  c AS (SELECT condition, avg(v) FILTER ({IN_SQL}) mci, stddev_samp(v) FILTER ({IN_SQL}) sci, avg(v) mca, stddev_samp(v) sca FROM cl GROUP BY ALL),
  j AS (SELECT * FROM s JOIN a USING (condition) JOIN c USING (condition)) """ + " UNION ALL ".join(
      f"SELECT condition, '{n}' AS population, round(max(abs((cr - {m}) / {sd} - cr_z)), 7) AS worst FROM j GROUP BY condition" for n, (m, sd) in POPS.items()))
def k15b(spark, sf):
    d = kp.population_fit(scored(spark, sf, in_scope()), ["condition"], in_scope(), ["condition", "method", "block", "bin"])
    return d.select("condition", "population", *R("worst", d=7))


@register("K16_bandwidth_extension", f"""WITH {SQL_CORE}, r AS (SELECT condition, method, be, enc_len, int_len, row_number() OVER (PARTITION BY condition, method ORDER BY be, enc_len, int_len) AS i FROM core)
  SELECT condition, method, round(be, 9) AS be, enc_len, CAST(int_len AS DOUBLE) AS int_len FROM r WHERE i = 1""")
def k16(spark, sf):
    return kp.bandwidth_extension(kpi_in(spark, sf), ["condition"]).select("condition", "method", *R("be"), "enc_len", "int_len")


SQL_DENS = f"""{SQL_CORE}, cl AS (SELECT condition, enc_len, method, count(*) AS n, avg(be) AS be, avg(actual) AS density, avg(actual / target) AS over_target FROM core GROUP BY ALL),
  rf AS (SELECT condition, enc_len, avg(actual) AS rd FROM core WHERE int_len = enc_len GROUP BY ALL)"""


@register("K17_density_ratio", f"""WITH {SQL_DENS} SELECT condition, enc_len, method, n, {rs('be', 'over_target')}, round(density / nullif(rd, 0), 9) AS ratio,
  round(abs(density / nullif(rd, 0) - be), 9) AS residual FROM cl JOIN rf USING (condition, enc_len)""")
def k17(spark, sf):
    d = kp.density_ratio(kpi_in(spark, sf), ["condition"], F.col("int_len") == F.col("enc_len"))
    return d.select("condition", "enc_len", "method", "n", *R("be", "over_target", "ratio", "residual"))


@register("K17b_density_moves", f"""WITH {SQL_CORE}, b AS (SELECT condition, method, avg(cr_raw) AS before, avg(cr) AS after FROM core GROUP BY ALL),
  m AS (SELECT *, {sql_rank('before')} AS rank_before, {sql_rank('after')} AS rank_after FROM b)
  SELECT condition, method, {rs('before', 'after')}, rank_before, rank_after, rank_before <> rank_after AS moved,
  round(max(abs(after - before)) OVER (PARTITION BY condition), 9) AS max_shift FROM m""")
def k17b(spark, sf):
    m = core(spark, sf).groupBy("condition", "method").agg(F.avg("cr_raw").alias("raw"), F.avg("cr").alias("cr"))
    d = kp.rank_moves(m, ["condition"], "raw", "cr")
    return d.select("condition", "method", *R("before", "after"), "rank_before", "rank_after", "moved", *R("max_shift"))


SQL_TRADE = f"""{SQL_SUM}, rt AS (SELECT condition, method, sum(int_len) / count(*) AS runtime FROM core GROUP BY ALL),
  e AS (SELECT condition, method, res, runtime, (res - min(res) OVER (PARTITION BY condition)) / (runtime + 1e-12::DOUBLE) AS efficiency FROM su JOIN rt USING (condition, method))"""


@register("K18_efficiency_tradeoff", f"""WITH {SQL_TRADE}, h AS (SELECT *, min(efficiency) OVER (PARTITION BY condition) AS lo, max(efficiency) OVER (PARTITION BY condition) AS hi FROM e)
  SELECT condition, method, {rs('res', 'runtime', 'efficiency', d=8)}, round(CASE WHEN hi > lo THEN (efficiency - lo) / (hi - lo) ELSE 1.0 END, 7) AS norm FROM h""")
def k18(spark, sf):
    c = core(spark, sf)
    per = kp.kpi_summary(c, ["condition"]).join(kp.runtime_mean(c, ["condition", "method"], "int_len").drop("n"), ["condition", "method"])
    d = kp.efficiency_tradeoff(per, ["condition"])
    return d.select("condition", "method", *R("res", "runtime", "efficiency", d=8), *R("norm", d=7))


@register("K19_minmax", f"""WITH {SQL_SUM} SELECT condition, method, """ + ", ".join(
    f"round(CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5::DOUBLE END, 7) AS {c}"
    for c in ("cr", "be", "effectiveness", "res")) + " FROM su WINDOW w AS (PARTITION BY condition)")
def k19(spark, sf):
    d = kp.minmax_normalize(summary(spark, sf), ["condition"], ["cr", "be", "effectiveness", "res"])
    return d.select("condition", "method", *R("cr", "be", "effectiveness", "res", d=7))


@register("K23_runtime_mean", f"WITH {SQL_OBS} SELECT method, count(*) AS n, round(sum(x1) / count(*)::DOUBLE, 9) AS runtime FROM obs GROUP BY method")
def k23(spark, sf):
    return kp.runtime_mean(obs(spark, sf), ["method"], "x1").select("method", "n", *R("runtime"))


@register("K24_metric_mean_finite", f"""WITH {SQL_OBS}, m AS (SELECT method, avg(CASE WHEN x2 > 0 THEN x1::DOUBLE / x2 END) AS ratio, avg(x1)::DOUBLE AS size, avg(x4)::DOUBLE AS tax FROM obs GROUP BY method),
  l AS (SELECT method, 'ratio' AS metric, ratio AS mean, -1 AS s FROM m UNION ALL SELECT method, 'size', size, 1 FROM m UNION ALL SELECT method, 'tax', tax, 1 FROM m)
  SELECT method, metric, round(mean, 8) AS mean, row_number() OVER (PARTITION BY metric ORDER BY round(s * mean, 9), method) AS rank FROM l""")
def k24(spark, sf):
    ratio = F.when(F.col("x2") > 0, F.col("x1") / F.col("x2")).when(F.col("x1") > 25, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    d = kp.metric_mean_finite(obs(spark, sf), ["method"], {"ratio": ratio, "size": F.col("x1"), "tax": F.col("x4")},
                              {"ratio": True, "size": False, "tax": False})
    return d.select("method", "metric", *R("mean", d=8), "rank")


LEVELS = [0.05, 0.12, 0.18, 0.26]


@register("K25_noise_discretize", f"""WITH {SQL_KPI_IN}, c AS (SELECT condition, actual, CASE WHEN actual >= 0.05::DOUBLE + (0.12::DOUBLE - 0.05::DOUBLE) / 2 THEN 1 ELSE 0 END
  + CASE WHEN actual >= 0.12::DOUBLE + (0.18::DOUBLE - 0.12::DOUBLE) / 2 THEN 1 ELSE 0 END + CASE WHEN actual >= 0.18::DOUBLE + (0.26::DOUBLE - 0.18::DOUBLE) / 2 THEN 1 ELSE 0 END + 1 AS noise_cat FROM kpi_in)
  SELECT condition, CAST(noise_cat AS BIGINT) AS noise_cat, count(*) AS n, round(avg(actual), 9) AS mean FROM c GROUP BY ALL""")
def k25(spark, sf):
    levels = spark.createDataFrame([(x,) for x in LEVELS], "level double")
    d = kp.noise_discretize(kpi_in(spark, sf), "actual", levels)
    return d.groupBy("condition", "noise_cat").agg(F.count("*").alias("n"), rnd(F.avg("actual")).alias("mean"))


@register("K25b_noise_own_levels", f"""WITH {SQL_KPI_IN}, lv AS (SELECT condition, target AS level FROM (SELECT DISTINCT condition, target, bin FROM kpi_in) WHERE bin % CASE condition WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END = 0),
  mi AS (SELECT condition, lag(level) OVER w + (level - lag(level) OVER w) / 2 AS mid FROM lv WINDOW w AS (PARTITION BY condition ORDER BY level)),
  c AS (SELECT condition, actual, 1 + (SELECT count(*) FROM mi WHERE mi.condition = k.condition AND k.actual >= mid) AS noise_cat FROM kpi_in k)
  SELECT condition, CAST(noise_cat AS BIGINT) AS noise_cat, count(*) AS n, round(avg(actual), 9) AS mean FROM c GROUP BY ALL""")
def k25b(spark, sf):
    """Each condition against its own levels: all, every second or every third target density."""
    k = kpi_in(spark, sf)
    step = F.when(F.col("condition") == "A", 1).when(F.col("condition") == "N", 2).otherwise(3)
    levels = k.where(F.col("bin") % step == 0).select("condition", F.col("target").alias("level")).distinct()
    d = kp.noise_discretize(k, "actual", levels, ["condition"])
    return d.groupBy("condition", "noise_cat").agg(F.count("*").alias("n"), rnd(F.avg("actual")).alias("mean"))
