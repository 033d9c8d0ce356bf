"""Bursts of three sizes injected into every order frame (balanced by construction), and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anova as an
from ..operators import assoc as ac
from ..operators import blockload as bl
from ..operators import bursts as bu
from ..operators import reorder as ro
from ..functions.numeric import hash32
from ..sources.tables import ORDER_W, SQL_OBS, frames_orders, obs
from .assoc_queries import SQL_PB, long
from .burst_queries import sql_hazen
from .kpi_queries import R
from .registry import register
from .blockload_queries import CW, PAIRED, SQL_STAT_CTES, T, sql_loads
from .burst_queries import LEVELS, SQL_BURST
from .perm_sql import perms_sql

V = "after_gini"


def trials(spark, sf):
    """One trial per (frame, burst size, rule); the burst starts at a hashed row."""
    f = frames_orders(spark, sf)
    lv = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("bin"), F.lit(x).alias("level")) for i, x in enumerate(LEVELS)])
    r = f.select("frame_id", "n_rows", "pos", F.inline(lv)).withColumn("size", bu.burst_size(F.col("level"), F.col("n_rows")))
    start = hash32(F.lit(42), "frame_id", "bin") % (F.col("n_rows") - F.col("size") + 1) + 1
    hit = ((F.col("pos") >= start) & (F.col("pos") < start + F.col("size"))).cast("int")
    r = r.select((F.col("frame_id") * 10 + F.col("bin")).alias("frame_id"), "n_rows", "pos", hit.alias("hit"))
    d = bl.trial_stats(r, ro.permutations(spark, PAIRED, ORDER_W), CW, T)
    return d.withColumn("bin", F.col("frame_id") % 10)


SQL_TRIALS = sql_loads(f"""{SQL_BURST}, {perms_sql(PAIRED, ORDER_W)}, f2 AS (SELECT f.frame_id * 10 + b.bin AS frame_id, f.pos, (f.pos BETWEEN b.start AND b.start + b.size - 1)::INT AS hit
  FROM f JOIN bursts b ON b.frame_id = f.frame_id)""", "f2", ORDER_W) + f""", {SQL_STAT_CTES}, pt AS (SELECT method, frame_id, frame_id % 10 AS bin, g AS after_gini FROM a)"""
SQL_ANOVA = f"""{SQL_TRIALS}, g AS (SELECT avg({V}) AS g, count(*) AS n FROM pt), mm AS (SELECT method, avg({V}) AS mm FROM pt GROUP BY ALL), mb AS (SELECT bin, avg({V}) AS mb FROM pt GROUP BY ALL),
  mc AS (SELECT method, bin, avg({V}) AS mc FROM pt GROUP BY ALL),
  ss AS (SELECT sum((mm - g) ** 2) AS sm, sum((mb - g) ** 2) AS sb, sum((mc - mm - mb + g) ** 2) AS si, sum(({V} - mc) ** 2) AS se, any_value(n) AS n,
    count(DISTINCT method) AS a, count(DISTINCT bin) AS b FROM pt JOIN mm USING (method) JOIN mb USING (bin) JOIN mc USING (method, bin) CROSS JOIN g),
  atb AS (SELECT 'method' AS term, sm AS ss, a - 1 AS df, sm + sb + si + se AS st, se / (n - a * b) AS mse, n - a * b AS de FROM ss
    UNION ALL SELECT 'bin', sb, b - 1, sm + sb + si + se, se / (n - a * b), n - a * b FROM ss
    UNION ALL SELECT 'interaction', si, (a - 1) * (b - 1), sm + sb + si + se, se / (n - a * b), n - a * b FROM ss
    UNION ALL SELECT 'error', se, n - a * b, sm + sb + si + se, se / (n - a * b), n - a * b FROM ss)"""


def table(spark, sf):
    return an.anova_two_way(trials(spark, sf), [], "method", "bin", V)


@register("A1_anova_two_way", f"""WITH {SQL_ANOVA} SELECT term, round(ss, 8) AS ss, df, round(ss / df, 8) AS ms, CASE WHEN term <> 'error' THEN round(ss / df / mse, 6) END AS f,
  CASE WHEN term <> 'error' THEN round(ss / st, 8) END AS eta2, CASE WHEN term = 'error' THEN NULL WHEN ss / st > 0.14 THEN 'LARGE' WHEN ss / st > 0.06 THEN 'MEDIUM' WHEN ss / st > 0.01 THEN 'SMALL' ELSE '' END AS effect FROM atb""")
def a1(spark, sf):
    return table(spark, sf).select("term", *R("ss", d=8), "df", *R("ms", d=8), *R("f", d=6), *R("eta2", d=8), "effect")


BINS = 9


def _sweeps(of: str, last: int) -> str:
    """Gaussian elimination of the bins 1..last from the table c0 (condition, j, k, c) with right side k = 0."""
    out = []
    for p in range(1, last + 1):
        out.append(f"""c{p} AS (SELECT condition, j, k, CASE WHEN pp > 1e-9 * top AND j > {p} THEN c - jp * pk / pp ELSE c END AS c FROM (SELECT *,
          max(c) FILTER (j = {p} AND k = {p}) OVER w AS pp, max(c) FILTER (k = {p}) OVER (PARTITION BY condition, j) AS jp, max(c) FILTER (j = {p}) OVER (PARTITION BY condition, k) AS pk FROM c{p - 1} WINDOW w AS (PARTITION BY condition)) JOIN top USING (condition)),
          s{p} AS (SELECT condition, max(c) FILTER (j = {p} AND k = 0) AS q, max(c) FILTER (j = {p} AND k = {p}) AS pp FROM c{p - 1} GROUP BY ALL)""")
    return ", ".join(out)


SQL_TYPE1 = f"""WITH {SQL_OBS}, cl AS (SELECT condition, method, bin, count(*)::DOUBLE AS n, avg(x1) AS m, coalesce(var_samp(x1), 0) AS v FROM obs GROUP BY ALL),
  g AS (SELECT condition, sum(n * m) / sum(n) AS g FROM cl GROUP BY ALL), ce AS (SELECT condition, method, bin, n, m - g AS m, v FROM cl JOIN g USING (condition)),
  mi AS (SELECT condition, method, sum(n) AS ni, sum(n * m) / sum(n) AS mi FROM ce GROUP BY ALL), d AS (SELECT * FROM ce JOIN mi USING (condition, method)),
  c0 AS (SELECT a.condition, a.bin AS j, b.bin AS k, sum(CASE WHEN a.bin = b.bin THEN a.n ELSE 0 END - a.n * b.n / a.ni) AS c FROM d a JOIN d b USING (condition, method) GROUP BY ALL
    UNION ALL SELECT condition, bin, 0, sum(n * (m - mi)) FROM d GROUP BY ALL), top AS (SELECT condition, max(c) AS top FROM c0 WHERE j = k GROUP BY ALL), {_sweeps('c', BINS)},
  sb AS (SELECT condition, sum(CASE WHEN pp > 1e-9 * top THEN q * q / pp ELSE 0 END) AS sb, count(*) FILTER (pp > 1e-9 * top) AS rk FROM ({" UNION ALL ".join(f"SELECT * FROM s{p}" for p in range(1, BINS + 1))}) JOIN top USING (condition) GROUP BY ALL),
  t AS (SELECT condition, sum(n * mi * mi) AS sm, sum(n * m * m) AS sc, sum((n - 1) * v) AS se, sum(n) AS n, count(*) AS cells, count(DISTINCT method) AS a FROM d GROUP BY ALL),
  u AS (SELECT *, sm + sb + (sc - sm - sb) + se AS st, se / (n - cells) AS mse FROM t JOIN sb USING (condition)),
  r AS (SELECT condition, 'method' AS term, sm AS ss, a - 1 AS df, st, mse FROM u UNION ALL SELECT condition, 'bin', sb, rk, st, mse FROM u
    UNION ALL SELECT condition, 'interaction', sc - sm - sb, cells - a - rk, st, mse FROM u UNION ALL SELECT condition, 'error', se, n - cells, st, mse FROM u)"""


@register("A1b_anova_type1", f"""{SQL_TYPE1} SELECT condition, term, round(ss, 5) AS ss, CAST(df AS BIGINT) AS df, CASE WHEN term <> 'error' THEN round(ss / df / mse, 6) END AS f,
  CASE WHEN term <> 'error' THEN round(ss / st, 8) END AS eta2, CASE WHEN term = 'error' THEN NULL WHEN ss / st > 0.14 THEN 'LARGE' WHEN ss / st > 0.06 THEN 'MEDIUM' WHEN ss / st > 0.01 THEN 'SMALL' ELSE '' END AS effect FROM r""")
def a1b(spark, sf):
    """Quantities of all line items by brand and tax bin, an unbalanced design: sequential sums of squares."""
    t = an.anova_two_way(obs(spark, sf), ["condition"], "method", "bin", "x1", allow_type1=True)
    return t.select("condition", "term", *R("ss", d=5), "df", *R("f", d=6), *R("eta2", d=8), "effect")


#: The F tail as the integral of a beta density, by Simpson's rule over the stretch that holds all but e^-60 of it.
STEPS = 20_000
SQL_TAIL = f"""{SQL_ANOVA}, tt AS (SELECT *, ss / df / mse AS f, df / 2.0::DOUBLE AS b, de / 2.0::DOUBLE AS a FROM atb WHERE term <> 'error'),
  tx AS (SELECT *, de / (de + df * f) AS x, lgamma(a + b) - lgamma(a) - lgamma(b) AS lb FROM tt), tw AS (SELECT *, greatest(0, x - 60 / a) AS x0, (x - greatest(0, x - 60 / a)) / {STEPS} AS h FROM tx),
  tp AS (SELECT term, df, f, ss / st AS eta2, h / 3 * list_sum(list_transform(range(0, {STEPS + 1}), lambda k: (CASE WHEN k IN (0, {STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
    * exp(lb + (a - 1) * ln(greatest(x0 + k * h, 1e-300)) + (b - 1) * ln(greatest(1 - x0 - k * h, 1e-300))))) AS p FROM tw)"""


@register("A2_anova_pvalue", f"""WITH {SQL_TAIL} SELECT term, df, round(f, 6) AS f, round(p, 9) AS p FROM tp UNION ALL SELECT term, df, NULL, NULL FROM atb WHERE term = 'error'""")
def a2(spark, sf):
    return an.anova_pvalue(table(spark, sf)).select("term", "df", *R("f", d=6), *R("p", d=9))


SQL_PAIR = f"""{SQL_TRIALS}, hp AS (SELECT *, (frame_id // 10) % 2 AS half FROM pt), m AS (SELECT half, method, count(*) AS n, avg({V}) AS mu FROM hp GROUP BY ALL),
  er AS (SELECT half, sum(({V} - mc) ** 2) / (count(*) - count(DISTINCT method) * count(DISTINCT bin)) AS mse FROM (SELECT *, avg({V}) OVER (PARTITION BY half, method, bin) AS mc FROM hp) GROUP BY half)"""


@register("A3_pairwise_means", f"""WITH {SQL_PAIR} SELECT half, o.method, round(f.mu - o.mu, 9) AS diff, round((f.mu - o.mu) / sqrt(mse / 2 * (1.0::DOUBLE / f.n + 1.0::DOUBLE / o.n)), 7) AS q
  FROM m o JOIN m f USING (half) JOIN er USING (half) WHERE f.method = 'S' AND o.method <> 'S'""")
def a3(spark, sf):
    p = trials(spark, sf).withColumn("half", F.floor(F.col("frame_id") / 10) % 2)
    t = an.anova_two_way(p, ["half"], "method", "bin", V)
    return an.pairwise_means(p, t, ["half"], "method", V, "S").select("half", "method", *R("diff"), *R("q", d=7))


@register("A4_group_descriptives", f"""WITH {SQL_OBS} SELECT method, count(*) AS n, round(avg(x1), 8) AS mean_x1, round(stddev_samp(x1), 8) AS sd_x1, round(stddev_samp(x1) / sqrt(count(*)), 8) AS sem_x1,
  round(avg(x3), 8) AS mean_x3, round(stddev_samp(x3), 8) AS sd_x3, round(stddev_samp(x3) / sqrt(count(*)), 8) AS sem_x3 FROM obs GROUP BY method""")
def a4(spark, sf):
    d = an.group_descriptives(obs(spark, sf), ["method"], ["x1", "x3"]).orderBy(F.col("mean_x1").desc())
    return d.select("method", "n", *R("mean_x1", "sd_x1", "sem_x1", "mean_x3", "sd_x3", "sem_x3", d=8))


@register("A5_topn_methods", f"""WITH {SQL_OBS}, m AS (SELECT condition, method, avg(y) AS mean_y FROM obs GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY round(mean_y, 6) DESC, method) AS rank FROM m)
  SELECT condition, method, round(mean_y, 2) AS mean_y, rank FROM k WHERE rank <= 5""")
def a5(spark, sf):
    d = an.group_descriptives(obs(spark, sf), ["condition", "method"], ["y"])
    return an.topn_methods(d, ["condition"], "mean_y", 5).select("condition", "method", *R("mean_y", d=2), "rank")


@register("A6_method_bin_profile", f"""WITH {SQL_OBS} SELECT condition, method, bin, count(*) AS n, CASE WHEN count(*) > 1 THEN round(avg(x1), 8) END AS mean,
  CASE WHEN count(*) > 1 THEN round(stddev_samp(x1) / sqrt(count(*)), 8) END AS sem FROM obs GROUP BY ALL""")
def a6(spark, sf):
    return an.method_bin_profile(obs(spark, sf), ["condition", "method", "bin"], "x1").select("condition", "method", "bin", "n", *R("mean", "sem", d=8))


@register("A7_effect_flags", f"""WITH {SQL_TAIL} SELECT '{V}' AS metric, max(eta2) FILTER (term = 'method') > 0.14 AS method_strong, max(eta2) FILTER (term = 'bin') > 0.14 AS bin_strong,
  max(p) FILTER (term = 'interaction') < 0.05 AS interaction_present FROM tp""")
def a7(spark, sf):
    p = trials(spark, sf).withColumn("metric", F.lit(V))
    return an.effect_flags(an.anova_pvalue(an.anova_two_way(p, ["metric"], "method", "bin", V)), ["metric"])


def sql_box(src, keys, v, d):
    return f"""SELECT {keys}, round({sql_hazen(25, v, 'a')}, {d}) AS q1, round({sql_hazen(50, v, 'a')}, {d}) AS median, round({sql_hazen(75, v, 'a')}, {d}) AS q3, CAST(len(a) AS BIGINT) AS n,
      round(a[1]::DOUBLE, {d}) AS low, round(a[len(a)]::DOUBLE, {d}) AS high, a[1] < 0 AND a[len(a)] > 0 AS flips FROM (SELECT {keys}, list_sort(list({v})) AS a FROM {src} GROUP BY ALL)"""


@register("A8_box_stats", f"WITH {SQL_OBS} {sql_box('obs', 'method', 'y', 2)}")
def a8(spark, sf):
    d = an.box_stats(obs(spark, sf), ["method"], "y")
    return d.select("method", *R("q1", "median", "q3", d=2), "n", *R("low", "high", d=2), "flips")


@register("A8b_box_per_metric", f"WITH {SQL_PB}, pr AS (SELECT metric, round(rho, 12) AS r FROM pb) {sql_box('pr', 'metric', 'r', 8)}")
def a8b(spark, sf):
    pb = ac.spearman_by_block(long(spark, sf)).withColumn("r", F.round("rho", 12))
    d = an.box_stats(pb, ["metric"], "r", small=True)
    return d.select("metric", *R("q1", "median", "q3", d=8), "n", *R("low", "high", d=8), "flips")
