"""Metrics of line items against revenue, methods being brands and blocks ship quarters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.dims import settle
from ..functions.numeric import rnd
from ..functions.rank import cdf, percentiles
from ..operators import assoc as ac
from ..operators import kpi as kp
from ..sources.tables import SQL_OBS, obs
from .burst_queries import sql_hazen
from .kpi_queries import R
from .registry import register

X = ["x1", "x2", "x3", "x4"]

SQL_CELLS = f"""{SQL_OBS}, cl AS (SELECT condition, block, method, count(*) AS n, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3, avg(x4) AS x4, avg(y) AS y FROM obs GROUP BY ALL),
  lg AS (SELECT condition, block, method, y, 'x1' AS metric, x1 AS x FROM cl UNION ALL SELECT condition, block, method, y, 'x2', x2 FROM cl
    UNION ALL SELECT condition, block, method, y, 'x3', x3 FROM cl UNION ALL SELECT condition, block, method, y, 'x4', x4 FROM cl)"""


def sql_rho(src: str, keys: str, least: int = 5, name: str = "pb", extra: str = "") -> str:
    """Average-tie ranks and their correlation, as CTEs ``<name>_r`` and ``name``."""
    return f"""{name}_r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0::DOUBLE AS ry FROM {src} WHERE x IS NOT NULL AND y IS NOT NULL),
  {name} AS (SELECT {keys}, count(*) AS m, corr(rx, ry) AS rho FROM {name}_r GROUP BY {keys}
    HAVING count(*) >= {least} AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1)"""


def sql_fisher(src: str, less: int = 3, r: str = "rho", bound: str = "0.999999") -> str:
    return f"tanh(sum((m - {less}) * atanh(greatest(-{bound}::DOUBLE, least({bound}::DOUBLE, {r})))) / sum(CASE WHEN {r} IS NOT NULL THEN m - {less} END))"


SQL_PB = f"{SQL_CELLS}, {sql_rho('lg', 'condition, block, metric')}"


def cells(spark, sf):
    return ac.cell_means(obs(spark, sf), X, "y")


def long(spark, sf):
    return ac.cells_long(cells(spark, sf), X, "y")


@register("R1_cell_means", f"WITH {SQL_CELLS} SELECT condition, block, method, n, round(x1, 9) AS x1, round(x2, 9) AS x2, round(x3, 9) AS x3, round(x4, 9) AS x4, round(y, 3) AS y FROM cl")
def r1(spark, sf):
    return cells(spark, sf).select("condition", "block", "method", "n", *R(*X), *R("y", d=3))


@register("R2_avg_rank", f"WITH {SQL_PB} SELECT condition, block, method, metric, rx, ry FROM pb_r")
def r2(spark, sf):
    return ac.rank_pairs(long(spark, sf), ["condition", "block", "metric"]).select("condition", "block", "method", "metric", "rx", "ry")


@register("R2b_rank_rows", f"""WITH {SQL_OBS} SELECT condition, x3, y, count(*) AS cnt, rk AS rank, total FROM
  (SELECT condition, x3, y, rank() OVER (PARTITION BY condition ORDER BY y) + (count(*) OVER (PARTITION BY condition, y) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY condition) AS total FROM obs) GROUP BY ALL""")
def r2b(spark, sf):
    """Ranks of raw trials inside whole conditions, without a window over the condition."""
    from ..functions.dims import attach

    o = obs(spark, sf).groupBy("condition", "x3", "y").agg(F.count("*").alias("cnt"))
    ranks = cdf(obs(spark, sf), ["condition"], "y").select("condition", F.col("v").alias("y"), (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("rank"), "total")
    return attach(o, ranks, ["condition", "y"]).select("condition", "x3", "y", "cnt", "rank", "total")


@register("R3_spearman_by_block", f"WITH {SQL_PB} SELECT condition, block, metric, m, round(rho, 9) AS rho FROM pb")
def r3(spark, sf):
    return ac.spearman_by_block(long(spark, sf)).select("condition", "block", "metric", "m", *R("rho"))


@register("R4_fisher_combine", f"WITH {SQL_PB} SELECT condition, metric, count(*) AS blocks, round({sql_fisher('pb')}, 9) AS rho FROM pb GROUP BY ALL")
def r4(spark, sf):
    return ac.fisher_combine(ac.spearman_by_block(long(spark, sf)), ["condition", "metric"]).select("condition", "metric", "blocks", *R("rho"))


@register("R5_spearman_trials", f"""WITH {SQL_OBS}, lg AS ({" UNION ALL ".join(f"SELECT condition, block, y, '{x}' AS metric, {x} AS x FROM obs" for x in X)}),
  {sql_rho('lg', 'condition, block, metric', 20)} SELECT condition, metric, count(*) AS blocks, round({sql_fisher('pb')}, 9) AS rho FROM pb GROUP BY ALL""")
def r5(spark, sf):
    t = ac.spearman_trials(obs(spark, sf), X, "y")
    return ac.fisher_combine(t, ["condition", "metric"]).select("condition", "metric", "blocks", *R("rho"))


@register("R6_between_block", f"""WITH {SQL_CELLS}, bm AS (SELECT condition, block, metric, round(avg(x), 12) AS x, round(avg(y), 6) AS y FROM lg GROUP BY ALL),
  {sql_rho('bm', 'condition, metric')} SELECT condition, metric, m, round(rho, 9) AS rho FROM pb""")
def r6(spark, sf):
    lg = long(spark, sf)
    return ac.between_block(lg).select("condition", "metric", "m", *R("rho"))


@register("R7_per_block_spread", f"""WITH {SQL_PB}, l AS (SELECT condition, metric, list_sort(list(round(rho, 12))) AS a FROM pb GROUP BY ALL)
  SELECT condition, metric, round({sql_hazen(50, 'rho', 'a')}, 9) AS median, round({sql_hazen(75, 'rho', 'a')} - {sql_hazen(25, 'rho', 'a')}, 9) AS iqr, CAST(len(a) AS BIGINT) AS blocks FROM l WHERE len(a) >= 4""")
def r7(spark, sf):
    d = ac.per_block_spread(ac.spearman_by_block(long(spark, sf)), ["condition", "metric"])
    return d.select("condition", "metric", *R("median", "iqr"), "blocks")


SQL_PIVOT = f"""{SQL_OBS}, pv AS (SELECT 'y' AS kpi, y::DOUBLE AS p, x1, x2, x3, x4 FROM obs UNION ALL SELECT 'x2', x2, x1, NULL, x3, x4 FROM obs WHERE x2 <> 0),
  lg AS (SELECT kpi, 'x1' AS metric, x1::DOUBLE AS x, p AS y FROM pv UNION ALL SELECT kpi, 'x3', x3, p FROM pv UNION ALL SELECT kpi, 'x4', x4, p FROM pv),
  pe AS (SELECT kpi, metric, corr(x, y) AS pearson FROM lg GROUP BY ALL), {sql_rho('lg', 'kpi, metric', 3)},
  j AS (SELECT kpi, metric, m, pearson, rho AS spearman FROM pb JOIN pe USING (kpi, metric))"""


def _pivot(spark, sf):
    o = settle(obs(spark, sf).select(*X, "y"))
    a = ac.pivot_correlations(o, ["x1", "x3", "x4"], ["y"])
    return a.unionByName(ac.pivot_correlations(o, ["x1", "x3", "x4"], ["x2"], drop_zero_pivot=True))


@register("R8_pivot_correlations", f"""WITH {SQL_PIVOT} SELECT kpi, metric, m, round(pearson, 8) AS pearson, round(spearman, 8) AS spearman,
  row_number() OVER (PARTITION BY kpi ORDER BY abs(round(pearson, 9)) DESC, metric) AS rank_pearson,
  row_number() OVER (PARTITION BY kpi ORDER BY abs(round(spearman, 9)) DESC, metric) AS rank_spearman,
  round(max(abs(pearson)) OVER (PARTITION BY kpi), 8) AS max_pearson, round(max(abs(spearman)) OVER (PARTITION BY kpi), 8) AS max_spearman FROM j""")
def r8(spark, sf):
    return _pivot(spark, sf).select("kpi", "metric", "m", *R("pearson", "spearman", d=8), "rank_pearson", "rank_spearman", *R("max_pearson", "max_spearman", d=8))


MX = ["x1", "x2", "x3", "x4", "x5", "y"]
SQL_MX = f"""{SQL_OBS}, mx AS (SELECT condition, block, method, x1::DOUBLE AS x1, x2::DOUBLE AS x2, x3::DOUBLE AS x3, x4::DOUBLE AS x4,
  CASE WHEN x2 > 0 THEN 10.0::DOUBLE * x1 + x4 END AS x5, y::DOUBLE / 1e6 AS y FROM obs)"""
PAIRS = list(combinations(MX, 2))
SQL_MATRIX = f"""{SQL_MX}, mt AS (""" + " UNION ALL ".join(
    f"SELECT condition, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM mx GROUP BY condition" for a, b in PAIRS) + ")"


def with_x5(spark, sf):
    o = obs(spark, sf)
    return o.withColumns({"x5": F.when(F.col("x2") > 0, 10.0 * F.col("x1") + F.col("x4")), "y": F.col("y") / 1e6})


def matrix(spark, sf):
    return ac.correlation_matrix(with_x5(spark, sf), MX, ["condition"])


@register("R9_correlation_matrix", f"WITH {SQL_MATRIX} SELECT condition, a, b, round(r, 8) AS r FROM mt")
def r9(spark, sf):
    return matrix(spark, sf).select("condition", "a", "b", *R("r", d=8))


SQL_WB = f"""{SQL_MX}, wc AS (SELECT condition, block, method, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3, avg(x4) AS x4, avg(x5) AS x5, avg(y) AS y FROM mx GROUP BY ALL),
  w0 AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {m} IS NOT NULL THEN rank() OVER (PARTITION BY condition, block ORDER BY {m}) + (count(*) OVER (PARTITION BY condition, block, {m}) - 1) / 2.0::DOUBLE END AS r_{m}" for m in MX) + """ FROM wc),
  wr AS (SELECT condition, block, method, """ + ", ".join(f"coalesce({m}, avg({m}) OVER w) AS {m}, coalesce(r_{m}, avg(r_{m}) OVER w) AS r_{m}" for m in MX) + """ FROM w0 WINDOW w AS (PARTITION BY condition, block)),
  wl AS (""" + " UNION ALL ".join(
    f"SELECT condition, block, '{a}' AS a, '{b}' AS b, count(*) AS m, CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN corr(r_{a}, r_{b}) END AS s, CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN corr({a}, {b}) END AS p FROM wr GROUP BY condition, block HAVING count(*) >= 5" for a, b in PAIRS) + f"""),
  wb AS (SELECT condition, a, b, {sql_fisher('wl', r='s', bound='0.999999999999')} AS spearman, {sql_fisher('wl', r='p', bound='0.999999999999')} AS pearson FROM wl GROUP BY ALL)"""


def within(spark, sf):
    return ac.within_block_matrix(ac.cell_means(with_x5(spark, sf), MX[:-1], "y"), MX)


@register("R10_within_block_matrix", f"WITH {SQL_WB} SELECT condition, a, b, round(spearman, 8) AS spearman, round(pearson, 8) AS pearson FROM wb")
def r10(spark, sf):
    return within(spark, sf).select("condition", "a", "b", *R("spearman", "pearson", d=8))


@register("R11_redundant_pairs", f"""WITH {SQL_MATRIX}, k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY abs(round(r, 9)) DESC, a, b) AS rank FROM mt)
  SELECT condition, a, b, round(r, 8) AS r, rank, abs(r) > 0.95 AS redundant FROM k WHERE rank <= 50""")
def r11(spark, sf):
    return ac.redundant_pairs(matrix(spark, sf), ["condition"], 50).select("condition", "a", "b", *R("r", d=8), "rank", "redundant")


@register("R12_metric_groups", f"""WITH RECURSIVE {SQL_MATRIX}, nm AS (SELECT unnest({MX!r}) AS name, generate_subscripts({MX!r}, 1) AS i),
  ed AS (SELECT condition, p.i AS i, q.i AS j FROM mt JOIN nm p ON p.name = a JOIN nm q ON q.name = b WHERE abs(r) > 0.60),
  gr(condition, i, seen, owner) AS (SELECT DISTINCT condition, 0, []::BIGINT[], []::BIGINT[] FROM mt
    UNION ALL SELECT g.condition, g.i + 1,
      CASE WHEN list_contains(g.seen, g.i + 1) THEN g.seen ELSE list_concat(g.seen, list_prepend((g.i + 1)::BIGINT, n.mates)) END,
      CASE WHEN list_contains(g.seen, g.i + 1) THEN g.owner ELSE list_concat(g.owner, list_transform(list_prepend((g.i + 1)::BIGINT, n.mates), lambda u: (g.i + 1)::BIGINT)) END
    FROM gr g, LATERAL (SELECT coalesce(list(e.j::BIGINT ORDER BY e.j) FILTER (NOT list_contains(g.seen, e.j)), []::BIGINT[]) AS mates FROM ed e WHERE e.condition = g.condition AND e.i = g.i + 1) n
    WHERE g.i < {len(MX)}),
  fl AS (SELECT condition, unnest(seen) AS m, unnest(owner) AS o FROM gr WHERE i = {len(MX)}),
  gg AS (SELECT condition, o, count(*) AS size, string_agg(name, ',' ORDER BY m) AS members FROM fl JOIN nm ON nm.i = m GROUP BY ALL HAVING count(*) > 1)
  SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY o) AS group_no, size, members FROM gg""")
def r12(spark, sf):
    return ac.metric_groups(matrix(spark, sf), ["condition"], MX, above=0.60)


def sql_partial(rxy, rxm, rmy):
    return f"CASE WHEN (1 - {rxm} * {rxm}) * (1 - {rmy} * {rmy}) >= 1e-6 THEN greatest(-1.0, least(1.0, ({rxy} - {rxm} * {rmy}) / sqrt((1 - {rxm} * {rxm}) * (1 - {rmy} * {rmy})))) END"


TRIPLES = [("x1", "x5", "y"), ("x5", "x1", "y"), ("x3", "x1", "y"), ("x4", "x2", "y")]
SQL_MED = f"""{SQL_WB}, sy AS (SELECT condition, a, b, spearman AS s, pearson AS p FROM wb UNION ALL SELECT condition, b, a, spearman, pearson FROM wb),
  tr(x, m, y) AS (VALUES {", ".join(str(t) for t in TRIPLES)}),
  md AS (SELECT xy.condition, tr.*, xy.s AS s_xy, xm.s AS s_xm, my.s AS s_my, xy.p AS p_xy, xm.p AS p_xm, my.p AS p_my FROM tr
    JOIN sy xy ON xy.a = tr.x AND xy.b = tr.y JOIN sy xm ON xm.a = tr.x AND xm.b = tr.m AND xm.condition = xy.condition JOIN sy my ON my.a = tr.m AND my.b = tr.y AND my.condition = xy.condition),
  mp AS (SELECT *, {sql_partial('s_xy', 's_xm', 's_my')} AS part_s, {sql_partial('p_xy', 'p_xm', 'p_my')} AS part_p FROM md)"""


@register("R13_partial_corr", f"WITH {SQL_MED} SELECT condition, x, m, y, round(part_s, 7) AS part_s, round(part_p, 7) AS part_p FROM mp")
def r13(spark, sf):
    return ac.mediation_test(within(spark, sf), TRIPLES, ["condition"]).select("condition", "x", "m", "y", *R("part_s", "part_p", d=7))


@register("R14_mediation", f"""WITH {SQL_MED}, mf AS (SELECT *, abs(part_p) / greatest(abs(p_xy), 2.220446049250313e-16) AS frac FROM mp)
  SELECT condition, x, m, y, round(s_xy, 8) AS s_xy, round(s_xm, 8) AS s_xm, round(s_my, 8) AS s_my, round(frac, 6) AS surviving,
  CASE WHEN part_s IS NULL OR part_p IS NULL THEN 'undefined: a leg is collinear' WHEN abs(s_xm) <= 0.3 OR abs(s_my) <= 0.3 THEN 'not mediation: a leg is too weak'
    WHEN frac < 0.25 THEN 'consistent with mediation' WHEN frac < 0.70 THEN 'partial mediation' ELSE 'not mediation: survives conditioning' END AS verdict FROM mf""")
def r14(spark, sf):
    d = ac.mediation_test(within(spark, sf), TRIPLES, ["condition"])
    return d.select("condition", "x", "m", "y", *R("s_xy", "s_xm", "s_my", d=8), *R("surviving", d=6), "verdict")


@register("R15_rank_partial", f"""WITH {SQL_CELLS}, l3 AS (SELECT condition, block, method, y, x1 AS c, 'x2' AS metric, x2 AS x FROM cl UNION ALL SELECT condition, block, method, y, x1, 'x3', x3 FROM cl UNION ALL SELECT condition, block, method, y, x1, 'x4', x4 FROM cl),
  rr AS (SELECT *, {", ".join(f"rank() OVER (PARTITION BY condition, block, metric ORDER BY {v}) + (count(*) OVER (PARTITION BY condition, block, metric, {v}) - 1) / 2.0::DOUBLE AS r{v}" for v in "xyc")} FROM l3),
  cc AS (SELECT condition, block, metric, count(*) AS m, corr(rx, ry) AS xy, corr(rx, rc) AS xc, corr(rc, ry) AS cy FROM rr GROUP BY ALL HAVING count(*) >= 6 AND count(DISTINCT x) > 1),
  pc AS (SELECT *, (xy - xc * cy) / sqrt((1 - xc * xc) * (1 - cy * cy)) AS rho FROM cc WHERE (1 - xc * xc) * (1 - cy * cy) > 1e-12)
  SELECT condition, metric, count(*) AS blocks, round({sql_fisher('pc', 4)}, 8) AS rho FROM pc GROUP BY ALL""")
def r15(spark, sf):
    p = ac.rank_partial_by_block(cells(spark, sf), ["x2", "x3", "x4"], "y", "x1")
    return ac.fisher_combine(p, ["condition", "metric"], less=4).select("condition", "metric", "blocks", *R("rho", d=8))


def sql_kendall(src: str, least: int) -> str:
    return f"""kp AS (SELECT p.condition, p.block, p.metric, sum(sign(p.x - q.x) * sign(p.y - q.y))::DOUBLE AS s, sum(abs(sign(p.x - q.x)))::DOUBLE AS nx, sum(abs(sign(p.y - q.y)))::DOUBLE AS ny
    FROM {src} p JOIN {src} q USING (condition, block, metric) GROUP BY ALL),
  kn AS (SELECT condition, block, metric, count(*) AS m FROM {src} GROUP BY ALL HAVING count(*) >= {least} AND count(DISTINCT x) > 1),
  kt AS (SELECT condition, block, metric, m, s / sqrt(nx * ny) AS rho FROM kp JOIN kn USING (condition, block, metric) WHERE nx > 0 AND ny > 0)
  SELECT condition, metric, count(*) AS blocks, round({sql_fisher('kt')}, 9) AS tau, abs(round({sql_fisher('kt')}, 12)) >= {ac.tau_threshold()!r}::DOUBLE AS passes FROM kt GROUP BY ALL"""


def _kendall(per_block):
    k = ac.fisher_combine(per_block, ["condition", "metric"])
    return k.select("condition", "metric", "blocks", rnd("rho").alias("tau"), (F.abs(F.round("rho", 12)) >= ac.tau_threshold()).alias("passes"))


@register("R16_kendall", f"WITH {SQL_CELLS}, {sql_kendall('lg', 5)}")
def r16(spark, sf):
    return _kendall(ac.kendall_by_block(long(spark, sf)))


@register("R16b_kendall_trials", f"""WITH {SQL_OBS}, lg AS ({" UNION ALL ".join(f"SELECT condition, block, y, '{x}' AS metric, {x} AS x FROM obs" for x in X)}), {sql_kendall('lg', 20)}""")
def r16b(spark, sf):
    """Kendall over the raw trials of each block, ties included."""
    return _kendall(ac.kendall_trials(obs(spark, sf), X, "y"))


@register("R30_pooled_vs_within", f"""WITH {SQL_PB}, {sql_rho('lg', 'condition, metric', 11, 'po')}, wi AS (SELECT condition, metric, count(*) AS blocks, {sql_fisher('pb')} AS within FROM pb GROUP BY ALL)
  SELECT condition, metric, po.m, round(po.rho, 9) AS pooled, blocks, round(within, 9) AS within FROM po JOIN wi USING (condition, metric)""")
def r30(spark, sf):
    return ac.pooled_vs_within(long(spark, sf)).select("condition", "metric", "m", *R("pooled"), "blocks", *R("within"))


@register("Q1_hazen_percentile", f"""WITH {SQL_OBS}, l AS (SELECT condition, method, list_sort(list(y)) AS a FROM obs GROUP BY ALL)
  SELECT condition, method, {", ".join(f"round({sql_hazen(p, 'y', 'a')}, 3) AS p{p}" for p in (5, 25, 50, 75, 95))}, CAST(len(a) AS BIGINT) AS n FROM l""")
def q1(spark, sf):
    d = percentiles(obs(spark, sf), ["condition", "method"], "y", {f"p{p}": p for p in (5, 25, 50, 75, 95)})
    return d.select("condition", "method", *[rnd(f"p{p}", 3).alias(f"p{p}") for p in (5, 25, 50, 75, 95)], "n")


@register("K20_top_correlated", f"""WITH {SQL_PIVOT}, k AS (SELECT kpi, metric, spearman AS r, row_number() OVER (PARTITION BY kpi ORDER BY abs(round(spearman, 9)) DESC, metric) AS rank FROM j WHERE abs(spearman) > 0.002)
  SELECT kpi, metric, round(r, 8) AS r, rank FROM k WHERE rank <= 6""")
def k20(spark, sf):
    c = _pivot(spark, sf).select("kpi", "metric", F.col("spearman").alias("r"))
    return kp.top_correlated(c, ["kpi"], 6, 0.002).select("kpi", "metric", *R("r", d=8), "rank")
