"""R17-R29, R31-R35 over line items, and paired trials of reordered event frames."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions.rank import spearman_rows
from ..operators import assoc as ac
from ..operators import blockload as bl
from ..operators import reorder as ro
from ..operators import validate as va
from ..sources.tables import EVENT_W, SQL_OBS, frames_events, obs
from .assoc_queries import SQL_CELLS, SQL_PB, X, cells, long, sql_fisher, sql_rho
from .blockload_queries import CW, SQL_STATS, T, _perm
from .burst_queries import sql_hazen
from .kpi_queries import IN_SQL, OUT, R
from .perm_sql import hash_sql
from .registry import register

DRAWS = 5000
PASS = "(abs(round(rho, 12)) >= 0.3)::INT"
SQL_FC = f"{SQL_PB}, fc AS (SELECT condition, metric, count(*) AS blocks, {sql_fisher('pb')} AS rho FROM pb GROUP BY ALL)"
SQL_BOOT = f"""{SQL_FC}, bl AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY block) - 1 AS slot, count(*) OVER (PARTITION BY condition) AS nb FROM (SELECT DISTINCT condition, block FROM pb)),
  pk AS (SELECT condition, d AS draw, {hash_sql('42', 'condition', 'd', 'slot')} % nb AS pick FROM bl CROSS JOIN range(1, {DRAWS + 1}) t(d)),
  bt AS (SELECT pk.condition, draw, metric, tanh(sum((m - 3) * atanh(greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, rho)))) / sum(m - 3)) AS rho
    FROM pk JOIN bl ON bl.condition = pk.condition AND bl.slot = pk.pick JOIN pb ON pb.condition = bl.condition AND pb.block = bl.block GROUP BY ALL)"""
SQL_CI = f"""{SQL_BOOT}, bq AS (SELECT b.metric, round(abs(b.rho), 12) AS a, round(abs(b.rho) / greatest(abs(r.rho), 2.220446049250313e-16), 12) AS q
    FROM bt b JOIN bt r ON r.condition = b.condition AND r.draw = b.draw AND r.metric = 'x1'),
  bs AS (SELECT metric, list_sort(list(a)) AS a, list_sort(list(q)) AS q FROM bq GROUP BY metric),
  ci AS (SELECT metric, {sql_hazen(2.5, 'a', 'a')} AS ci_lo, {sql_hazen(97.5, 'a', 'a')} AS ci_hi, {sql_hazen(2.5, 'q', 'q')} AS ratio_lo, {sql_hazen(97.5, 'q', 'q')} AS ratio_hi FROM bs)"""
SQL_SPREAD = f"""spl AS (SELECT condition, metric, list_sort(list(round(rho, 12))) AS a FROM pb GROUP BY ALL),
  sp AS (SELECT condition, metric, {sql_hazen(50, 'a', 'a')} AS median, {sql_hazen(75, 'a', 'a')} - {sql_hazen(25, 'a', 'a')} AS iqr FROM spl WHERE len(a) >= 4)"""


def per_block(spark, sf):
    return ac.spearman_by_block(long(spark, sf))


def combined(spark, sf):
    return ac.fisher_combine(per_block(spark, sf), ["condition", "metric"])


@register("R17_scorecard", f"""WITH {SQL_CI}, {SQL_SPREAD},
  bm AS (SELECT condition, block, metric, avg(x) AS x, avg(y) AS y FROM lg GROUP BY ALL), {sql_rho('bm', 'condition, metric', name='bw')},
  tl AS (SELECT condition, block, y, 'x1' AS metric, x1 AS x FROM obs UNION ALL SELECT condition, block, y, 'x2', x2 FROM obs UNION ALL SELECT condition, block, y, 'x3', x3 FROM obs UNION ALL SELECT condition, block, y, 'x4', x4 FROM obs),
  {sql_rho('tl', 'condition, block, metric', 20, 'tr')}, tc AS (SELECT condition, metric, {sql_fisher('tr')} AS rho FROM tr GROUP BY ALL),
  sc AS (SELECT metric, avg(abs(rho)) AS cell, sum({PASS}) AS pass, count(*) AS nc FROM fc GROUP BY metric)
  SELECT metric, round(cell, 8) AS cell, round(t, 8) AS trial, round(bt_, 8) AS between, round(md, 8) AS med_len, round(iq, 8) AS "IQR_len", round(ci_lo, 8) AS ci_lo, round(ci_hi, 8) AS ci_hi,
  CAST(pass AS BIGINT) AS pass, nc AS "nCond", round(cell / (SELECT cell FROM sc WHERE metric = 'x1'), 8) AS ratio_to_ref, round(ratio_lo, 7) AS ratio_lo, round(ratio_hi, 7) AS ratio_hi
  FROM sc JOIN ci USING (metric) JOIN (SELECT metric, avg(abs(rho)) AS t FROM tc GROUP BY metric) USING (metric) JOIN (SELECT metric, avg(rho) AS bt_ FROM bw GROUP BY metric) USING (metric)
  JOIN (SELECT metric, avg(median) AS md, avg(iqr) AS iq FROM sp GROUP BY metric) USING (metric)""")
def r17(spark, sf):
    o = obs(spark, sf)
    lg = va.settle(long(spark, sf))
    pb = va.settle(ac.spearman_by_block(lg))
    trial = ac.fisher_combine(ac.spearman_trials(o, X, "y"), ["condition", "metric"])
    d = va.scorecard(pb, ac.per_block_spread(pb, ["condition", "metric"]), ac.between_block(lg), trial, "x1", DRAWS)
    return d.select("metric", *R("cell", "trial", "between", "med_len", "IQR_len", "ci_lo", "ci_hi", d=8), "pass", "nCond",
                    *R("ratio_to_ref", d=8), *R("ratio_lo", "ratio_hi", d=7))


@register("R18_block_bootstrap", f"WITH {SQL_BOOT} SELECT condition, metric, CAST(draw AS BIGINT) AS draw, round(rho, 8) AS rho FROM bt")
def r18(spark, sf):
    return va.block_bootstrap(per_block(spark, sf), DRAWS).select("condition", "metric", F.col("draw").cast("bigint").alias("draw"), *R("rho", d=8))


@register("R18b_bootstrap_intervals", f"WITH {SQL_CI} SELECT metric, round(ci_lo, 8) AS ci_lo, round(ci_hi, 8) AS ci_hi, round(ratio_lo, 7) AS ratio_lo, round(ratio_hi, 7) AS ratio_hi FROM ci")
def r18b(spark, sf):
    b = va.settle(va.block_bootstrap(per_block(spark, sf), DRAWS))
    return va.bootstrap_intervals(b, "x1").select("metric", *R("ci_lo", "ci_hi", d=8), *R("ratio_lo", "ratio_hi", d=7))


@register("R19_heldout", f"""WITH {SQL_FC}, h AS (SELECT CASE WHEN metric IN ('x1', 'x2') THEN 'size' ELSE 'attribute' END AS stat, metric AS param,
  avg(abs(rho)) FILTER (condition <> 'R') AS s, avg(abs(rho)) FILTER (condition = 'R') AS r FROM fc GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY stat ORDER BY round(s, 12) DESC, param DESC) AS i FROM h)
  SELECT stat, param, round(s, 9) AS chosen_on, round(r, 9) AS reported FROM k WHERE i = 1""")
def r19(spark, sf):
    c = combined(spark, sf).select(
        F.when(F.col("metric").isin("x1", "x2"), "size").otherwise("attribute").alias("stat"), F.col("metric").alias("param"),
        F.when(F.col("condition") == "R", "report").otherwise("select").alias("side"), "rho")
    return va.heldout_parameter(c).select("stat", "param", *R("chosen_on", "reported"))


VARS_SQL = [("all", "true", "y"), ("target size", "true", "x1"), ("no extending", IN_SQL, "y"), ("low load", "bin <= 4", "y"), ("high load", "bin > 4", "y")]


@register("R20_variants", f"WITH {SQL_OBS}, v AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, condition, block, method, x2, x3, x4, {t}::DOUBLE AS t FROM obs WHERE {c}" for n, c, t in VARS_SQL) + f"""),
  vc AS (SELECT variant, condition, block, method, avg(x2) AS x2, avg(x3) AS x3, avg(x4) AS x4, avg(t) AS y FROM v GROUP BY ALL),
  vl AS (SELECT variant, condition, block, method, y, 'x2' AS metric, x2 AS x FROM vc UNION ALL SELECT variant, condition, block, method, y, 'x3', x3 FROM vc UNION ALL SELECT variant, condition, block, method, y, 'x4', x4 FROM vc),
  {sql_rho('vl', 'variant, condition, block, metric')} SELECT variant, condition, metric, count(*) AS blocks, round({sql_fisher('pb')}, 9) AS rho FROM pb GROUP BY ALL""")
def r20(spark, sf):
    rules = {"all": (F.lit(True), "y"), "target size": (F.lit(True), "x1"), "no extending": (~F.col("method").isin(OUT), "y"),
             "low load": (F.col("bin") <= 4, "y"), "high load": (F.col("bin") > 4, "y")}
    k = ["variant", "condition", "block"]
    v = va.variants(obs(spark, sf), rules)
    c = ac.cell_means(v, ["x2", "x3", "x4"], "target", [*k, "method"])
    lg = ac.cells_long(c, ["x2", "x3", "x4"], "target", [*k, "method"])
    d = ac.fisher_combine(ac.spearman_by_block(lg, [*k, "metric"]), ["variant", "condition", "metric"])
    return d.select("variant", "condition", "metric", "blocks", *R("rho"))


def sql_loo(group: str) -> str:
    return f"""{SQL_CELLS}, lf AS (SELECT *, {group} AS fam FROM lg), lo AS (SELECT o.fam AS left_out, lf.* FROM lf JOIN (SELECT DISTINCT fam FROM lf) o ON o.fam <> lf.fam),
  {sql_rho('lo', 'left_out, condition, block, metric')}, fo AS (SELECT left_out, condition, metric, {sql_fisher('pb')} AS rho FROM pb GROUP BY ALL),
  so AS (SELECT metric, left_out, avg(abs(rho)) AS mean_abs, sum({PASS}) AS pass FROM fo GROUP BY ALL)"""


@register("R21_leave_one_method_out", f"""WITH {sql_loo('method')} SELECT metric, count(*) AS left_outs, round(min(mean_abs), 9) AS lowest, round(max(mean_abs), 9) AS highest,
  CAST(min(pass) AS BIGINT) AS pass_min, CAST(max(pass) AS BIGINT) AS pass_max FROM so GROUP BY metric""")
def r21(spark, sf):
    d = va.leave_one_out_range(va.leave_one_out(va.settle(long(spark, sf))))
    return d.select("metric", "left_outs", *R("lowest", "highest"), "pass_min", "pass_max")


@register("R22_leave_family_out", f"WITH {sql_loo('right(method, 1)')} SELECT metric, left_out, round(mean_abs, 9) AS mean_abs, CAST(pass AS BIGINT) AS pass FROM so")
def r22(spark, sf):
    lg = va.settle(long(spark, sf).withColumn("family", F.right("method", F.lit(1))))
    d = va.score(va.leave_one_out(lg, "family"), ["metric", "left_out"])
    return d.select("metric", "left_out", *R("mean_abs"), "pass")


NULLS = 5000
_RANK = "rank() OVER (PARTITION BY condition, block ORDER BY {c}) + (count(*) OVER (PARTITION BY condition, block, {c}) - 1) / 2.0::DOUBLE AS r_{c}"
SQL_NULL = f"""{SQL_CELLS}, bs AS (SELECT condition, block, method, {", ".join(_RANK.format(c=c) for c in [*X, "y"])},
    row_number() OVER (PARTITION BY condition, block ORDER BY method) AS place, count(*) OVER (PARTITION BY condition, block) AS m FROM cl),
  dr AS (SELECT condition, block, method, r_y, m, d AS draw,
    row_number() OVER (PARTITION BY condition, block, d ORDER BY {hash_sql('42', 'd', 'block', 'method')}, method) AS shared,
    row_number() OVER (PARTITION BY condition, block, d ORDER BY {hash_sql('42', 'd', 'condition', 'block', 'method')}, method) AS indep,
    row_number() OVER (PARTITION BY condition, block, d ORDER BY {hash_sql('42', "'deal'", 'd', 'block', 'method')}, method) AS deal FROM bs CROSS JOIN range(1, {NULLS + 1}) t(d)),
  dj AS (SELECT dr.*, {", ".join(f"q.r_{x} AS s_{x}" for x in X)} FROM dr JOIN bs q ON q.condition = dr.condition AND q.block = dr.block AND q.place = dr.deal),
  pb AS (SELECT draw, condition, block, any_value(m) AS m, corr(shared, r_y) AS shared, corr(indep, r_y) AS indep, {", ".join(f"corr(s_{x}, r_y) AS s_{x}" for x in X)} FROM dj WHERE m >= 5 GROUP BY draw, condition, block),
  nl AS (SELECT 'shared' AS kind, '' AS metric, draw, condition, m, shared AS rho FROM pb UNION ALL SELECT 'independent', '', draw, condition, m, indep FROM pb
    UNION ALL {" UNION ALL ".join(f"SELECT 'shuffled', '{x}', draw, condition, m, s_{x} FROM pb" for x in X)}),
  nf AS (SELECT kind, metric, draw, condition, {sql_fisher('nl')} AS rho FROM nl WHERE NOT isnan(rho) GROUP BY ALL),
  ns AS (SELECT kind, metric, draw, round(avg(abs(rho)), 12) AS a, sum({PASS}) AS pass FROM nf GROUP BY ALL)"""


@register("R23_null_calibration", f"""WITH {SQL_NULL} SELECT kind, metric, count(*) AS draws, round(quantile_cont(a, 0.95), 8) AS p95, round(quantile_cont(a, 0.99), 8) AS p99,
  round(quantile_cont(a, 0.999), 8) AS p999, round(max(a), 8) AS highest, CAST(max(pass) AS BIGINT) AS max_pass FROM ns GROUP BY kind, metric""")
def r23(spark, sf):
    d = va.null_limits(va.null_draws(cells(spark, sf), X, NULLS))
    return d.select("kind", "metric", "draws", *R("p95", "p99", "p999", "highest", d=8), "max_pass")


SUB = 2000


@register("R24_subset_stability", f"""WITH {SQL_PB}, dr AS (SELECT block, d AS draw, row_number() OVER (PARTITION BY d ORDER BY {hash_sql('42', 'd', 'block')}, block) AS rk
    FROM (SELECT DISTINCT block FROM pb) CROSS JOIN range(1, {SUB + 1}) t(d)),
  sz AS (SELECT block, draw, k AS size FROM dr JOIN (VALUES (17), (23)) v(k) ON rk <= k),
  ls AS (SELECT size, draw, condition, metric, list_sort(list(round(rho, 12))) AS a FROM pb JOIN sz USING (block) GROUP BY ALL),
  iq AS (SELECT size, draw, metric, round(avg({sql_hazen(75, 'a', 'a')} - {sql_hazen(25, 'a', 'a')}), 12) AS iqr FROM ls GROUP BY ALL),
  md AS (SELECT size, metric, list_sort(list(iqr)) AS a, avg((iqr > 0.15)::INT) AS p FROM iq GROUP BY ALL)
  SELECT CAST(size AS BIGINT) AS size, metric, round({sql_hazen(50, 'a', 'a')}, 8) AS median_iqr, round(p, 8) AS p_above FROM md""")
def r24(spark, sf):
    d = va.subset_stability(va.settle(per_block(spark, sf)), [17, 23], SUB)
    return d.select("size", "metric", *R("median_iqr", "p_above", d=8))


BANDS = [(19900, 19980), (19980, 20000), (19900, 20100)]


@register("R24b_band_spread", f"WITH {SQL_PB}, bd AS (" + " UNION ALL ".join(
    f"SELECT '({a},{b}]' AS band, * FROM pb WHERE block > {a} AND block <= {b}" for a, b in BANDS) + f"""),
  ls AS (SELECT band, condition, metric, list_sort(list(round(rho, 12))) AS a FROM bd GROUP BY ALL)
  SELECT band, metric, CAST(max(len(a)) AS BIGINT) AS blocks, round(avg({sql_hazen(75, 'a', 'a')} - {sql_hazen(25, 'a', 'a')}), 8) AS iqr FROM ls GROUP BY ALL""")
def r24b(spark, sf):
    return va.band_spread(per_block(spark, sf), BANDS).select("band", "metric", "blocks", *R("iqr", d=8))


SQL_SCORE = f"""{SQL_FC}, {SQL_SPREAD}, sc AS (SELECT metric, avg(abs(rho)) AS mean_abs, sum({PASS}) AS pass, count(*) AS n_cond FROM fc GROUP BY metric),
  si AS (SELECT metric, round(avg(iqr), 12) AS iqr FROM sp GROUP BY metric), ss AS (SELECT * FROM sc JOIN si USING (metric))"""


def scores(spark, sf):
    pb = va.settle(per_block(spark, sf))
    iqr = ac.per_block_spread(pb, ["condition", "metric"]).groupBy("metric").agg(F.round(F.avg("iqr"), 12).alias("iqr"))
    return va.score(ac.fisher_combine(pb, ["condition", "metric"])).join(iqr, "metric")


@register("R25_threshold_sweep", f"""WITH {SQL_SCORE}, e AS (SELECT DISTINCT iqr AS lo FROM ss), g AS (SELECT 0.0::DOUBLE AS lo UNION ALL SELECT lo FROM e)
  SELECT round(g.lo, 9) AS lo, round((SELECT min(e.lo) FROM e WHERE e.lo > g.lo), 9) AS hi, (SELECT count(*) FROM ss WHERE ss.iqr <= g.lo) AS n,
  coalesce((SELECT string_agg(metric, ',' ORDER BY metric) FROM ss WHERE ss.iqr <= g.lo), '') AS recommended FROM g""")
def r25(spark, sf):
    d = va.threshold_sweep(scores(spark, sf), 0)
    return d.select(*R("lo", "hi"), "n", "recommended")


@register("R26_status", f"""WITH {SQL_SCORE} SELECT metric, round(mean_abs, 9) AS mean_abs, CAST(pass AS BIGINT) AS pass, n_cond,
  CASE WHEN pass >= 0.75 * n_cond THEN 'recommended' WHEN pass > 0 THEN 'moderate' ELSE 'discarded' END AS status FROM ss""")
def r26(spark, sf):
    return va.score(combined(spark, sf)).select("metric", *R("mean_abs"), "pass", "n_cond", va.status(F.col("pass"), F.col("n_cond")).alias("status"))


@register("R27_sign_stability", f"""WITH {SQL_FC} SELECT metric, count(*) AS n_cond, CAST(min(sign(round(rho, 12))) AS DOUBLE) AS lo, CAST(max(sign(round(rho, 12))) AS DOUBLE) AS hi,
  min(sign(round(rho, 12))) = max(sign(round(rho, 12))) AND min(sign(round(rho, 12))) <> 0 AS constant_sign FROM fc GROUP BY metric""")
def r27(spark, sf):
    return va.sign_stability(combined(spark, sf))


@register("R28_discrimination", f"""WITH {SQL_OBS}, l AS ({" UNION ALL ".join(f"SELECT condition, block, method, bin, '{x}' AS metric, {x} AS x FROM obs" for x in X)}),
  w AS (SELECT condition, metric, avg(v) AS wv FROM (SELECT condition, metric, block, method, bin, var_samp(x) AS v FROM l GROUP BY ALL) GROUP BY ALL),
  b AS (SELECT condition, metric, avg(v) AS bv FROM (SELECT condition, metric, block, var_samp(mu) AS v FROM (SELECT condition, metric, block, method, avg(x) AS mu FROM l GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)
  SELECT condition, metric, round(bv, 8) AS between_var, round(wv, 8) AS within_var, CASE WHEN wv > 0 THEN round(bv / wv, 9) WHEN bv > 0 THEN 'inf'::DOUBLE END AS ratio,
  CAST(CASE WHEN wv = 0 OR bv / wv >= 1000 THEN 0 ELSE greatest(1, ceil(round(wv / bv, 9))) END AS BIGINT) AS trials_needed FROM w JOIN b USING (condition, metric)""")
def r28(spark, sf):
    d = va.discrimination_ratio(obs(spark, sf), X)
    return d.select("condition", "metric", *R("between_var", "within_var", d=8), *R("ratio"), "trials_needed")


SQL_RS = f"""{SQL_PB}, rn AS (SELECT condition, block, method, metric, y, rx / count(*) OVER (PARTITION BY condition, block, metric) AS nx, ry / count(*) OVER (PARTITION BY condition, block, metric) AS ny FROM pb_r),
  st AS (SELECT condition, metric, method, count(*) AS blocks, 1 - least(stddev_samp(nx) / 0.5, 1.0) AS stability, 1 - least(stddev_samp(ny) / 0.5, 1.0) AS outcome_stability, avg(y) AS outcome FROM rn GROUP BY ALL HAVING count(*) >= 4)"""


@register("R29_rank_stability", f"WITH {SQL_RS} SELECT condition, metric, method, blocks, round(stability, 8) AS stability, round(outcome_stability, 8) AS outcome_stability FROM st")
def r29(spark, sf):
    s, _ = va.rank_stability(long(spark, sf))
    return s.select("condition", "metric", "method", "blocks", *R("stability", "outcome_stability", d=8))


@register("R29b_stability_correlation", f"""WITH {SQL_RS}, s2 AS (SELECT condition, metric, outcome, round(stability, 10) AS x, round(outcome_stability, 10) AS y FROM st),
  {sql_rho('s2', 'condition, metric', 8, 'a')}, s3 AS (SELECT condition, metric, x, outcome AS y FROM s2), {sql_rho('s3', 'condition, metric', 8, 'b')}
  SELECT condition, metric, a.m AS methods, round(a.rho, 8) AS with_stability, round(b.rho, 8) AS with_outcome FROM a JOIN b USING (condition, metric)""")
def r29b(spark, sf):
    _, c = va.rank_stability(long(spark, sf))
    return c.select("condition", "metric", "methods", *R("with_stability", "with_outcome", d=8))


@register("R31_anchor_check", """WITH g AS (SELECT p_brand AS method, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
  e AS (SELECT method, round(q, 3) + CASE WHEN method = 'Brand#1' THEN 0.01 ELSE 0 END AS expected, q FROM g)
  SELECT method, round(expected, 6) AS expected, round(q, 6) AS got, abs(q - expected) <= 0.001 AS ok FROM e""")
def r31(spark, sf):
    """Means over all trials against a table rounded to three places, one entry of it wrong."""
    o = obs(spark, sf)
    exp = ac.cell_means(o, ["x1"], "y").groupBy("method").agg((F.sum(F.col("n") * F.col("x1")) / F.sum("n")).alias("q"))
    exp = exp.select("method", (F.round("q", 3) + F.when(F.col("method") == "Brand#1", 0.01).otherwise(0.0)).alias("q"))
    got = o.groupBy("method").agg(F.avg("x1").alias("q"))
    return va.anchor_check(got, exp, ["method"], "q", 0.001).select("method", *R("expected", "got", d=6), "ok")


@register("R32_reference_table", f"""WITH {SQL_OBS}, c AS (SELECT condition, method, block, bin, count(*) AS n, avg(x1) AS x1, avg(y) AS y FROM obs GROUP BY ALL),
  p AS (SELECT condition, method, count(*) AS cells, min(n) AS lo, max(n) AS hi, avg(x1) AS x1, avg(y) AS y FROM c GROUP BY ALL)
  SELECT method, count(*) AS conditions, min(cells) = max(cells) AS same_cells, min(lo) = max(hi) AS balanced, round(avg(x1), 8) AS x1, round(avg(y), 1) AS y FROM p GROUP BY method""")
def r32(spark, sf):
    d = va.reference_table(obs(spark, sf), ["x1", "y"], ["block", "bin"])
    return d.select("method", "conditions", "same_cells", "balanced", *R("x1", d=8), *R("y", d=1))


@register("R33_campaign_matrix", f"""WITH {SQL_FC}, {SQL_SPREAD}, t AS (SELECT metric, condition, printf('%.3f', round(abs(rho), 3)) || CASE WHEN {PASS} < 1 THEN '*' ELSE '' END || ' / ' || printf('%.3f', round(iqr, 3)) AS s
  FROM fc JOIN sp USING (condition, metric)) SELECT metric, max(s) FILTER (condition = 'A') AS "A", max(s) FILTER (condition = 'N') AS "N", max(s) FILTER (condition = 'R') AS "R" FROM t GROUP BY metric""")
def r33(spark, sf):
    pb = va.settle(per_block(spark, sf))
    s = va.score(ac.fisher_combine(pb, ["condition", "metric"]), ["metric", "condition"]).join(
        ac.per_block_spread(pb, ["condition", "metric"]), ["condition", "metric"]).withColumnRenamed("condition", "campaign")
    return va.campaign_matrix(s, ["A", "N", "R"], 1)


SQL_PAIRED = f"""{SQL_STATS}, pt AS (SELECT method, frame_id, 'p' || (frame_id % 2) AS condition, frame_id % 5 AS bin, greatest(0.0, least(1.0, b.g - a.g)) AS delta_g, a.es AS eta_es, a.bs AS delta_bs,
  CAST({T} - a.mx AS DOUBLE) AS s_ecc, a.av / {T} AS u_ecc, a.g AS after_gini FROM a JOIN b USING (method, frame_id))"""


def paired(spark, sf):
    d = bl.trial_stats(frames_events(spark, sf), _perm(spark), CW, T)
    return d.withColumns({"condition": F.concat(F.lit("p"), (F.col("frame_id") % 2).cast("string")), "bin": F.col("frame_id") % 5})


#: Rules that keep a frame's length at the width used here; the others pad it.
SQL_PLAIN = f"pl AS (SELECT method FROM perm GROUP BY method HAVING max(pos) = {EVENT_W})"


def _plain(spark):
    return ro.extension(_perm(spark), ["method"]).where("n_out = n_rows").select("method")


@register("R34_column_identity", f"""WITH {SQL_PAIRED}, {SQL_PLAIN}, r AS (SELECT condition, frame_id, delta_g, u_ecc, round(delta_g, 12) AS va, round(u_ecc, 12) AS vb, method IN (SELECT method FROM pl) AS plain FROM pt),
  w AS (SELECT condition, max(abs(delta_g - u_ecc)) AS md, count(DISTINCT va) AS n_a, count(DISTINCT vb) AS n_b, count(DISTINCT va) FILTER (plain) AS n_a_plain, count(DISTINCT vb) FILTER (plain) AS n_b_plain FROM r GROUP BY ALL),
  t AS (SELECT condition, min(frame_id) AS block FROM r GROUP BY ALL),
  u AS (SELECT r.condition, block, count(DISTINCT va) AS n_a_block, count(DISTINCT vb) AS n_b_block FROM r JOIN t ON t.condition = r.condition AND t.block = r.frame_id GROUP BY ALL)
  SELECT condition, round(md, 9) AS max_diff, n_a, n_b, n_a_plain, n_b_plain, block, n_a_block, n_b_block, CASE WHEN md = 0 THEN 'identical' WHEN n_a_block <= 1 THEN 'constant within block' WHEN n_a_block > 2 THEN 'separates' ELSE 'mixed' END AS verdict
  FROM w JOIN u USING (condition)""")
def r34(spark, sf):
    p = paired(spark, sf).join(F.broadcast(_plain(spark).withColumn("plain", F.lit(True))), "method", "left")
    d = va.column_identity(p, ["condition"], "delta_g", "u_ecc", "frame_id", F.coalesce("plain", F.lit(False)))
    return d.select("condition", *R("max_diff"), "n_a", "n_b", F.col("n_a_subset").alias("n_a_plain"), F.col("n_b_subset").alias("n_b_plain"), "block", "n_a_block", "n_b_block", "verdict")


@register("R34b_column_by_block", f"""WITH {SQL_PAIRED}, l AS (SELECT condition, frame_id AS y, round(u_ecc, 12) AS x FROM pt), {sql_rho('l', 'condition', 3)} SELECT condition, m, round(rho, 9) AS rho FROM pb""")
def r34b(spark, sf):
    d = spearman_rows(paired(spark, sf), ["condition"], F.round("u_ecc", 12), "frame_id")
    return d.select("condition", "m", *R("rho"))


@register("R35_within_trial_invariance", f"""WITH {SQL_PAIRED}, l AS (SELECT 'u_ecc' AS metric, frame_id, u_ecc AS x FROM pt UNION ALL SELECT 'delta_g', frame_id, delta_g FROM pt)
  SELECT metric, frame_id, count(*) AS methods, round(max(x) - min(x), 9) AS spread, round(avg(abs(x)), 9) AS level, count(DISTINCT round(x, 12)) AS "distinct",
  (max(x) - min(x)) / greatest(avg(abs(x)), 2.220446049250313e-16) < 1e-9 AS invariant FROM l GROUP BY ALL""")
def r35(spark, sf):
    p = paired(spark, sf).select("frame_id", F.inline(F.array(
        F.struct(F.lit("u_ecc").alias("metric"), F.col("u_ecc").alias("x")), F.struct(F.lit("delta_g").alias("metric"), F.col("delta_g").alias("x")))))
    return va.within_trial_invariance(p, ["metric", "frame_id"], "x").select("metric", "frame_id", "methods", *R("spread", "level"), "distinct", "invariant")


@register("R35b_invariance_without_padding", f"""WITH {SQL_PAIRED}, {SQL_PLAIN}, pp AS (SELECT * FROM pt WHERE method IN (SELECT method FROM pl)), l AS (SELECT 'u_ecc' AS metric, frame_id, u_ecc AS x FROM pp UNION ALL SELECT 'delta_g', frame_id, delta_g FROM pp)
  SELECT metric, frame_id, count(*) AS methods, round(max(x) - min(x), 9) AS spread, round(avg(abs(x)), 9) AS level, count(DISTINCT round(x, 12)) AS "distinct",
  (max(x) - min(x)) / greatest(avg(abs(x)), 2.220446049250313e-16) < 1e-9 AS invariant FROM l GROUP BY ALL""")
def r35b(spark, sf):
    p = paired(spark, sf).join(F.broadcast(_plain(spark)), "method", "left_semi").select("frame_id", F.inline(F.array(
        F.struct(F.lit("u_ecc").alias("metric"), F.col("u_ecc").alias("x")), F.struct(F.lit("delta_g").alias("metric"), F.col("delta_g").alias("x")))))
    return va.within_trial_invariance(p, ["metric", "frame_id"], "x").select("metric", "frame_id", "methods", *R("spread", "level"), "distinct", "invariant")


@register("R33b_discarded_rest", f"""WITH {SQL_FC} SELECT condition AS campaign, count(*) AS metrics, round(max(abs(rho)), 8) AS rho_max, CAST(max({PASS}) AS BIGINT) AS pass_max FROM fc WHERE metric <> 'x1' GROUP BY condition""")
def r33b(spark, sf):
    s = va.score(ac.fisher_combine(per_block(spark, sf), ["condition", "metric"]), ["metric", "condition"]).withColumnRenamed("condition", "campaign")
    return va.discarded_rest(s, ["x1"]).select("campaign", "metrics", *R("rho_max", d=8), "pass_max")
