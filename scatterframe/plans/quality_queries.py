"""H0-H9, HA1-HA5: quality checks of line items as trials and of paired, reordered frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import union_all
from ..functions.numeric import EPS
from ..operators import bursts as bu
from ..operators import kpi as kp
from ..operators import load as ld
from ..operators import quality as qa
from ..operators import reorder as ro
from ..operators import structure as st
from ..operators.blockload import block_loads
from ..sources.tables import EVENT_W, ORDER_W, SQL_OBS, frames_events, frames_orders, obs, sql_frames, table
from .blockload_queries import CW, T, sql_loads
from .burst_queries import EXTENDING, LEVELS, sql_burst, sql_hazen
from .kpi_queries import SQL_CORE, R, core, sql_z
from .perm_sql import perms_sql
from .registry import ORACLES, QUERIES, register

CELL = ["condition", "method", "block", "bin"]


def files(spark, sf):
    """One entry per (status, year of orders): a condition seen in several years counts as several files."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderstatus").alias("condition"), F.year("o_orderdate").alias("year")).distinct()


@register("H0_condition_inventory", """WITH d AS (SELECT DISTINCT o_orderstatus AS condition, year(o_orderdate) AS y FROM orders), c AS (SELECT condition, count(*) AS copies FROM d GROUP BY ALL)
  SELECT condition, copies, CAST((SELECT sum(copies) FROM c) AS BIGINT) AS present, copies = 1 AND (SELECT sum(copies) FROM c) = 8 AS ok FROM c""")
def h0(spark, sf):
    return qa.condition_inventory(files(spark, sf), 8)


def sql_occupancy(src="obs", runs=None):
    want = str(runs) if runs else "max(n)"
    return f"""oc AS (SELECT condition, method, block, bin, count(*) AS n FROM {src} GROUP BY ALL), o1 AS (SELECT condition, count(*) AS cells, count(DISTINCT method) * count(DISTINCT block) * count(DISTINCT bin) AS expected,
      min(n) AS fewest, max(n) AS most, {want} AS runs FROM oc GROUP BY condition), o2 AS (SELECT condition, count(*) FILTER (n <> runs) AS off_count FROM oc JOIN o1 USING (condition) GROUP BY condition),
    occ AS (SELECT condition, cells, expected, expected - cells AS missing, fewest, most, off_count, expected = cells AND off_count = 0 AS ok FROM o1 JOIN o2 USING (condition))"""


@register("H1_cell_occupancy", f"WITH {SQL_OBS}, {sql_occupancy()} SELECT * FROM occ")
def h1(spark, sf):
    return qa.cell_occupancy(obs(spark, sf), ["condition"], ["method", "block", "bin"])


def paired_rows(spark, sf):
    """One row per (frame, rule): length, size class of the trial and realised density after padding."""
    f = frames_events(spark, sf).groupBy("frame_id", "n_rows").agg(F.sum("hit").alias("hits"))
    ext = ro.extension(ro.permutations(spark, EXTENDING, EVENT_W), ["method"])
    j = f.select("*", F.inline(ext.agg(F.array_agg(F.struct("method", "n_out")).alias("e")).scalar()))
    return j.select(F.concat(F.lit("p"), (F.col("frame_id") % 2).cast("string")).alias("condition"), "frame_id", "method",
                    F.col("n_rows").alias("length"), (F.col("hits") % 3).alias("bin"), F.col("n_out").alias("int_len"), (F.col("hits") / F.col("n_out")).alias("actual"))


SQL_DENS = f"""{sql_frames()}, {perms_sql(EXTENDING, EVENT_W)}, e AS (SELECT method, max(pos) AS n_out FROM perm GROUP BY method),
  h AS (SELECT frame_id, sum(hit) AS hits FROM f GROUP BY frame_id), pr AS (SELECT 'p' || (frame_id % 2) AS condition, frame_id, method, {EVENT_W} AS length, hits % 3 AS bin, n_out AS int_len, hits::DOUBLE / n_out AS actual FROM h CROSS JOIN e)"""


@register("H2_pairing", f"""WITH {SQL_DENS}, d AS (SELECT * FROM pr WHERE NOT (frame_id % 7 = 3 AND method = 'block')), nm AS (SELECT condition, count(DISTINCT method) AS k FROM d GROUP BY ALL),
  t AS (SELECT condition, frame_id, count(*) AS r, count(DISTINCT method) AS m, (min(length) <> max(length))::INT AS dl, (min(bin) <> max(bin))::INT AS db FROM d GROUP BY ALL)
  SELECT condition, any_value(k) AS methods, count(*) AS trials, count(*) FILTER (r <> k OR m <> k) AS incomplete, CAST(sum(dl) AS BIGINT) AS diff_length, CAST(sum(db) AS BIGINT) AS diff_bin,
  count(*) FILTER (r <> k OR m <> k) = 0 AND sum(dl) = 0 AND sum(db) = 0 AS ok FROM t JOIN nm USING (condition) GROUP BY condition""")
def h2(spark, sf):
    """Some trials lose one method, which the check must report."""
    d = paired_rows(spark, sf).where(~((F.col("frame_id") % 7 == 3) & (F.col("method") == "block")))
    return qa.pairing(d, ["condition"], ["frame_id"], ["length", "bin"])


@register("H3_length_resolution", f"WITH {SQL_OBS} SELECT condition, count(DISTINCT block) AS lengths, CAST(28 AS BIGINT) AS intended, count(DISTINCT block) >= 28 AS ok FROM obs GROUP BY condition")
def h3(spark, sf):
    return qa.length_resolution(obs(spark, sf), ["condition"], "block", 28)


FIELDS = ["cr", "be", "share", "gain"]


def fields(spark, sf):
    c = core(spark, sf)
    return c.withColumns({"share": F.when(F.col("actual") > 0, F.col("cr")), "gain": F.when(F.col("bin") == 3, F.lit(float("inf"))).otherwise(F.col("cr"))})


@register("H4_field_integrity", f"""WITH {SQL_CORE}, l AS (SELECT condition, 'cr' AS field, cr AS x FROM core UNION ALL SELECT condition, 'be', be FROM core
  UNION ALL SELECT condition, 'share', CASE WHEN actual > 0 THEN cr END FROM core UNION ALL SELECT condition, 'gain', CASE WHEN bin = 3 THEN 'inf'::DOUBLE ELSE cr END FROM core)
  SELECT condition, field, count(*) AS n, count(*) FILTER (x IS NULL OR isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_inf, count(*) FILTER (x IS NULL OR isnan(x) OR isinf(x)) = 0 AS ok FROM l GROUP BY ALL""")
def h4(spark, sf):
    return qa.field_integrity(fields(spark, sf), ["condition"], FIELDS)


TWO = "method NOT IN ('Brand#11', 'Brand#2')"


SQL_REBUILD = f"""{SQL_CORE}, {sql_z(TWO)}, t AS (SELECT condition, method, cr, be, 0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z AS res FROM z),
  m AS (SELECT DISTINCT condition, method FROM t),
  ca AS (SELECT condition, '' AS x, '' AS y FROM m UNION SELECT condition, method, '' FROM m UNION SELECT a.condition, a.method, b.method FROM m a JOIN m b ON a.condition = b.condition AND a.method < b.method),
  mo AS (SELECT ca.condition, x, y, avg(cr) AS m1, stddev_samp(cr) AS s1, avg(be) AS m2, stddev_samp(be) AS s2 FROM ca JOIN t ON t.condition = ca.condition AND method <> x AND method <> y GROUP BY ALL),
  er AS (SELECT condition, x, y, max(abs(0.5::DOUBLE * (cr - m1) / (s1 + 2.220446049250313e-16) + 0.5::DOUBLE * (be - m2) / (s2 + 2.220446049250313e-16) - res)) AS e FROM t JOIN mo USING (condition) GROUP BY ALL),
  be AS (SELECT condition, min(e) AS e, arg_min(CASE WHEN y = '' THEN x ELSE x || ',' || y END, e) AS left_out FROM er GROUP BY condition),
  ft AS (SELECT condition, avg(cr) AS mc, avg(be) AS mb, avg(res) AS mr, var_samp(cr) AS cc, var_samp(be) AS bb, covar_samp(cr, be) AS cb, covar_samp(cr, res) AS c_, covar_samp(be, res) AS b_ FROM t GROUP BY condition),
  co AS (SELECT *, (c_ * bb - b_ * cb) / (cc * bb - cb * cb) AS a1, (b_ * cc - c_ * cb) / (cc * bb - cb * cb) AS a2 FROM ft),
  rs AS (SELECT condition, max(abs(res - mr - a1 * (cr - mc) - a2 * (be - mb))) AS e FROM t JOIN co USING (condition) GROUP BY condition)"""


@register("H5_kpi_reconstruction", f"""WITH {SQL_REBUILD}, rc AS (SELECT condition, max(abs(cr - cr_raw * c_nn)) AS e FROM core GROUP BY condition)
  SELECT condition, round(rc.e, 7) AS err_cr, round(rs.e, 7) AS err_fit, round(be.e, 7) AS err_res, left_out, rc.e < 1e-9 AND rs.e < 1e-9 AND be.e < 1e-9 AS ok FROM be JOIN rc USING (condition) JOIN rs USING (condition)""")
def h5(spark, sf):
    """RES was standardised without two brands; the check must find which."""
    c = core(spark, sf)
    z = kp.res_composite(kp.zscore(c, ["condition"], ["cr", "be"], ~F.col("method").isin("Brand#11", "Brand#2")))
    d = qa.kpi_reconstruction(z.withColumn("cr_again", F.col("cr_raw") * F.col("c_nn")), ["condition"])
    return d.select("condition", *R("err_cr", "err_fit", "err_res", d=7), "left_out", "ok")


@register("H6_method_field", f"WITH {SQL_OBS} SELECT condition, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM obs GROUP BY condition")
def h6(spark, sf):
    return qa.method_field(obs(spark, sf), ["condition"])


@register("HA1_noise_fairness", f"""WITH {SQL_DENS}, t AS (SELECT condition, frame_id, max(abs(actual * int_len - round_)) AS dev, round((max(actual) - min(actual)) / (avg(actual) + 2.220446049250313e-16), 12) AS spread
    FROM (SELECT *, round(avg(actual * int_len) OVER (PARTITION BY condition, frame_id)) AS round_ FROM pr) GROUP BY ALL), l AS (SELECT condition, list_sort(list(spread)) AS a, max(dev) AS w FROM t GROUP BY condition)
  SELECT condition, CAST(len(a) AS BIGINT) AS trials, round(w, 6) AS worst_count, round(list_max(a), 9) AS max_spread, round({sql_hazen(50, 'a', 'a')}, 9) AS median_spread, w > 0.5 AS flag FROM l""")
def ha1(spark, sf):
    d = qa.noise_fairness(paired_rows(spark, sf), ["condition"], ["frame_id"], "actual", "int_len")
    return d.select("condition", "trials", *R("worst_count", d=6), *R("max_spread", "median_spread"), "flag")


SQL_VAR = """vr AS (SELECT condition, method, avg(v) AS v FROM (SELECT condition, method, block, bin, coalesce(var_samp(x1), 0) AS v FROM obs GROUP BY ALL) GROUP BY ALL HAVING avg(v) > 0),
  va AS (SELECT condition, arg_max(method, v) AS widest, arg_min(method, v) AS narrowest, max(v) / min(v) AS ratio FROM vr GROUP BY condition)"""


@register("HA2_variance_ratio", f"WITH {SQL_OBS}, {SQL_VAR} SELECT condition, widest, narrowest, round(ratio, 8) AS ratio, ratio > 4 AS flag FROM va")
def ha2(spark, sf):
    d = qa.variance_ratio(obs(spark, sf), ["condition"], ["block", "bin"], "x1")
    return d.select("condition", "widest", "narrowest", *R("ratio", d=8), "flag")


@register("HA3_outliers", f"""WITH {SQL_OBS}, l AS (SELECT condition, method, bin, list_sort(list(y)) AS a FROM obs GROUP BY ALL), q AS (SELECT *, {sql_hazen(25, 'y', 'a')} AS q1, {sql_hazen(75, 'y', 'a')} AS q3, len(a) AS n FROM l),
  s AS (SELECT condition, sum(n) AS rows, min(n) AS smallest, sum(len(list_filter(a, lambda v: v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)))) AS o FROM q GROUP BY condition)
  SELECT condition, CAST(rows AS BIGINT) AS rows, CAST(smallest AS BIGINT) AS smallest, CASE WHEN smallest >= 10 THEN CAST(o AS BIGINT) END AS outside, CASE WHEN smallest >= 10 THEN round(100.0::DOUBLE * o / rows, 8) END AS pct,
  coalesce(smallest >= 10 AND 100.0 * o / rows > 2, false) AS flag FROM s""")
def ha3(spark, sf):
    d = qa.outliers(obs(spark, sf), ["condition"], ["method", "bin"], "y")
    return d.select("condition", "rows", "smallest", "outside", *R("pct", d=8), "flag")


@register("HA4_block_count", f"WITH {SQL_OBS} SELECT condition, count(DISTINCT block) AS blocks, count(DISTINCT block) < 20 AS flag FROM obs GROUP BY condition")
def ha4(spark, sf):
    return qa.block_count(obs(spark, sf), ["condition"], "block")


@register("HA5_residual_shape", f"""WITH {SQL_OBS}, r AS (SELECT condition, x1 - avg(x1) OVER (PARTITION BY condition, method, block, bin) AS r FROM obs), s AS (SELECT condition, stddev_samp(r) AS sd FROM r GROUP BY condition)
  SELECT condition, count(*) AS n, round(avg((r / sd) ** 3), 7) AS skewness, round(avg((r / sd) ** 4), 7) AS kurtosis FROM r JOIN s USING (condition) GROUP BY condition""")
def ha5(spark, sf):
    return qa.residual_shape(obs(spark, sf), ["condition"], ["method", "block", "bin"], "x1").select("condition", "n", *R("skewness", "kurtosis", d=7))


#: Every check: its query, whether it blocks, and the condition (of SQL and of Spark) under which a row of it is in order.
#: Condition N is held to one block more than it has, and the variance ratio to a tighter limit than its own query.
CHECKS = {
    "H0_condition_inventory": (True, "ok"), "H1_cell_occupancy": (True, "ok"), "H2_pairing": (True, "ok"),
    "H3_length_resolution": (True, "lengths >= CASE WHEN condition = 'N' THEN 29 ELSE 28 END"), "H4_field_integrity": (True, "ok"),
    "H5_kpi_reconstruction": (True, "ok"), "H6_method_field": (True, "n_methods >= 25"), "HA1_noise_fairness": (False, "NOT flag"),
    "HA2_variance_ratio": (False, "ratio <= 1.15"), "HA3_outliers": (False, "NOT flag"), "HA4_block_count": (False, "NOT flag"),
    "HA5_residual_shape": (False, "abs(skewness) <= 1 AND abs(kurtosis - 3) <= 2"),
}


@register("H7_verdict", "WITH ck AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, condition, {str(blocking).lower()} AS blocking, bool_and({ok}) AS ok FROM ({ORACLES[name]}) GROUP BY condition" for name, (blocking, ok) in CHECKS.items()) + """)
  SELECT condition, count(*) AS checks, count(*) FILTER (blocking AND NOT ok) AS failed, count(*) FILTER (NOT blocking AND NOT ok) AS cautions,
  CASE WHEN count(*) FILTER (blocking AND NOT ok) > 0 THEN 'NOT QUOTABLE' WHEN count(*) FILTER (NOT blocking AND NOT ok) > 0 THEN 'QUOTABLE WITH CAVEATS' ELSE 'QUOTABLE' END AS verdict FROM ck GROUP BY condition""")
def h7(spark, sf):
    """All twelve checks; those on frames and on orders have conditions of their own."""
    parts = [QUERIES[name](spark, sf).groupBy("condition").agg(F.bool_and(F.expr(ok)).alias("ok")).select("condition", F.lit(blocking).alias("blocking"), "ok", F.lit(name).alias("check"))
             for name, (blocking, ok) in CHECKS.items()]
    return qa.verdict(union_all(parts))


SQL_COV = """li AS (SELECT l_returnflag AS condition, p_brand AS method, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS block FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sparse(spark, sf):
    """Ship days as lengths, of which every method lacks some."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_returnflag").alias("condition"), F.col("p_brand").alias("method"), F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("block"))


@register("H8_length_coverage", f"""WITH {SQL_COV}, t AS (SELECT condition, count(DISTINCT block) AS total FROM li GROUP BY ALL), s AS (SELECT condition, method, count(DISTINCT block) AS lengths, count(*) AS rows FROM li GROUP BY ALL)
  SELECT condition, method, lengths, rows, total - lengths AS lacking, total = lengths AS complete FROM s JOIN t USING (condition)""")
def h8(spark, sf):
    return qa.length_coverage(sparse(spark, sf), ["condition"], "block")


@register("H8b_missing_lengths", f"""WITH {SQL_COV}, m AS (SELECT DISTINCT condition, method FROM li), b AS (SELECT DISTINCT block FROM li)
  SELECT condition, method, block FROM m CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.condition = m.condition AND li.method = m.method AND li.block = b.block)""")
def h8b(spark, sf):
    s = sparse(spark, sf)
    blocks = s.agg(F.array_sort(F.collect_set("block")).alias("b")).scalar()
    expected = s.select("condition", "method").distinct().withColumn("block", F.explode(blocks))
    return qa.missing_lengths(s, expected, ["condition"], "block")


SCREENED = ["block", "snake", "goldenRP", "convolutional", "freqDeterm", "time", "identity", "hierarchical"]
B = 24


def _screen_sql(source: str, width: int, rules: list[str]) -> str:
    """Bursts of three sizes in every whole frame, and what they and the rules' own structure say of each rule."""
    return "WITH " + sql_loads(f"""{sql_burst(source)}, {perms_sql(rules, width)}, f2 AS (SELECT f.frame_id * 10 + b.bin AS frame_id, f.pos, (f.pos BETWEEN b.start AND b.start + b.size - 1)::INT AS hit
  FROM f JOIN bursts b ON b.frame_id = f.frame_id)""", "f2", width) + f""", cr AS (SELECT method, frame_id, greatest(0.0, 1 - (coalesce(sum(load) FILTER (phase = 'after' AND load > {T}), 0)::DOUBLE / {width})
    / (coalesce(sum(load) FILTER (phase = 'before' AND load > {T}), 0)::DOUBLE / {width} + 2.220446049250313e-16)) AS cr FROM loads GROUP BY ALL),
  e AS (SELECT method, max(pos) AS n_out, {width}.0::DOUBLE / max(pos) AS be FROM perm GROUP BY method), cb AS (SELECT * FROM cr JOIN e USING (method)),
  g AS (SELECT avg(cr) AS mu, stddev_samp(cr) AS sd, avg(be) AS mub, stddev_samp(be) AS sdb FROM cb),
  k AS (SELECT method, avg(cr) AS cr, avg((cr = 0)::INT) AS zero_share, (avg(cr) - any_value(mu)) / (any_value(sd) + 2.220446049250313e-16) AS cr_z, any_value((be - mub) / (sdb + 2.220446049250313e-16)) AS be_z FROM cb CROSS JOIN g GROUP BY method),
  rm AS (SELECT method, pos, src, max(src) OVER (PARTITION BY method ORDER BY pos) AS hi FROM perm), br AS (SELECT method, pos - coalesce(lag(pos) OVER (PARTITION BY method ORDER BY pos), 0) AS w FROM rm WHERE hi = pos),
  wd AS (SELECT method, max(w) / {width}.0::DOUBLE AS widest_share FROM br GROUP BY method), rc AS (SELECT method, max(abs(src - pos)) / count(*)::DOUBLE AS reach, avg((src = pos)::INT) AS fixed_share FROM perm GROUP BY method),
  wc AS (SELECT method, s, (src - 1) // {CW} AS cw, count(*) AS l FROM perm JOIN e USING (method) JOIN range(1, {2 * width}) r(s) ON s <= n_out - {B} + 1 AND pos BETWEEN s AND s + {B} - 1 GROUP BY ALL), wm AS (SELECT method, s, max(l) AS mx FROM wc GROUP BY ALL),
  ov AS (SELECT method, avg((mx > {T})::INT) AS over_share, max(mx) AS max_load FROM wm GROUP BY method),
  a_ AS (SELECT *, round(0.5::DOUBLE * be_z, 12) AS bp, round(0.5::DOUBLE * cr_z, 12) AS cp, 0.5::DOUBLE * cr_z + 0.5::DOUBLE * be_z AS res FROM k JOIN wd USING (method) JOIN rc USING (method) JOIN ov USING (method)),
  t_ AS (SELECT *, concat_ws(' + ', CASE WHEN widest_share < 0.25 THEN 'CONFINED' END, CASE WHEN zero_share > 0.2 THEN 'CENSORED' END, CASE WHEN res < 0 AND bp < 0 AND abs(bp) > abs(cp) THEN 'RATE-LIMITED' END,
    CASE WHEN over_share > 0.5 AND widest_share >= 0.25 THEN 'CAPACITY-EXCEEDED' END, CASE WHEN fixed_share > 0.5 THEN 'DEGENERATE' END) AS t FROM a_)
  SELECT method, round(res, 8) AS res, round(zero_share, 9) AS zero_share, round(widest_share, 9) AS widest_share, round(reach, 9) AS reach, round(fixed_share, 9) AS fixed_share, round(over_share, 9) AS over_share,
  max_load, CASE WHEN t = '' THEN 'in scope' ELSE t END AS screen FROM t_"""


def _screen(f, perm, width: int):
    lv = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("bin"), F.lit(x).alias("level")) for i, x in enumerate(LEVELS)])
    r = f.select("frame_id", "n_rows", "pos", F.inline(lv)).withColumn("size", bu.burst_size(F.col("level"), F.col("n_rows")))
    start = bu.hash32(F.lit(42), "frame_id", "bin") % (F.col("n_rows") - F.col("size") + 1) + 1
    r = r.select((F.col("frame_id") * 10 + F.col("bin")).alias("frame_id"), "n_rows", "pos",
                 ((F.col("pos") >= start) & (F.col("pos") < start + F.col("size"))).cast("int").alias("hit"))
    heads = r.where(F.col("pos") == 1).select("frame_id", "n_rows")
    cr = bu.block_failure(block_loads(r, perm, CW), T, heads).select("method", F.col("contribution").alias("cr"))
    cr = cr.join(F.broadcast(ro.extension(perm, ["method"]).select("method", "be")), "method")
    cells = kp.moments(cr.withColumn("zero", (F.col("cr") == 0).cast("double")), ["method"], ["cr", "zero", "be"])
    m = cells.withColumn("all", F.lit(1)).select("*", *kp.merged(cells.withColumn("all", F.lit(1)), ["all"], ["cr", "be"]))
    z = {c: (F.col(f"m_{c}") - F.col(f"mu_{c}")) / (F.col(f"sd_{c}") + EPS) for c in ("cr", "be")}
    k = m.select("method", z["cr"].alias("cr_z"), z["be"].alias("be_z"), (0.5 * z["cr"] + 0.5 * z["be"]).alias("res"), F.col("m_zero").alias("zero_share"))
    n = F.lit(float(width))
    s = (
        st.closed_blocks(perm, ["method"]).select("method", (F.col("widest") / n).alias("widest_share"))
        .join(st.reach(perm, ["method"]).select("method", "reach", F.col("fixed").alias("fixed_share")), "method")
        .join(ld.load_metrics(perm, ["method"], [B], CW, T).select("method", F.col("over_t").alias("over_share"), F.col("max_err").alias("max_load")), "method")
    )
    d = qa.method_screen(k, s)
    return d.select("method", *R("res", d=8), *R("zero_share", "widest_share", "reach", "fixed_share", "over_share"), "max_load", "screen")


@register("H9_method_screen", _screen_sql("orders", ORDER_W, SCREENED))
def h9(spark, sf):
    return _screen(frames_orders(spark, sf), ro.permutations(spark, SCREENED, ORDER_W), ORDER_W)


#: Among these, five rules lengthen a frame of 200 rows to 210.
LENGTHENING = [*SCREENED, "matrix", "helical", "helicalScan", "spiral", "prime"]


@register("H9b_screen_of_lengthening_rules", _screen_sql("events", EVENT_W, LENGTHENING))
def h9b(spark, sf):
    """Rules that pad their frames, so the rate flag can fire."""
    return _screen(frames_events(spark, sf), ro.permutations(spark, LENGTHENING, EVENT_W), EVENT_W)
