"""Block loads of real error masks, before and after reordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import blockload as bl
from ..operators import reorder as ro
from ..sources.tables import EVENT_W, SQL_OBS, frames_events, hundredths, obs, sql_frames
from .perm_sql import perms_sql
from .registry import register

CW, T = 15, 3
PAIRED = ["block", "snake", "goldenRP", "convolutional", "random", "diagonal", "S", "time"]


def sql_loads(head: str, f: str, n: int) -> str:
    """Zero-filled block loads of the frames in ``f`` under every rule of the CTE perm."""
    return f"""{head}, ids AS (SELECT DISTINCT frame_id FROM {f}), ks AS (SELECT range AS cw FROM range(1, {-(-n // CW) + 1})),
  ph AS (SELECT method, frame_id, pos, src FROM {f} JOIN perm USING (pos) WHERE hit = 1),
  cnt AS (SELECT method, frame_id, 'before' AS phase, (pos + {CW} - 1) // {CW} AS cw, count(*) AS c FROM ph GROUP BY ALL
    UNION ALL SELECT method, frame_id, 'after', (src + {CW} - 1) // {CW}, count(*) FROM ph WHERE src <= {n} GROUP BY ALL),
  loads AS (SELECT m.method, i.frame_id, p.phase, k.cw, coalesce(c, 0) AS load
    FROM (SELECT DISTINCT method FROM perm) m CROSS JOIN ids i CROSS JOIN (VALUES ('before'), ('after')) p(phase)
    CROSS JOIN ks k LEFT JOIN cnt USING (method, frame_id, phase, cw))"""


SQL_LOADS = sql_loads(f"{sql_frames()}, {perms_sql(PAIRED, EVENT_W)}", "f", EVENT_W)

SQL_STAT_CTES = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY method, frame_id, phase ORDER BY load) AS i FROM loads),
  st AS (SELECT method, frame_id, phase, count(*) AS k, sum(load) AS h, count(*) FILTER (load > 0) AS nz,
    coalesce(min(load) FILTER (load > 0), 0) AS mn, max(load) AS mx, avg(load) AS av, var_samp(load) AS va,
    stddev_samp(load) AS sd, count(*) FILTER (load > {T}) AS ov, count(*) FILTER (load = {T}) AS mg,
    count(*) FILTER (load <= {T} AND load > 0) AS ok, stddev_samp(load) FILTER (load > 0) AS sdz, avg(load) FILTER (load > 0) AS avz,
    CASE WHEN sum(load) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 2.0::DOUBLE * sum(i * load) / (count(*) * sum(load)) - (count(*) + 1.0::DOUBLE) / count(*))) END AS g
    FROM rk GROUP BY ALL),
  st2 AS (SELECT *, nz::DOUBLE / k AS oc, CASE WHEN h = 0 THEN 1.0 ELSE 1 / (1 + va / (av * av + 2.220446049250313e-16)) END AS un,
    CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE nz::DOUBLE / least(k, h) END AS es,
    CASE WHEN nz <= 1 THEN 1.0::DOUBLE ELSE 1 / (1 + sdz / avz) END AS bs FROM st),
  b AS (SELECT * FROM st2 WHERE phase = 'before'), a AS (SELECT * FROM st2 WHERE phase = 'after')"""
SQL_STATS = f"{SQL_LOADS}, {SQL_STAT_CTES}"
J = "FROM a JOIN b USING (method, frame_id)"


def _frames(spark, sf):
    return frames_events(spark, sf)


def _perm(spark):
    return ro.permutations(spark, PAIRED, EVENT_W)


def loads(spark, sf, dense=False):
    return bl.block_loads(_frames(spark, sf), _perm(spark), CW, dense=dense)


def stats(spark, sf):
    return bl.load_stats(loads(spark, sf), CW, T)


def sides(spark, sf):
    return bl.sides(stats(spark, sf))


@register("E1_block_loads", f"WITH {SQL_LOADS} SELECT method, frame_id, phase, cw, CAST(load AS BIGINT) AS load FROM loads")
def e1(spark, sf):
    return loads(spark, sf, dense=True).drop("n_rows")


@register("E2_block_load_stats", f"""WITH {SQL_STATS} SELECT method, frame_id, phase, k AS blocks, CAST(h AS BIGINT) AS hits,
  nz AS noisy_blocks, mn AS load_min, mx AS load_max, round(av, 9) AS load_avg, round(va, 9) AS load_var, round(sd, 9) AS load_sd,
  round(oc, 9) AS occupancy, round(un, 9) AS uniformity FROM st2""")
def e2(spark, sf):
    return stats(spark, sf).select(
        "method", "frame_id", "phase", "blocks", "hits", "noisy_blocks", "load_min", "load_max",
        *[rnd(c).alias(c) for c in ("load_avg", "load_var", "load_sd", "occupancy", "uniformity")])


@register("E3_gini", f"""WITH {sql_frames()}, r AS (SELECT frame_id, CAST(round(value * 100) AS BIGINT) AS x,
  row_number() OVER (PARTITION BY frame_id ORDER BY value) AS i FROM f)
  SELECT frame_id, round(greatest(0.0, least(1.0, 2.0::DOUBLE * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0::DOUBLE) / count(*))), 9) AS gini
  FROM r GROUP BY frame_id""")
def e3(spark, sf):
    f = _frames(spark, sf).withColumn("x", hundredths("value"))
    return bl.gini(f, ["frame_id"], "x").select("frame_id", rnd("gini").alias("gini"))


@register("E4_delta_gini", f"""WITH {SQL_STATS} SELECT method, frame_id, round(b.g, 9) AS before_gini, round(a.g, 9) AS after_gini,
  round(greatest(0.0, least(1.0, b.g - a.g)), 9) AS delta_g {J}""")
def e4(spark, sf):
    d = bl.delta_gini(sides(spark, sf))
    return d.select("method", "frame_id", *[rnd(c).alias(c) for c in ("before_gini", "after_gini", "delta_g")])


@register("E5_capacity_stats", f"""WITH {SQL_STATS} SELECT method, frame_id, CAST({T} - mx AS BIGINT) AS s_ecc,
  round(({T} - mx)::DOUBLE / {T}, 9) AS s_ecc_norm, ov AS v_ecc, round(av / {T}, 9) AS u_ecc FROM a""")
def e5(spark, sf):
    d = bl.ecc_stats(sides(spark, sf), T)
    return d.select("method", "frame_id", "s_ecc", rnd("s_ecc_norm").alias("s_ecc_norm"), "v_ecc", rnd("u_ecc").alias("u_ecc"))


@register("E6_spreading", f"""WITH {SQL_STATS} SELECT method, frame_id, CAST(h AS BIGINT) AS hits, nz AS noisy_blocks,
  round(es, 9) AS eta_es, round(bs, 9) AS delta_bs FROM a""")
def e6(spark, sf):
    return sides(spark, sf).select(
        "method", "frame_id", F.col("after_hits").alias("hits"), F.col("after_noisy_blocks").alias("noisy_blocks"),
        rnd("after_eta_es").alias("eta_es"), rnd("after_delta_bs").alias("delta_bs"))


E7 = ["compliance_gain", "before_margin_avg", "after_margin_avg", "before_margin_min", "after_margin_min", "before_use", "after_use",
      "before_correctable_ratio", "after_correctable_ratio", "occupancy_gain", "uniformity_gain", "variance_reduction",
      "sd_reduction", "concentration_reduction_norm"]
SQL_E7 = f"""{SQL_STATS}, e AS (SELECT method, frame_id, b.ov - a.ov AS violation_reduction,
  (a.k - a.ov)::DOUBLE / a.k - (b.k - b.ov)::DOUBLE / b.k AS compliance_gain, {T} - b.av AS before_margin_avg, {T} - a.av AS after_margin_avg,
  CAST({T} - b.mx AS DOUBLE) AS before_margin_min, CAST({T} - a.mx AS DOUBLE) AS after_margin_min,
  least(1.0, b.av / {T}) AS before_use, least(1.0, a.av / {T}) AS after_use,
  CASE WHEN b.nz = 0 THEN 1.0::DOUBLE ELSE b.ok::DOUBLE / b.nz END AS before_correctable_ratio,
  CASE WHEN a.nz = 0 THEN 1.0::DOUBLE ELSE a.ok::DOUBLE / a.nz END AS after_correctable_ratio,
  a.oc - b.oc AS occupancy_gain, a.un - b.un AS uniformity_gain, b.va - a.va AS variance_reduction, b.sd - a.sd AS sd_reduction,
  CASE WHEN greatest(b.mx, a.mx) > 0 THEN (b.mx - a.mx)::DOUBLE / greatest(b.mx, a.mx) ELSE 0.0::DOUBLE END AS concentration_reduction_norm,
  b.nz AS bnz, a.nz AS anz {J})"""


@register("E7_efficiency", f"WITH {SQL_E7} SELECT method, frame_id, violation_reduction, "
          + ", ".join(f"round({c}, 9) AS {c}" for c in E7) + " FROM e")
def e7(spark, sf):
    return bl.efficiency(sides(spark, sf), T).select("method", "frame_id", "violation_reduction", *[rnd(c).alias(c) for c in E7])


@register("E8_scores", f"""WITH {SQL_E7}, n AS (SELECT *, greatest(0, least(1, (after_margin_min - before_margin_min) / {T})) AS m,
  greatest(0, least(1, concentration_reduction_norm)) AS c, greatest(0, least(1, compliance_gain)) AS p,
  greatest(0, least(1, uniformity_gain)) AS u, greatest(0, least(1, occupancy_gain)) AS o FROM e)
  SELECT method, frame_id, round(0.35::DOUBLE * p + 0.25::DOUBLE * m + 0.25::DOUBLE * u + 0.15::DOUBLE * c, 9) AS aware_score,
  round(0.4::DOUBLE * u + 0.3::DOUBLE * o + 0.3::DOUBLE * c, 9) AS overall_score,
  round(CASE WHEN bnz > 0 THEN least(1.0, anz::DOUBLE / bnz) ELSE 1.0::DOUBLE END, 9) AS spreading FROM n""")
def e8(spark, sf):
    d = bl.scores(bl.efficiency(sides(spark, sf), T), T)
    return d.select("method", "frame_id", *[rnd(c).alias(c) for c in ("aware_score", "overall_score", "spreading")])


@register("E9_sustainability", f"""WITH {SQL_STATS} SELECT method, frame_id, b.k - b.ov AS before_safe, b.mg AS before_marginal,
  b.ov AS before_over, a.k - a.ov AS after_safe, a.mg AS after_marginal, a.ov AS after_over,
  round((a.k - 2 * a.ov)::DOUBLE / a.k, 9) AS score, round((b.ov - a.ov)::DOUBLE / a.k, 9) AS safe_gain,
  round((b.ov - a.ov)::DOUBLE / a.k, 9) AS over_reduction,
  CASE WHEN a.ov = 0 THEN 'EXCELLENT' WHEN a.ov < b.ov THEN 'IMPROVED' WHEN a.ov = b.ov THEN 'MAINTAINED' ELSE 'DEGRADED' END AS level {J}""")
def e9(spark, sf):
    d = bl.sustainability(sides(spark, sf))
    return d.select(*[c for c in d.columns if c not in ("score", "safe_gain", "over_reduction")],
                    *[rnd(c).alias(c) for c in ("score", "safe_gain", "over_reduction")])


@register("E10_spread_map", f"""WITH {SQL_STATS} SELECT method, frame_id, CAST(a.h AS BIGINT) AS hits, b.nz AS blocks_before,
  a.nz AS blocks_after, round(100.0::DOUBLE * a.nz / least(a.k, a.h), 9) AS spread_pct {J} WHERE a.h > 0""")
def e10(spark, sf):
    d = bl.spread_map(_frames(spark, sf), _perm(spark), CW)
    return d.select("method", "frame_id", "hits", "blocks_before", "blocks_after", rnd("spread_pct").alias("spread_pct"))


E11 = ["before_gini", "after_gini", "delta_g", "eta_es", "delta_bs", "s_ecc", "u_ecc", "compliance_gain", "uniformity_gain",
       "variance_reduction", "after_occupancy"]


@register("E11_trial_stats", f"""WITH {SQL_STATS}, x AS (SELECT method, frame_id, b.g AS before_gini, a.g AS after_gini,
  greatest(0.0, least(1.0, b.g - a.g)) AS delta_g, a.es AS eta_es, a.bs AS delta_bs, CAST({T} - a.mx AS DOUBLE) AS s_ecc, a.ov AS v_ecc,
  a.av / {T} AS u_ecc, (a.k - a.ov)::DOUBLE / a.k - (b.k - b.ov)::DOUBLE / b.k AS compliance_gain, a.un - b.un AS uniformity_gain,
  b.va - a.va AS variance_reduction, a.oc AS after_occupancy {J}) SELECT method, frame_id, v_ecc, """
          + ", ".join(f"round({c}, 9) AS {c}" for c in E11) + " FROM x")
def e11(spark, sf):
    d = bl.trial_stats(_frames(spark, sf), _perm(spark), CW, T)
    return d.select("method", "frame_id", "v_ecc", *[rnd(c).alias(c) for c in E11])


@register("E12_cv", f"""WITH {SQL_OBS} SELECT condition, method, round(stddev_samp(y) / avg(y), 8) AS cv FROM obs GROUP BY ALL""")
def e12(spark, sf):
    d = bl.coefficient_of_variation(obs(spark, sf), ["condition", "method"], "y")
    return d.select("condition", "method", rnd("cv", 8).alias("cv"))
