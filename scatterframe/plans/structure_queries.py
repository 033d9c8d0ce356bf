"""G1-G16 and L1-L9.  The permutation of a frame is the order its rows take when stored by value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import big
from ..operators import load as ld
from ..operators import reorder as ro
from ..operators import structure as st
from ..sources.tables import EVENT_W, frames_events, hundredths, sql_frames, table
from .blockload_queries import CW, T
from .kpi_queries import R
from .perm_sql import hash_sql
from .registry import register

K = ["frame_id"]
N = EVENT_W


def perm(spark, sf, deal=lambda f: f):
    f = deal(frames_events(spark, sf))
    w = Window.partitionBy("frame_id").orderBy("value", "pos")
    return f.select("frame_id", "n_rows", F.col("pos").alias("src"), big(F.row_number().over(w)).alias("pos"))


SQL_P = f"{sql_frames()}, p AS (SELECT frame_id, pos AS src, row_number() OVER (PARTITION BY frame_id ORDER BY value, pos) AS pos FROM f)"


@register("G1_separation", f"""WITH {SQL_P}, g AS (SELECT a.frame_id, abs(a.pos - b.pos) / {N - 1}.0::DOUBLE AS g FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.src = a.src + 1)
  SELECT frame_id, round(min(g), 9) AS sep_min, round(max(g), 9) AS sep_max, round(avg(g), 9) AS sep_avg, round(var_samp(g), 9) AS sep_var, round(stddev_samp(g) / avg(g), 9) AS sep_cv,
  round(least(2 * avg(g), 2 * (1 - avg(g))), 9) AS eta_sep FROM g GROUP BY frame_id""")
def g1(spark, sf):
    return st.separation(perm(spark, sf), K).select("frame_id", *R("sep_min", "sep_max", "sep_avg", "sep_var", "sep_cv", "eta_sep"))


@register("G2_adjacency", f"""WITH {SQL_P}, g AS (SELECT a.frame_id, abs(a.src - b.src) / {N - 1}.0::DOUBLE AS g FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.pos = a.pos + 1)
  SELECT frame_id, round(min(g), 9) AS adj_min, round(avg(g), 9) AS adj_avg, round(stddev_samp(g) / avg(g), 9) AS adj_cv FROM g GROUP BY frame_id""")
def g2(spark, sf):
    return st.adjacency(perm(spark, sf), K).select("frame_id", *R("adj_min", "adj_avg", "adj_cv"))


@register("G3_adj_dispersion", f"""WITH {SQL_P} SELECT a.frame_id, round(count(DISTINCT abs(a.src - b.src)) / {N - 1}.0::DOUBLE, 9) AS adj_dispersion
  FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.pos = a.pos + 1 GROUP BY a.frame_id""")
def g3(spark, sf):
    return st.adjacency(perm(spark, sf), K).select("frame_id", *R("adj_dispersion"))


@register("G4_dispersion", f"""WITH {SQL_P}, d AS (SELECT DISTINCT a.frame_id, b.src - a.src AS gap, b.pos - a.pos AS dis FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.src > a.src)
  SELECT frame_id, count(*) AS "distinct", round(count(*) / {N * (N - 1) // 2}.0::DOUBLE, 9) AS dispersion FROM d GROUP BY frame_id""")
def g4(spark, sf):
    return st.dispersion(perm(spark, sf), K).select("frame_id", "distinct", *R("dispersion"))


@register("G4b_dispersion_approx", f"""WITH {SQL_P}, d AS (SELECT DISTINCT a.frame_id, b.src - a.src AS gap, b.pos - a.pos AS dis FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.src > a.src)
  SELECT frame_id, count(*) AS "distinct", true AS within FROM d GROUP BY frame_id""")
def g4b(spark, sf):
    """Sketched and exact dispersion: is the sketch within six standard errors?"""
    p = perm(spark, sf)
    near = st.dispersion_approx(p, K).select("frame_id", F.col("distinct").alias("sketched"))
    off = F.abs(F.col("sketched") - F.col("distinct")) / F.col("distinct")
    return st.dispersion(p, K).join(near, "frame_id").select("frame_id", "distinct", (off <= 6 * 1.04 / 2 ** (st.SKETCH_BITS / 2)).alias("within"))


SAMPLE = 40


@register("G5b_spread_sampled", f"""WITH {SQL_P}, s AS (SELECT frame_id, pos, src FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {hash_sql('42', 'pos')}, pos) AS i FROM p) WHERE i <= {SAMPLE})
  SELECT a.frame_id, round(min(sqrt((a.pos - b.pos) ** 2 + (a.src - b.src) ** 2)), 9) AS s_factor FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.pos < b.pos GROUP BY ALL""")
def g5b(spark, sf):
    return st.sampled_spread(perm(spark, sf), K, SAMPLE).select("frame_id", *R("s_factor"))


SQL_LAG = f"{SQL_P}, lg AS (SELECT a.frame_id, b.pos - a.pos AS d, abs(b.src - a.src) AS m FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.pos > a.pos)"


@register("G5_spread_factor", f"WITH {SQL_LAG} SELECT frame_id, round(min(sqrt(d * d + m * m)), 9) AS s_factor FROM lg GROUP BY frame_id")
def g5(spark, sf):
    return st.spreads(st.lag_minima(perm(spark, sf), K), K).select("frame_id", *R("s_factor"))


@register("G6_s_new", f"WITH {SQL_LAG} SELECT frame_id, min(d + m) AS s_new FROM lg GROUP BY frame_id")
def g6(spark, sf):
    return st.spreads(st.lag_minima(perm(spark, sf), K), K).select("frame_id", "s_new")


@register("G7_s_attained", f"""WITH {SQL_LAG}, s AS (SELECT frame_id, range AS s FROM (SELECT DISTINCT frame_id FROM p) CROSS JOIN range(1, 60)),
  c AS (SELECT s.frame_id, s, coalesce(min(m), 1000000) AS lo FROM s LEFT JOIN lg ON lg.frame_id = s.frame_id AND d < s GROUP BY ALL) SELECT frame_id, max(s) AS s_ach FROM c WHERE lo >= s GROUP BY frame_id""")
def g7(spark, sf):
    return st.spreads(st.lag_minima(perm(spark, sf), K), K).select("frame_id", "s_ach")


@register("G8_b_guar", f"""WITH {SQL_P}, o AS (SELECT frame_id, (src - 1) // {CW} + 1 AS cw, pos, row_number() OVER (PARTITION BY frame_id, (src - 1) // {CW} ORDER BY pos) AS j FROM p),
  g AS (SELECT a.frame_id, a.cw, b.pos - a.pos AS g FROM o a JOIN o b ON a.frame_id = b.frame_id AND a.cw = b.cw AND b.j = a.j + {T}),
  k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY g, cw) AS i FROM g) SELECT frame_id, g AS b_guar, cw AS worst_block FROM k WHERE i = 1""")
def g8(spark, sf):
    return st.b_guar(perm(spark, sf), K, CW, T)


@register("G9_apsr", f"""WITH {SQL_P}, x AS (SELECT frame_id, pos, 2 * src - {N + 1} AS x FROM p), pk AS (SELECT frame_id, sum(x * x) AS pk FROM x GROUP BY frame_id),
  ac AS (SELECT a.frame_id, b.pos - a.pos AS k, abs(sum(a.x * b.x)) AS r FROM x a JOIN x b ON a.frame_id = b.frame_id AND b.pos > a.pos GROUP BY ALL),
  m AS (SELECT frame_id, max(r)::DOUBLE / any_value(pk) AS lobe FROM ac JOIN pk USING (frame_id) GROUP BY frame_id)
  SELECT frame_id, round(lobe, 9) AS max_sidelobe, round(10 * log10(1 / (lobe + 2.220446049250313e-16)), 8) AS apsr FROM m""")
def g9(spark, sf):
    return st.apsr(perm(spark, sf), K).select("frame_id", *R("max_sidelobe"), *R("apsr", d=8))


@register("G10_source_separation", f"""WITH {SQL_P}, m AS (SELECT a.frame_id, (a.pos - 1) // {CW} AS cw, min(abs(a.src - b.src)) / {CW}.0::DOUBLE AS g FROM p a JOIN p b
    ON a.frame_id = b.frame_id AND (a.pos - 1) // {CW} = (b.pos - 1) // {CW} AND a.pos <> b.pos WHERE (a.pos - 1) // {CW} < {N // CW} GROUP BY ALL)
  SELECT frame_id, round(min(g), 9) AS s_sf, round(avg(g), 9) AS s_sf_avg FROM m GROUP BY frame_id""")
def g10(spark, sf):
    return st.source_separation(perm(spark, sf), K, CW).select("frame_id", *R("s_sf", "s_sf_avg"))


G11 = ["min_min", "min_max", "min_avg", "avg_avg", "var_avg", "var_max"]


@register("G11_block_distances", f"""WITH {SQL_P}, d AS (SELECT a.frame_id, (a.pos - 1) // {CW} AS b, abs(a.src - b.src) / {N - 1}.0::DOUBLE AS d FROM p a JOIN p b
    ON a.frame_id = b.frame_id AND (a.pos - 1) // {CW} = (b.pos - 1) // {CW} AND a.pos < b.pos WHERE (a.pos - 1) // {CW} < {N // CW}),
  k AS (SELECT frame_id, b, min(d) AS lo, avg(d) AS av, var_samp(d) AS va FROM d GROUP BY ALL)
  SELECT frame_id, round(min(lo), 9) AS min_min, round(max(lo), 9) AS min_max, round(avg(lo), 9) AS min_avg, round(avg(av), 9) AS avg_avg, round(avg(va), 9) AS var_avg, round(max(va), 9) AS var_max FROM k GROUP BY frame_id""")
def g11(spark, sf):
    return st.block_distances(perm(spark, sf), K, CW).select("frame_id", *R(*G11))


@register("G11b_block_distances_nonzero", f"""WITH {sql_frames()}, v AS (SELECT frame_id, pos, CASE WHEN hit = 1 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS x FROM f),
  z AS (SELECT * FROM v WHERE x <> 0 AND (pos - 1) // {CW} < {N // CW}), d AS (SELECT a.frame_id, (a.pos - 1) // {CW} AS b, abs(a.x - b.x) / {N - 1}.0::DOUBLE AS d FROM z a JOIN z b
    ON a.frame_id = b.frame_id AND (a.pos - 1) // {CW} = (b.pos - 1) // {CW} AND a.pos < b.pos),
  k AS (SELECT frame_id, b, min(d) AS lo, avg(d) AS av, var_samp(d) AS va FROM d GROUP BY ALL)
  SELECT frame_id, round(min(lo), 7) AS min_min, round(max(lo), 7) AS min_max, round(avg(av), 6) AS avg_avg, round(max(va), 4) AS var_max FROM k GROUP BY frame_id""")
def g11b(spark, sf):
    f = frames_events(spark, sf).withColumn("x", F.when(F.col("hit") == 1, 0).otherwise(hundredths("value")))
    return st.block_distances(f, K, CW, "x", exclude_zero=True).select("frame_id", *R("min_min", "min_max", d=7), *R("avg_avg", d=6), *R("var_max", d=4))


@register("G12_laplacian_energy", f"WITH {SQL_P} SELECT frame_id, round((6 * count(*) - 8)::DOUBLE / (count(*) * count(*)), 9) AS energy FROM p GROUP BY frame_id")
def g12(spark, sf):
    p = perm(spark, sf)
    nodes = p.groupBy("frame_id").agg(F.count("*").alias("n"))
    return st.laplacian_energy(st.transition_edges(p, K), nodes, K).select("frame_id", *R("energy"))


@register("G12b_laplacian_transitions", f"""WITH t AS (SELECT event_id // {N} AS frame_id, event_id % {N} + 1 AS pos, event_type AS e FROM events WHERE event_id // {N} < (SELECT (max(event_id) + 1) // {N} FROM events)),
  ed AS (SELECT a.frame_id, a.e AS u, b.e AS v FROM t a JOIN t b ON a.frame_id = b.frame_id AND b.pos = a.pos + 1 WHERE a.e <> b.e),
  ad AS (SELECT frame_id, u, v, count(*) AS w FROM (SELECT frame_id, u, v FROM ed UNION ALL SELECT frame_id, v, u FROM ed) GROUP BY ALL),
  dg AS (SELECT frame_id, u, sum(w) AS d FROM ad GROUP BY ALL), nn AS (SELECT frame_id, count(DISTINCT e) AS n FROM t GROUP BY frame_id)
  SELECT frame_id, round(((SELECT sum(d * d) FROM dg WHERE dg.frame_id = nn.frame_id) + (SELECT sum(w * w) FROM ad WHERE ad.frame_id = nn.frame_id))::DOUBLE / (n * n), 9) AS energy FROM nn""")
def g12b(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id"), F.col("event_type").alias("kind"))
    t = ev.select(F.floor(F.col("event_id") / N).alias("frame_id"), (F.col("event_id") % N + 1).alias("pos"), "kind")
    nodes = t.groupBy("frame_id").agg(F.count_distinct("kind").alias("n"))
    return st.laplacian_energy(st.transition_edges(t, K, "kind"), nodes, K).select("frame_id", *R("energy"))


@register("G13_pattern_fit", f"WITH {SQL_P} SELECT frame_id, round(avg(((pos - 1) % {CW} = (src - 1) % {CW})::INT), 9) AS fit FROM p WHERE pos <= {N // CW * CW} GROUP BY frame_id")
def g13(spark, sf):
    return st.pattern_fit(perm(spark, sf), K, CW).select("frame_id", *R("fit"))


@register("G14_reach", f"""WITH {SQL_P} SELECT frame_id, round(max(abs(src - pos)) / {N}.0::DOUBLE, 9) AS reach, round(median(abs(src - pos)) / {N}.0::DOUBLE, 9) AS median_reach,
  round(avg((src = pos)::INT), 9) AS fixed FROM p GROUP BY frame_id""")
def g14(spark, sf):
    return st.reach(perm(spark, sf), K).select("frame_id", *R("reach", "median_reach", "fixed"))


@register("G15_closed_blocks", f"""WITH {SQL_P}, c AS (SELECT a.frame_id, a.pos FROM p a WHERE a.pos = (SELECT max(b.src) FROM p b WHERE b.frame_id = a.frame_id AND b.pos <= a.pos)),
  w AS (SELECT frame_id, pos - coalesce(lag(pos) OVER (PARTITION BY frame_id ORDER BY pos), 0) AS w FROM c) SELECT frame_id, count(*) AS blocks, max(w) AS widest FROM w GROUP BY frame_id""")
def g15(spark, sf):
    return st.closed_blocks(perm(spark, sf), K)


@register("G16_pairwise_distance", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL)
  SELECT e.vec_id, CAST(c.label AS BIGINT) AS label, round(sqrt(sum((e.x - c.x) * (e.x - c.x))), 8) AS distance FROM e JOIN c USING (i) GROUP BY ALL""")
def g16(spark, sf):
    e = table(spark, sf, "embeddings")
    return st.pairwise_distance(e, "vec_id", "embedding", st.centroids(e, "label", "embedding"), "label").select("vec_id", "label", *R("distance", d=8))


# --- load over every burst start -------------------------------------------

BURSTS = [CW * m for m in (1, 2, 4, 8, 12, 16, 24)]


def sql_loads(bursts, src="p", keys="frame_id", name="lm") -> str:
    ks = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"x.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    k_ = -(-N // CW)
    return f"""{name}_s AS (SELECT DISTINCT {keys}, b, s FROM {src} CROSS JOIN (VALUES {", ".join(f"({b})" for b in bursts)}) v(b) CROSS JOIN range(1, {N + 1}) r(s) WHERE s <= {N} - least(b, {N}) + 1),
  {name}_c AS (SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, s.b, s.s, (x.src - 1) // {CW} AS cw, count(*) AS l FROM {name}_s s JOIN {src} x ON {on} AND x.pos BETWEEN s.s AND s.s + least(s.b, {N}) - 1 GROUP BY ALL),
  {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, b, s ORDER BY l) AS i, count(*) OVER (PARTITION BY {keys}, b, s) AS nz FROM {name}_c),
  {name}_w AS (SELECT {keys}, b, s, max(l) AS mx, any_value(nz) AS nz, CASE WHEN any_value(nz) < 2 THEN 0 ELSE coalesce(stddev_pop(l) / avg(l), 0) END AS cv,
    greatest(0.0, 2.0::DOUBLE * sum(({k_} - nz + i) * l) / ({k_} * sum(l)) - ({k_} + 1.0::DOUBLE) / {k_}) AS g FROM {name}_r GROUP BY ALL),
  {name} AS (SELECT {keys}, b, CASE WHEN b < {N} THEN avg((mx > {T})::INT) END AS over_t, CASE WHEN b < {N} THEN max(mx) END AS max_err, CASE WHEN b < {N} THEN avg(mx) END AS mean_max,
    CASE WHEN b < {N} THEN avg(cv) END AS cv_load, CASE WHEN b < {N} THEN avg(g) END AS gini_load, avg(nz) / least({k_}, least(b, {N})) AS es_load FROM {name}_w GROUP BY {keys}, b)"""


SQL_LM = f"{SQL_P}, {sql_loads(BURSTS)}"


def loads(spark, sf, bursts=BURSTS):
    """Frames are dealt once: they are sorted, and their loads taken, in the same task."""
    return ld.load_metrics(perm(spark, sf, lambda f: ld.deal(f, K, bursts)), K, bursts, CW, T, dealt=True)


def _load_query(name, col, digits):
    v = col if digits is None else f"round({col}, {digits})"

    @register(name, f"WITH {SQL_LM} SELECT frame_id, CAST(b AS BIGINT) AS b, {v} AS {col} FROM lm")
    def run(spark, sf):
        return loads(spark, sf).select("frame_id", "b", *([col] if digits is None else R(col, d=digits)))


for _n, _c, _d in [("L1_over_t", "over_t", 9), ("L2_max_err", "max_err", None), ("L3_mean_max", "mean_max", 9), ("L4_cv_load", "cv_load", 8),
                   ("L5_gini_load", "gini_load", 8), ("L6_es_load", "es_load", 9)]:
    _load_query(_n, _c, _d)


@register("L7_design_cells", f"""WITH {SQL_LM}, w AS (SELECT frame_id, {", ".join(f"max({c}) FILTER (b = {b}) AS {c}_b{b}" for b in BURSTS for c in ld.STATS)} FROM lm GROUP BY frame_id),
  lg AS (SELECT a.frame_id, b.pos - a.pos AS d, abs(b.src - a.src) AS m, b.src - a.src AS ds FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.pos > a.pos),
  sn AS (SELECT frame_id, min(d + m) AS s_new, count(DISTINCT m) FILTER (d = 1) / {N - 1}.0::DOUBLE AS adj_dispersion FROM lg GROUP BY frame_id),
  s1 AS (SELECT frame_id, range AS s FROM (SELECT DISTINCT frame_id FROM p) CROSS JOIN range(1, 60)),
  s2 AS (SELECT s1.frame_id, s, coalesce(min(m), 1000000) AS lo FROM s1 LEFT JOIN lg ON lg.frame_id = s1.frame_id AND d < s GROUP BY ALL), sa AS (SELECT frame_id, max(s) AS s_ach FROM s2 WHERE lo >= s GROUP BY frame_id),
  ds AS (SELECT frame_id, count(*) / {N * (N - 1) // 2}.0::DOUBLE AS dispersion FROM (SELECT DISTINCT a.frame_id, b.src - a.src AS gap, b.pos - a.pos AS dis FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.src > a.src) GROUP BY frame_id),
  o AS (SELECT frame_id, (src - 1) // {CW} + 1 AS cw, pos, row_number() OVER (PARTITION BY frame_id, (src - 1) // {CW} ORDER BY pos) AS j FROM p),
  bg AS (SELECT a.frame_id, min(b.pos - a.pos) AS b_guar FROM o a JOIN o b ON a.frame_id = b.frame_id AND a.cw = b.cw AND b.j = a.j + {T} GROUP BY a.frame_id)
  SELECT frame_id, {", ".join((f"{c}_b{b}" if c == "max_err" else f"round({c}_b{b}, 8) AS {c}_b{b}") for b in BURSTS for c in ld.STATS)}, b_guar, round(dispersion, 9) AS dispersion, s_new, s_ach, round(adj_dispersion, 9) AS adj_dispersion
  FROM w JOIN sn USING (frame_id) JOIN sa USING (frame_id) JOIN ds USING (frame_id) JOIN bg USING (frame_id)""")
def l7(spark, sf):
    d = ld.design_cells(perm(spark, sf), K, CW, T)
    cols = []
    for b in BURSTS:
        for c in ld.STATS:
            cols += [F.col(f"{c}_b{b}")] if c == "max_err" else R(f"{c}_b{b}", d=8)
    return d.select("frame_id", *cols, "b_guar", *R("dispersion"), "s_new", "s_ach", *R("adj_dispersion"))


ENSEMBLE, BB = 200, 60


@register("L8_bracket", f"""WITH {SQL_P}, e AS (SELECT d AS draw, v AS src, row_number() OVER (PARTITION BY d ORDER BY {hash_sql('42', 'd', 'v')}, v) AS pos FROM range(0, {ENSEMBLE}) a(d) CROSS JOIN range(1, {N + 1}) b(v)),
  id AS (SELECT 0 AS draw, v AS src, v AS pos FROM range(1, {N + 1}) b(v)), {sql_loads([BB])}, {sql_loads([BB], 'e', 'draw', 'em')}, {sql_loads([BB], 'id', 'draw', 'im')},
  q AS (SELECT list_sort(list(round(gini_load, 12))) AS a FROM em), z AS (SELECT a, h FROM q, (SELECT 0 AS h)),
  s AS (SELECT a[1] AS low, a[{ENSEMBLE}] AS high, (a[{ENSEMBLE // 4}] + a[{ENSEMBLE // 4 + 1}]) / 2 AS q1, (a[{ENSEMBLE // 2}] + a[{ENSEMBLE // 2 + 1}]) / 2 AS median, (a[{ENSEMBLE * 3 // 4}] + a[{ENSEMBLE * 3 // 4 + 1}]) / 2 AS q3 FROM z)
  SELECT frame_id, round(lm.gini_load, 8) AS value, round(im.gini_load, 8) AS identity, round(low, 8) AS low, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3, round(high, 8) AS high,
  CASE WHEN lm.gini_load < low THEN 'below the ensemble' WHEN lm.gini_load > high THEN 'above the ensemble' ELSE 'inside' END AS place FROM lm CROSS JOIN im CROSS JOIN s""")
def l8(spark, sf):
    cand = loads(spark, sf, [BB]).withColumn("n_rows", F.lit(N))
    draws = spark.range(0, ENSEMBLE, 1, 8).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(N).cast("bigint"))).alias("src"))
    w = Window.partitionBy("draw").orderBy(ro.hash32(F.lit(42), "draw", "src"), "src")
    ens = draws.select("draw", "src", big(F.row_number().over(w)).alias("pos"))
    e = ld.load_metrics(ens, ["draw"], [BB], CW, T).withColumn("n_rows", F.lit(N))
    ident = ro.permutation(spark, "identity", N).withColumn("draw", F.lit(0))
    i = ld.load_metrics(ident, ["draw"], [BB], CW, T).withColumn("n_rows", F.lit(N))
    d = ld.bracket(cand, e, i, K, "gini_load")
    return d.select("frame_id", *R("value", "identity", "low", "q1", "median", "q3", "high", d=8), "place")


SWEEP = [15, 30, 60, 120, 180]
SQL_SWEEP = f"""{SQL_P}, {sql_loads(SWEEP)}, oc AS (SELECT frame_id, CAST(sum(round(value * 100)) AS BIGINT) AS y FROM f GROUP BY frame_id),
  ll AS (SELECT 'gini_load' AS stat, b, round(gini_load, 12) AS x, y FROM lm JOIN oc USING (frame_id) UNION ALL SELECT 'mean_max', b, round(mean_max, 12), y FROM lm JOIN oc USING (frame_id)
    UNION ALL SELECT 'es_load', b, round(es_load, 12), y FROM lm JOIN oc USING (frame_id)),
  rk AS (SELECT *, rank() OVER (PARTITION BY stat, b ORDER BY x) + (count(*) OVER (PARTITION BY stat, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY stat, b ORDER BY y) + (count(*) OVER (PARTITION BY stat, b, y) - 1) / 2.0::DOUBLE AS ry FROM ll),
  rh AS (SELECT stat, b, count(*) AS m, abs(corr(rx, ry)) AS rho FROM rk GROUP BY ALL HAVING count(DISTINCT x) > 1 AND count(DISTINCT y) > 1)"""


def _rhos(spark, sf):
    out = frames_events(spark, sf).groupBy("frame_id").agg(F.sum(hundredths("value")).alias("y"))
    return ld.rho_by_burst(loads(spark, sf, SWEEP), out, K, ["gini_load", "mean_max", "es_load"])


@register("L9_rho_by_burst", f"WITH {SQL_SWEEP} SELECT stat, CAST(b AS BIGINT) AS b, m, round(rho, 8) AS rho FROM rh")
def l9(spark, sf):
    return _rhos(spark, sf).select("stat", "b", "m", *R("rho", d=8))


@register("L9b_sweep", f"""WITH {SQL_SWEEP}, r AS (SELECT stat, b, round(rho, 10) AS rho FROM rh), t AS (SELECT stat, max(rho) AS top, max(b) AS lastb FROM r GROUP BY stat),
  pk AS (SELECT r.stat, min(b) AS peak FROM r JOIN t USING (stat) WHERE rho = top GROUP BY r.stat),
  sp AS (SELECT stat, b, rho - lag(rho) OVER (PARTITION BY stat ORDER BY b) AS d FROM r),
  fb AS (SELECT sp.stat, greatest(0.0, coalesce(max(-d), 0.0)) AS fall_before FROM sp JOIN pk USING (stat) WHERE b <= peak GROUP BY sp.stat),
  pl AS (SELECT r.stat, min(r.b) AS plateau_from FROM r JOIN t USING (stat) WHERE top - (SELECT min(q.rho) FROM r q WHERE q.stat = r.stat AND q.b >= r.b) <= 0.02 + 1e-12 GROUP BY r.stat)
  SELECT t.stat, CAST(peak AS BIGINT) AS best_b, round(top, 8) AS best_rho, CAST(plateau_from AS BIGINT) AS plateau_from, round(fall_before, 8) AS fall_before, round(top - r.rho, 8) AS fall_after,
  CASE WHEN fall_before > 0.10 THEN 'swings before its peak' WHEN top - r.rho > 0.10 THEN 'peaks then falls' ELSE 'rises to a plateau' END AS verdict
  FROM t JOIN pk USING (stat) JOIN fb USING (stat) LEFT JOIN pl USING (stat) JOIN r ON r.stat = t.stat AND r.b = t.lastb""")
def l9b(spark, sf):
    d = ld.b_sweep(_rhos(spark, sf))
    return d.select("stat", "best_b", *R("best_rho", d=8), "plateau_from", *R("fall_before", "fall_after", d=8), "verdict")
