"""Writing, reading back and reshaping tables derived from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import big
from ..operators import blockload as bl
from ..operators import reorder as ro
from ..sources import io
from ..sources.tables import EVENT_W, frames_events, sql_frames, table
from .blockload_queries import CW, SQL_STAT_CTES, T, sql_loads
from .kpi_queries import IN_SQL, SQL_CORE, R, core, in_scope
from .perm_sql import perm_sql
from .registry import register

SQL_COND = """co AS (SELECT lower(l_returnflag) AS regime, CASE WHEN l_linestatus = 'O' THEN 'common' ELSE 'standards' END AS grid, p_brand AS method,
  CAST(l_quantity AS BIGINT) AS qty, CAST(p_size AS BIGINT) AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def conditioned(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.lower("l_returnflag").alias("regime"), F.when(F.col("l_linestatus") == "O", "common").otherwise("standards").alias("grid"),
        F.col("p_brand").alias("method"), big("l_quantity").alias("qty"), big("p_size").alias("size"))


@register("S1_scan_conditions", f"""WITH {SQL_COND} SELECT regime, grid, DATE '2026-01-31' AS run_date, CAST(2 AS INTEGER) AS version, count(*) AS rows, CAST(sum(qty) AS BIGINT) AS qty FROM co GROUP BY ALL""")
def s1(spark, sf):
    path = io.shared_folder(spark)
    io.write_named(conditioned(spark, sf).drop("method"), path, F.concat_ws("_", F.lit("trials"), "regime", "grid", F.lit("260131"), F.lit("2")))
    d = io.scan_conditions(spark, path)
    return d.groupBy("regime", "grid", "run_date", "version").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"))


@register("S2_grid_filter", f"WITH {SQL_COND} SELECT regime, method, count(*) AS rows, CAST(sum(qty) AS BIGINT) AS qty FROM co WHERE grid = 'common' GROUP BY ALL")
def s2(spark, sf):
    path = io.shared_folder(spark)
    io.write_conditioned(conditioned(spark, sf), path)
    d = io.grid_filter(io.read_conditioned(spark, path), "common")
    return d.groupBy("regime", "method").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"))


@register("S3_decode_category", f"WITH {SQL_COND} SELECT method, count(*) AS rows, CAST(sum(qty) AS BIGINT) AS qty FROM co GROUP BY method")
def s3(spark, sf):
    enc, dim = io.dictionary_encode(conditioned(spark, sf), "method")
    return io.decode_category(enc, dim, "method").groupBy("method").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"))


@register("S4_dictionary_encode", f"""WITH {SQL_COND}, d AS (SELECT method, row_number() OVER (ORDER BY method) AS method_id FROM (SELECT DISTINCT method FROM co))
  SELECT method_id, regime, count(*) AS rows FROM co JOIN d USING (method) GROUP BY ALL""")
def s4(spark, sf):
    enc, _ = io.dictionary_encode(conditioned(spark, sf), "method")
    return enc.groupBy("method_id", "regime").agg(F.count("*").alias("rows"))


@register("S5_export_csv_gz", f"WITH {SQL_COND} SELECT regime, method, count(*) AS rows, CAST(sum(qty) AS BIGINT) AS qty FROM co WHERE method NOT IN ('Brand#1', 'Brand#2') GROUP BY ALL")
def s5(spark, sf):
    c = conditioned(spark, sf)
    allow = table(spark, sf, "part").select(F.col("p_brand").alias("method")).distinct()
    path = io.shared_folder(spark)
    io.export_csv_gz(c, path, allow, ["Brand#1", "Brand#2"])
    back = spark.read.schema(c.schema).option("header", True).csv(path)
    return back.groupBy("regime", "method").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"))


@register("S6_scorecard_csv", f"""WITH {SQL_COND} SELECT method AS metric, round(avg(qty), 6) AS cell, CAST(NULL AS DOUBLE) AS trial, round(avg(size), 6) AS between, CAST(count(DISTINCT regime) AS INTEGER) AS pass FROM co GROUP BY method""")
def s6(spark, sf):
    c = conditioned(spark, sf).groupBy(F.col("method").alias("metric")).agg(
        F.avg("qty").alias("cell"), F.avg("size").alias("between"), F.count_distinct("regime").cast("int").alias("pass"))
    have = set(c.columns)
    c = c.withColumns({f.name: F.lit(None).cast(f.dataType) for f in io.SCORECARD if f.name not in have})
    path = io.shared_folder(spark)
    io.write_scorecard_csv(c, path)
    return io.read_scorecard_csv(spark, path).select("metric", *R("cell", d=6), "trial", *R("between", d=6), "pass")


@register("S7_write_conditioned", f"WITH {SQL_COND} SELECT regime, grid, count(*) AS rows, string_agg(DISTINCT method, ',' ORDER BY method) AS variables FROM co GROUP BY ALL")
def s7(spark, sf):
    path = io.shared_folder(spark)
    d = conditioned(spark, sf)
    io.write_conditioned(d.limit(0), path)
    latest = io.write_conditioned(d, path)
    return io.inventory(io.read_conditioned(spark, path, latest), ["regime", "grid"], "method")


@register("S8_wide_to_long", f"""WITH {SQL_CORE}, l AS (SELECT condition, method, 'cr' AS metric, cr AS v FROM core UNION ALL SELECT condition, method, 'be', be FROM core
  UNION ALL SELECT condition, method, 'gain', CASE WHEN bin <> 3 AND actual > 0 THEN cr END FROM core) SELECT condition, method, metric, count(*) AS n, round(sum(v), 7) AS total FROM l WHERE v IS NOT NULL GROUP BY ALL""")
def s8(spark, sf):
    c = core(spark, sf).withColumns({
        "gain": F.when(F.col("bin") == 3, F.lit(float("inf"))).when(F.col("actual") > 0, F.col("cr")).otherwise(F.lit(float("nan"))),
        "empty": F.lit(float("nan"))})
    d = io.wide_to_long(c, ["condition", "method"], ["cr", "be", "gain", "empty"])
    return d.groupBy("condition", "method", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("condition", "method", "metric", "n", *R("total", d=7))


@register("S9_design_grid", """WITH c AS (SELECT l_returnflag AS condition, max(l_orderkey) AS top FROM lineitem GROUP BY ALL),
  l AS (SELECT condition, unnest(range(60, top + 1, 60)) AS length FROM c), b AS (SELECT 'A' AS condition, i + 1 AS bin, 0.02::DOUBLE + 0.08::DOUBLE * i / 4 AS level FROM range(0, 5) r(i)
    UNION ALL SELECT x, i + 1, 0.05::DOUBLE + 0.15::DOUBLE * i / 2 FROM range(0, 3) r(i), (VALUES ('N'), ('R')) v(x))
  SELECT condition, CAST(length AS BIGINT) AS length, CAST(bin AS BIGINT) AS bin, round(level, 9) AS level, CAST(run AS BIGINT) AS run FROM l JOIN b USING (condition) CROSS JOIN range(1, 4) q(run)""")
def s9(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("condition")).agg(F.max("l_orderkey").alias("top"))
    d = io.design_grid(c, F.sequence(F.lit(60).cast("bigint"), F.col("top"), F.lit(60).cast("bigint")), {"A": (0.02, 0.10, 5), "*": (0.05, 0.20, 3)}, 3)
    return d.select("condition", "length", "bin", *R("level"), big("run").alias("run"))


@register("S10_encoded_length", "SELECT DISTINCT CAST(ceil(o_custkey / 9.0::DOUBLE) * 15 AS BIGINT) AS enc_len FROM orders")
def s10(spark, sf):
    return io.encoded_length(table(spark, sf, "orders"), "o_custkey", 9, 15)


@register("S11_row_alignment", f"""WITH {sql_frames()}, b AS (SELECT frame_id, pos, CASE WHEN pos % 50 = 7 THEN value + 1 ELSE value END AS value, hit FROM f WHERE pos <> 3)
  SELECT count(*) AS rows, count(*) FILTER (b.pos IS NULL) AS only_a, 0::BIGINT AS only_b, count(*) FILTER (abs(f.value - b.value) > 1e-9) AS diff_value, count(*) FILTER (f.hit <> b.hit) AS diff_hit
  FROM f LEFT JOIN b ON b.frame_id = f.frame_id AND b.pos = f.pos""")
def s11(spark, sf):
    f = frames_events(spark, sf, whole=False)
    b = f.where(F.col("pos") != 3).withColumn("value", F.when(F.col("pos") % 50 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return io.row_alignment(f, b, ["frame_id", "pos"], ["value", "hit"], 1e-9)


@register("S12_standardization_constants", f"""WITH {SQL_CORE} SELECT condition, 'cr' AS quantity, round(avg(cr), 9) AS mean, round(stddev_samp(cr), 9) AS sd, count(*) AS n FROM core WHERE {IN_SQL} GROUP BY condition
  UNION ALL SELECT condition, 'be', round(avg(be), 9), round(stddev_samp(be), 9), count(*) FROM core WHERE {IN_SQL} GROUP BY condition""")
def s12(spark, sf):
    d = io.standardization_constants(core(spark, sf), ["condition"], ["cr", "be"], in_scope())
    return d.select("condition", "quantity", *R("mean", "sd"), "n")


DRAWS = 15
_PERM = "perm AS (" + " UNION ALL ".join(f"SELECT 'random#{d}' AS method, pos, src FROM ({perm_sql('random', EVENT_W, draw=d)})" for d in range(DRAWS)) + ")"


@register("S13_ensemble_mean", "WITH " + sql_loads(f"{sql_frames()}, {_PERM}", "f", EVENT_W) + f""", {SQL_STAT_CTES} SELECT split_part(method, '#', 1) AS method, frame_id, count(*) AS draws,
  round(avg(es), 9) AS eta_es, round(avg(g), 9) AS gini FROM a GROUP BY ALL""")
def s13(spark, sf):
    perm = ro.union_draws(spark, "random", EVENT_W, DRAWS)
    s = bl.load_stats(bl.block_loads(frames_events(spark, sf), perm, CW), CW, T).where(F.col("phase") == "after")
    s = s.withColumn("method", F.split_part("method", F.lit("#"), F.lit(1)))
    return io.ensemble_mean(s, ["method", "frame_id"], ["eta_es", "gini"]).select("method", "frame_id", "draws", *R("eta_es", "gini"))


