"""Runs of each event type, bursts injected into order frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import big, rnd
from ..operators import bursts as bu
from ..operators import reorder as ro
from ..sources.tables import (EVENT_W, ORDER_W, SQL_KPI_IN, frames_events, frames_orders, kpi_in, sql_frames, table)
from .blockload_queries import SQL_LOADS, T, loads
from .perm_sql import hash_sql, perms_by_length
from .registry import register

LEVELS = [0.02, 0.06, 0.10]
BASE = 200
#: Frame lengths of the tables: the width, and the last frames of the small scale factors.
EVENT_LENGTHS, ORDER_LENGTHS = (EVENT_W,), (ORDER_W, 120, 60)


def typed(spark, sf):
    """Positions of every event type in event frames, a short last one included."""
    ev = table(spark, sf, "events").select(F.col("event_id"), F.col("event_type").alias("kind"))
    return ev.select("kind", F.floor(F.col("event_id") / EVENT_W).alias("frame_id"), (F.col("event_id") % EVENT_W + 1).alias("pos"))


SQL_RUNS = f"""t AS (SELECT event_type AS kind, event_id // {EVENT_W} AS frame_id, event_id % {EVENT_W} + 1 AS pos FROM events
    WHERE event_id // {EVENT_W} < (SELECT (max(event_id) + 1) // {EVENT_W} FROM events)),
  brk AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY kind, frame_id ORDER BY pos)),
  grp AS (SELECT *, sum(b) OVER (PARTITION BY kind, frame_id ORDER BY pos) AS run_no FROM brk),
  r AS (SELECT kind, frame_id, CAST(run_no AS BIGINT) AS run_no, min(pos) AS start, max(pos) AS "end", count(*) AS len FROM grp GROUP BY ALL)"""


@register("B1_runs", f"WITH {SQL_RUNS} SELECT * FROM r")
def b1(spark, sf):
    return bu.runs(typed(spark, sf), ["kind", "frame_id"])


@register("B2_run_stats", f"""WITH {SQL_RUNS}, n AS (SELECT count(DISTINCT frame_id) AS frames, count(*) AS rows FROM t),
  p AS (SELECT kind, frame_id, count(*) AS c, sum(len) AS s, max(len) AS m FROM r GROUP BY ALL)
  SELECT kind, any_value(frames) AS frames, count(*) AS hit_frames, CAST(sum(c) AS BIGINT) AS runs, round(sum(c)::DOUBLE / any_value(frames), 9) AS runs_per_frame,
  round(avg(s / c), 9) AS mean_len_frame, round(sum(s)::DOUBLE / sum(c), 9) AS mean_len_pooled, max(m) AS max_len,
  round(sum(s)::DOUBLE / any_value(rows), 9) AS rate FROM p CROSS JOIN n GROUP BY kind""")
def b2(spark, sf):
    t = typed(spark, sf)
    size = t.agg(F.count_distinct("frame_id").alias("frames"), F.count("*").alias("rows"))
    kinds = t.select("kind").distinct().select("kind", size.select("frames").scalar().alias("frames"), size.select("rows").scalar().alias("rows"))
    d = bu.run_stats(bu.runs(t, ["kind", "frame_id"]), kinds, ["kind"])
    return d.select("kind", "frames", "hit_frames", "runs", "max_len",
                    *[rnd(c).alias(c) for c in ("runs_per_frame", "mean_len_frame", "mean_len_pooled", "rate")])


def sql_hazen(p: float, value: str, over: str) -> str:
    """Hazen percentile of a sorted list column ``over`` holding ``value``."""
    h = f"greatest(1.0, least(len({over})::DOUBLE, round(len({over}) * {p / 100}::DOUBLE + 0.5::DOUBLE, 9)))"
    lo, hi = f"{over}[floor({h})::INT]", f"{over}[ceil({h})::INT]"
    return f"({lo} + ({h} - floor({h})) * ({hi} - {lo}))"


@register("B3_run_quantiles", f"""WITH {SQL_RUNS}, l AS (SELECT kind, list_sort(list(len)) AS a FROM r GROUP BY kind)
  SELECT kind, {", ".join(f"round({sql_hazen(p, 'len', 'a')}, 9) AS p{p}" for p in (5, 25, 50, 75, 95))}, CAST(len(a) AS BIGINT) AS n FROM l""")
def b3(spark, sf):
    d = bu.run_quantiles(bu.runs(typed(spark, sf), ["kind", "frame_id"]), ["kind"])
    return d.select("kind", *[rnd(f"p{p}").alias(f"p{p}") for p in (5, 25, 50, 75, 95)], "n")


@register("B4_ks", f"""WITH {SQL_RUNS}, g AS (SELECT DISTINCT k.kind, v.len FROM (SELECT DISTINCT kind FROM r WHERE kind <> 'error') k, (SELECT DISTINCT len FROM r) v),
  c AS (SELECT g.kind, g.len, (SELECT avg((r.len <= g.len)::INT) FROM r WHERE r.kind = g.kind) AS fx,
    (SELECT avg((r.len <= g.len)::INT) FROM r WHERE r.kind = 'error') AS fy,
    (SELECT count(*) FROM r WHERE r.kind = g.kind) AS n, (SELECT count(*) FROM r WHERE r.kind = 'error') AS m FROM g)
  SELECT kind, any_value(n) AS n, any_value(m) AS m, round(max(abs(fx - fy)), 9) AS ks,
  round(any_value(1.36::DOUBLE * sqrt((n + m) / (n::DOUBLE * m))), 9) AS critical FROM c GROUP BY kind""")
def b4(spark, sf):
    d = bu.ks_two_sample(bu.runs(typed(spark, sf), ["kind", "frame_id"]), "kind", "error", "len")
    return d.select("kind", "n", "m", rnd("ks").alias("ks"), rnd("critical").alias("critical"))


def sql_burst(source: str = "orders", whole: bool = True) -> str:
    return f"""{sql_frames(source=source, whole=whole)}, lv(bin, level) AS (VALUES (1, 0.02::DOUBLE), (2, 0.06::DOUBLE), (3, 0.10::DOUBLE)),
  bs AS (SELECT DISTINCT frame_id, n_rows, bin, level, CAST(least(n_rows, greatest(1, floor(level * n_rows + 0.5))) AS BIGINT) AS size FROM f CROSS JOIN lv),
  bursts AS (SELECT *, {hash_sql('42', 'frame_id', 'bin')} % (n_rows - size + 1) + 1 AS start FROM bs)"""


#: Bursts in whole frames only, for designs that need equal frames, and in all frames.
SQL_BURST, SQL_BURST_ALL = sql_burst(), sql_burst(whole=False)


@register("B5_single_burst", f"""WITH {SQL_BURST_ALL} SELECT b.frame_id, CAST(bin AS BIGINT) AS bin, pos FROM bursts b JOIN f
  ON f.frame_id = b.frame_id AND pos BETWEEN start AND start + size - 1""")
def b5(spark, sf):
    return bu.burst_positions(bu.inject_single_burst(frames_orders(spark, sf, whole=False), LEVELS)).select("frame_id", "bin", "pos")


@register("B6_every_start", f"""WITH {sql_frames(source='orders', whole=False)} SELECT a.frame_id, a.pos AS start, CAST(sum(b.hit) AS BIGINT) AS hits, round(sum(b.value), 3) AS lost
  FROM f a JOIN f b ON a.frame_id = b.frame_id AND b.pos BETWEEN a.pos AND a.pos + 23 WHERE a.pos <= a.n_rows - 24 + 1 GROUP BY ALL""")
def b6(spark, sf):
    d = bu.inject_every_start(frames_orders(spark, sf, whole=False), 24)
    return d.select("frame_id", "start", "hits", rnd("lost", 3).alias("lost"))


METHODS = ["block", "goldenRP"]


def _received(spark, sf):
    f = frames_orders(spark, sf, whole=False, value=big(F.col("o_custkey") % BASE)).withColumnRenamed("value", "x")
    sent = ro.reorder(f, ro.permutations_of(f, METHODS), ["x"])
    b = bu.inject_single_burst(f, LEVELS).where(F.col("bin") == 3)
    return bu.shared_error_values(sent, b, "x", BASE)


SQL_RECEIVED = f"""{SQL_BURST_ALL}, {perms_by_length(METHODS, ORDER_LENGTHS)},
  x AS (SELECT o_orderkey // {ORDER_W} AS frame_id, o_orderkey % {ORDER_W} + 1 AS pos, o_custkey % {BASE} AS x FROM orders),
  rec AS (SELECT p.method, f.frame_id, p.pos, p.src, x.x, CASE WHEN p.pos BETWEEN b.start AND b.start + b.size - 1
    THEN 1 + {hash_sql('42', "'err'", 'f.frame_id', 'p.pos')} % 255 ELSE 0 END AS error
    FROM f JOIN bursts b ON b.frame_id = f.frame_id AND b.bin = 3 JOIN perm p ON p.src = f.pos AND p.n_rows = f.n_rows JOIN x ON x.frame_id = f.frame_id AND x.pos = p.src)"""


@register("B7_shared_errors", f"WITH {SQL_RECEIVED} SELECT method, frame_id, pos, CAST(x AS BIGINT) AS x, CAST(error AS BIGINT) AS error, CAST((x + error) % 256 AS BIGINT) AS received FROM rec")
def b7(spark, sf):
    return _received(spark, sf).select("method", "frame_id", "pos", "x", "error", "received")


@register("K21_symbol_error_rate", f"""WITH {SQL_RECEIVED} SELECT method, frame_id, count(*) AS rows, count(*) FILTER ((x + error) % 256 <> x) AS errors,
  round(avg(((x + error) % 256 <> x)::INT), 9) AS rate FROM rec GROUP BY ALL""")
def k21(spark, sf):
    d = bu.symbol_error_rate(_received(spark, sf), ["method", "frame_id"], "x", "received")
    return d.select("method", "frame_id", "rows", "errors", rnd("rate").alias("rate"))


@register("K22_snr", f"""WITH {sql_frames(source='orders', whole=False)} SELECT frame_id,
  round(10 * log10(sum(value * value) / sum(hit * value * value)), 8) AS snr_db FROM f GROUP BY frame_id""")
def k22(spark, sf):
    noisy = F.when(F.col("hit") == 1, F.lit(0.0)).otherwise(F.col("value"))
    d = bu.snr_db(frames_orders(spark, sf, whole=False), ["frame_id"], F.col("value"), noisy)
    return d.select("frame_id", rnd("snr_db", 8).alias("snr_db"))


def _fid_sql(m):
    return f"""SELECT condition, '{m}' AS measure, bin, count(*) AS n, avg(target) AS target, avg({m}) AS mean, stddev_samp({m}) AS sd
      FROM kpi_in WHERE enc_len = int_len GROUP BY ALL"""


SQL_FID = f"{SQL_KPI_IN}, p AS ({_fid_sql('actual')} UNION ALL {_fid_sql('err')}), q AS (SELECT *, mean / target AS kappa FROM p)"


def _fidelity(spark, sf):
    k = kpi_in(spark, sf).where(F.col("enc_len") == F.col("int_len"))
    both = k.select("condition", "bin", "target", F.inline(F.array(
        F.struct(F.lit("actual").alias("measure"), F.col("actual").alias("v")),
        F.struct(F.lit("err").alias("measure"), F.col("err").alias("v")))))
    return bu.noise_fidelity(both, ["condition", "measure"], "v", "target")


@register("B8_noise_fidelity", f"""WITH {SQL_FID} SELECT condition, measure, count(*) AS bins, round(regr_slope(mean, target), 8) AS slope,
  round(max(abs(kappa - 1)), 8) AS worst, CASE WHEN max(abs(kappa - 1)) <= 0.05 THEN 'honoured' WHEN regr_slope(mean, target) < 0.3 THEN 'FLAT' ELSE 'PARTIAL' END AS verdict
  FROM q GROUP BY ALL""")
def b8(spark, sf):
    d = _fidelity(spark, sf)[1]
    return d.select("condition", "measure", "bins", rnd("slope", 8).alias("slope"), rnd("worst", 8).alias("worst"), "verdict")


@register("B8b_noise_by_bin", f"""WITH {SQL_FID} SELECT condition, measure, bin, n, round(target, 9) AS target, round(mean, 9) AS mean,
  round(sd, 7) AS sd, round(kappa, 9) AS kappa FROM q""")
def b8b(spark, sf):
    d = _fidelity(spark, sf)[0]
    return d.select("condition", "measure", "bin", "n", rnd("target").alias("target"), rnd("mean").alias("mean"),
                    rnd("sd", 7).alias("sd"), rnd("kappa").alias("kappa"))


EXTENDING = ["matrix", "helical", "helicalScan", "spiral", "prime", "block"]


@register("B9_clean_region", f"""WITH {sql_frames(whole=False)}, {perms_by_length(EXTENDING, EVENT_LENGTHS)},
  r AS (SELECT method, frame_id, n_rows, p.pos, (p.src <= n_rows)::INT AS d FROM (SELECT DISTINCT frame_id, n_rows FROM f) JOIN perm p USING (n_rows)),
  w AS (SELECT *, sum(d) OVER (PARTITION BY method, frame_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS h,
        max(pos) OVER (PARTITION BY method, frame_id) AS n_out FROM r),
  m AS (SELECT method, frame_id, n_rows, n_out, n_rows::DOUBLE / n_out AS be, avg(h) AS mh FROM w WHERE pos <= n_rows - 24 + 1 GROUP BY ALL)
  SELECT method, frame_id, n_rows, n_out, round(be, 9) AS be, round(mh, 9) AS mean_hit,
  round(mh - 24 * be, 9) AS residual_rows, round(mh / 24 / be - 1, 9) AS residual_ratio FROM m""")
def b9(spark, sf):
    f = frames_events(spark, sf, whole=False)
    moved = ro.reorder(f, ro.permutations_of(f, EXTENDING), [])
    d = bu.clean_region(moved, ["method", "frame_id"], 24)
    return d.select("method", "frame_id", "n_rows", "n_out", *[rnd(c).alias(c) for c in ("be", "mean_hit", "residual_rows", "residual_ratio")])


@register("B10_block_failure", f"""WITH {SQL_LOADS}, s AS (SELECT method, frame_id, coalesce(sum(load) FILTER (phase = 'before' AND load > {T}), 0) AS lb,
  coalesce(sum(load) FILTER (phase = 'after' AND load > {T}), 0) AS la, count(*) FILTER (phase = 'before' AND load > {T}) AS bb,
  count(*) FILTER (phase = 'after' AND load > {T}) AS ba FROM loads GROUP BY ALL)
  SELECT method, frame_id, CAST(lb AS BIGINT) AS lost_before, CAST(la AS BIGINT) AS lost_after, bb AS blocks_before, ba AS blocks_after,
  round(lb::DOUBLE / {EVENT_W}, 9) AS rate_before, round(la::DOUBLE / {EVENT_W}, 9) AS rate_after,
  round(greatest(0.0, 1 - (la::DOUBLE / {EVENT_W}) / (lb::DOUBLE / {EVENT_W} + 2.220446049250313e-16)), 9) AS contribution FROM s""")
def b10(spark, sf):
    rows = frames_events(spark, sf).where(F.col("pos") == 1).select("frame_id", "n_rows")
    d = bu.block_failure(loads(spark, sf), T, rows)
    return d.select("method", "frame_id", "lost_before", "lost_after", "blocks_before", "blocks_after",
                    *[rnd(c).alias(c) for c in ("rate_before", "rate_after", "contribution")])
