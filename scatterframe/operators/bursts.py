"""Runs, bursts and fault injection on tables of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import attach
from ..functions.numeric import EPS, big, hash32
from ..functions.rank import PIECE_ROWS, percentiles, running, value_counts


def runs(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of consecutive positions.  ``keys`` must contain the (bounded) frame."""
    w = Window.partitionBy(*keys).orderBy("pos")
    island = hits.select(*keys, "pos", (F.col("pos") - F.row_number().over(w)).alias("_isl"))
    r = island.groupBy(*keys, "_isl").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("len"))
    return r.select(*keys, big(F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).alias("run_no"), "start", "end", "len")


def run_stats(r: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Runs per frame, mean length per frame and pooled, longest run, realised hit rate.

    ``frames`` gives the number of frames and rows of each key.
    """
    per = r.groupBy(*keys, "frame_id").agg(
        F.count("*").alias("c"), F.sum("len").alias("s"), F.max("len").alias("m"))
    s = per.groupBy(*keys).agg(
        F.count("*").alias("hit_frames"), F.sum("c").alias("runs"), F.sum("s").alias("hits"), F.max("m").alias("max_len"),
        F.avg(F.col("s") / F.col("c")).alias("mean_len_frame"))
    return s.join(frames, keys).select(
        *keys, "frames", "hit_frames", "runs", (F.col("runs") / F.col("frames")).alias("runs_per_frame"), "mean_len_frame",
        (F.col("hits") / F.col("runs")).alias("mean_len_pooled"), "max_len", (F.col("hits") / F.col("rows")).alias("rate"))


def run_quantiles(r: DataFrame, keys: list[str], ps=(5, 25, 50, 75, 95)) -> DataFrame:
    return percentiles(r, keys, "len", {f"p{p}": p for p in ps}, small=True)


def ks_two_sample(r: DataFrame, group: str, reference: str, value: str, k: float = 1.36, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """sup|F1 - F2| of every group against one reference group, with the critical value.

    Works on running counts per distinct value; a group with many of them is dealt by ranges.
    """
    vc = value_counts(r, [group], value)
    ref = vc.where(F.col(group) == reference).select("v", F.col("cnt").alias("y"))
    others = vc.where(F.col(group) != reference).select(group, "v", F.col("cnt").alias("x"))
    # Every other group is laid over the reference values; the groups are few.
    names = others.agg(F.array_sort(F.collect_set(group)).alias("g")).scalar()
    grid = others.withColumn("y", F.lit(0).cast("bigint")).unionByName(
        ref.select(F.explode(names).alias(group), "v", F.lit(0).cast("bigint").alias("x"), "y"))
    grid = grid.groupBy(group, "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    g = running(grid, [group], "v", ["x", "y"], piece_rows=piece_rows)
    g = g.select(group, F.col("total_x").alias("n"), F.col("total_y").alias("m"), F.abs(F.col("upto_x") / F.col("total_x") - F.col("upto_y") / F.col("total_y")).alias("d"))
    out = g.groupBy(group).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("d").alias("ks"))
    return out.withColumn("critical", k * F.sqrt((F.col("n") + F.col("m")) / (F.col("n").cast("double") * F.col("m"))))


def burst_size(level: Column, n: Column) -> Column:
    """round(level*n), at least one row and at most the frame."""
    return F.least(n, F.greatest(F.lit(1), F.floor(level * n + 0.5))).cast("bigint")


def inject_single_burst(frames: DataFrame, levels: list[float], seed: int = 42) -> DataFrame:
    """One contiguous burst per frame and level: (frame_id, bin, start, size), start by hash."""
    lv = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("bin"), F.lit(x).alias("level")) for i, x in enumerate(levels)])
    head = frames.where(F.col("pos") == 1).select("frame_id", "n_rows", F.inline(lv))
    size = burst_size(F.col("level"), F.col("n_rows"))
    return head.withColumn("size", size).withColumn(
        "start", hash32(F.lit(seed), "frame_id", "bin") % (F.col("n_rows") - F.col("size") + 1) + 1)


def burst_positions(bursts: DataFrame) -> DataFrame:
    end = F.col("start") + F.col("size") - 1
    return bursts.select("frame_id", "n_rows", "bin", "level", F.explode(F.sequence("start", end)).alias("pos"))


def inject_every_start(frames: DataFrame, size: int, value: str = "value") -> DataFrame:
    """What a burst of ``size`` rows would cost at every start that fits: hits and value lost."""
    w = Window.partitionBy("frame_id").orderBy("pos").rowsBetween(Window.currentRow, size - 1)
    lost = frames.select("frame_id", "n_rows", F.col("pos").alias("start"), F.sum("hit").over(w).alias("hits"),
                         F.sum(value).over(w).alias("lost"))
    return lost.where(F.col("start") <= F.col("n_rows") - size + 1).drop("n_rows")


def field_size(base: int) -> int:
    """Smallest power of two that holds ``base`` values."""
    return 1 << (base - 1).bit_length()


def shared_error_values(rows: DataFrame, bursts: DataFrame, value: str, base: int, seed: int = 42) -> DataFrame:
    """Add one error value per (frame, position), shared by all methods, inside the burst only.

    ``bursts`` has one interval per frame, so it is joined by frame and size-checked.
    """
    q = field_size(base)
    b = bursts.select("frame_id", "start", "size")
    hit = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size"))
    d = F.when(hit, 1 + hash32(F.lit(seed), F.lit("err"), "frame_id", "pos") % (q - 1)).otherwise(F.lit(0))
    return attach(rows, b, ["frame_id"]).withColumn("error", big(d)).withColumn(
        "received", (F.col(value) + F.col("error")) % q).drop("start", "size")


def symbol_error_rate(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Share of positions that differ, per group; a group without positions gives 0."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum((F.col(a) != F.col(b)).cast("bigint")).alias("errors"),
    ).withColumn("rate", F.coalesce(F.col("errors") / F.col("rows"), F.lit(0.0)))


def snr_db(rows: DataFrame, keys: list[str], clean: Column, noisy: Column) -> DataFrame:
    p = rows.groupBy(*keys).agg(F.sum(clean * clean).alias("s"), F.sum((noisy - clean) * (noisy - clean)).alias("e"))
    return p.select(*keys, F.when(F.col("e") > 0, 10 * F.log10(F.col("s") / F.col("e"))).alias("snr_db"))


def noise_fidelity(df: DataFrame, keys: list[str], actual: str, target: str, tol: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Realised against target level: per bin (mean, sd, kappa) and per key (slope, verdict)."""
    per = df.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(target).alias("target"), F.avg(actual).alias("mean"), F.stddev_samp(actual).alias("sd"),
    ).withColumn("kappa", F.col("mean") / F.col("target"))
    v = per.groupBy(*keys).agg(
        F.count("*").alias("bins"), F.regr_slope("mean", "target").alias("slope"),
        F.max(F.abs(F.col("kappa") - 1)).alias("worst"))
    verdict = (
        F.when(F.col("worst") <= tol, "honoured").when(F.col("slope") < 0.3, "FLAT").otherwise("PARTIAL"))
    return per, v.withColumn("verdict", verdict)


def cover(pos: Column, n: Column, size: int) -> Column:
    """How many starts of a burst of ``size`` rows among n-size+1 cover a position."""
    starts = n - size + 1
    return F.greatest(F.lit(0), F.least(pos, starts) - F.greatest(F.lit(1), pos - size + 1) + 1)


def clean_region(reordered: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Mean data rows hit over all burst starts against size * bandwidth efficiency.

    Every position is weighted by the number of starts covering it, so the mean
    over all starts is one aggregation.
    """
    c = cover(F.col("pos"), F.col("n_rows"), size)
    data = (F.col("src") <= F.col("n_rows")).cast("bigint")
    s = reordered.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"), F.max("pos").alias("n_out"), F.sum(c * data).alias("covered"))
    be = F.col("n_rows") / F.col("n_out")
    mean = F.col("covered") / (F.col("n_rows") - size + 1)
    return s.select(*keys, "n_rows", "n_out", be.alias("be"), mean.alias("mean_hit"), (mean - size * be).alias("residual_rows"),
                    (mean / size / be - 1).alias("residual_ratio"))


def block_failure(loads: DataFrame, capacity: int, frame_rows: DataFrame) -> DataFrame:
    """What-if: a block is lost when it holds more hits than its capacity.

    Failed-row rate with and without reordering and the share of loss avoided.
    """
    bad = F.col("load") > capacity
    lost = lambda ph: F.sum(F.when((F.col("phase") == ph) & bad, F.col("load")).otherwise(0))
    blocks = lambda ph: F.count(F.when((F.col("phase") == ph) & bad, 1))
    s = loads.groupBy("method", "frame_id").agg(
        lost("before").alias("lost_before"), lost("after").alias("lost_after"),
        blocks("before").alias("blocks_before"), blocks("after").alias("blocks_after"))
    s = s.join(frame_rows, "frame_id")
    rb, ra = F.col("lost_before") / F.col("n_rows"), F.col("lost_after") / F.col("n_rows")
    return s.select("method", "frame_id", "lost_before", "lost_after", "blocks_before", "blocks_after",
                    rb.alias("rate_before"), ra.alias("rate_after"), F.greatest(F.lit(0.0), 1 - ra / (rb + EPS)).alias("contribution"))


