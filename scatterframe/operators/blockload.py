"""Per-trial block loads: how many hits fall into each block of a frame, before and after reordering.

Statistics need only the hits: a frame of n rows has ceil(n / codeword) blocks
whether hit or not, so blocks without hits enter the sums by arithmetic.  One
further row per frame is kept, so that frames without hits stay in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import spread
from ..functions.numeric import EPS, big, clip, idiv
from .reorder import ruled, small_perm

ID = ["method", "frame_id"]


def block_loads(frames: DataFrame, perm: DataFrame, codeword: int, dense: bool = False) -> DataFrame:
    """(method, frame_id, n_rows, phase, cw, load); phase is before or after.

    ``dense`` counts every row, so each block of the frame appears even with
    load 0; otherwise only hit blocks do, plus one block per frame.  Positions
    that carry padding belong to no block.
    """
    rows = frames.select("frame_id", "n_rows", "pos", "hit")
    if not dense:
        rows = rows.where((F.col("hit") == 1) | (F.col("pos") == 1))
    rows = rows.join(small_perm(perm), ["n_rows", "pos"], "left").withColumn("src", ruled("src"))
    rows = spread(rows, *ID)  # every grouping below holds a frame's rows of a method, so this is the only shuffle
    cw = lambda c: idiv(F.col(c) - 1, codeword) + 1
    hit = F.col("hit").cast("bigint")
    both = F.array(
        F.struct(F.lit("before").alias("phase"), cw("pos").alias("cw"), hit.alias("h")),
        F.struct(F.lit("after").alias("phase"), F.least(cw("src"), cw("n_rows")).alias("cw"),
                 F.when(F.col("src") <= F.col("n_rows"), hit).otherwise(0).alias("h")),
    )
    return (
        rows.select(*ID, "n_rows", F.inline(both))
        .groupBy(*ID, "n_rows", "phase", "cw").agg(F.sum("h").alias("load"))
    )


def gini_sums(keys: list[str], value: str):
    """Ascending rank inside a group bounded by its block count."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(value))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient per group of at most a frame's worth of values, zeros included."""
    x = F.col(value)
    s = df.withColumn("_i", gini_sums(keys, value)).groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col("_i") * x).alias("ix"))
    return s.select(*keys, gini_value("n", "s", "ix").alias("gini"))


def gini_value(n: str, s: str, ix: str):
    n_, s_, ix_ = F.col(n).cast("double"), F.col(s).cast("double"), F.col(ix).cast("double")
    g = 2 * ix_ / (n_ * s_) - (n_ + 1) / n_
    return F.when((s_ == 0) | (n_ == 1), F.lit(0.0)).otherwise(clip(g, 0.0, 1.0))


def load_stats(loads: DataFrame, codeword: int, capacity: int, keys: list[str] | None = None) -> DataFrame:
    """One row per frame and phase with every statistic of its block loads, blocks without hits included."""
    keys = keys or [*ID, "phase"]
    x = F.col("load")
    noisy = F.when(x > 0, x)
    s = loads.withColumn("_i", gini_sums(keys, "load")).groupBy(*keys).agg(
        (idiv(F.max("n_rows") - 1, codeword) + 1).alias("blocks"), F.sum(x).alias("hits"), F.sum(x * x).alias("sq"),
        F.sum((x == 0).cast("bigint")).alias("zeros_seen"),
        F.count(noisy).alias("noisy_blocks"), F.coalesce(F.min(noisy), F.lit(0).cast("bigint")).alias("load_min"),
        F.max(x).alias("load_max"), F.sum(F.col("_i") * x).alias("ix"),
        F.sum((x > capacity).cast("bigint")).alias("over"), F.sum((x == capacity).cast("bigint")).alias("_marginal"),
        F.sum(((x <= capacity) & (x > 0)).cast("bigint")).alias("correctable"),
    )
    # Ranks were counted among the blocks present; the unseen empty ones come first.
    s = s.withColumns({
        "ix": F.col("ix") + (F.col("blocks") - F.col("noisy_blocks") - F.col("zeros_seen")) * F.col("hits"),
        "marginal": F.col("_marginal") if capacity else F.col("blocks") - F.col("noisy_blocks")})
    k, h, sq, nz = (F.col(c).cast("double") for c in ("blocks", "hits", "sq", "noisy_blocks"))
    var = F.when(k > 1, (sq - h * h / k) / (k - 1))
    var_nz = F.when(nz > 1, F.greatest(F.lit(0.0), (sq - h * h / nz) / (nz - 1)))
    return s.select(
        *keys, "blocks", "hits", "noisy_blocks", "load_min", "load_max", (h / k).alias("load_avg"),
        var.alias("load_var"), F.sqrt(var).alias("load_sd"), (nz / k).alias("occupancy"),
        F.when(h == 0, F.lit(1.0)).otherwise(1 / (1 + var / ((h / k) * (h / k) + EPS))).alias("uniformity"),
        gini_value("blocks", "hits", "ix").alias("gini"), "over", "marginal", "correctable",
        (F.col("blocks") - F.col("over")).alias("safe"),
        F.when(h == 0, F.lit(1.0)).otherwise(nz / F.least(k, h)).alias("eta_es"),
        F.when(nz <= 1, F.lit(1.0)).otherwise(1 / (1 + F.sqrt(var_nz) / (h / nz))).alias("delta_bs"),
    )


SIDES = ["blocks", "hits", "noisy_blocks", "load_max", "load_avg", "load_var", "load_sd", "occupancy", "uniformity",
         "gini", "over", "marginal", "correctable", "safe", "eta_es", "delta_bs"]


def sides(stats: DataFrame) -> DataFrame:
    """before_* and after_* columns on one row per (method, frame)."""
    at = lambda ph, c: F.max(F.when(F.col("phase") == ph, F.col(c))).alias(f"{ph}_{c}")
    return stats.groupBy(*ID).agg(*[at(p, c) for c in SIDES for p in ("before", "after")])


def delta_gini(s: DataFrame) -> DataFrame:
    return s.select(*ID, "before_gini", "after_gini", clip(F.col("before_gini") - F.col("after_gini"), 0.0, 1.0).alias("delta_g"))


def ecc_stats(s: DataFrame, capacity: int) -> DataFrame:
    """Margin, relative margin, blocks over capacity, mean use of capacity (after reordering)."""
    t = F.lit(capacity)
    return s.select(
        *ID, big(t - F.col("after_load_max")).alias("s_ecc"), ((t - F.col("after_load_max")) / t).alias("s_ecc_norm"),
        F.col("after_over").alias("v_ecc"), (F.col("after_load_avg") / t).alias("u_ecc"))


def efficiency(s: DataFrame, capacity: int) -> DataFrame:
    """Compliance, margin, utilisation and correctable ratios with their before-to-after differences."""
    t = F.lit(float(capacity))
    b, a = (lambda c: F.col(f"before_{c}")), (lambda c: F.col(f"after_{c}"))
    use = lambda x: F.least(F.lit(1.0), x / t) if capacity else F.lit(0.0)
    ratio = lambda f: F.when(f("noisy_blocks") == 0, F.lit(1.0)).otherwise(f("correctable") / f("noisy_blocks"))
    top = F.greatest(b("load_max"), a("load_max"))
    return s.select(
        *ID, *[c for c in s.columns if c not in ID],
        (b("over") - a("over")).alias("violation_reduction"),
        (b("safe") / b("blocks")).alias("before_compliance"), (a("safe") / a("blocks")).alias("after_compliance"),
        (a("safe") / a("blocks") - b("safe") / b("blocks")).alias("compliance_gain"),
        (t - b("load_avg")).alias("before_margin_avg"), (t - a("load_avg")).alias("after_margin_avg"),
        (t - b("load_max")).alias("before_margin_min"), (t - a("load_max")).alias("after_margin_min"),
        use(b("load_avg")).alias("before_use"), use(a("load_avg")).alias("after_use"),
        ratio(b).alias("before_correctable_ratio"), ratio(a).alias("after_correctable_ratio"),
        (a("occupancy") - b("occupancy")).alias("occupancy_gain"), (a("uniformity") - b("uniformity")).alias("uniformity_gain"),
        (b("load_var") - a("load_var")).alias("variance_reduction"), (b("load_sd") - a("load_sd")).alias("sd_reduction"),
        (b("load_max") - a("load_max")).alias("concentration_reduction"),
        F.when(top > 0, (b("load_max") - a("load_max")) / top).otherwise(F.lit(0.0)).alias("concentration_reduction_norm"),
    )


# Weights of the two composite scores.
AWARE_WEIGHTS = {"compliance": 0.35, "margin": 0.25, "uniformity": 0.25, "concentration": 0.15}
OVERALL_WEIGHTS = {"uniformity": 0.4, "occupancy": 0.3, "concentration": 0.3}


def scores(eff: DataFrame, capacity: int) -> DataFrame:
    part = {
        "margin": clip((F.col("after_margin_min") - F.col("before_margin_min")) / float(capacity), 0.0, 1.0) if capacity else F.lit(0.0),
        "concentration": clip("concentration_reduction_norm", 0.0, 1.0),
        "compliance": clip("compliance_gain", 0.0, 1.0),
        "uniformity": clip("uniformity_gain", 0.0, 1.0),
        "occupancy": clip("occupancy_gain", 0.0, 1.0),
    }
    weigh = lambda ws: sum((part[k] * w for k, w in ws.items()), F.lit(0.0))
    nb, na = F.col("before_noisy_blocks"), F.col("after_noisy_blocks")
    return eff.select(
        *ID, weigh(AWARE_WEIGHTS).alias("aware_score"), weigh(OVERALL_WEIGHTS).alias("overall_score"),
        F.when(nb > 0, F.least(F.lit(1.0), na / nb)).otherwise(F.lit(1.0)).alias("spreading"))


def sustainability(s: DataFrame) -> DataFrame:
    bo, ao, n = F.col("before_over"), F.col("after_over"), F.col("after_blocks")
    level = F.when(ao == 0, "EXCELLENT").when(ao < bo, "IMPROVED").when(ao == bo, "MAINTAINED").otherwise("DEGRADED")
    gain, fewer = F.col("after_safe") - F.col("before_safe"), bo - ao
    return s.select(
        *ID, "before_safe", "before_marginal", "before_over", "after_safe", "after_marginal", "after_over",
        ((F.col("after_safe") - ao) / n).alias("score"), clip(gain / n, -1.0, 1.0).alias("safe_gain"),
        clip(fewer / n, -1.0, 1.0).alias("over_reduction"), level.alias("level"))


def spread_map(frames: DataFrame, perm: DataFrame, codeword: int) -> DataFrame:
    """Where the hits of each frame land: distinct blocks before and after, and the spread in percent."""
    rows = frames.where(F.col("hit") == 1).select("frame_id", "n_rows", "pos").join(small_perm(perm), ["n_rows", "pos"], "left").withColumn("src", ruled("src"))
    b, a = idiv(F.col("pos") - 1, codeword), idiv(F.col("src") - 1, codeword)
    return rows.groupBy(*ID).agg(
        F.count("*").alias("hits"), F.count_distinct(b).alias("blocks_before"), F.count_distinct(a).alias("blocks_after"),
        F.max(F.floor((F.col("n_rows") - 1) / codeword) + 1).alias("_k"),
    ).select(*ID, "hits", "blocks_before", "blocks_after",
             (100.0 * F.col("blocks_after") / F.least("_k", "hits")).alias("spread_pct"))


def trial_stats(frames: DataFrame, perm: DataFrame, codeword: int, capacity: int) -> DataFrame:
    """Every per-trial measure on one row per (method, frame)."""
    st = sides(load_stats(block_loads(frames, perm, codeword), codeword, capacity))
    t = F.lit(float(capacity))
    eff = efficiency(st, capacity)
    return eff.select(
        *ID, "after_hits", "before_gini", "after_gini",
        clip(F.col("before_gini") - F.col("after_gini"), 0.0, 1.0).alias("delta_g"),
        F.col("after_eta_es").alias("eta_es"), F.col("after_delta_bs").alias("delta_bs"),
        (t - F.col("after_load_max")).alias("s_ecc"), F.col("after_over").alias("v_ecc"),
        (F.col("after_load_avg") / t).alias("u_ecc"), "compliance_gain", "uniformity_gain", "variance_reduction",
        "violation_reduction", "after_occupancy", "before_load_max", "after_load_max",
    )


def coefficient_of_variation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.stddev_samp(value) / F.avg(value)).alias("cv"))
