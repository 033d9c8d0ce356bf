"""A-priori load metrics of permutations over every burst start.

A burst of B rows starting at s (1..N-B+1) hits the block of each source row it
covers.  Instead of sliding a window row by row, each row raises its block's
load at the first start that covers it and lowers it after the last; the rest
is cumulative sums over those events.  Per (permutation, B) there are at most 2N
events, and after one shuffle by permutation every step stays in place.

With C_c(s) the number of blocks holding at least c hits at start s:
touched blocks = C_1, sum of squares = sum (2c-1) C_c, rank sum of the Gini =
sum C_c K - C_c (C_c - 1)/2, and the maximum load is the number of c with C_c > 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import attach, spread
from ..functions.numeric import big, idiv
from ..functions.rank import percentiles, spearman_rows
from . import structure as st

#: Events, about, that one task of ``load_metrics`` takes; a permutation stays whole.
EVENTS_A_TASK = 1 << 19

STATS = ["over_t", "max_err", "mean_max", "cv_load", "gini_load", "es_load"]


def deal(rows: DataFrame, keys: list[str], bursts: list[int]) -> DataFrame:
    """``rows`` of permutations, or of what they are made from, by ``keys`` in tasks of about ``EVENTS_A_TASK`` events."""
    return spread(rows, *keys, least=-(-2 * len(bursts) * rows.count() // EVENTS_A_TASK))


def load_metrics(perm: DataFrame, keys: list[str], bursts: list[int], codeword: int, capacity: int, dealt: bool = False) -> DataFrame:
    """(keys, b, over_t, max_err, mean_max, cv_load, gini_load, es_load); all but es_load are NULL when B >= N.

    ``dealt`` states that ``perm`` comes from rows that ``deal`` has dealt, so they are not shuffled again.
    """
    k = [*keys, "b"]
    n, nb = F.col("n"), F.col("b")
    size = Window.partitionBy(*keys)
    d = (perm if dealt else deal(perm, keys, bursts)).select(
        *keys, "pos", (idiv(F.col("src") - 1, codeword) + 1).alias("cw"), F.count("*").over(size).alias("n"))
    d = d.withColumn("asked", F.explode(F.array(*[F.lit(b).cast("bigint") for b in bursts]))).withColumn("b", F.least("asked", "n"))
    last = n - nb + 1
    ev = d.select(*keys, "asked", "b", "n", "cw", F.inline(F.array(
        F.struct(F.greatest(F.lit(1).cast("bigint"), F.col("pos") - nb + 1).alias("s"), F.lit(1).alias("delta")),
        F.struct((F.col("pos") + 1).alias("s"), F.lit(-1).alias("delta")))))
    ev = ev.where(F.col("s") <= last)
    k = [*keys, "asked", "b", "n"]
    net = ev.groupBy(*k, "cw", "s").agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)
    run = F.sum("delta").over(Window.partitionBy(*k, "cw").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lv = net.select(*k, "s", run.alias("v"), (run - F.col("delta")).alias("o"))
    # A change from o to v crosses the levels in between, one unit each.
    up = F.col("v") > F.col("o")
    levels = F.sequence(F.least("o", "v") + 1, F.greatest("o", "v"))
    unit = lv.select(*k, "s", F.when(up, 1).otherwise(-1).alias("u"), F.explode(levels).alias("c"))
    step = unit.groupBy(*k, "c", "s").agg(F.sum("u").alias("u"))
    w = Window.partitionBy(*k, "c").orderBy("s")
    cnt = F.sum("u").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = step.select(*k, "c", "s", "u", cnt.alias("cnt"))
    kk = F.floor((n - 1) / codeword) + 1
    q = lambda x: x * kk - x * (x - 1) / 2
    prev = F.col("cnt") - F.col("u")
    alive = F.when(F.col("cnt") > 0, 1).otherwise(0) - F.when(prev > 0, 1).otherwise(0)
    at = step.groupBy(*k, "s").agg(
        F.sum(F.when(F.col("c") == 1, F.col("u")).otherwise(0)).alias("d_nz"), F.sum((2 * F.col("c") - 1) * F.col("u")).alias("d_sq"),
        F.sum(q(F.col("cnt")) - q(prev)).alias("d_rank"), F.sum(alive).alias("d_max"),
        F.sum(F.when(F.col("c") == capacity + 1, alive).otherwise(0)).alias("d_over"))
    ws = Window.partitionBy(*k).orderBy("s")
    cum = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.select(*k, (F.lead("s", 1).over(ws)).alias("nxt"), "s", *[F.sum(f"d_{c}").over(cum).alias(c) for c in ("nz", "sq", "rank", "max", "over")])
    span = (F.coalesce("nxt", last + 1) - F.col("s")).cast("double")
    nz, sq = F.col("nz").cast("double"), F.col("sq").cast("double")
    mu = nb / nz
    var = sq / nz - mu * mu
    cv = F.when((nz < 2) | (var <= 0), F.lit(0.0)).otherwise(F.sqrt(var) / mu)
    gini = F.when(kk < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 2 * F.col("rank") / (kk * nb) - (kk + 1) / kk))
    s = at.groupBy(*k).agg(
        F.sum(span * (F.col("over") > 0).cast("int")).alias("over"), F.max("max").alias("max_err"), F.sum(span * F.col("max")).alias("mx"),
        F.sum(span * cv).alias("cv"), F.sum(span * gini).alias("g"), F.sum(span * nz).alias("t"))
    fits = F.col("asked") < n
    mean = lambda c: F.when(fits, F.col(c) / last)
    return s.select(*keys, F.col("asked").alias("b"), mean("over").alias("over_t"), F.when(fits, big("max_err")).alias("max_err"),
                    mean("mx").alias("mean_max"), mean("cv").alias("cv_load"), mean("g").alias("gini_load"),
                    (F.col("t") / last / F.least(kk, nb)).alias("es_load"))


def design_cells(perm: DataFrame, keys: list[str], codeword: int, capacity: int, multiples=(1, 2, 4, 8, 12, 16, 24)) -> DataFrame:
    """One wide row per permutation: the six load statistics at each burst length and five structure metrics."""
    bursts = [codeword * m for m in multiples]
    loads = load_metrics(perm, keys, bursts, codeword, capacity)
    wide = loads.groupBy(*keys).agg(*[
        F.max(F.when(F.col("b") == b, F.col(c))).alias(f"{c}_b{b}") for b in bursts for c in STATS])
    longest = perm.agg(F.max("n_rows")).first()[0] or 0
    if longest * (longest - 1) // 2 <= st.PAIRS_A_TASK:
        return wide.join(st.design_metrics(perm, keys, codeword, capacity), keys)
    minima = st.spreads(st.lag_minima(perm, keys), keys).select(*keys, "s_new", "s_ach")
    return (
        wide.join(st.b_guar(perm, keys, codeword, capacity).select(*keys, "b_guar"), keys)
        .join(st.dispersion(perm, keys).select(*keys, "dispersion"), keys).join(minima, keys)
        .join(st.adjacency(perm, keys).select(*keys, "adj_dispersion"), keys)
    )


def bracket(candidates: DataFrame, ensemble: DataFrame, identity: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Metric of each candidate between the identity and a random ensemble of the same length."""
    q = percentiles(ensemble.select("n_rows", F.round(value, 12).alias(value)), ["n_rows"], value, {"q1": 25, "median": 50, "q3": 75}, small=True)
    e = ensemble.groupBy("n_rows").agg(F.min(value).alias("low"), F.max(value).alias("high")).join(q.drop("n"), "n_rows")
    e = e.join(identity.select("n_rows", F.col(value).alias("identity")), "n_rows")
    d = attach(candidates.select(*keys, "n_rows", F.col(value).alias("value")), e, ["n_rows"])
    return d.withColumn("place", F.when(F.col("value") < F.col("low"), "below the ensemble").when(F.col("value") > F.col("high"), "above the ensemble").otherwise("inside"))


def rho_by_burst(loads: DataFrame, outcome: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """|Spearman| of every load statistic with an outcome, per burst length."""
    one = F.array(*[F.struct(F.lit(s).alias("stat"), F.round(F.col(s).cast("double"), 12).alias("x")) for s in stats])
    d = loads.join(outcome, keys).select("b", "y", F.inline(one))
    return spearman_rows(d, ["stat", "b"], "x", "y").select("stat", "b", "m", F.abs("rho").alias("rho")).where(F.col("rho").isNotNull())


def b_sweep(rhos: DataFrame) -> DataFrame:
    """Best burst length, where the plateau starts, the falls before and after the peak, and a verdict per statistic.

    A statistic has one row per burst length, so its windows are tiny.
    """
    w = Window.partitionBy("stat")
    by_b = w.orderBy("b")
    r = rhos.select("stat", "b", F.round("rho", 10).alias("rho"))
    d = r.withColumns({
        "top": F.max("rho").over(w), "tail_low": F.min("rho").over(by_b.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "step": F.col("rho") - F.lag("rho").over(by_b)})
    peak = F.min(F.when(F.col("rho") == F.col("top"), F.col("b"))).over(w)
    d = d.withColumn("peak", peak)
    s = d.groupBy("stat").agg(
        F.max("peak").alias("best_b"), F.max("top").alias("best_rho"), F.min(F.when(F.col("top") - F.col("tail_low") <= 0.02 + 1e-12, F.col("b"))).alias("plateau_from"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("b") <= F.col("peak"), -F.col("step"))), F.lit(0.0))).alias("fall_before"),
        (F.max("top") - F.max_by("rho", "b")).alias("fall_after"))
    verdict = F.when(F.col("fall_before") > 0.10, "swings before its peak").when(F.col("fall_after") > 0.10, "peaks then falls").otherwise("rises to a plateau")
    return s.withColumn("verdict", verdict)
