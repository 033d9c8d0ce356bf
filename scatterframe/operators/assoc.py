"""Association of metrics with an outcome, within blocks and between them.

The trials are scanned once into cell means (condition, block, method); every
window below runs on cells of one (condition, block, metric), which hold one row
per method.  Trial-level ranks use the piecewise ranks of ``functions.rank``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import settle, union_all
from ..functions.numeric import atanh_clipped, big, finite
from ..functions.rank import GROUP_ROWS, avg_rank_small, kendall_rows, percentiles, spearman_columns, spearman_rows

CB = ["condition", "block"]


def cell_means(trials: DataFrame, metrics: list[str], outcome: str, keys: list[str] | None = None) -> DataFrame:
    """Means over finite values per (condition, block, method)."""
    keys = keys or [*CB, "method"]
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(finite(c)).alias(c) for c in [*metrics, outcome]])


def cells_long(cells: DataFrame, metrics: list[str], outcome: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, x, y)"""
    keys = keys or [*CB, "method"]
    one = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])
    return cells.select(*keys, F.col(outcome).alias("y"), F.inline(one))


def rank_pairs(long: DataFrame, keys: list[str]) -> DataFrame:
    """Average ranks of x and y among the rows of a key where both are present."""
    ok = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return ok.withColumns({"rx": avg_rank_small(keys, "x"), "ry": avg_rank_small(keys, "y")})


def spearman_by_block(long: DataFrame, keys: list[str] | None = None, least: int = 5) -> DataFrame:
    """Spearman per (condition, block, metric) where at least ``least`` methods and two x values are seen."""
    keys = keys or [*CB, "metric"]
    s = rank_pairs(long, keys).groupBy(*keys).agg(
        F.count("*").alias("m"), F.corr("rx", "ry").alias("rho"),
        (F.min("x") != F.max("x")).alias("_vx"), (F.min("y") != F.max("y")).alias("_vy"))
    return s.where((F.col("m") >= least) & F.col("_vx") & F.col("_vy")).select(*keys, "m", "rho")


def fisher_combine(per_block: DataFrame, keys: list[str], less: int = 3, bound: float = 0.999999, r: str = "rho") -> DataFrame:
    """tanh of the mean atanh weighted by m - less."""
    w = (F.col("m") - less).cast("double")
    z = atanh_clipped(F.col(r), bound)
    return per_block.where(F.col(r).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("blocks"), F.tanh(F.try_divide(F.sum(w * z), F.sum(w))).alias("rho"))


def spearman_trials(trials: DataFrame, metrics: list[str], outcome: str, least: int = 20) -> DataFrame:
    """Spearman over the raw trials of each block."""
    s = spearman_columns(trials, CB, metrics, outcome)
    return s.where((F.col("m") >= least) & F.col("rho").isNotNull()).select(*CB, "metric", "m", "rho")


def between_block(long: DataFrame, least: int = 5) -> DataFrame:
    """Spearman of block means over the blocks of a condition; means are rounded, so ties do not hang on the order of sums."""
    means = long.groupBy("condition", "block", "metric").agg(F.round(F.avg("x"), 12).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    return spearman_by_block(means, ["condition", "metric"], least)


def per_block_spread(per_block: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    q = percentiles(per_block, keys, F.round("rho", 12), {"p25": 25, "p50": 50, "p75": 75}, small=True)
    return q.where(F.col("n") >= least).select(*keys, F.col("p50").alias("median"), (F.col("p75") - F.col("p25")).alias("iqr"), F.col("n").alias("blocks"))


def pivot_correlations(trials: DataFrame, metrics: list[str], pivots: list[str], drop_zero_pivot: bool = False, least: int = 3) -> DataFrame:
    """Pearson and Spearman of every metric with every pivot, ranked by |r| per pivot."""
    found = []
    for p in pivots:
        rest = [m for m in metrics if m != p]
        d = trials.select(*[finite(m).alias(m) for m in rest], finite(p).alias(p)).where(F.col(p) != 0 if drop_zero_pivot else F.col(p).isNotNull())
        pear = d.agg(*[F.corr(m, p).alias(m) for m in rest]).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("pearson")) for m in rest])))
        s = spearman_columns(d, [], rest, p).where(F.col("m") >= least).join(pear, "metric")
        found.append(s.select(F.lit(p).alias("kpi"), "metric", "m", "pearson", F.col("rho").alias("spearman")))
    d = union_all(found)
    w = Window.partitionBy("kpi")
    order = lambda c: w.orderBy(F.abs(F.round(c, 9)).desc_nulls_last(), "metric")
    return d.withColumns({
        "rank_pearson": big(F.row_number().over(order("pearson"))), "rank_spearman": big(F.row_number().over(order("spearman"))),
        "max_pearson": F.max(F.abs("pearson")).over(w), "max_spearman": F.max(F.abs("spearman")).over(w)})


def pair_columns(metrics: list[str], prefix: str = "") -> list[tuple[str, str, Column]]:
    return [(a, b, F.corr(prefix + a, prefix + b)) for a, b in combinations(metrics, 2)]


def melt_pairs(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], cols: dict[str, list[str]], extra=()) -> DataFrame:
    """One row per metric pair from wide columns; ``cols`` maps output name to column names in pair order."""
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(c[i]).alias(n) for n, c in cols.items()]) for i, (a, b) in enumerate(pairs)]
    return df.select(*keys, *extra, F.inline(F.array(*items)))


def correlation_matrix(trials: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson of every metric pair, all pairs in one aggregation of one scan."""
    keys = keys or []
    clean = trials.select(*keys, *[finite(m).alias(m) for m in metrics])
    pairs = list(combinations(metrics, 2))
    wide = clean.groupBy(*keys).agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return melt_pairs(wide, keys, pairs, {"r": [f"r{i}" for i in range(len(pairs))]}).where(F.col("r").isNotNull() & ~F.isnan("r"))


def within_block_matrix(cells: DataFrame, metrics: list[str], least: int = 5) -> DataFrame:
    """Spearman and Pearson of metric pairs within blocks, Fisher-combined per condition.

    Missing values take the mean rank (mean value) of their block; a pair with a
    constant side in a block adds no weight there.
    """
    w = Window.partitionBy(*CB)
    ranks = {}
    for m in metrics:
        r = F.rank().over(w.orderBy(F.col(m).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*CB, m)) - 1) / 2.0
        ranks[f"_r_{m}"] = F.when(F.col(m).isNotNull(), r)
    d = cells.withColumns(ranks)
    fill = {f"_r_{m}": F.coalesce(F.col(f"_r_{m}"), F.avg(f"_r_{m}").over(w)) for m in metrics}
    fill |= {m: F.coalesce(F.col(m), F.avg(m).over(w)) for m in metrics}
    d = d.withColumns(fill)
    pairs = list(combinations(metrics, 2))
    flat = lambda a: F.min(a) == F.max(a)
    wide = d.groupBy(*CB).agg(
        F.count("*").alias("m"),
        *[F.when(~flat(a) & ~flat(b), F.corr(f"_r_{a}", f"_r_{b}")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)],
        *[F.when(~flat(a) & ~flat(b), F.corr(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    long = melt_pairs(wide.where(F.col("m") >= least), CB, pairs, {
        "s": [f"s{i}" for i in range(len(pairs))], "p": [f"p{i}" for i in range(len(pairs))]}, extra=["m"])
    bound = 1 - 1e-12
    wt = (F.col("m") - 3).cast("double")
    comb = lambda c: F.tanh(F.try_divide(F.sum(F.when(F.col(c).isNotNull(), wt * atanh_clipped(c, bound))), F.sum(F.when(F.col(c).isNotNull(), wt))))
    return long.groupBy("condition", "a", "b").agg(comb("s").alias("spearman"), comb("p").alias("pearson"))


def redundant_pairs(matrix: DataFrame, keys: list[str], limit: int = 50, above: float = 0.95, r: str = "r") -> DataFrame:
    """The strongest pairs per key with a mark on those above the redundancy bound."""
    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    d = matrix.withColumn("rank", big(F.row_number().over(w.orderBy(F.abs(F.round(r, 9)).desc(), "a", "b"))))
    return d.where(F.col("rank") <= limit).withColumn("redundant", F.abs(r) > above)


def metric_groups(matrix: DataFrame, keys: list[str], metrics: list[str], above: float = 0.80, r: str = "r") -> DataFrame:
    """Greedy groups: each unvisited metric, in list order, takes the later unvisited ones it correlates with."""
    index = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i + 1))])
    n = len(metrics)
    edges = matrix.where(F.abs(r) > above).select(*keys, F.element_at(index, F.col("a")).alias("i"), F.element_at(index, F.col("b")).alias("j"))
    edges = edges.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    adj = edges.groupBy(*keys).agg(F.collect_set(F.col("i") * 10_000 + F.col("j")).alias("e"))
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<array<int>>").alias("groups"))

    def step(s, i):
        mates = F.filter(F.sequence(F.lit(1), F.lit(n)), lambda j: (j > i) & ~F.array_contains(s["seen"], j) & F.array_contains(F.col("e"), i * 10_000 + j))
        grown = F.concat(F.array(i), mates)
        return F.when(F.array_contains(s["seen"], i), s).otherwise(F.struct(
            F.concat(s["seen"], grown).alias("seen"),
            F.when(F.size(mates) > 0, F.concat(s["groups"], F.array(grown))).otherwise(s["groups"]).alias("groups")))

    names = F.array(*[F.lit(m) for m in metrics])
    g = adj.select(*keys, F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: s["groups"])).alias("g", "members"))
    return g.select(*keys, big(F.col("g") + 1).alias("group_no"), big(F.size("members")).alias("size"),
                    F.array_join(F.transform("members", lambda i: F.element_at(names, i)), ",").alias("members"))


def partial_corr(rxy, rxm, rmy) -> Column:
    """Correlation of x and y given m; NULL when a leg is collinear."""
    den2 = (1 - rxm * rxm) * (1 - rmy * rmy)
    p = (rxy - rxm * rmy) / F.sqrt(den2)
    return F.when(den2 >= 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p)))


def mediation_test(matrix: DataFrame, triples: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """Does x reach y only through m?  ``matrix`` holds spearman and pearson per unordered pair."""
    def pick(a, b, c):
        hit = ((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a))
        return F.max(F.when(hit, F.col(c)))

    aggs = []
    for i, (x, m, y) in enumerate(triples):
        for tag, (p, q) in {"xy": (x, y), "xm": (x, m), "my": (m, y)}.items():
            aggs += [pick(p, q, c).alias(f"{c[0]}_{tag}_{i}") for c in ("spearman", "pearson")]
    one = matrix.groupBy(*keys).agg(*aggs)
    items = [F.struct(F.lit(x).alias("x"), F.lit(m).alias("m"), F.lit(y).alias("y"),
                      *[F.col(f"{c}_{t}_{i}").alias(f"{c}_{t}") for c in "sp" for t in ("xy", "xm", "my")])
             for i, (x, m, y) in enumerate(triples)]
    d = one.select(*keys, F.inline(F.array(*items)))
    d = d.withColumns({"part_s": partial_corr(F.col("s_xy"), F.col("s_xm"), F.col("s_my")),
                       "part_p": partial_corr(F.col("p_xy"), F.col("p_xm"), F.col("p_my"))})
    frac = F.abs("part_p") / F.greatest(F.abs("p_xy"), F.lit(2.220446049250313e-16))
    verdict = (
        F.when(F.col("part_s").isNull() | F.col("part_p").isNull(), "undefined: a leg is collinear")
        .when((F.abs("s_xm") <= 0.3) | (F.abs("s_my") <= 0.3), "not mediation: a leg is too weak")
        .when(frac < 0.25, "consistent with mediation").when(frac < 0.70, "partial mediation")
        .otherwise("not mediation: survives conditioning"))
    return d.withColumns({"surviving": frac, "verdict": verdict})


def rank_partial_by_block(cells: DataFrame, metrics: list[str], outcome: str, control: str, least: int = 6) -> DataFrame:
    """Rank correlation of metric and outcome given one control, per (condition, block, metric)."""
    keys = [*CB, "metric"]
    one = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])
    long = cells.select(*CB, "method", F.col(outcome).alias("y"), F.col(control).alias("c"), F.inline(one)).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("c").isNotNull())
    r = long.withColumns({f"r{v}": avg_rank_small(keys, v) for v in "xyc"})
    s = r.groupBy(*keys).agg(
        F.count("*").alias("m"), F.corr("rx", "ry").alias("xy"), F.corr("rx", "rc").alias("xc"), F.corr("rc", "ry").alias("cy"),
        (F.min("x") != F.max("x")).alias("_v"))
    s = s.where((F.col("m") >= least) & F.col("_v"))
    den2 = (1 - F.col("xc") * F.col("xc")) * (1 - F.col("cy") * F.col("cy"))
    return s.select(*keys, "m", F.when(den2 > 1e-12, (F.col("xy") - F.col("xc") * F.col("cy")) / F.sqrt(den2)).alias("rho"))


def kendall_by_block(long: DataFrame, keys: list[str] | None = None, least: int = 5, piece_rows: int = GROUP_ROWS) -> DataFrame:
    """Kendall tau-b of cells per (condition, block, metric)."""
    k = kendall_rows(long, keys or [*CB, "metric"], "x", "y", piece_rows)
    return k.where((F.col("m") >= least) & F.col("rho").isNotNull())


def kendall_trials(trials: DataFrame, metrics: list[str], outcome: str, least: int = 20, piece_rows: int = GROUP_ROWS) -> DataFrame:
    """Kendall tau-b over the raw trials of each block; a trial is dealt once for all its metrics."""
    k = kendall_rows(trials, CB, metrics, outcome, piece_rows)
    return k.where((F.col("m") >= least) & F.col("rho").isNotNull()).select(*CB, "metric", "m", "rho")


def tau_threshold(rho: float = 0.30) -> float:
    """Kendall threshold matching a Spearman one under normality."""
    from math import asin, pi, sin

    return 2 / pi * asin(2 * sin(pi * rho / 6))


def pooled_vs_within(long: DataFrame, least_pooled: int = 11, least: int = 5) -> DataFrame:
    """Spearman over all cells of a condition beside the within-block value, both ranked in one pass."""
    levels = F.array(F.struct(F.col("block").alias("_block"), F.lit(False).alias("pooled")), F.struct(F.lit(None).cast(long.schema["block"].dataType).alias("_block"), F.lit(True).alias("pooled")))
    both = long.select("condition", "metric", "x", "y", F.inline(levels)).withColumnRenamed("_block", "block")
    s = settle(spearman_rows(both, [*CB, "metric", "pooled"], "x", "y").where(F.col("rho").isNotNull()))
    within = fisher_combine(s.where(~F.col("pooled") & (F.col("m") >= least)), ["condition", "metric"]).withColumnRenamed("rho", "within")
    pooled = s.where(F.col("pooled") & (F.col("m") >= least_pooled))
    return pooled.select("condition", "metric", "m", F.col("rho").alias("pooled")).join(within, ["condition", "metric"])
