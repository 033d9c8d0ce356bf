"""A-priori structure metrics of permutations held as (keys, n_rows, pos, src).

Every window is partitioned by permutation, whose length is that of one frame.
Metrics over many lags keep a permutation as one array of at most a frame's
length and scan lags inside the row, so pairs of positions never become rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import BROADCAST_BYTES, settle, spread
from ..functions.numeric import EPS, big, hash32, idiv


def _win(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def separation(perm: DataFrame, keys: list[str]) -> DataFrame:
    """How far neighbours in source order end up: min, max, mean, variance, CV and efficiency."""
    gap = F.abs(F.lead("pos").over(_win(keys, "src")) - F.col("pos")).cast("double")
    s = perm.select(*keys, gap.alias("g")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"), F.avg("g").alias("av"), F.var_samp("g").alias("va"))
    e = (F.col("n") - 1).cast("double")
    a = F.col("av") / e
    return s.select(*keys, (F.col("lo") / e).alias("sep_min"), (F.col("hi") / e).alias("sep_max"), a.alias("sep_avg"),
                    (F.col("va") / (e * e)).alias("sep_var"), (F.sqrt("va") / F.col("av")).alias("sep_cv"),
                    F.least(2 * a, 2 * (1 - a)).alias("eta_sep"))


def adjacency(perm: DataFrame, keys: list[str]) -> DataFrame:
    """Source jumps between neighbouring positions: min, mean, CV, and the number of distinct jumps."""
    jump = F.abs(F.col("src") - F.lag("src").over(_win(keys, "pos")))
    s = perm.select(*keys, jump.alias("j")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("j").alias("lo"), F.avg("j").alias("av"), F.stddev_samp("j").alias("sd"), F.count_distinct("j").alias("distinct"))
    e = (F.col("n") - 1).cast("double")
    return s.select(*keys, (F.col("lo") / e).alias("adj_min"), (F.col("av") / e).alias("adj_avg"),
                    ((F.col("sd") / e) / (F.col("av") / e + EPS)).alias("adj_cv"), (F.col("distinct") / e).alias("adj_dispersion"))


def as_array(perm: DataFrame, keys: list[str], by: str, value: str, least: int = 0) -> DataFrame:
    """One row per permutation: ``value`` in the order of ``by`` (bounded by the frame length), in ``least`` tasks or more."""
    pairs = F.array_sort(F.array_agg(F.struct(F.col(by), F.col(value))))
    return spread(perm, *keys, least=least).groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.transform("_p", lambda s: s[value]).alias("p"), F.size("_p").alias("n"))


def _shifted(p: Column, d: Column, f) -> Column:
    n = F.size(p) - d
    return F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, d + 1, n), f)


#: Pairs of positions that one call of the dispersion kernel compares; longer permutations are dealt by lags.
PAIRS_A_TASK = 1 << 28
#: Registers of a distinct-count sketch are 2^SKETCH_BITS; its relative standard error is about 1.04 / 2^(SKETCH_BITS/2).
SKETCH_BITS = 12
#: Sketches that one task builds, on average.  Beyond 128 Spark sorts all vectors of a task before it sketches them.
SKETCHES_A_TASK = 64


def _by_length(arrays: pd.Series, kernel, out: np.ndarray, cells: int) -> np.ndarray:
    """``kernel`` on stacks of equally long permutations of about ``cells`` values, results in the order of ``arrays``."""
    sizes = arrays.map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, cells // int(n))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            out[part] = kernel(np.array(arrays.iloc[part].tolist(), np.int64))
    return out


def _vectors(p: np.ndarray) -> np.ndarray:
    """Distinct (gap, displacement) vectors of each row."""
    m, n = p.shape
    seen, total, row = np.empty((m, 2 * n), bool), np.zeros(m, np.int64), np.arange(m)[:, None]
    for d in range(1, n):
        seen[:] = False
        seen[row, p[:, d:] - p[:, :-d] + n] = True
        total += seen.sum(1)
    return total


def _vectors_at(p: np.ndarray, first: int, step: int) -> int:
    """Distinct (gap, displacement) vectors of one permutation over every ``step``-th gap from ``first`` on."""
    n = len(p)
    p, seen, total = p.astype(np.int32), np.empty(2 * n, bool), 0
    for d in range(first, n, step):
        seen[:] = False
        seen[p[d:] - p[:-d] + n] = True
        total += np.count_nonzero(seen)
    return total


def autocorrelations(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Aperiodic autocorrelation of each row of whole numbers as exact sums: (shift, r) with the sum of r * 2^shift.

    Numbers are cut into digits so short that rounding a product of their
    Fourier transforms is certain to give its whole value.
    """
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    bits = int(np.abs(x).max(initial=1)).bit_length() + 1
    digits = next(k for k in range(1, bits + 1) if n * 4.0 ** -(-bits // k) * 2.0**-53 * 16 * size.bit_length() < 0.25)
    width = -(-bits // digits)
    half, left, spectra = 1 << (width - 1), x, []
    for _ in range(digits):
        low = ((left + half) & (2 * half - 1)) - half
        left = (left - low) >> width
        spectra.append(np.fft.rfft(low, size))
    if left.any():  # the carry of the last digit
        spectra.append(np.fft.rfft(left, size))
    out = []
    for i, a in enumerate(spectra):
        for j in range(i, len(spectra)):
            cross = a * np.conj(spectra[j])
            r = np.fft.irfft(cross if i == j else cross + np.conj(cross), size)[:, :n]
            out.append((width * (i + j), np.rint(r).astype(np.int64)))
    return out


#: Up to this length whole sums fit 64 bits.
_WHOLE = 2_900_000


def _lobes(p: np.ndarray) -> np.ndarray:
    """Largest absolute autocorrelation of each row's centred values over all lags but 0, over that at lag 0."""
    n = p.shape[1]
    if n == 1:
        return np.full(len(p), np.nan)
    parts = autocorrelations(2 * p - n - 1)
    r = sum(part << shift for shift, part in parts) if n <= _WHOLE else sum(part.astype(np.longdouble) * 2.0**shift for shift, part in parts)
    return (np.abs(r[:, 1:]).max(1).astype(np.float64) / r[:, 0].astype(np.float64))


@F.pandas_udf(T.LongType())
def distinct_vectors(p: pd.Series, first: pd.Series, step: pd.Series) -> pd.Series:
    out, whole = np.zeros(len(p), np.int64), (step == 1).to_numpy()
    out[whole] = _by_length(p[whole], _vectors, out[whole], 1 << 22)
    for i in np.flatnonzero(~whole):
        out[i] = _vectors_at(np.asarray(p.iloc[i]), int(first.iloc[i]), int(step.iloc[i]))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def largest_lobe(p: pd.Series) -> pd.Series:
    return pd.Series(_by_length(p, _lobes, np.zeros(len(p)), 1 << 20))


def _dealt_by_lag(perm: DataFrame, keys: list[str], pairs_a_task: int, sets_a_task: int | None = None) -> DataFrame:
    """(keys, p, n, first, step): positions by source; long permutations once for each of ``step`` sets of lags."""
    sets = lambda n: F.greatest(F.lit(1), F.ceil(n.cast("double") * (n - 1) / (2 * pairs_a_task)).cast("int"))
    least = 0
    if sets_a_task:  # a permutation has one source 1
        least = -(-(perm.where(F.col("src") == 1).agg(F.sum(sets(F.col("n_rows")))).first()[0] or 0) // sets_a_task)
    a = as_array(perm, keys, "src", "pos", least)
    longest = perm.agg(F.max("n_rows")).first()[0] or 0
    if longest * (longest - 1) // 2 <= pairs_a_task:
        return a.select("*", F.lit(1).alias("first"), F.lit(1).alias("step"))
    return spread(a.withColumn("step", sets(F.col("n"))).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("step")))), *keys, "first", least=least)


def dispersion(perm: DataFrame, keys: list[str], pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """Distinct (source gap, displacement) vectors over all pairs, as a share of the pairs.

    Vectors of different gaps differ, so gaps are counted apart: a permutation
    with more than ``pairs_a_task`` pairs goes to several tasks by its gaps.
    """
    a = _dealt_by_lag(perm, keys, pairs_a_task).select(*keys, "n", distinct_vectors("p", "first", "step").alias("distinct"))
    a = a.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("distinct").alias("distinct"))
    return a.select(*keys, "distinct", F.try_divide("distinct", F.col("n").cast("double") * (F.col("n") - 1) / 2.0).alias("dispersion"))


def dispersion_approx(perm: DataFrame, keys: list[str], bits: int = SKETCH_BITS, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """``dispersion`` with the vectors of each set of gaps counted by a sketch, and sketches merged over all gaps."""
    a = _dealt_by_lag(perm, keys, pairs_a_task, SKETCHES_A_TASK)
    gap = F.explode(F.sequence(F.col("first"), F.col("n") - 1, F.col("step"))).alias("d")
    v = a.where(F.col("first") < F.col("n")).select(*keys, "n", "first", "p", gap).select(*keys, "n", "first", "d", F.explode(_shifted(F.col("p"), F.col("d"), lambda u, v: v - u)).alias("v"))
    # a vector as one number; hashed by the sketch
    s = v.groupBy(*keys, "first").agg(F.max("n").alias("n"), F.hll_sketch_agg(F.col("d").cast("long") * 2 * F.col("n") + F.col("v") + F.col("n"), F.lit(bits)).alias("s"))
    s = s.groupBy(*keys).agg(F.max("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("s")).alias("distinct"))
    return s.select(*keys, "distinct", F.try_divide("distinct", F.col("n").cast("double") * (F.col("n") - 1) / 2.0).alias("dispersion"))


def lag_minima(perm: DataFrame, keys: list[str]) -> DataFrame:
    """m(d) = min |p(i+d) - p(i)| for lags up to ceil(2 sqrt(N-1)) + 1.

    By pigeonhole every spread below is reached within that bound, so the bound
    loses nothing and grows with the frame.
    """
    a = as_array(perm, keys, "pos", "src")
    top = F.least(F.col("n") - 1, (F.ceil(2 * F.sqrt(F.col("n") - 1.0)) + 1).cast("int"))
    m = F.transform(F.sequence(F.lit(1), top), lambda d: F.array_min(_shifted(F.col("p"), d, lambda u, v: F.abs(v - u))))
    return a.select(*keys, "n", m.alias("m"))


def spreads(minima: DataFrame, keys: list[str]) -> DataFrame:
    """Euclidean spread, L1 spread and the attained S-random spread."""
    euclid = F.array_min(F.transform("m", lambda x, i: F.sqrt((i + 1).cast("double") * (i + 1) + x * x)))
    l1 = F.array_min(F.transform("m", lambda x, i: x + i + 1))
    # Running minimum against s = lag + 1; both move apart, so the prefix is counted.
    run = F.aggregate(
        "m", F.struct(F.lit(2147483647).cast("bigint").alias("low"), F.lit(1).cast("bigint").alias("s"), F.lit(2).cast("bigint").alias("next")),
        lambda st, x: F.struct(
            F.least(st["low"], x).alias("low"),
            F.when((F.least(st["low"], x) >= st["next"]) & (st["s"] == st["next"] - 1), st["next"]).otherwise(st["s"]).alias("s"),
            (st["next"] + 1).alias("next")),
        lambda st: st["s"])
    return minima.select(*keys, euclid.alias("s_factor"), big(l1).alias("s_new"), run.alias("s_ach"))


def b_guar(perm: DataFrame, keys: list[str], codeword: int, capacity: int) -> DataFrame:
    """Longest burst that cannot overload any block, and the block that limits it."""
    cw = idiv(F.col("src") - 1, codeword) + 1
    d = perm.select(*keys, "pos", cw.alias("cw"))
    w = Window.partitionBy(*keys, "cw").orderBy("pos")
    g = d.select(*keys, "cw", "pos", (F.lead("pos", capacity).over(w) - F.col("pos")).alias("g"))
    return g.groupBy(*keys).agg(
        F.coalesce(F.min("g"), F.count("*")).alias("b_guar"),
        F.min(F.when(F.col("g").isNotNull(), F.struct("g", "cw")))["cw"].alias("worst_block"))


def apsr(perm: DataFrame, keys: list[str]) -> DataFrame:
    """Peak to largest sidelobe of the aperiodic autocorrelation, in dB.

    Values are centred as whole numbers (2p - N - 1), and their sums, taken by
    Fourier transforms, are exact.
    """
    lobe = F.col("max_sidelobe")
    a = as_array(perm, keys, "pos", "src").select(*keys, largest_lobe("p").alias("max_sidelobe"))
    return a.select(*keys, lobe, (10 * F.log10(1 / (lobe + EPS))).alias("apsr"))


def sampled_spread(perm: DataFrame, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """Euclidean spread of ``size`` positions of each permutation, drawn by hash without replacement.

    The sample's points (position, source) are laid on a grid of square cells.
    With k = floor(sqrt(m - 1)), two of m points share one of the k^2 squares of
    side n/k that fill the n by n square, so some pair is at most sqrt(2) n/k
    apart.  Cells of that width put the closest pair into the same or
    neighbouring cells; a cell meets half of its neighbours, and only pairs that
    meet are compared, about two points to a cell.
    """
    draw = Window.partitionBy(*keys).orderBy(hash32(F.lit(seed), "pos"), "pos")
    s = perm.select(*keys, "n_rows", "pos", "src", F.row_number().over(draw).alias("_i")).where(F.col("_i") <= max(2, size))
    points = F.least(F.col("n_rows"), F.lit(max(2, size)))
    width = 2.0**0.5 * F.col("n_rows") / F.floor(F.sqrt(F.greatest(F.lit(1), points - 1).cast("double")))
    cell = s.select(*keys, "pos", "src", F.floor(F.col("pos") / width).alias("u"), F.floor(F.col("src") / width).alias("v"))
    steps = F.array(*[F.struct(F.lit(i).alias("du"), F.lit(j).alias("dv")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = cell.select(*keys, F.col("pos").alias("pos2"), F.col("src").alias("src2"), "u", "v", F.inline(steps)).withColumn("u", F.col("u") - F.col("du")).withColumn("v", F.col("v") - F.col("dv"))
    pairs = cell.join(near, [*keys, "u", "v"]).where((F.col("du") != 0) | (F.col("dv") != 0) | (F.col("pos") < F.col("pos2")))
    x, y = F.col("pos") - F.col("pos2"), F.col("src") - F.col("src2")
    return pairs.groupBy(*keys).agg(F.sqrt(F.min(x * x + y * y).cast("double")).alias("s_factor"))


_DESIGN = T.StructType([T.StructField(c, T.LongType()) for c in ("distinct", "s_new", "s_ach", "jumps", "b_guar")])


def _design(p: np.ndarray, codeword: int, capacity: int) -> np.ndarray:
    """Distinct vectors, L1 and attained spread, distinct jumps and guaranteed burst of each row's sources by position."""
    m, n = p.shape
    out = np.empty((m, 5), np.int64)
    # a vector and its transpose are met together, so sources by position count as positions by source do
    out[:, 0] = _vectors(p)
    low, new, attained = np.full(m, n, np.int64), np.full(m, np.iinfo(np.int64).max), np.ones(m, np.int64)
    for d in range(1, min(n - 1, int(np.ceil(2 * np.sqrt(n - 1))) + 1) + 1):
        least = np.abs(p[:, d:] - p[:, :-d]).min(1)
        low, new = np.minimum(low, least), np.minimum(new, d + least)
        attained[(low >= d + 1) & (attained == d)] = d + 1
    seen = np.zeros((m, n + 1), bool)
    seen[np.arange(m)[:, None], np.abs(np.diff(p, axis=1))] = True
    blocks = (p - 1) // codeword
    order = np.argsort(blocks, axis=1, kind="stable")
    blocks = np.take_along_axis(blocks, order, 1)
    gaps = np.where(blocks[:, capacity:] == blocks[:, : n - capacity], order[:, capacity:] - order[:, : n - capacity], n) if capacity < n else np.full((m, 1), n)
    out[:, 1], out[:, 2], out[:, 3], out[:, 4] = new, attained, seen.sum(1), gaps.min(1)
    return out


def design_metrics(perm: DataFrame, keys: list[str], codeword: int, capacity: int) -> DataFrame:
    """(keys, b_guar, dispersion, s_new, s_ach, adj_dispersion) from one array and one kernel for permutations within a task's pairs."""

    @F.pandas_udf(_DESIGN)
    def measured(p: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(p), 5), np.int64)
        _by_length(p, lambda x: _design(x, codeword, capacity), out, 1 << 20)
        return pd.DataFrame(out, columns=_DESIGN.fieldNames())

    a = as_array(perm, keys, "pos", "src").select(*keys, "n", measured("p").alias("m"))
    n = F.col("n").cast("double")
    return a.select(*keys, "m.b_guar", F.try_divide("m.distinct", n * (n - 1) / 2.0).alias("dispersion"), "m.s_new", "m.s_ach", F.try_divide("m.jumps", n - 1).alias("adj_dispersion"))


def source_separation(perm: DataFrame, keys: list[str], codeword: int) -> DataFrame:
    """Smallest gap between source rows sharing a transmitted block, whole blocks only: minimum and mean of minima."""
    n = F.count("*").over(Window.partitionBy(*keys))
    d = perm.select(*keys, "src", idiv(F.col("pos") - 1, codeword).alias("cw"), idiv(n, codeword).alias("whole")).where(F.col("cw") < F.col("whole"))
    w = Window.partitionBy(*keys, "cw").orderBy("src")
    g = d.select(*keys, "cw", (F.lead("src").over(w) - F.col("src")).alias("g")).groupBy(*keys, "cw").agg(F.min("g").alias("g"))
    return g.groupBy(*keys).agg((F.min("g") / codeword).alias("s_sf"), (F.avg("g") / codeword).alias("s_sf_avg"))


def block_distances(rows: DataFrame, keys: list[str], block: int, value: str = "src", exclude_zero: bool = False) -> DataFrame:
    """Pairwise distances inside whole blocks: min/mean/variance per block, then over blocks.

    Sorted values give all three without forming pairs: the minimum is an
    adjacent gap, the sum of distances is sum((2i - n - 1) x_i) and the sum of
    squares n * sum(x^2) - (sum x)^2.  ``exclude_zero`` drops zero values first.
    """
    size = F.count("*").over(Window.partitionBy(*keys))
    d = rows.select(*keys, F.col(value).alias("x"), idiv(F.col("pos") - 1, block).alias("b"), size.alias("n_rows"))
    d = d.where(F.col("b") < idiv(F.col("n_rows"), block))
    if exclude_zero:
        d = d.where(F.col("x") != 0)
    w = Window.partitionBy(*keys, "b").orderBy("x")
    d = d.withColumns({"i": F.row_number().over(w), "gap": F.lead("x").over(w) - F.col("x"), "n": F.count("*").over(Window.partitionBy(*keys, "b"))})
    x = F.col("x")
    s = d.groupBy(*keys, "b").agg(
        F.max("n").alias("n"), F.max("n_rows").alias("n_rows"), F.min("gap").alias("gap"), F.sum((2 * F.col("i") - F.col("n") - 1) * x).alias("sd"),
        F.sum(x * x).alias("sxx"), F.sum(x).alias("sx"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    e = (F.col("n_rows") - 1).cast("double")
    ss = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    var = F.when(pairs > 1, (ss - F.col("sd") * F.col("sd") / pairs) / (pairs - 1))
    many = F.col("n") >= 2
    z = F.lit(0.0)
    per = s.select(*keys, F.when(many, F.col("gap") / e).otherwise(z).alias("lo"), F.when(many, F.col("sd") / pairs / e).otherwise(z).alias("av"),
                   F.when(many, F.coalesce(var, z) / (e * e)).otherwise(z).alias("va"))
    return per.groupBy(*keys).agg(
        F.min("lo").alias("min_min"), F.max("lo").alias("min_max"), F.avg("lo").alias("min_avg"), F.avg("av").alias("avg_avg"),
        F.avg("va").alias("var_avg"), F.max("va").alias("var_max"))


def transition_edges(perm: DataFrame, keys: list[str], node: str = "src") -> DataFrame:
    """Weighted undirected edges between the nodes of neighbouring positions."""
    d = perm.select(*keys, F.col(node).alias("a"), F.lead(node).over(_win(keys, "pos")).alias("b")).where(F.col("b").isNotNull())
    return d.groupBy(*keys, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("w"))


def laplacian_energy(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of squared Laplacian entries over N^2; ``nodes`` gives N per key.  Loops cancel on the diagonal."""
    e = edges.where(F.col("u") != F.col("v"))
    ends = e.select(*keys, "w", F.explode(F.array("u", "v")).alias("x")).groupBy(*keys, "x").agg(F.sum("w").alias("deg"))
    deg = ends.groupBy(*keys).agg(F.sum(F.col("deg") * F.col("deg")).alias("dd"))
    off = e.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    d = nodes.join(deg.join(off, keys), keys, "left")
    return d.select(*keys, F.coalesce((F.col("dd") + 2 * F.col("ww")) / (F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("energy"))


def pattern_fit(perm: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Share of rows in whole blocks that keep their place inside the block."""
    n = F.count("*").over(Window.partitionBy(*keys))
    d = perm.select(*keys, "pos", "src", n.alias("n")).where(F.col("pos") <= idiv(F.col("n"), block) * block)
    same = ((F.col("pos") - 1) % block == (F.col("src") - 1) % block).cast("bigint")
    return d.groupBy(*keys).agg(F.avg(same).alias("fit"))


def reach(perm: DataFrame, keys: list[str]) -> DataFrame:
    """Longest and median displacement over N, and the share of fixed points."""
    far = F.abs(F.col("src") - F.col("pos"))
    s = perm.groupBy(*keys).agg(F.count("*").alias("n"), F.max(far).alias("far"), F.median(far).alias("med"), F.avg((far == 0).cast("int")).alias("fixed"))
    return s.select(*keys, (F.col("far") / F.col("n")).alias("reach"), (F.col("med") / F.col("n")).alias("median_reach"), "fixed")


def closed_blocks(perm: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges mapped onto themselves: their number and the widest."""
    w = _win(keys, "pos")
    run = F.max("src").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = perm.select(*keys, "pos", run.alias("hi")).where(F.col("hi") == F.col("pos"))
    width = F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0))
    return ends.select(*keys, width.alias("w")).groupBy(*keys).agg(F.count("*").alias("blocks"), F.max("w").alias("widest"))


def pairwise_distance(vectors: DataFrame, id_col: str, vec: str, others: DataFrame, other_id: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Euclidean distance of every vector to every row of a second set.

    The result has a row per combination.  The second set is measured and cut
    into blocks of about ``most`` bytes.  One block is broadcast; of several, each
    goes to as many tasks as the session shuffles to, and meets its share of the
    vectors there.
    """
    o = settle(others.select(F.col(other_id).cast("bigint").alias("id"), F.col("vec")))
    size = o.agg(F.coalesce(F.sum(F.size("vec") * 8 + 16), F.lit(0))).first()[0]
    blocks, parts = 1 + size // most, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = o.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("id", "vec")).alias("_a"))
    left = vectors.select(id_col, F.transform(F.col(vec), lambda x: x.cast("double")).alias("_v"))
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if blocks == 1:
        met = left.join(F.broadcast(whole), "_b")
    else:
        share = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        met = left.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")).join(whole.withColumn("_s", share), ["_b", "_s"])
    d = met.select(id_col, "_v", F.inline("_a"))
    sq = F.aggregate(F.zip_with("_v", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return d.select(id_col, F.col("id").alias(other_id), F.sqrt(sq).alias("distance"))


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group."""
    d = vectors.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return d.groupBy(group).agg(F.transform(F.array_sort(F.array_agg(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
