"""Ranks, order statistics and empirical distributions that survive hot groups.

Everything starts from ``running``: sums of weights up to each row of its group.
``cdf`` applies it to one row per distinct value of a group, so rows are
pre-aggregated by value before the shuffle.  While every group holds at most
``piece_rows`` rows, one window per group adds them up.  Beyond that the table
is dealt by ranges of (group, value): each range is summed on its own, and the
totals of the ranges before it, one row for each range and group, are added.
No task sees more than its range, however large a group is.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .dims import attach, settle
from .numeric import as_col

PIECE_ROWS = 1_000_000
#: Rows of a group whose columns are ranked, or its pairs counted, in one task.
GROUP_ROWS = 4_000_000
#: Distinct values up to which each is a cell of its own when the pairs of a larger group are counted.
CELL_VALUES = 1024


def value_counts(df: DataFrame, keys: list[str], value) -> DataFrame:
    return (
        df.select(*keys, as_col(value).alias("v")).where(F.col("v").isNotNull())
        .groupBy(*keys, "v").agg(F.count("*").alias("cnt"))
    )


def _largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: one light pass over the key columns."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("b")).first()["b"] or 0


def _sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and of the table."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("b"), F.sum("n").alias("rows")).first()
    return got["b"] or 0, got["rows"] or 0


def _in_order(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _running_windows(df: DataFrame, keys: list[str], order: str, weights: list[str]) -> DataFrame:
    run, whole = _in_order(keys, order), Window.partitionBy(*keys)
    return df.withColumns({f"upto_{w}": F.sum(w).over(run) for w in weights} | {f"total_{w}": F.sum(w).over(whole) for w in weights})


def _running_ranges(df: DataFrame, keys: list[str], order: str, weights: list[str], piece_rows: int) -> DataFrame:
    rows, spark = df.count(), df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // piece_rows))
    # the number of a range is stored with its rows, so that a rerun cannot cut otherwise
    dealt = settle(df.repartitionByRange(ranges, *keys, order).withColumn("_range", F.spark_partition_id()))
    inside = _in_order(["_range", *keys], order)
    sums = dealt.groupBy("_range", *keys).agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    before, whole = _in_order(keys, "_range"), Window.partitionBy(*keys)
    offsets = sums.select("_range", *keys, *[(F.sum(f"_{w}").over(before) - F.col(f"_{w}")).alias(f"before_{w}") for w in weights],
                          *[F.sum(f"_{w}").over(whole).alias(f"total_{w}") for w in weights])
    summed = dealt.withColumns({f"upto_{w}": F.sum(w).over(inside) for w in weights})
    out = attach(summed, offsets, ["_range", *keys])
    return out.withColumns({f"upto_{w}": F.col(f"upto_{w}") + F.col(f"before_{w}") for w in weights}).drop("_range", *[f"before_{w}" for w in weights])


def running(df: DataFrame, keys: list[str], order: str, weights: list[str], small: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with ``upto_w``, the sum of each weight up to and with the row, and ``total_w``, that of its group.

    Rows of a group must differ in ``order``.  ``small`` states that groups are
    bounded by design, so their size is not looked up.
    """
    if small:
        return _running_windows(df, keys, order, weights)
    df = settle(df)  # read several times below, computed once
    sums = _running_windows if _largest(df, keys) <= piece_rows else partial(_running_ranges, piece_rows=piece_rows)
    return sums(df, keys, order, weights)


def row_numbers(df: DataFrame, order: str, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with its rows, which must differ in ``order``, numbered from 1."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, ["_one"], piece_rows=piece_rows).withColumnRenamed("upto__one", name).drop("_one", "total__one")


def cdf(df: DataFrame, keys: list[str], value, small: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(keys, v, cnt, below, total).

    ``small`` states that groups are bounded by design, so their size is not
    looked up.  With ``value=None`` the input already holds (keys, v, cnt).
    """
    vc = df if value is None else value_counts(df, keys, value)
    small = small or (value is not None and _largest(df, keys) <= piece_rows)
    out = running(vc, keys, "v", ["cnt"], small, piece_rows)
    return out.select(*keys, "v", "cnt", (F.col("upto_cnt") - F.col("cnt")).alias("below"), F.col("total_cnt").alias("total"))


def order_stats(c: DataFrame, keys: list[str], picks: dict[str, Column]) -> DataFrame:
    """Values at 1-based positions (expressions in ``total``) of a ``cdf`` table."""
    at = {
        n: F.max(F.when((F.col("below") < k) & (k <= F.col("below") + F.col("cnt")), F.col("v")))
        for n, k in picks.items()
    }
    return c.groupBy(*keys).agg(*[e.alias(n) for n, e in at.items()], F.max("total").alias("n"))


def percentiles(df: DataFrame, keys: list[str], value, ps: dict[str, float],
                small: bool = False, rule: str = "hazen") -> DataFrame:
    """Percentiles with plotting positions (i-0.5)/n, or (i-1)/(n-1) with rule 'linear'."""
    c = cdf(df, keys, value, small=small)
    n = F.col("total").cast("double")

    def position(p):
        h = n * (p / 100.0) + 0.5 if rule == "hazen" else (n - 1.0) * (p / 100.0) + 1.0
        return F.greatest(F.lit(1.0), F.least(n, F.round(h, 9)))

    picks = {}
    for name, p in ps.items():
        picks[f"_lo_{name}"] = F.floor(position(p))
        picks[f"_hi_{name}"] = F.ceil(position(p))
    got = order_stats(c, keys, picks).withColumn("total", F.col("n"))
    out = [
        (F.col(f"_lo_{name}") + (position(p) - F.floor(position(p)))
         * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
        for name, p in ps.items()
    ]
    return got.select(*keys, *out, "n")


def avg_rank_small(keys: list[str], value) -> Column:
    """Average-of-ties rank inside a group bounded by design (e.g. one row per method)."""
    w = Window.partitionBy(*[as_col(k) for k in keys])
    peers = Window.partitionBy(*[as_col(k) for k in keys], as_col(value))
    return F.rank().over(w.orderBy(as_col(value))) + (F.count("*").over(peers) - 1) / 2.0


def spearman_rows(df: DataFrame, keys: list[str], x, y, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Spearman of raw rows per group, hot groups included: (keys, m, rho).

    While groups fit one task each, both ranks are windows over one shuffle;
    otherwise see ``spearman_columns``.
    """
    by = keys or ["_g"]
    raw = (
        df.select(*(keys or [F.lit(0).alias("_g")]), as_col(x).alias("x"), as_col(y).alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    drop = [] if keys else ["_g"]
    if _largest(raw, by) <= piece_rows:
        n = F.count("*").over(Window.partitionBy(*by))

        def centred(c):
            w = Window.partitionBy(*by).orderBy(c)
            return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, c)) - n) / 2.0 - 1

        return _weighted_corr(raw.select(*by, "x", "y", F.lit(1).alias("w"), centred("x").alias("rx"), centred("y").alias("ry")), by).drop(*drop)
    return spearman_columns(df, keys, x, y, piece_rows)


def _weighted_corr(rows: DataFrame, by: list[str]) -> DataFrame:
    # Ranks come centred on their mean, so no sum cancels.
    a, b, w = F.col("rx"), F.col("ry"), F.col("w")
    s = rows.groupBy(*by).agg(
        F.sum("w").alias("m"), (F.min("x") != F.max("x")).alias("_vx"), (F.min("y") != F.max("y")).alias("_vy"),
        F.sum(a * a * w).alias("aa"), F.sum(b * b * w).alias("bb"), F.sum(a * b * w).alias("ab"))
    return s.select(*by, "m", F.when(F.col("_vx") & F.col("_vy"), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def _dense(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct values, and how often each of these occurs; NaN counts as one value, the last."""
    _, place, times = np.unique(a, return_inverse=True, return_counts=True)
    return place.reshape(-1), times


def _falls(a: np.ndarray) -> int:
    """Pairs of a sequence of whole numbers whose earlier member is the larger.

    Two numbers meet at the highest bit in which they differ: members that agree
    above it stand together, in the order of the sequence.
    """
    total, start = 0, np.zeros(len(a), np.int64)  # where the run of equal higher bits of each member starts
    for bit in range(int(a.max(initial=0)).bit_length() - 1, -1, -1):
        one = (a >> bit) & 1
        upto = np.cumsum(one)
        ones = upto - one - np.where(start > 0, upto[start - 1], 0)  # before the member, in its run
        total += int(ones[one == 0].sum())
        place = np.arange(len(a)) - start
        last = np.append(start[1:] != start[:-1], True)
        runs, which = np.flatnonzero(last), np.cumsum(last) - last
        zeros = (place + 1 - ones - one)[runs][which]  # in the whole run
        to = np.where(one == 1, start + zeros + ones, start + place - ones)
        moved, begins = np.empty_like(a), np.empty_like(start)
        moved[to], begins[to] = a, start + np.where(one == 1, zeros, 0)
        a, start = moved, begins
    return total


def agreement(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs ordered alike by x and y less pairs ordered oppositely; ties count for neither."""
    if len(x) < 2:
        return 0
    (px, tx), (py, ty) = _dense(x), _dense(y)
    both = py * np.int64(len(tx)) + px
    both.sort()
    met = np.diff(np.flatnonzero(np.diff(both, prepend=-1, append=-1)))
    pairs = lambda t: int((t.astype(np.int64) * (t - 1) // 2).sum())
    n = len(x)
    return n * (n - 1) // 2 - pairs(tx) - pairs(ty) + pairs(met) - 2 * _falls(both % len(tx))


def _columns(table: pa.Table, xs: list[str]):
    """(number of the metric, x, y) over the rows that hold both."""
    y = table.column("_y")
    for i in range(len(xs)):
        x = table.column(f"_x{i}")
        t = pa.table({"x": x, "y": y}).drop_null()
        yield i, t.column("x").to_numpy(), t.column("y").to_numpy()


def _untied(times: np.ndarray) -> float:
    """Ordered pairs of rows that differ."""
    t = times.astype(np.int64)
    return float((t * (t.sum() - t)).sum())


def _tau_parts(table: pa.Table, xs: list[str]):
    for i, x, y in _columns(table, xs):
        if len(x):
            yield i, len(x), 2.0 * agreement(x, y), _untied(_dense(x)[1]), _untied(_dense(y)[1])


def _rank_parts(table: pa.Table, xs: list[str]):
    for i, x, y in _columns(table, xs):
        if len(x):
            (px, tx), (py, ty) = _dense(x), _dense(y)
            rx, ry = ((np.cumsum(t) - t + (t - len(x)) / 2.0)[p] for p, t in ((px, tx), (py, ty)))  # centred: no sum cancels
            yield i, len(x), float(rx @ ry), float(rx @ rx) * (len(tx) > 1), float(ry @ ry) * (len(ty) > 1)


def _by_group(wide: DataFrame, by: list[str], xs: list[str], parts, rows: int, piece_rows: int) -> DataFrame:
    """(by, _i, m, s, nx, ny): ``parts`` of every group and metric, one group in a task at a time.

    Tasks are numbered by the rows, so that a task's share does not grow with the table.
    """
    tasks = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(1, piece_rows // 4)))
    out = T.StructType([*[wide.schema[k] for k in by], *[T.StructField(n, t) for n, t in (
        ("_i", T.IntegerType()), ("m", T.LongType()), ("s", T.DoubleType()), ("nx", T.DoubleType()), ("ny", T.DoubleType()))]])
    types = to_arrow_schema(out)

    def run(key, table):
        got = list(parts(table, xs))
        cols = [[k.as_py()] * len(got) for k in key] + ([list(c) for c in zip(*got)] if got else [[]] * 5)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, types)], schema=types)

    return wide.repartition(tasks, *by).groupBy(*by).applyInArrow(run, out)


def _wide(df: DataFrame, by: list[str], keys: list[str], xs: list, y) -> DataFrame:
    ks = [F.col(k) for k in keys] if keys else [F.lit(0).alias(k) for k in by]
    return df.select(*ks, *[as_col(x).alias(f"_x{i}") for i, x in enumerate(xs)], as_col(y).alias("_y")).where(F.col("_y").isNotNull())


def _named(parts: DataFrame, keys: list[str], xs: list[str], names: list[str] | None) -> DataFrame:
    rho = F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny")))
    metric = [] if names is None else [F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1).alias("metric")]
    return parts.select(*keys, *metric, F.col("m"), rho.alias("rho"))


def spearman_columns(df: DataFrame, keys: list[str], x, y, piece_rows: int = GROUP_ROWS) -> DataFrame:
    """Spearman of columns x with y per group, hot groups included: (keys, m, rho); for a list of columns x, (keys, metric, m, rho).

    A row is dealt once for all its metrics.  A group of at most ``piece_rows``
    rows is ranked in one task.  Otherwise rows take the ranks of their x from
    ``cdf`` tables, ranks are summed for each value of y, and these sums, one row
    for each distinct y, meet the ranks of y as running sums.
    """
    xs, names = ([x], None) if not isinstance(x, list) else (x, x)
    by = keys or ["_g"]
    wide = _wide(df, by, keys, xs, y)
    largest, rows = _sizes(wide, by)
    if largest <= piece_rows:
        return _named(_by_group(wide, by, xs, _rank_parts, rows, piece_rows), keys, xs, names)
    at = range(len(xs))
    values = wide.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_x{i}").alias("v")) for i in at]))).where(F.col("v").isNotNull())
    ranks = cdf(values.groupBy(*by, "_i", "v").agg(F.count("*").alias("cnt")), [*by, "_i"], None, piece_rows=piece_rows)
    centred = F.col("below") + (F.col("cnt") - F.col("total")) / 2.0  # ranks centred on their mean, so no sum cancels
    ranks = settle(ranks.select(*by, "_i", "v", "cnt", centred.alias("r")))
    sides = ranks.groupBy(*by, "_i").agg(F.sum("cnt").alias("m"), F.sum(F.col("r") * F.col("r") * F.col("cnt")).alias("nx"))
    for i in at:
        wide = attach(wide, ranks.where(F.col("_i") == i).select(*by, F.col("v").alias(f"_x{i}"), F.col("r").alias(f"_r{i}")), [*by, f"_x{i}"], "left")
    sums = wide.groupBy(*by, "_y").agg(*[F.count(f"_r{i}").alias(f"_n{i}") for i in at], *[F.sum(f"_r{i}").alias(f"_s{i}") for i in at])
    placed = running(sums, by, "_y", [f"_n{i}" for i in at], piece_rows=piece_rows)
    ry = [F.col(f"upto__n{i}") - (F.col(f"_n{i}") + F.col(f"total__n{i}")) / 2.0 for i in at]
    both = placed.groupBy(*by).agg(*[F.sum(ry[i] * F.col(f"_s{i}")).alias(f"s{i}") for i in at], *[F.sum(ry[i] * ry[i] * F.col(f"_n{i}")).alias(f"n{i}") for i in at])
    both = both.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("ny")) for i in at])))
    return _named(attach(both, sides, [*by, "_i"]), keys, xs, names)


def kendall_rows(df: DataFrame, keys: list[str], x, y, piece_rows: int = GROUP_ROWS, cell_values: int = CELL_VALUES) -> DataFrame:
    """Kendall tau-b of raw rows per group, hot groups included: (keys, m, rho); for a list of columns x, (keys, metric, m, rho).

    A group of at most ``piece_rows`` rows is counted in one task.  In larger ones
    x and y are cut into ordered cells of bounded rows.  Pairs that differ in both
    cells follow from the numbers of rows in them; those of one cell by y are
    counted where it is, and the rest, of one cell by x, where that is.  A value of
    more than ``piece_rows`` rows is a cell, and so is each of up to ``cell_values``
    distinct values; such cells hold ties only and are not looked into.
    """
    xs, names = ([x], None) if not isinstance(x, list) else (x, x)
    by = keys or ["_g"]
    wide = _wide(df, by, keys, xs, y)
    largest, rows = _sizes(wide, by)
    if largest <= piece_rows:
        return _named(_by_group(wide, by, xs, _tau_parts, rows, piece_rows), keys, xs, names)
    parts = [_tau_of_cells(wide.select(*by, F.col(f"_x{i}").alias("x"), F.col("_y").alias("y")).where(F.col("x").isNotNull()), by, rows, piece_rows, cell_values)
             .withColumn("_i", F.lit(i)) for i in range(len(xs))]
    return _named(reduce(DataFrame.unionByName, parts), keys, xs, names)


def _tau_of_cells(d: DataFrame, by: list[str], rows: int, piece_rows: int, cell_values: int) -> DataFrame:
    placed, untied, looked_into = d, {}, {}
    for c in "xy":
        sums = settle(cdf(d, by, c, piece_rows=piece_rows))
        untied[c] = sums.groupBy(*by).agg(F.max("total").alias("m"), F.sum((F.col("cnt") * (F.col("total") - F.col("cnt"))).cast("double")).alias(f"n{c}"))
        looked_into[c] = _largest(sums, by) > cell_values
        # odd cells hold one value; a value of more than piece_rows rows ends its stretch of piece_rows
        cell = 2 * F.floor(F.col("below") / piece_rows) + (F.col("cnt") > piece_rows).cast("long") if looked_into[c] else 2 * F.col("below") + 1
        placed = attach(placed, sums.select(*by, F.col("v").alias(c), cell.cast("long").alias(f"_c{c}")), [*by, c])
    placed = settle(placed)
    counts = placed.groupBy(*by, "_cx", "_cy").agg(F.count("*").alias("n"))
    scores = [counts.groupBy(*by).applyInArrow(_between_cells(by, counts.schema), T.StructType([*[counts.schema[k] for k in by], T.StructField("s", T.DoubleType())]))]
    for c, other in (("y", None), ("x", "_cy")):
        if looked_into[c]:
            inside = placed.where(F.col(f"_c{c}") % 2 == 0).select(*by, f"_c{c}", F.col("x").alias("_x0"), F.col("y").alias("_y"), *([other] if other else []))
            scores.append(_by_group(inside, [*by, f"_c{c}"], ["x"], _across_cells if other else _tau_parts, rows, piece_rows).select(*by, "s"))
    score = reduce(DataFrame.unionByName, scores).groupBy(*by).agg(F.sum("s").alias("s"))
    return attach(attach(untied["x"], untied["y"].drop("m"), by), score, by)


def _across_cells(table: pa.Table, xs: list[str]):
    """Twice the agreement of the rows of one cell by x, over pairs of different cells by y."""
    x, y, c = (table.column(n).to_numpy() for n in ("_x0", "_y", "_cy"))
    order = np.argsort(c, kind="stable")
    same = sum(agreement(x[k], y[k]) for k in np.split(order, np.flatnonzero(np.diff(c[order])) + 1))
    yield 0, len(x), 2.0 * (agreement(x, y) - same), 0.0, 0.0


def _between_cells(by: list[str], schema: T.StructType):
    types = to_arrow_schema(T.StructType([*[schema[k] for k in by], T.StructField("s", T.DoubleType())]))

    def run(key, table):
        (r, nr), (c, nc) = _dense(table.column("_cy").to_numpy()), _dense(table.column("_cx").to_numpy())
        n = np.zeros((len(nr), len(nc)), np.int64)
        n[r, c] = table.column("n").to_numpy()
        before = np.cumsum(n, 0) - n
        upto = np.cumsum(before, 1)
        lead = 2 * upto - before - upto[:, -1:]  # rows of earlier cells by y in lower cells by x, less those in higher ones
        s = 2.0 * sum(float(a @ b) for a, b in zip(n.astype(object), lead.astype(object)))
        return pa.table([pa.array([k.as_py()], f.type) for k, f in zip(key, types)] + [pa.array([s], pa.float64())], schema=types)

    return run
