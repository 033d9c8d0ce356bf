"""Two-way analysis of variance from grouped sums, and descriptives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import settle
from ..functions.numeric import big
from ..functions.rank import percentiles


def anova_two_way(df: DataFrame, keys: list[str], method: str, bin_: str, value: str, allow_type1: bool = False) -> DataFrame:
    """SS, df, MS, F and eta^2 of method, bin, their interaction and error, per key.

    Exact for balanced designs.  Unbalanced input is refused unless ``allow_type1``
    asks for sequential (Type I) sums of squares: method, then bin given method,
    then their interaction given both.
    """
    cells = settle(df.groupBy(*keys, method, bin_).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    shape = cells.groupBy(*keys).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("cells"),
        (F.count_distinct(method) * F.count_distinct(bin_)).alias("full"))
    if allow_type1:
        return _terms(_sequential(cells, keys, method, bin_), keys)
    if shape.where((F.col("lo") != F.col("hi")) | (F.col("cells") != F.col("full"))).limit(1).count():
        raise ValueError("unbalanced design: cells differ in size or are missing")
    nn = F.col("n")
    grand = (F.sum(nn * F.col("mean")).over(w) / F.sum(nn).over(w))
    margin = lambda c: F.sum(nn * F.col("mean")).over(Window.partitionBy(*keys, c)) / F.sum(nn).over(Window.partitionBy(*keys, c))
    d = cells.withColumns({"g": grand, "mm": margin(method), "mb": margin(bin_)})
    sq = lambda e: F.sum(nn * e * e)
    s = d.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.count_distinct(method).alias("a"), F.count_distinct(bin_).alias("b"),
        sq(F.col("mm") - F.col("g")).alias("ss_method"), sq(F.col("mb") - F.col("g")).alias("ss_bin"),
        sq(F.col("mean") - F.col("mm") - F.col("mb") + F.col("g")).alias("ss_int"), F.sum((nn - 1) * F.col("v")).alias("ss_err"))
    a, b, n = F.col("a"), F.col("b"), F.col("N")
    return _terms(s.withColumns({"df_method": a - 1, "df_bin": b - 1, "df_int": (a - 1) * (b - 1), "df_err": n - a * b}), keys)


def _terms(s: DataFrame, keys: list[str]) -> DataFrame:
    """One row per term from a row of sums of squares ss_* and degrees of freedom df_*."""
    names = {"method": "method", "bin": "bin", "interaction": "int", "error": "err"}
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"ss_{c}").alias("ss"), big(f"df_{c}").alias("df")) for t, c in names.items()])
    t = s.select(*keys, (F.col("ss_method") + F.col("ss_bin") + F.col("ss_int") + F.col("ss_err")).alias("ss_total"),
                 F.try_divide("ss_err", "df_err").alias("mse"), big("df_err").alias("df_err"), F.inline(terms))
    eta = F.try_divide("ss", "ss_total")
    size = F.when(eta > 0.14, "LARGE").when(eta > 0.06, "MEDIUM").when(eta > 0.01, "SMALL").otherwise("")
    err = F.col("term") == "error"
    ms = F.try_divide("ss", "df")
    return t.select(*keys, "term", "ss", "df", ms.alias("ms"), F.when(~err, F.try_divide(ms, F.col("mse"))).alias("f"),
                    F.when(~err, eta).alias("eta2"), F.when(~err, size).alias("effect"), "df_err", "mse")


def _sequential(cells: DataFrame, keys: list[str], method: str, bin_: str) -> DataFrame:
    """Type I sums of squares per key from cell counts and means.

    Eliminating the methods from the normal equations of the additive model
    leaves one equation per bin; their matrix and right side are grouped sums of
    cells and of pairs of cells of one method, of which there are as many as
    bins squared.  What they explain is read off their Cholesky factor.
    """
    by = keys or ["_g"]
    cells = cells if keys else cells.withColumn("_g", F.lit(0))
    nn, mean = F.col("n").cast("double"), F.col("mean")
    key, of_method = Window.partitionBy(*by), Window.partitionBy(*by, method)
    d = cells.withColumn("mean", mean - F.sum(nn * mean).over(key) / F.sum(nn).over(key))
    d = d.withColumns({"ni": F.sum(nn).over(of_method), "mi": F.sum(nn * mean).over(of_method) / F.sum(nn).over(of_method)})
    rows = d.groupBy(*by).agg(
        F.sum("n").alias("N"), F.count("*").alias("cells"), F.count_distinct(method).alias("a"), F.sum(nn * F.col("mi") * F.col("mi")).alias("ss_method"),
        F.sum(nn * mean * mean).alias("ss_cells"), F.sum((nn - 1) * F.col("v")).alias("ss_err"))
    right = d.groupBy(*by, F.col(bin_).alias("j")).agg(F.sum(nn).alias("nj"), F.sum(nn * (mean - F.col("mi"))).alias("q"))
    one = d.select(*by, F.col(method).alias("_m"), F.col(bin_).alias("j"), nn.alias("x"), "ni")
    two = d.select(*by, F.col(method).alias("_m"), F.col(bin_).alias("k"), nn.alias("y"))
    matrix = one.join(two, [*by, "_m"]).groupBy(*by, "j", "k").agg(F.sum(F.col("x") * F.col("y") / F.col("ni")).alias("c")).join(right, [*by, "j"])

    def explained(block: pd.DataFrame) -> pd.DataFrame:
        levels = {x: i for i, x in enumerate(sorted(set(block["j"])))}
        c, q = np.zeros((len(levels), len(levels))), np.zeros(len(levels))
        for r in block.itertuples():
            j, k = levels[r.j], levels[r.k]
            c[j, k] -= r.c
            if j == k:
                c[j, j] += r.nj
                q[j] = r.q
        ss, rank, least = 0.0, 0, 1e-9 * max(1e-300, c.diagonal().max())
        for p in range(len(q)):
            if c[p, p] > least:
                ss, rank = ss + q[p] ** 2 / c[p, p], rank + 1
                lead = c[:, p] / c[p, p]
                q = q - lead * q[p]
                c = c - np.outer(lead, c[p])
        return pd.DataFrame({**{k: [block[k].iloc[0]] for k in by}, "ss_bin": [ss], "rank": [rank]})

    schema = T.StructType([*[f for f in d.schema if f.name in by], T.StructField("ss_bin", T.DoubleType()), T.StructField("rank", T.LongType())])
    s = rows.join(matrix.groupBy(*by).applyInPandas(explained, schema), by)
    return s.withColumns({
        "ss_int": F.col("ss_cells") - F.col("ss_method") - F.col("ss_bin"), "df_method": F.col("a") - 1, "df_bin": F.col("rank"),
        "df_int": F.col("cells") - F.col("a") - F.col("rank"), "df_err": F.col("N") - F.col("cells")})


def _f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f): regularised incomplete beta by Lentz's continued fraction."""
    from math import exp, lgamma, log

    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x > (a + 1) / (a + b + 2):
        flip, x, a, b = True, 1 - x, b, a
    else:
        flip = False
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    p = front * h / a
    return 1 - p if flip else p


def anova_pvalue(table: DataFrame) -> DataFrame:
    """Add the F tail to an ANOVA table (three tested rows per key)."""
    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else _f_tail(x, y, z) for x, y, z in zip(f, d1, d2)], dtype="float64")

    return table.withColumn("p", tail("f", F.col("df").cast("double"), F.col("df_err").cast("double")))


def pairwise_means(df: DataFrame, table: DataFrame, keys: list[str], method: str, value: str, focus: str) -> DataFrame:
    """Differences of one method's mean to every other, with the studentised q; only where the method effect is significant."""
    m = df.groupBy(*keys, method).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    gate = anova_pvalue(table).where((F.col("term") == "method") & (F.col("p") < 0.001)).select(*keys, "mse")
    f = m.where(F.col(method) == focus).select(*keys, F.col("mean").alias("fm"), F.col("n").alias("fn"))
    j = m.where(F.col(method) != focus).join(f, keys).join(gate, keys)
    diff = F.col("fm") - F.col("mean")
    return j.select(*keys, method, diff.alias("diff"), (diff / F.sqrt(F.col("mse") / 2 * (1 / F.col("fn") + 1 / F.col("n")))).alias("q"))


def group_descriptives(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), *[e for v in values for e in (
        F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}"), (F.stddev_samp(v) / F.sqrt(n)).alias(f"sem_{v}"))])


def topn_methods(desc: DataFrame, keys: list[str], mean: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    d = desc.withColumn("rank", big(F.row_number().over(w.orderBy(F.round(mean, 6).desc(), "method"))))
    return d.where(F.col("rank") <= n)


def method_bin_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error and count per cell; the first two only where more than one trial was seen."""
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n > 1, F.avg(value)).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("sem"))


def effect_flags(table_p: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda t, c: F.max(F.when(F.col("term") == t, c))
    return table_p.groupBy(*keys).agg(
        (at("method", F.col("eta2")) > 0.14).alias("method_strong"), (at("bin", F.col("eta2")) > 0.14).alias("bin_strong"),
        (at("interaction", F.col("p")) < 0.05).alias("interaction_present"))


def box_stats(df: DataFrame, keys: list[str], value, small: bool = False) -> DataFrame:
    """Minimum, quartiles by Hazen positions and maximum per group, plus a mark when the sign flips."""
    q = percentiles(df, keys, value, {"q1": 25, "median": 50, "q3": 75}, small=small)
    e = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(e, keys).withColumn("flips", (F.col("low") < 0) & (F.col("high") > 0))


