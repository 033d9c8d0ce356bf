"""Ranks, percentiles and validation statistics, including groups cut into pieces."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scatterframe.functions import dims, numeric, rank
from scatterframe.operators import anova as an
from scatterframe.operators import assoc as ac
from scatterframe.operators import bursts as bu
from scatterframe.operators import validate as va


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds most rows, with heavy ties."""
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.8, "hot", "cold"), "x": rng.integers(0, 500, n) ** 2 / 7.0, "y": rng.normal(size=n).round(2)})
    pdf.loc[rng.random(n) < 0.3, "x"] = 0.0
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("piece_rows", [10, 100, 10**6])
def test_cdf_in_pieces(rows, piece_rows):
    pdf, df = rows
    got = rank.cdf(df, ["g"], "x", piece_rows=piece_rows).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got.g == g].sort_values("v")
        vals, cnt = np.unique(part.x, return_counts=True)
        assert np.allclose(mine.v, vals) and (mine.cnt == cnt).all()
        assert (mine.below == np.concatenate([[0], np.cumsum(cnt)[:-1]])).all() and (mine.total == len(part)).all()


def test_cdf_without_keys(rows):
    pdf, df = rows
    got = rank.cdf(df, [], "x", piece_rows=20).toPandas()
    assert got.cnt.sum() == len(pdf) and (got.total == len(pdf)).all()


@pytest.mark.parametrize("piece_rows", [10, 10**6])
def test_running_sums_of_two_weights(spark, piece_rows):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900, p=[0.9, 0.05, 0.05]), "v": rng.permutation(900), "p": rng.integers(0, 9, 900), "q": rng.integers(0, 9, 900)})
    got = rank.running(spark.createDataFrame(pdf), ["g"], "v", ["p", "q"], piece_rows=piece_rows).toPandas()
    assert len(got) == 900
    for g, part in got.groupby("g", dropna=False):
        part = part.sort_values("v")
        for w in "pq":
            assert (part[f"upto_{w}"] == part[w].cumsum()).all() and (part[f"total_{w}"] == part[w].sum()).all()


@pytest.mark.parametrize("piece_rows", [7, 10**6])
def test_row_numbers(spark, piece_rows):
    df = spark.createDataFrame([(chr(97 + i % 26) * (1 + i // 26),) for i in range(100)], "s string")
    got = {r.s: r.i for r in rank.row_numbers(df, "s", "i", piece_rows=piece_rows).collect()}
    assert got == {s: i for i, s in enumerate(sorted(got), 1)}


@pytest.mark.parametrize("piece_rows", [40, 10**6])
def test_kendall_of_hot_group(spark, piece_rows):
    """Ties on both sides, groups of one row and of one value, NULLs."""
    rng = np.random.default_rng(6)
    rows = [("hot", float(x), float(y)) for x, y in zip(rng.integers(0, 60, 700), rng.integers(0, 25, 700))]
    rows += [("few", float(i), float(-i)) for i in range(9)] + [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("hot", None, 1.0), ("hot", 1.0, None), (None, 1.0, 1.0), (None, 2.0, 2.0)]
    got = {r.g: (r.m, r.rho) for r in rank.kendall_rows(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", piece_rows=piece_rows).collect()}
    for g in {r[0] for r in rows}:
        x, y = np.array([r[1:] for r in rows if r[0] == g and None not in r[1:]]).T
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        den = np.sqrt(np.abs(sx).sum() * np.abs(sy).sum())
        assert got[g][0] == len(x)
        assert got[g][1] is None if den == 0 else got[g][1] == pytest.approx((sx * sy).sum() / den, abs=1e-12)


@pytest.mark.parametrize("piece_rows, cells", [(10**6, 9), (150, 10**6), (150, 9), (40, 30)])
def test_columns_of_hot_groups(spark, piece_rows, cells):
    """Several columns beside one y, with ties, one value in half of the rows, and NULLs, counted whole and in cells."""
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < 800, "hot", "few"), "a": rng.permutation(n).astype(float), "b": rng.integers(0, 5, n).astype(float), "c": 1.0,
                        "d": np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 300, n)), "y": np.where(rng.random(n) < 0.3, 50.0, rng.integers(0, 400, n))})
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("y") % 11 != 0, F.col("a")))
    tau = {(r.g, r.metric): r for r in rank.kendall_rows(df, ["g"], ["a", "b", "c", "d"], "y", piece_rows=piece_rows, cell_values=cells).collect()}
    rho = {(r.g, r.metric): r for r in rank.spearman_columns(df, ["g"], ["a", "b", "c", "d"], "y", piece_rows=piece_rows).collect()}
    assert len(tau) == len(rho) == 8
    for (g, c), r in tau.items():
        part = pdf[(pdf.g == g) & ((c != "a") | (pdf.y % 11 != 0))]
        sx, sy = (np.sign(part[k].to_numpy()[:, None] - part[k].to_numpy()) for k in (c, "y"))
        assert r.m == rho[g, c].m == len(part)
        if c == "c":
            assert r.rho is None and rho[g, c].rho is None
        else:
            assert r.rho == pytest.approx((sx * sy).sum() / np.sqrt(np.abs(sx).sum() * np.abs(sy).sum()), abs=1e-12)
            assert rho[g, c].rho == pytest.approx(part[c].rank().corr(part.y.rank()), abs=1e-12)


def test_a_trial_is_dealt_once_for_all_its_metrics(spark):
    """Kendall over trials ships each row once, not once for each metric and bit of its position."""
    df = spark.range(20_000).select(F.lit("c").alias("condition"), F.lit(1).alias("block"), *[(F.col("id") * k % 19_997).alias(f"x{k}") for k in (3, 5, 7, 11)], F.col("id").alias("y"))
    plan = ac.kendall_trials(df, ["x3", "x5", "x7", "x11"], "y")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


@pytest.mark.parametrize("piece_rows", [5, 10**6])
def test_ks_in_ranges(spark, piece_rows):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 50, 300), rng.integers(5, 70, 200)
    df = spark.createDataFrame([("a", int(x)) for x in a] + [("ref", int(x)) for x in b], "k string, v int")
    r = bu.ks_two_sample(df, "k", "ref", "v", piece_rows=piece_rows).collect()
    at = np.arange(80)
    want = np.abs((a[:, None] <= at).mean(0) - (b[:, None] <= at).mean(0)).max()
    assert len(r) == 1 and r[0]["ks"] == pytest.approx(want) and (r[0]["n"], r[0]["m"]) == (300, 200)


@pytest.mark.parametrize("piece_rows", [50, 10**6])
def test_spearman_of_hot_group(rows, piece_rows):
    pdf, df = rows
    for r in rank.spearman_rows(df, ["g"], "x", "y", piece_rows=piece_rows).collect():
        part = pdf[pdf.g == r["g"]]
        assert r["m"] == len(part)
        assert r["rho"] == pytest.approx(part.x.rank().corr(part.y.rank()), abs=1e-12)


def test_percentiles(rows):
    pdf, df = rows
    got = rank.percentiles(df, ["g"], "y", {"a": 5, "b": 50, "c": 97.5}).toPandas().set_index("g")
    lin = rank.percentiles(df, ["g"], "y", {"a": 5, "b": 50, "c": 97.5}, rule="linear").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for c, p in {"a": 5, "b": 50, "c": 97.5}.items():
            assert got.loc[g, c] == pytest.approx(np.percentile(part.y, p, method="hazen"))
            assert lin.loc[g, c] == pytest.approx(np.percentile(part.y, p))


def test_attach_beyond_the_broadcast_bound(rows):
    _, df = rows
    dim = df.groupBy("g").agg(F.count("*").alias("n"))
    a = dims.attach(df, dim, ["g"]).groupBy("g").agg(F.sum("n").alias("s"))
    b = dims.attach(df, dim, ["g"], most=0).groupBy("g").agg(F.sum("n").alias("s"))
    want = sorted(map(tuple, a.collect()))
    assert sorted(map(tuple, b.collect())) == want
    null = df.withColumn("g", F.when(F.col("g") != F.lit(want[0][0]), F.col("g")))
    assert dims.with_totals(null, ["g"], F.count("*").alias("n")).count() == df.count()


def test_numeric_helpers(spark):
    d = spark.createDataFrame([(48, 36, 3, 200, 211), (17, 5, 2, 10, 1000003)], "a bigint, b bigint, g bigint, e bigint, p bigint")
    got = d.select(numeric.gcd("a", "b").alias("q"), numeric.modpow("g", "e", "p").alias("r"), numeric.hash32(F.lit(1), "a").alias("h")).collect()
    assert [(r["q"], r["r"]) for r in got] == [(12, pow(3, 200, 211)), (1, pow(2, 10, 1000003))]
    assert all(0 <= r["h"] < 2**32 for r in got)


def test_f_tail():
    assert an._f_tail(0, 3, 10) == 1.0
    assert an._f_tail(1.0, 1, 1) == pytest.approx(0.5)
    assert an._f_tail(4.0, 2, 10) == pytest.approx((10 / (10 + 2 * 4.0)) ** 5)
    assert an._f_tail(3.0, 2, 2) == pytest.approx(0.25)


def test_anova_refuses_unbalanced(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "method string, bin int, v double")
    with pytest.raises(ValueError):
        an.anova_two_way(d, [], "method", "bin", "v")


def test_tau_threshold():
    assert ac.tau_threshold() == pytest.approx(2 / math.pi * math.asin(2 * math.sin(0.05 * math.pi)))


def test_ks(spark):
    x, y = [1, 1, 2, 5], [2, 3, 3]
    d = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "k string, len bigint")
    r = bu.ks_two_sample(d, "k", "y", "len").first()
    grid = sorted(set(x + y))
    want = max(abs(np.mean([v <= g for v in x]) - np.mean([v <= g for v in y])) for g in grid)
    assert r["ks"] == pytest.approx(want) and r["critical"] == pytest.approx(1.36 * math.sqrt(7 / 12))


def mediation_cells(kind):
    """Cell means of x, mediator and outcome: a pure path, no path, a path beside a direct leg."""
    rng = np.random.default_rng(11)
    out = []
    for method in range(10):
        for length in range(420, 1201, 60):
            s, e1, e2 = rng.normal(size=3)
            m = {"path": s + e1, "none": e1, "direct": s + 0.6 * e1}[kind]
            y = {"path": m + e2, "none": 2 * s + e2, "direct": 3 * s + m + 0.3 * e2}[kind]
            out.append(("c", length, f"m{method}", float(s), float(m), float(y)))
    return out


@pytest.mark.parametrize("kind,verdict", [("path", "consistent with mediation"), ("none", "not mediation: a leg is too weak"),
                                          ("direct", "not mediation: survives conditioning")])
def test_mediation_verdicts(spark, kind, verdict):
    cells = spark.createDataFrame(mediation_cells(kind), "condition string, block int, method string, x double, m double, y double")
    r = ac.mediation_test(ac.within_block_matrix(cells, ["x", "m", "y"]), [("x", "m", "y")], ["condition"]).first()
    assert r["verdict"] == verdict


def test_threshold_sweep_band(spark):
    # Published (metric, conditions passed of 8, IQR).
    table = [("delta_G", 8, 0.042), ("eta_ES", 8, 0.043), ("giniLoad", 8, 0.066), ("esLoad", 8, 0.132), ("meanMaxCW", 8, 0.060),
             ("S_ECC", 8, 0.073), ("delta_BS", 8, 0.098), ("cvLoad", 8, 0.299), ("overT", 8, 0.168), ("maxErrCW", 8, 0.110),
             ("eta_sep", 8, 0.092), ("B_guar", 8, 0.092), ("sepMin", 8, 0.112)]
    d = spark.createDataFrame(table, "metric string, pass int, iqr double")
    bands = va.threshold_sweep(d, 6).collect()
    hit = [b for b in bands if b["lo"] <= 0.15 and (b["hi"] is None or 0.15 < b["hi"])]
    assert [(round(b["lo"], 3), round(b["hi"], 3), b["n"]) for b in hit] == [(0.132, 0.168, 11)]


def test_metric_groups_are_greedy(spark):
    m = spark.createDataFrame([("c", "a", "b", 0.9), ("c", "b", "d", 0.95), ("c", "a", "d", 0.1), ("c", "d", "e", -0.85)], "condition string, a string, b string, r double")
    got = ac.metric_groups(m, ["condition"], ["a", "b", "d", "e"]).orderBy("group_no").collect()
    assert [r["members"] for r in got] == ["a,b", "d,e"]


def test_kendall_matches_pairs(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, 12), rng.integers(0, 6, 12)
    d = spark.createDataFrame([("c", 1, "k", float(a), float(b)) for a, b in zip(x, y)], "condition string, block int, metric string, x double, y double")
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (dx * dy).sum() / math.sqrt((dx**2).sum() * (dy**2).sum())
    assert ac.kendall_by_block(d).first()["rho"] == pytest.approx(want)


def test_bootstrap_shares_draws_between_metrics(spark):
    rng = np.random.default_rng(2)
    v = rng.uniform(-0.9, 0.9, 12)
    d = spark.createDataFrame([("c", int(b), m, 10, float(s * v[b])) for b in range(12) for m, s in (("p", 1), ("q", -1))],
                              "condition string, block int, metric string, m bigint, rho double")
    b = va.block_bootstrap(d, 50).toPandas().pivot(index="draw", columns="metric", values="rho")
    assert len(b) == 50 and np.allclose(b.p, -b.q) and b.p.nunique() > 10


def test_sequential_sums_of_unbalanced_design(spark):
    """Type I sums against least squares on dummy variables; a missing cell and an isolated bin included."""
    rng = np.random.default_rng(9)
    rows = [(m, b, float(m + 2 * b + rng.normal())) for m in range(4) for b in range(3) for _ in range(rng.integers(1, 6)) if (m, b) != (1, 2)]
    rows += [(9, 7, 3.0), (9, 7, 4.5)]  # a method and a bin seen only together
    got = {r["term"]: r for r in an.anova_two_way(spark.createDataFrame(rows, "m int, b int, v double"), [], "m", "b", "v", allow_type1=True).collect()}
    y = np.array([r[2] for r in rows])
    dummy = lambda k: np.array([[float(k(r) == level) for level in sorted({k(r) for r in rows})] for r in rows])
    one, mm, bb, cc = np.ones((len(rows), 1)), dummy(lambda r: r[0]), dummy(lambda r: r[1]), dummy(lambda r: r[:2])
    fits = [np.hstack(x) for x in ([one], [one, mm], [one, mm, bb], [one, mm, bb, cc])]
    left = [((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() for x in fits]
    ranks = [np.linalg.matrix_rank(x) for x in fits]
    for k, term in enumerate(["method", "bin", "interaction"]):
        assert got[term]["ss"] == pytest.approx(left[k] - left[k + 1], abs=1e-9) and got[term]["df"] == ranks[k + 1] - ranks[k]
    assert got["error"]["ss"] == pytest.approx(left[3]) and got["error"]["df"] == len(rows) - ranks[3]


def test_sequential_sums_equal_balanced_ones(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(m, b, float(rng.normal() + m)) for m in range(3) for b in range(4) for _ in range(5)], "m int, b int, v double")
    a, b = ({r["term"]: r for r in an.anova_two_way(df, [], "m", "b", "v", allow_type1=t).collect()} for t in (False, True))
    for t in a:
        assert a[t]["ss"] == pytest.approx(b[t]["ss"]) and a[t]["df"] == b[t]["df"]


def test_discrimination_of_constant_cells(spark):
    """A cell of one value, in parts whose moments do not merge without rounding, has no variance."""
    i = F.col("id") % 2  # three tasks of 49 rows a cell
    d = spark.range(0, 294, 1, 3).select(F.lit("c").alias("condition"), F.lit(1).alias("block"), F.concat(F.lit("m"), i).alias("method"), F.lit(1).alias("bin"), (1 + i).alias("x"))
    r = va.discrimination_ratio(d, ["x"]).first()
    assert r["within_var"] == 0.0 and r["between_var"] == pytest.approx(0.5) and r["ratio"] == float("inf") and r["trials_needed"] == 0
