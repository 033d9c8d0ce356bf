"""Structure and load metrics: published anchors and brute force."""

import re

import numpy as np
import pytest

from scatterframe.operators import load as ld
from scatterframe.operators import structure as st
from scatterframe.plans import structure_queries as sq
from scatterframe.plans.catalog import QUERIES

K = ["perm_id"]


def one(df):
    return {r["perm_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def test_dispersion_anchors(perms, rng):
    n = 120
    got = one(st.dispersion(perms({"id": range(1, n + 1), "rnd": rng.permutation(n) + 1}), K))
    assert got["id"]["dispersion"] == pytest.approx(2 / n)
    assert got["rnd"]["dispersion"] == pytest.approx(0.81, abs=0.03)


def test_adjacency_of_identity(perms):
    got = one(st.adjacency(perms({"id": range(1, 61)}), K))["id"]
    assert got["adj_dispersion"] == pytest.approx(1 / 59) and got["adj_cv"] == pytest.approx(0)


@pytest.mark.parametrize("k,n,t", [(8, 15, 3), (12, 10, 2), (5, 7, 6)])
def test_b_guar_of_matched_block(perms, k, n, t):
    p = (np.arange(k * n) + 1).reshape(k, n).T.ravel()
    assert one(st.b_guar(perms({"b": p}), K, n, t))["b"]["b_guar"] == t * k


def test_b_guar_without_limit(perms):
    assert one(st.b_guar(perms({"b": range(1, 31)}), K, 10, 10))["b"] == {"perm_id": "b", "b_guar": 30, "worst_block": None}


def test_laplacian_energy_is_degenerate(perms, rng):
    named = {}
    for n in (10, 33, 64):
        named |= {f"{n}-id": range(1, n + 1), f"{n}-rev": range(n, 0, -1), f"{n}-rnd": rng.permutation(n) + 1}
    p = perms(named)
    e = one(st.laplacian_energy(st.transition_edges(p, K), p.groupBy("perm_id").count().withColumnRenamed("count", "n"), K))
    for name, r in e.items():
        n = int(name.split("-")[0])
        assert r["energy"] == pytest.approx((6 * n - 8) / n**2)


def test_spreads_brute_force(perms, rng):
    named = {str(i): rng.permutation(n) + 1 for i, n in enumerate([5, 17, 40, 90])}
    got = one(st.spreads(st.lag_minima(perms(named), K), K))
    for name, p in named.items():
        m = [None] + [np.abs(p[d:] - p[:-d]).min() for d in range(1, len(p))]
        s = 1
        while s < len(p) and min(m[1:s + 1]) >= s + 1:
            s += 1
        assert got[name]["s_new"] == min(d + m[d] for d in range(1, len(p)))
        assert got[name]["s_factor"] == pytest.approx(min(np.hypot(d, m[d]) for d in range(1, len(p))))
        assert got[name]["s_ach"] == s


def test_apsr_brute_force(perms, rng):
    p = rng.permutation(50) + 1
    x = p - p.mean()
    lobe = max(abs((x[k:] * x[:-k]).sum()) for k in range(1, 50)) / (x * x).sum()
    assert one(st.apsr(perms({"a": p}), K))["a"]["apsr"] == pytest.approx(10 * np.log10(1 / lobe))


@pytest.mark.parametrize("n,top", [(2, 3), (5, 1), (63, 1000), (400, 2**20), (3000, 2**30)])
def test_autocorrelation_is_exact(rng, n, top):
    x = rng.integers(-top, top + 1, (3, n))
    parts = st.autocorrelations(x)
    for i in range(3):
        row = [int(v) for v in x[i]]
        got = [sum(int(r[i, k]) << s for s, r in parts) for k in range(n)]
        lags = range(n) if n < 500 else [0, 1, 2, n // 2, n - 1]
        assert all(got[k] == sum(a * b for a, b in zip(row, row[k:])) for k in lags)


def test_apsr_of_long_frame(perms, rng, monkeypatch):
    """The wide sums of very long frames give the same ratio."""
    p = rng.permutation(2000) + 1
    whole = one(st.apsr(perms({"a": p, "b": range(1, 2)}), K))
    assert whole["b"]["apsr"] is None
    lobe = st._lobes(p[None])[0]
    monkeypatch.setattr(st, "_WHOLE", 10)
    assert st._lobes(p[None])[0] == pytest.approx(lobe, rel=1e-12) and whole["a"]["max_sidelobe"] == lobe


@pytest.mark.parametrize("pairs", [50, 700, 10**9])
def test_dispersion_dealt_by_lags(perms, rng, pairs):
    named = {"a": rng.permutation(90) + 1, "b": rng.permutation(7) + 1, "c": [1], "d": range(1, 61)}
    p = perms(named)
    got = one(st.dispersion(p, K, pairs))
    near = one(st.dispersion_approx(p, K, pairs_a_task=pairs))
    for name, q in named.items():
        pos = np.argsort(np.asarray(q))
        want = len({(d, int(v)) for d in range(1, len(pos)) for v in pos[d:] - pos[:-d]})
        assert got[name]["distinct"] == want
        assert name == "c" or near[name]["distinct"] == pytest.approx(want, rel=0.08, abs=1)


@pytest.mark.parametrize("codeword,capacity", [(7, 2), (15, 3), (4, 1), (10, 50)])
def test_design_metrics_equal_their_parts(perms, rng, codeword, capacity):
    p = perms({str(i): rng.permutation(n) + 1 for i, n in enumerate([2, 3, 40, 61, 45])} | {"id": range(1, 43)})
    got = one(st.design_metrics(p, K, codeword, capacity))
    spread = one(st.spreads(st.lag_minima(p, K), K))
    parts = [one(st.b_guar(p, K, codeword, capacity)), one(st.dispersion(p, K)), spread, one(st.adjacency(p, K))]
    for name, r in got.items():
        assert r == {"perm_id": name, "b_guar": parts[0][name]["b_guar"], "dispersion": parts[1][name]["dispersion"], "s_new": spread[name]["s_new"],
                     "s_ach": spread[name]["s_ach"], "adj_dispersion": parts[3][name]["adj_dispersion"]}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 50, 500])
def test_sampled_spread(perms, rng, size):
    named = {"a": rng.permutation(120) + 1, "b": range(1, 41), "c": rng.permutation(3) + 1}
    p = perms(named)
    got = one(st.sampled_spread(p, K, size))
    from scatterframe.functions.numeric import hash32
    from pyspark.sql import functions as F
    order = [r["pos"] for r in p.where("perm_id = 'a'").orderBy(hash32(F.lit(42), "pos"), "pos").collect()]
    for name, q in named.items():
        q = [None, *q]
        s = [x for x in order if x < len(q)][: max(2, size)]
        want = min(np.hypot(x - y, q[x] - q[y]) for i, x in enumerate(s) for y in s[:i])
        assert got[name]["s_factor"] == pytest.approx(want)


def test_block_distances_brute_force(perms, rng):
    p = rng.permutation(64) + 1
    blocks = [p[i:i + 10] for i in range(0, 60, 10)]
    d = [np.abs(b[:, None] - b)[np.triu_indices(10, 1)] / 63 for b in blocks]
    got = one(st.block_distances(perms({"a": p}), K, 10))["a"]
    assert got["min_min"] == pytest.approx(min(x.min() for x in d))
    assert got["avg_avg"] == pytest.approx(np.mean([x.mean() for x in d]))
    assert got["var_max"] == pytest.approx(max(x.var(ddof=1) for x in d))


def test_closed_blocks(perms):
    got = one(st.closed_blocks(perms({"a": [2, 1, 3, 6, 5, 4, 7]}), K))["a"]
    assert (got["blocks"], got["widest"]) == (4, 3)


def brute_load(p, b, n, t):
    p, size = np.asarray(p), len(p)
    k = -(-size // n)
    over, mx, cv, gini, touched = [], [], [], [], []
    for s in range(size - b + 1):
        load = np.bincount((p[s:s + b] - 1) // n, minlength=k)
        nz = load[load > 0]
        over.append(load.max() > t)
        mx.append(load.max())
        cv.append(nz.std() / nz.mean() if len(nz) > 1 else 0)
        x = np.sort(load)
        gini.append(max(0, 2 * (np.arange(1, k + 1) * x).sum() / (k * b) - (k + 1) / k) if k > 1 else 0)
        touched.append(len(nz))
    return {"over_t": np.mean(over), "max_err": max(mx), "mean_max": np.mean(mx), "cv_load": np.mean(cv), "gini_load": np.mean(gini),
            "es_load": np.mean(touched) / min(k, b)}


@pytest.mark.parametrize("n,t,bursts", [(7, 2, [1, 5, 20]), (15, 3, [15, 30]), (4, 1, [3, 37])])
def test_load_brute_force(perms, rng, n, t, bursts):
    named = {str(i): rng.permutation(size) + 1 for i, size in enumerate([40, 61, 45])} | {"id": np.arange(1, 43)}
    for r in ld.load_metrics(perms(named), K, bursts, n, t).collect():
        want = brute_load(named[r["perm_id"]], r["b"], n, t)
        for c, v in want.items():
            assert r[c] == pytest.approx(v, abs=1e-12), (r["perm_id"], r["b"], c)


def test_load_when_burst_covers_frame(perms):
    r = ld.load_metrics(perms({"id": range(1, 31)}), K, [30, 50], 10, 3).collect()
    assert all(x["gini_load"] is None and x["over_t"] is None and x["es_load"] == pytest.approx(1.0) for x in r) and len(r) == 2


def test_gini_load_anchor(perms, rng):
    got = one(ld.load_metrics(perms({"id": range(1, 1201), "rnd": rng.permutation(1200) + 1}), K, [120], 15, 3))
    assert got["id"]["gini_load"] == pytest.approx(0.899, abs=5e-4)
    assert got["rnd"]["gini_load"] == pytest.approx(0.41, abs=0.02)


def test_pairwise_distance_in_blocks(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 1.0])], "vec_id bigint, vec array<double>")
    pairs = lambda **kw: {(r["vec_id"], r["o"]): r["distance"] for r in st.pairwise_distance(v, "vec_id", "vec", v.withColumnRenamed("vec_id", "o"), "o", **kw).collect()}
    assert pairs()[(1, 2)] == 5.0 and len(pairs()) == 9
    assert pairs(most=1) == pairs()


def test_load_tasks_follow_the_rows(perms, rng, monkeypatch):
    p = perms({str(i): rng.permutation(30) + 1 for i in range(20)})
    want = sorted(ld.load_metrics(p, K, [5, 10], 5, 2).collect())
    monkeypatch.setattr(ld, "EVENTS_A_TASK", 100)
    d = ld.load_metrics(p, K, [5, 10], 5, 2)
    assert ", 24), REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()  # 20 * 30 rows, 4 events each
    assert [tuple(r) for r in sorted(d.collect())] == [tuple(pytest.approx(x, abs=1e-12) if isinstance(x, float) else x for x in r) for r in want]


@pytest.mark.parametrize("pairs, tasks", [(10**9, 20), (50, 80)])
def test_sketches_of_a_task_are_few(perms, rng, monkeypatch, pairs, tasks):
    monkeypatch.setattr(st, "SKETCHES_A_TASK", 1)
    d = st.dispersion_approx(perms({str(i): rng.permutation(20) + 1 for i in range(20)}), K, pairs_a_task=pairs)  # 190 pairs each
    assert f", {tasks}), REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()


def test_loads_sort_and_count_frames_in_one_deal(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(sq.loads(spark, sf, [15, 30]).collect())
    monkeypatch.setattr(ld, "EVENTS_A_TASK", 100)
    d = sq.loads(spark, sf, [15, 30])
    plan, rows = d._jdf.queryExecution().executedPlan().toString(), sq.perm(spark, sf).count()
    assert plan.count("Exchange hashpartitioning(frame_id") == 1 and f", {4 * rows // 100}), REPARTITION_BY_NUM" in plan
    assert len(want) == 2 * rows // sq.N and [tuple(r) for r in sorted(d.collect())] == [tuple(pytest.approx(x, abs=1e-12) if isinstance(x, float) else x for x in r) for r in want]


@pytest.mark.parametrize("name, bursts", [
    ("L9_rho_by_burst", sq.SWEEP),
    ("L9b_sweep", sq.SWEEP),
    ("L2_max_err", sq.BURSTS),
    ("L3_mean_max", sq.BURSTS),
    ("L5_gini_load", sq.BURSTS),
    ("L4_cv_load", sq.BURSTS),
])
def test_load_queries_deal_frames_by_their_events(spark, monkeypatch, name, bursts):
    sf, rows = "/root/testdata/sf0.001", lambda d: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in d.collect())
    run = QUERIES[name]
    want, events = rows(run(spark, sf)), 2 * len(bursts) * sq.perm(spark, sf).count()
    monkeypatch.setattr(ld, "EVENTS_A_TASK", 100)
    d = run(spark, sf)
    # frames are dealt into as many tasks as their events ask for, whatever the session's width
    dealt = re.findall(r"Exchange hashpartitioning\(frame_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", d._jdf.queryExecution().executedPlan().toString())
    assert dealt == [str(events // 100)] and rows(d) == want
