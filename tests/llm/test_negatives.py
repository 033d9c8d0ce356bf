"""Intervals against scores, mining against a full sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterframe.llm import negatives
from scatterframe.llm.negatives import mine

VECTORS = "vec_id long, embedding array<double>, label int, row string, v int, of int, score int, id int"


def draws(kind, draw, n=700):
    if kind == "groups":
        return (draw.normal(size=(12, 48))[draw.integers(0, 12, n)] * 200 + draw.normal(size=(n, 48)) * 60).astype(np.int64)
    if kind == "ties":
        return draw.integers(-1, 2, (n, 5))
    if kind == "large":
        return draw.integers(-(2**29), 2**29, (n, 30))
    m = (draw.normal(size=(n, 33)) * 10.0 ** draw.integers(0, 6, (n, 1))).astype(np.int64)
    m[::9] = 0
    return m


@pytest.mark.parametrize("kind", ["groups", "ties", "large", "mixed"])
def test_bounds_hold(kind):
    m = draws(kind, np.random.default_rng(2))
    a = m[:100]
    low, high = negatives.Anchors(a).bounds(negatives.Codes.of(m))
    for r, x in enumerate(a):
        exact = [sum(int(p) * int(q) for p, q in zip(x, y)) for y in m]
        assert all(lo <= s <= hi for lo, s, hi in zip(low[r], exact, high[r]))
    if kind == "groups":
        assert (high - low).mean() < 0.8 * np.sqrt((a**2).sum(1).mean() * (m**2).sum(1).mean())


def test_few_pairs_are_scored(monkeypatch):
    m, scored = draws("groups", np.random.default_rng(4), 6000), []
    whole = negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda a, c, i, j: scored.append(len(i)) or whole(a, c, i, j))
    ids = np.arange(len(m))
    best, = negatives.search(ids[:40], m[:40], ids, m, negatives.Codes.of(m), lambda s: np.ones((40, len(ids[s])), bool), 5)
    want = sorted((int(q), -int(s), int(i)) for q in range(40) for s, i in sorted(((int(x), int(i)) for i, x in enumerate(m @ m[q]) if i != q), key=lambda x: (-x[0], x[1]))[:5])
    assert sorted((int(q), int(-s), int(i)) for q, s, i in zip(best.list, best.score, best.id)) == want
    assert sum(scored) < 0.25 * 40 * 6000


def brute(rows, asks, k=5, n=3, scale=256):
    inf = float("inf")
    good = sorted({(i, str(c), tuple(int(np.floor(x * scale)) for x in v)) for i, v, c in rows if None not in (i, v, c) and all(x is not None and abs(x) < inf for x in v)}, key=repr)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, c, v in good:
        if not asks(i):
            continue
        ranked = sorted(((dot(v, w), j, d) for j, d, w in good if j != i), key=lambda x: (-x[0], x[1]))
        for s, p, _ in [x for x in ranked if x[2] == c][:k]:
            band = [x for x in ranked if x[2] != c and 50 * s <= 100 * x[0] <= 95 * s][:n]
            out += [(i, p, r, x[1], s, x[0]) for r, x in enumerate(band, 1)]
    return sorted(out)


def answer(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("block", [7, 5000])
def test_mine(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 10 * block)
    draw = np.random.default_rng(8)
    centre = draw.normal(size=12)
    rows = [(i, [float(x) for x in centre + draw.normal(size=12) * 0.4], int(draw.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, rows[10][1], i % 3) for i in range(60)]  # copies in every label
    nan = float("nan")
    rows += [rows[0], (400, [], 1), (450, [0.5], 2), (500, None, 1), (550, [1.0, None], 1), (600, [nan], 1), (650, [float("inf")], 1), (700, [1.0] * 12, None), (None, [9.0] * 12, 1), (750, [0.0] * 12, 2), (800, [-1.0] * 12, 0)]
    df = spark.createDataFrame([(i, v, c, "r", 1, 2, 3, 4) for i, v, c in rows], VECTORS)
    asks = F.pmod("vec_id", F.lit(50)) == 0
    got = answer(mine(df, asks))
    assert got == brute(rows, lambda i: i % 50 == 0) and got
    assert answer(mine(df.limit(0), asks)) == [] and answer(mine(df, F.lit(False))) == []
    assert answer(mine(df.where("label = 1"), asks)) == []


def test_huge_components_saturate(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [1e29, 2.0], 2), (3, [-1e30, 0.0], 2), (4, [1e8, 0.0], 2)]
    df = spark.createDataFrame([(i, v, c, "r", 1, 2, 3, 4) for i, v, c in rows], VECTORS)
    top = int((2**63 - 1) // 2) ** 0.5
    got = mine(df, F.col("vec_id") == 0).collect()
    assert all(abs(r.positive_score) < 2**63 and r.positive_score > top for r in got)
