"""Top-k against a full sort; the classifier on held-out rows and odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterframe.llm import quality, topk
from scatterframe.llm.quality_query import op10

VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(ids, m, queries, k):
    out = []
    for q in queries:
        s = m @ m[list(ids).index(q)]
        best = sorted((-int(x), int(i)) for x, i in zip(s, ids) if i != q)[:k]
        out += [(q, r, i, -x) for r, (x, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "large"])
def test_search(kind):
    draw = np.random.default_rng(3)
    m = {"normal": lambda: (draw.normal(size=(2500, 40)) * 30 * draw.exponential(size=(2500, 1))).astype(np.int64), "ties": lambda: draw.integers(-1, 2, (2500, 40)), "large": lambda: draw.integers(-(2**28), 2**28, (300, 40))}[kind]()
    ids = draw.permutation(len(m))
    best = topk.search(ids[:50], m[:50], ids, m, 20)
    rows = sorted((int(ids[q]), int(-s), int(i)) for q, s, i in zip(best.query, best.score, best.id))
    assert rows == sorted((q, -s, i) for q, _, i, s in brute(ids, m, ids[:50].tolist(), 20))


def test_top_k_odd(spark):
    inf = float("inf")
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (3, []), (4, None), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [float("nan")]), (None, [9.0]), (8, [-1.0, 0.3]), (20, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECTORS)
    ask = lambda d, k=20: sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 20 == 0, k).collect())
    ones = [(20, 8192), (1, 8192), (2, 4096), (3, 0), (8, -64 * 64 + 64 * 19)]
    want = sorted([(0, r, i, s) for r, (i, s) in enumerate(sorted(ones, key=lambda x: (-x[1], x[0])), 1)] + [(20, r, i, s) for r, (i, s) in enumerate(sorted([(0, 8192), *ones[1:]], key=lambda x: (-x[1], x[0])), 1)])
    assert ask(df) == want
    assert ask(df, 2) == [w for w in want if w[1] <= 2]
    assert ask(df.limit(0)) == [] and ask(df.where("vec_id = 3")) == []


def test_floors_before_sorting(monkeypatch):
    """Already the first step hands on no more than each query's best scores, with their ties."""
    draw = np.random.default_rng(4)
    m = (draw.normal(size=(2000, 48)) * 1000).astype(np.int64)
    added, plain = [], topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, query, *more: added.append(len(query)) or plain(self, query, *more))
    best = topk.search(np.arange(30), m[:30], np.arange(2000), m, 20)
    assert len(best.id) == 600 and max(added) <= 30 * 20 + 30


def test_tiles_of_several_blocks(spark, monkeypatch):
    """Many blocks, a task with several of them, and one shuffle to rank their rows."""
    for name, size in (("QUERY_BLOCK", 8), ("CANDIDATE_BLOCK", 16), ("COMPONENTS", 16 * 12 * 4), ("STEP", 24)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(6)
    m = draw.integers(-3, 4, (700, 12))
    df = spark.createDataFrame([(i, [x / 64 for x in v], 0, 1, 2) for i, v in enumerate(m.tolist())], VECTORS)
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, 15)
    assert sorted(tuple(r) for r in found.collect()) == brute(range(700), m, range(0, 700, 20), 15)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(query_id") == 1


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95
    assert all(r.predicted == 1 for r in held if labels[r.doc_id] == 1)


def test_quality_odd(spark, docs):
    texts = docs([(None, "a b"), (1, None), (2, ""), (3, "x" * 200_000), (4, "same"), (4, "same")])
    marks = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score double")
    for rows, want in (([], 0.5), ([(1, None, 0, "", 0.0), (None, 1, 0, "", 0.0)], 0.5), ([(1, 1, 0, "t", 1.0), (2, 1, 0, "t", 1.0)], 1.0)):
        got = quality.classify(texts, marks(rows)).collect()
        assert len(got) == 6 and {r.score for r in got} == {want} and got[0].held_out
    both = quality.classify(texts, marks([(1, 0, 0, "", 0.0), (2, 1, 0, "", 0.0), (3, 1, 0, "", 0.0), (4, 0, 0, "", 0.0), (4, 1, 0, "", 0.0)])).collect()
    assert all(0 <= r.score <= 1 for r in both) and both[4].score == both[5].score
    assert quality.classify(texts.limit(0), marks([])).count() == 0


def test_isotonic():
    assert quality.isotonic(np.arange(4), np.array([0.0, 1.0, 0.5, 1.0]), np.array([1, 1, 3, 1])).tolist() == [0.0, 0.625, 0.625, 1.0]
