"""Queries on an event table that the frame length does not divide: the short last frame counts."""

import numpy as np
import pytest

from scatterframe.plans.catalog import QUERIES

ROWS, WIDTH = 450, 200


@pytest.fixture(scope="module")
def tail(spark, tmp_path_factory):
    sf = f"file://{tmp_path_factory.mktemp('tail')}"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(f"event_id < {ROWS}").write.parquet(f"{sf}/events.parquet")
    return sf


@pytest.fixture(scope="module")
def kinds(spark, tail):
    return [r.event_type for r in spark.read.parquet(f"{tail}/events.parquet").orderBy("event_id").collect()]


def test_runs(spark, tail, kinds):
    runs = QUERIES["B1_runs"](spark, tail).collect()
    assert sum(r.len for r in runs) == ROWS
    for r in runs:
        at = r.frame_id * WIDTH + r.start - 1
        assert kinds[at : at + r.len] == [r.kind] * r.len
    stats = {r.kind: r for r in QUERIES["B2_run_stats"](spark, tail).collect()}
    assert all(r.frames == 3 and r.rate == pytest.approx(kinds.count(k) / ROWS) for k, r in stats.items())
    assert {r.kind: r.n for r in QUERIES["B3_run_quantiles"](spark, tail).collect()} == {k: r.runs for k, r in stats.items()}
    for r in QUERIES["B4_ks"](spark, tail).collect():
        assert (r.n, r.m) == (stats[r.kind].runs, stats["error"].runs)


def test_transitions(spark, tail, kinds):
    last = kinds[400:]
    names = sorted(set(last))
    a = np.zeros((len(names), len(names)))
    for u, v in zip(last, last[1:]):
        if u != v:
            a[names.index(u), names.index(v)] += 1
            a[names.index(v), names.index(u)] += 1
    energy = ((a.sum(1) ** 2).sum() + (a**2).sum()) / len(names) ** 2
    got = {r.frame_id: r.energy for r in QUERIES["G12b_laplacian_transitions"](spark, tail).collect()}
    assert sorted(got) == [0, 1, 2] and got[2] == pytest.approx(energy)


def test_restore_and_alignment(spark, tail):
    back = QUERIES["I0_restore"](spark, tail).collect()
    assert sorted((r.frame_id, r.pos) for r in back) == [(k // WIDTH, k % WIDTH + 1) for k in range(ROWS)]
    assert not any(r.moved_back_wrong for r in back)
    r = QUERIES["S11_row_alignment"](spark, tail).first()
    assert (r.rows, r.only_a, r.diff_value) == (ROWS, 3, 9)


def test_padding_and_clean_region(spark, tail):
    rows = {(r.method, r.n_rows): r for r in QUERIES["I0_extension"](spark, tail).collect()}
    assert {n for _, n in rows} == {200, 50} and all(r.frames == (2 if n == 200 else 1) for (_, n), r in rows.items())
    clean = QUERIES["B9_clean_region"](spark, tail).collect()
    assert {r.frame_id for r in clean} == {0, 1, 2} and all(r.n_rows == (50 if r.frame_id == 2 else 200) for r in clean)
