"""Streaming deduplication against grouping by whole text, over several runs of one store."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scatterframe.llm import stream_dedup
from scatterframe.llm.stream_dedup import deduplicate

ODD = "doc_id long, text string, digest string, place int, id string, n int, first string, salt int, other string"


def write(spark, path, rows, files=2):
    df = spark.createDataFrame([(i, t, "d", 1, "i", 2, "f", 3, "o") for i, t in rows], ODD)
    df.repartition(files).write.mode("append").parquet(path)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = lambda i: -1 if i is None else i
    return sorted(((i, max(g, key=low), len(g)) for g in groups.values() for i in g), key=repr)


def holds(df, rows):
    got = df.collect()
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.id == r.keep_id for r in kept)
    assert len({tuple(r.place) for r in got}) == len(rows)


def rows_of(draw, n, first=0):
    texts = ["hot"] * 30 + [None, "", "é", "x" * 200_000, "X", "x"] + [f"text {i}" for i in range(30)]
    return [(draw.choice([None, first + i, first + i, first + i, draw.randrange(20)]), draw.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("digest", ["whole", "weak", "one"])
def test_runs_of_one_store(spark, tmp_path, digest):
    of = {"whole": stream_dedup.sha256, "weak": lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), "one": lambda t: F.unhex(F.lit("00"))}[digest]
    draw, path, store = random.Random(digest), str(tmp_path / "docs"), str(tmp_path / "store")
    rows = []
    for turn in range(3):
        more = rows_of(draw, 90, 1000 * turn)
        write(spark, path, more, 3)
        rows += more
        # a batch takes one file at least, so every file is a batch of its own
        holds(deduplicate(spark, path, store, digest=of, batch_bytes=1), rows)
    state = stream_dedup.known(spark, store)
    assert state.agg(F.sum("n")).first()[0] == len(rows)
    holds(deduplicate(spark, path, store, digest=of), rows)


def test_large_set_of_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_dedup, "small", lambda *a: False)
    path, rows = str(tmp_path / "docs"), rows_of(random.Random(1), 200)
    write(spark, path, rows)
    holds(deduplicate(spark, path), rows)


def test_empty_and_single_file(spark, tmp_path, sf):
    path = str(tmp_path / "none")
    spark.createDataFrame([], ODD).write.parquet(path)
    assert deduplicate(spark, path).count() == 0
    assert deduplicate(spark, f"{sf}/documents.parquet").count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_removed_file_is_an_error(spark, tmp_path):
    path, store = tmp_path / "docs", str(tmp_path / "store")
    write(spark, str(path), [(1, "a")], 1)
    deduplicate(spark, str(path), store)
    for f in path.glob("*part*"):
        f.unlink()
    write(spark, str(path), [(2, "a")], 1)
    with pytest.raises(Exception, match="changed or removed"):
        deduplicate(spark, str(path), store).collect()
