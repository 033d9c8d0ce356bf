"""Repeated strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterframe.llm import suffix_dedup
from scatterframe.llm.suffix_dedup_query import op3


def brute(rows, least):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i] += 1
                gone[i + least] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_query(spark, sf, corpus):
    got = result(op3(spark, sf))
    assert got == brute(corpus, 400)
    assert sum(r[2] for r in got)


@pytest.mark.parametrize(("least", "gram", "batch"), [(12, 4, 64), (20, 3, 1 << 20)])
def test_small(spark, docs, least, gram, batch, monkeypatch):
    draw = random.Random(least)
    parts = ["".join(draw.choice("abé") for _ in range(draw.randint(1, 60))) for _ in range(12)]
    rows = [(k, "".join(draw.choice(parts) if draw.random() < 0.4 else draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(draw.randint(0, 25)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, parts[0] * 3), (205, "x" * (least - 1)), (None, parts[1] * 2), (206, "only here, once"), (206, "twice the same row"), (206, "twice the same row")]
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    got = suffix_dedup.remove_repeats(docs(rows), least, gram)
    assert result(got) == brute(rows, least)
    for r in got.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("least", [8, 11, 16, 21, 40])
def test_suffix_array(least):
    """The order of the strings, by plain sorting, zero bytes and high ones among them."""
    draw = random.Random(least)
    strings = [bytes(draw.choice((0, 97, 255)) for _ in range(draw.randint(1, 90))) for _ in range(40)] + [b"\0" * 70, b"ab" * 40]
    strings += strings[3:9]
    data = np.frombuffer(b"".join(strings), np.uint8)
    room = np.concatenate([np.arange(len(s), 0, -1) for s in strings])
    places, same = suffix_dedup.suffix_array(data, room, least)
    whole = data.tobytes()
    assert sorted(places.tolist()) == np.flatnonzero(room >= least).tolist()
    found = [whole[p : p + least] for p in places]
    assert found == sorted(found)
    assert same.tolist() == [k > 0 and found[k] == found[k - 1] for k in range(len(found))]


@pytest.mark.parametrize("least", [8, 13, 30])
def test_levels(least):
    draw = random.Random(least)
    parts = [bytes(draw.choice((0, 98, 200)) for _ in range(draw.randint(3, 30))) for _ in range(9)]
    levels, seen = suffix_dedup.Levels(least), []
    for size in (5, 60, 3, 9, 9, 1, 90, 4, 4, 4):
        strings = [b"".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) + b"z" * least + bytes([draw.randrange(256)]) for _ in range(size)]
        levels.add(strings)
        seen += strings
        assert all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(levels.levels, levels.levels[1:]))
        whole = levels.data.tobytes()
        for places, _ in levels.levels:
            found = [whole[p : p + least] for p in places]
            assert found == sorted(set(found))
    windows = [s[i : i + least] if i + least <= len(s) else None for s in seen for i in range(len(s))]
    count = Counter(windows)
    assert levels.marked[: levels.size].tolist() == [w is not None and count[w] > 1 for w in windows]


def test_prints():
    draw = np.random.default_rng(5)
    levels, seen = suffix_dedup.Prints(), []
    for size in (5, 400, 3, 64, 64, 1, 900, 30, 30, 30):
        prints = draw.integers(0, 2500, size).astype(np.uint64)
        levels.add(prints)
        seen += prints.tolist()
        assert all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(levels.levels, levels.levels[1:]))
    count = Counter(seen)
    assert levels.marks().tolist() == [count[x] > 1 for x in seen]


def test_long_text(spark, docs, monkeypatch):
    """Texts of many pieces, one with its own start at its end, one whose middle another text has."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    monkeypatch.setattr(suffix_dedup, "BATCH", 4096)
    draw = random.Random(3)
    words = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    text = words(120_000)
    rows = [(1, text + text[:700]), (2, words(5000)), (3, words(90) + text[60_000:70_000] + words(50)), (4, words(4096)), (5, "")]
    got = result(suffix_dedup.remove_repeats(docs(rows)))
    assert got == brute(rows, 400)
    assert [r[2] for r in got] == [11_400, 0, 10_000, 0, 0]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 7, 50):
        assert suffix_dedup.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(51 - w)]


@pytest.mark.parametrize("batch", [64, 1 << 20])
def test_crowded_anchor(spark, docs, batch, monkeypatch):
    """A passage in every document, with other text around it: no task gets more than its share of the strings."""
    draw = random.Random(7)
    words = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    passage = words(30)
    rows = [(k, words(40) + passage + words(40)) for k in range(300)] + [(k, words(25) + passage[:25] + "z") for k in range(300, 330)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (401, rows[0][1]), (402, "a" * 300), (403, None), (404, passage)]
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "CROWD", 500, raising=False)
    monkeypatch.setattr(suffix_dedup, "SHARE", 2000, raising=False)
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)

    def bounded(name, key, strings, most):
        call = getattr(suffix_dedup, name, None)

        def checked(df, *args):
            sizes.append((name, df.groupBy(key).agg(F.sum(F.expr(strings)).alias("n")).agg(F.max("n")).first()[0], most))
            return call(df, *args)

        monkeypatch.setattr(suffix_dedup, name, checked, raising=False)

    sizes = []
    bounded("_cover", "anchor", "length(slice) - 19", 500)
    bounded("_met", "part", "length(prints) / 8", 4000)
    assert result(suffix_dedup.remove_repeats(docs(rows), 20, 4)) == brute(rows, 20)
    assert [n for n, _, _ in sizes] == ["_cover", "_met"]
    assert all(n <= most for _, n, most in sizes)
