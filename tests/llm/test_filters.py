"""The byte transducer against regular expressions; the audit against filters applied one after the other."""

import random
import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterframe.llm import filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, text string, part string, id long"


def plain(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbB #\t\n\x1f\xa0é漢😀\x00", max_size=40), max_size=6), st.integers(1, 30), st.integers(1, 64))
def test_transducer(texts, window, bits):
    assert filters.measured([t.encode() for t in texts], window, bits).tolist() == [plain(t) for t in texts]


def test_transducer_long():
    texts = ["", "x" * 700 + " " + "x" * 700 + " " + "x" * 699 + "y", "wörd " * 300_000, "é" * 1_500_000, " ".join(map(str, range(200_000)))]
    assert filters.measured([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def brute(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w, d, c, p, s = plain(text)
        copies = [j for j, u, _ in rows if (u or "") == text and j is not None]
        fails = {"A": w < 100, "B": 100 * d < 80 * w, "C": 100 * c > 10 * p, "D": s > 0, "E": i is not None and min(copies) < i}
        docs.append((lang or "", i, {f for f in fails if fails[f]}))
    out = {}
    for part in {d[0] for d in docs}:
        share = dict.fromkeys("ABCDE", 0)
        here = []
        for order in map("".join, permutations("ABCDE")):
            alive = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in alive if f in d[2]]
                late = [d for d in gone if f in d[2]]
                alive = [d for d in alive if f not in d[2]]
                gone += removed
                only = [d for d in docs if d[0] == part and d[2] == {f}]
                share[f] += len(removed)
                here.append((order, step, len(alive), len(removed), len(late), len(only), sum(d[1] in good for d in removed), sum(d[1] in toxic for d in removed)))
        for o, s, *n in here:
            out[part, o, s] = (*n, share[o[s - 1]])
    return out


def answer(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit(spark):
    draw = random.Random(5)
    base = [" ".join(draw.choice(["a", "B", "c#", "dog", "EEL"]) + str(draw.randrange(k)) for _ in range(n)) for k in (3, 500) for n in (0, 5, 99, 100, 150)] + [None, "", "漢字 " * 60]
    rows = [(draw.choice([*range(40), None]), draw.choice(base), draw.choice(["en", "fr", None, ""])) for _ in range(120)] + [(7, "same", "en")] * 3 + [(None, "alone", "en"), (None, "same", "fr")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, l, "x", 1, b"1", 2, True, True) for i, t, l in rows], "doc_id long, text string, lang string, part string, id int, digest binary, n int, good boolean, leads boolean")
    marks = spark.createDataFrame([(*x, "t", "p", 1) for x in labels], LABELS)
    got = answer(filters.audit(docs, marks))
    assert got == brute(rows, labels)
    assert all(sum(got[p, o, s][1] for s in range(1, 6)) + got[p, o, 5][0] == sum((x or "") == p for *_, x in rows) for p, o, _ in got)
    assert filters.audit(docs.limit(0), marks).count() == 0
    assert answer(filters.audit(docs, marks.limit(0)))["en", "ABCDE", 1][4:6] == (0, 0)


@pytest.mark.parametrize("window", [16, 1 << 20])
def test_text_counts_keeps_columns(spark, window):
    df = spark.createDataFrame([(1, None, "k"), (2, "a A a", None)], "n int, body string, n_bytes string")
    assert [tuple(r) for r in filters.text_counts(df, "body", window).orderBy("n").collect()] == [(1, "k", 0, 0, 0, 0, 0), (2, None, 3, 2, 1, 5, 0)]
