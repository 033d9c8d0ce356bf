"""Windows against plain loops; personal data against plain patterns."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterframe.llm import pii
from scatterframe.llm.decontaminate import clean, decontaminate
from scatterframe.llm.pii_query import op8


def tokens_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items, size=10):
    grams = {}
    for i, t in items:
        w = tokens_of(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found, any_ = tokens_of(t), set(), set(), False
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    any_ = True
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in grams[tuple(w[k : k + n])] if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any_))
    return sorted(out, key=repr)


def test_windows_odd(spark, docs):
    long = " ".join(["the"] * 3000 + [f"w{k}" for k in range(14)] + ["the"] * 3000)
    rows = [(1, None), (2, ""), (3, "!?"), (4, "Short ITEM here"), (5, "a short-item; ok"), (6, long), (6, long), (None, "x Ünï É y"), (7, "ÜNï É"), (8, "same same same same"), (9, "<w3 w4 w5 w6 w7 w8 w9 w10 w11>")]
    items = [(10, "short item"), (9, " ".join(f"w{k}" for k in range(12))), (9, " ".join(f"w{k}" for k in range(12))), (2, None), (3, ""), (4, "ünï"), (None, "Ünï é"), (5, "same same"), (6, "the the the the the the the the the the the the"), (11, "never seen words")]
    bench = spark.createDataFrame([(i, t, 1, "n") for i, t in items], "item_id long, text string, n long, norm string")
    got = sorted((tuple(r) for r in decontaminate(docs(rows), bench).collect()), key=repr)
    assert got == brute(rows, items)
    assert sorted(r.doc_id or 0 for r in clean(docs(rows), bench).collect()) == sorted((r[0] or 0) for r in brute(rows, items) if not r[5])
    assert decontaminate(docs([]), bench).count() == 0
    assert [r.contaminated for r in decontaminate(docs(rows[:5]), bench.limit(0)).collect()] == [False] * 5


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    count = lambda m: sum(c in "0123456789" for c in m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= count(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= count(m) <= 15]


@given(st.lists(st.sampled_from(["a", "1", "2", "25", "255", "4111111111111111", "+1", "(", ")", "-", ".", "@", " ", "é", "\n", "_", "b.c", "١"]), max_size=40).map("".join))
@settings(max_examples=1500, deadline=None)
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_query(spark, sf, corpus):
    rows = {r.doc_id: r for r in op8(spark, sf).collect()}
    assert len(rows) == len(corpus)
    for d, t in corpus:
        base = plain(t)
        r = rows[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(",")) and (r.n_added or r.spans == pii.joined(base))


@pytest.fixture(scope="module")
def field(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    return pii.fit([t for t in texts if re.search("[0-9@+]", t)])


def test_field_parts_cards(field):
    text = "on 4111111111111111 5500005555555559 and 1234567890123456 or v4.0 or 10.0.0.1 end"
    base, added = pii.find_spans(text, field)
    assert base == [("ip", text.index("10.0"), text.index(" end"))]
    assert {text[s:e]: k for k, s, e in added} == {"4111111111111111": "card", "5500005555555559": "card"}


def test_gradient_is_the_slope_of_the_likelihood():
    import numpy as np

    text = "x 4111111111111111 5500005555555559 12 a@b.cc"
    (cores,) = pii.islands(text)
    n, stretches, true = pii._seen(text, cores, [("email", text.index("a@"), len(text))])
    w = np.random.default_rng(1).normal(size=(4, pii.WIDTH)) * 0.3

    def likelihood(w):
        score = {(i, j): w @ x for i, j, x in stretches}
        fore = [0.0]
        for j in range(1, n + 1):
            fore.append(np.logaddexp.reduce([fore[j - 1], *(fore[i] + s for i in range(max(0, j - pii.MOST_CHUNKS), j) for s in score[i, j])]))
        return sum(score[k][v] for k, v in true.items()) - fore[n]

    slope = pii._gradient(w, n, stretches, true)
    for at in ((0, 0), (0, 3), (2, 9), (3, 1)):
        step = np.zeros_like(w)
        step[at] = 1e-5
        assert abs((likelihood(w + step) - likelihood(w - step)) / 2e-5 - slope[at]) < 1e-4


def test_odd(spark, docs):
    rows = [(1, None), (2, ""), (3, "9" * 300_000), (4, "a@" * 50_000), (5, "x" * 300_000 + "@b.c"), (6, "+1 " + "(" * 100_000), (7, "1." * 100_000), (None, "a@b.c"), (7, "a@b.c"), (7, "a@b.c")]
    got = pii.find_pii(docs(rows)).collect()
    assert [r.n_email for r in got] == [len([s for s in pii.base_spans(t or "") if s[0] == "email"]) for _, t in rows]
    assert got[1].spans == got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs([])).count() == 0


def test_long_texts_and_islands_are_fitted(spark, docs):
    cards = ["4111111111111111", "5500005555555559", "340000000000009"]
    row = lambda k: f"card {cards[k % 3]} or {k} or a{k}@b.cc"
    field = pii.train(docs([(1, "word " * 5000 + "\n".join(map(row, range(200))))]))
    assert field.weights.any() and [t[0] for t in pii.find_spans(f"{cards[0]} {cards[1]}", field)[1]] == ["card", "card"]
    table = " ".join(f"a{k}@b.cc 1 {cards[k % 3]}x" for k in range(60))
    assert pii.fit([table]).weights.any()


def test_units_keep_every_chunk_and_span():
    text = "start " * 4000 + " ".join(f"4111 1111 1111 1111 x {k}" for k in range(900)) + " end\n" + "+1 (202) 555-0143 " * 3000
    parts = list(pii.units(text))
    assert len(parts) > 1 and max(map(len, parts)) <= pii.UNIT
    chunks = lambda t: [t[s:e] for cores in pii.islands(t) for s, e in cores]
    assert [c for p in parts for c in chunks(p)] == chunks(text)
    spans = lambda t: [(k, t[s:e]) for k, s, e in pii.base_spans(t)]
    assert sorted(x for p in parts for x in spans(p)) == sorted(spans(text))
