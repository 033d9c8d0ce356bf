"""Ids, packing and id files against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scatterframe.llm import idfiles, packing
from scatterframe.llm.idfiles_query import VOCABULARY, op9
from scatterframe.llm.packing_query import op7
from scatterframe.llm.tokens import Encoder

ODD = ["", None, "a<|endoftext|>b", "x\x1cy z", "It's ok don't", "Σίσυφος ΣΑΣ ﬁ İx", "a\u00a0b \u3000c", "e\u0301 x", "ª² ½ a2b33", "w " * 9000, "no" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_tokenizer(text):
    global _pair
    if "_pair" not in globals():
        _pair = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert list(_pair[0].ids(text)) == ids(_pair[1], text)


def check_packing(rows, want, room):
    """Every piece once, no overlap, no gap, nothing cut that fits."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [p.start for p in parts] == list(range(0, len(want[d]), room))
        assert [p.ids_crc32 for p in parts] == [crc(want[d][k : k + room]) for k in range(0, len(want[d]), room)]
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(by_bin)


def test_packing(spark, sf, corpus, tokenizer):
    want = {d: ids(tokenizer, t) + [1] for d, t in corpus}
    bins = check_packing(op7(spark, sf).collect(), want, 4096)
    assert bins <= 1.05 * sum(map(len, want.values())) / 4096 + 2


def test_packing_odd(docs, tokenizer):
    texts = dict(enumerate(ODD))
    rows = packing.pack_documents(docs(texts), VOCABULARY, room=64, open_bins=2).collect()
    check_packing(rows, {d: ids(tokenizer, t) + [1] for d, t in texts.items()}, 64)
    assert packing.pack_documents(docs({}), VOCABULARY).count() == 0
    assert packing.pack_documents(docs([(None, "a"), (1, "b"), (1, "b")]), VOCABULARY).count() == 3


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8, 3, 2, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8), (3, 0)]


def test_id_files(spark, sf, corpus, tokenizer):
    at, want = 0, {}
    for d, t in sorted(corpus):
        x = ids(tokenizer, t) + [2]
        want[d] = (at, len(x), crc(x))
        at += len(x)
    assert {r[0]: tuple(r[1:]) for r in op9(spark, sf).collect()} == want


def test_id_files_odd(spark, docs, tokenizer, tmp_path):
    def back(rows, name):
        idfiles.write_ids(docs(rows), f"file://{tmp_path}/{name}", VOCABULARY)
        return sorted((tuple(r) for r in idfiles.read_ids(spark, f"file://{tmp_path}/{name}").collect()), key=lambda r: r[1])

    rows = [*enumerate(ODD), (None, "null id"), (3, ODD[3]), (3, "again")]
    got, at = back(rows, "odd"), 0
    for (d, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), got, strict=True):
        x = ids(tokenizer, t) + [2]
        assert r == (d, at, len(x), crc(x))
        at += len(x)
    assert back([], "none") == []
    assert [r[2] for r in back([(1, None)], "one")] == [1]


@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.integers(9, 20))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(counts, limit):
    lengths = idfiles.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and (len(counts) == 1 or sum(2.0 ** -int(x) for x in lengths) == 1)
    codes = idfiles.canonical_codes(lengths)
    x = np.random.default_rng(len(counts)).integers(0, len(counts), 1000)
    data, stretches = idfiles.encode(x, lengths, codes)
    assert (idfiles.decode(data, stretches, 1000, idfiles.decode_table(lengths, codes)) == x).all()


def test_lengths_are_huffman_without_limit():
    assert idfiles.code_lengths(np.array([1, 1, 2, 4, 8]), 18).tolist() == [4, 4, 3, 2, 1]
    assert idfiles.code_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist() == [3, 3, 3, 3, 1]
