"""Audit of quality filters: who removes what, alone and in any order.

The text measures come from a byte transducer: one table gives the next state
of every byte, another what the step emits (a word opens, a word closes, a
capital, a symbol, a code point), and both are looked up for a window of bytes
at once.  Word spans go straight into an open-addressing hash table; a hit
counts only once its bytes have been compared with those of the slot's owner.
Each document becomes a mask of the filters it fails, masks are counted by
part and label, and everything about orders of filters follows from these
counts.

Defined results: null text is empty; a null part is the empty string.  A text
fails E if its bytes (as named by SHA-256) also belong to a row with a smaller
id; rows without an id never do, and rows that repeat both id and text are
equals.  Labels of one id are joined: good or toxic if any of its rows says so;
labels without an id, and ids without a label, count for nothing.  Repeated
rows count as often as they stand.  A table without rows gives no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bytes that the transducer reads at once; texts are gathered up to it, longer ones read in windows.
WINDOW = 1 << 20
SYMBOLS = "#$%&*|"
#: Words of more bytes are hashed and compared one by one.
LONG = 256
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
LETTERS = "ABCDE"

_END = 0xFF  # no byte of UTF-8
_OUT, _IN = 0, 1
_OPENS, _CLOSES, _POINT, _CAPITAL, _SYMBOL = 1, 2, 4, 8, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def transducer(symbols: str = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(next state by byte, emissions by state and byte); a byte alone decides the state after it."""
    nexts, emits = np.empty(256, np.uint8), np.zeros((2, 256), np.uint8)
    for b in range(256):
        gap = b == 0x20 or 0x09 <= b <= 0x0D or b == _END
        nexts[b] = _OUT if gap else _IN
        emits[_IN if gap else _OUT, b] = _CLOSES if gap else _OPENS
        more = _POINT if b != _END and b & 0xC0 != 0x80 else 0
        more |= _CAPITAL if 0x41 <= b <= 0x5A else 0
        more |= _SYMBOL if chr(b) in symbols and b < 0x80 else 0
        emits[:, b] |= more
    return nexts, emits


class Words:
    """Distinct (text, word) pairs in open addressing, verified byte by byte."""

    def __init__(self, data: np.ndarray, bits: int = 64):
        """``data`` ends in eight spare bytes; ``bits`` of the hash are used, fewer only to force collisions."""
        self.data, self.bits = data, bits
        self.eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.slots = np.full(1 << 10, -1, np.int64)
        self.text, self.start, self.size = (np.empty(0, np.int64) for _ in range(3))
        self.hash = np.empty(0, np.uint64)

    def _hashes(self, text, start, size) -> np.ndarray:
        h = text.astype(np.uint64) * _MIX + size.astype(np.uint64)
        short = np.flatnonzero(size <= LONG)
        at = 0
        while len(short):
            h[short] = self._mixed(h[short] ^ self._eight(start[short], size[short], at))
            at += 8
            short = short[size[short] > at]
        for i in np.flatnonzero(size > LONG):
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.data[start[i]: start[i] + size[i]]))
        return self._mixed(h) >> np.uint64(64 - self.bits)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    def _eight(self, start, size, at: int) -> np.ndarray:
        """Eight bytes from ``at`` on, zero behind the word's end."""
        spare = np.clip(at + 8 - size, 0, 7).astype(np.uint64) * np.uint64(8)
        return self.eight[start + at] << spare

    def _equal(self, text, start, size, hashes, owner) -> np.ndarray:
        same = (self.hash[owner] == hashes) & (self.text[owner] == text) & (self.size[owner] == size)
        left = np.flatnonzero(same & (self.start[owner] != start))
        for i in left[size[left] > LONG]:
            o = self.start[owner[i]]
            same[i] = np.array_equal(self.data[start[i]: start[i] + size[i]], self.data[o: o + size[i]])
        left, at = left[size[left] <= LONG], 0
        while len(left):
            ok = self._eight(start[left], size[left], at) == self._eight(self.start[owner[left]], size[left], at)
            same[left[~ok]] = False
            at += 8
            left = left[ok & (size[left] > at)]
        return same

    def _make_room(self, more: int) -> None:
        need = 2 * (len(self.start) + more)
        if need <= len(self.slots):
            return
        self.slots = np.full(1 << int(need - 1).bit_length(), -1, np.int64)
        mask = np.uint64(len(self.slots) - 1)
        at, left = (self.hash & mask).astype(np.int64), np.arange(len(self.start))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & int(mask)

    def add(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The texts of the words that were new, one entry each."""
        self._make_room(len(start))
        hashes = self._hashes(text, start, size)
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        left, new = np.arange(len(start)), []
        while len(left):
            here = at[left]
            open_ = self.slots[here] < 0
            claims, places = left[open_], here[open_]
            self.slots[places] = claims
            won = claims[self.slots[places] == claims]
            self.slots[at[won]] = len(self.start) + np.arange(len(won))
            self.text, self.start = np.append(self.text, text[won]), np.append(self.start, start[won])
            self.size, self.hash = np.append(self.size, size[won]), np.append(self.hash, hashes[won])
            new.append(text[won])
            same = self._equal(text[left], start[left], size[left], hashes[left], self.slots[here])
            left = left[~same]
            at[left] = (at[left] + 1) & mask
        return np.concatenate(new) if new else np.empty(0, np.int64)


_NEXTS, _EMITS = transducer()


def measured(texts: Sequence[bytes], window: int = WINDOW, bits: int = 64, tables=(_NEXTS, _EMITS)) -> np.ndarray:
    """The measures ``COUNTS`` of each text, one row each."""
    nexts, emits = tables
    joined = bytes([_END]).join(texts) + bytes([_END]) if len(texts) else b""
    data = np.frombuffer(joined + bytes(8), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)  # one behind each end mark
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    words, state, opened = Words(data, bits), _OUT, np.empty(0, np.int64)
    for a in range(0, len(joined), window):
        part = data[a: min(a + window, len(joined))]
        after = nexts[part]
        before = np.empty_like(after)
        before[0], before[1:] = state, after[:-1]
        state = after[-1]
        emitted = emits[before, part]
        for column, flag in ((2, _CAPITAL), (3, _POINT), (4, _SYMBOL)):
            hits = a + np.flatnonzero(emitted & flag)
            first, last = np.searchsorted(ends, (a, a + len(part) - 1), "right")
            upto = np.searchsorted(hits, np.minimum(ends[first: last + 1], a + len(part)))
            out[first: last + 1, column] += np.diff(upto, prepend=0)
        starts = np.append(opened, a + np.flatnonzero(emitted & _OPENS))
        closes = a + np.flatnonzero(emitted & _CLOSES)
        opened, starts = starts[len(closes):], starts[: len(closes)]
        text = np.searchsorted(ends, starts, "right")
        out[:, 0] += np.bincount(text, minlength=len(texts))
        out[:, 1] += np.bincount(words.add(text, starts, closes - starts), minlength=len(texts))
    return out


def _gathered(texts: Sequence[bytes], window: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``window`` bytes together, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > window:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if len(texts) > first:
        yield first, len(texts)


def text_counts(df: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """``df`` with its ``text`` replaced by the measures ``COUNTS``."""
    others = [c for c in df.columns if c != text]

    def measure(batches):
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            counts = [measured(texts[a:b], window) for a, b in _gathered(texts, window)]
            counts = np.concatenate(counts) if counts else np.zeros((0, len(COUNTS)), np.int64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, counts.T)], names=[*others, *COUNTS])

    schema = df.select(others).schema
    for c in COUNTS:
        schema = schema.add(c, "long", False)
    return df.mapInArrow(measure, schema)


def failures(documents: DataFrame, labels: DataFrame, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> DataFrame:
    """(part, mask, good, toxic, n): rows by the filters they fail (bit i for the i-th letter) and their labels."""
    text = F.coalesce("text", F.lit(""))
    slim = documents.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("body"))
    bit = lambda i, failed: F.when(failed, F.lit(1 << i)).otherwise(0)
    low = bit(0, F.col("n_words") < least_words) + bit(1, 100 * F.col("n_distinct") < distinct_percent * F.col("n_words"))
    low = low + bit(2, 100 * F.col("n_capitals") > capital_percent * F.col("n_points")) + bit(3, F.col("n_symbols") > 0)
    rows = table(text_counts(slim, "body").select("id", "part", "digest", low.alias("low")), "failures")

    cells = rows.groupBy("id", "digest", "part", "low").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("leads", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id have no partner; the digest keeps them apart
    apart = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    cells = cells.join(firsts, ["digest", "id"], "left").withColumn("apart", apart).join(marks.withColumn("apart", F.lit(0).cast("long")), ["id", "apart"], "left")
    mask = (F.col("low") + bit(4, F.col("id").isNotNull() & F.col("leads").isNull())).cast("int")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return cells.select("part", mask.alias("mask"), *flags, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def by_order(failed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every filter does at every place of every order, and its Shapley value over all orders."""
    steps = [{"filter_order": "".join(o), "step": s + 1, "bit": 1 << letters.index(f), "prior": sum(1 << letters.index(x) for x in o[:s])}
             for o in permutations(letters) for s, f in enumerate(o)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, prior: int>>")
    here = failed.select("*", F.inline(listed))
    fails, gone = F.expr("mask & bit <> 0"), F.expr("mask & prior <> 0")
    removed = fails & ~gone
    count = lambda cond, n="n": F.sum(F.when(cond, F.expr(n)).otherwise(0)).cast("long")
    orders = len({s["filter_order"] for s in steps})
    return here.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"), count(removed).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.expr("mask = bit")).alias("unique_fails"), count(removed & F.col("good")).alias("good_lost"), count(removed & F.col("toxic")).alias("toxic_lost"),
        count(fails, f"n * ({orders} div bit_count(mask))").alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return by_order(failures(documents, labels))
