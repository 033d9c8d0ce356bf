"""Personal data: base patterns, and spans that a semi-Markov conditional random field adds.

The patterns find emails, IP addresses, payment cards and phone numbers.  They
miss numbers that run into each other, such as two cards with a blank between
them.  The field reads each island (a run of chunks between white space that
hold a digit, ``@`` or ``+``): every stretch of up to ``MOST_CHUNKS`` chunks
is scored as a whole for each kind, and dynamic programming chooses boundaries
and kinds together.  Its weights are fitted, by the gradient of the conditional
likelihood, to the pattern spans of a bounded sample of texts.  A text of
``UNIT`` characters or more enters the sample as units of its islands, and an
island of more than ``MOST_RUN`` chunks as runs of them, so none is left out for
its length.  Chunks outside islands hold nothing that a kind could score, so they
need no scores.

Defined results: a null or empty text has no spans.  Pattern spans always stay,
also where kinds overlap; spans of the field are added where they touch no
pattern span.  Repeated rows give equal results.  A corpus without islands gives
a field that adds nothing.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MOST_CHUNKS = 6
#: Texts, by order of a hash, to which the field is fitted, and islands taken from them.
SAMPLE_TEXTS = 1000
SAMPLE_ISLANDS = 3000
#: Characters from which a text is drawn in units, about as long at most; a chunk is never cut.
UNIT = 20_000
#: Chunks that are fitted together, at most; longer islands are cut between spans.
MOST_RUN = 40
STEPS = 200
RATE = 0.5
DECAY = 1e-3
#: How much better than no span, in log odds, an added span must be.
MARGIN = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ISLAND = re.compile(r"(?<!\S)[^\s0-9@+]*[0-9@+]\S*(?:[^\S\n]+[^\s0-9@+]*[0-9@+]\S*)*")
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.DOTALL)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Pattern spans, by kind and then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(end, at + 1))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() < 40 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of chunks, each chunk without marks at its ends."""
    if "@" not in text and "+" not in text and not _DIGIT.search(text):
        return
    for run in _ISLAND.finditer(text):
        cores = []
        for chunk in re.finditer(r"\S+", run[0]):
            core = _CORE.search(chunk[0])
            if core:
                cores.append((run.start() + chunk.start() + core.start(), run.start() + chunk.start() + core.end()))
        if cores:
            yield cores


def runs(cores: list[tuple[int, int]], base: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """An island in runs of at most ``MOST_RUN`` chunks, cut where no pattern span crosses if there is such a place."""
    at = 0
    while len(cores) - at > MOST_RUN:
        to = next((k for k in range(at + MOST_RUN, at, -1) if not any(s < cores[k - 1][1] and cores[k][0] < e for _, s, e in base)), at + MOST_RUN)
        yield cores[at:to]
        at = to
    yield cores[at:]


def units(text: str) -> Iterator[str]:
    """All islands of a text, with one run of chunks a line, in parts of about ``UNIT`` characters."""
    base, held, size = base_spans(text), [], 0
    for island in islands(text):
        s, e = island[0][0], island[-1][1]
        for cores in runs(island, [b for b in base if b[1] < e and s < b[2]] if len(island) > MOST_RUN else []):
            s, e = cores[0][0], cores[-1][1]
            while s and not text[s - 1].isspace():
                s -= 1
            while e < len(text) and not text[e].isspace():
                e += 1
            if held and size + e - s >= UNIT:
                yield "\n".join(held)
                held, size = [], 0
            held.append(text[s:e])
            size += e - s + 1
    if held:
        yield "\n".join(held)


_SHAPES = (
    re.compile(r"[^\s@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]+(?:[ -][0-9]+)*"),
    re.compile(r"\+?[0-9(][0-9(). -]*[0-9]"),
)
WIDTH = 14


def describe(text: str, start: int, end: int, chunks: int) -> np.ndarray:
    """What the field sees of a stretch as a whole."""
    out = np.zeros(WIDTH)
    out[0], out[1] = 1, chunks - 1
    if end - start > 320:
        out[2] = 1
        return out
    span = text[start:end]
    digits = _digits(span)
    for k, shape in enumerate(_SHAPES, 3):
        out[k] = shape.fullmatch(span) is not None
    out[7] = out[4] and all(map(_small, span.split(".")))
    out[8] = 13 <= len(digits) <= 19
    out[9] = bool(out[5] and out[8] and luhn(digits))
    out[10] = span[0] == "+"
    out[11] = bool(out[6] and 9 <= len(digits) <= 15)
    out[12] = any(c.isalpha() for c in span)
    out[13] = "(" in span and ")" in span
    return out


@dataclass
class Field:
    """Weights by kind (row) and what is seen (column); no span scores 0."""

    weights: np.ndarray

    def scores(self, text: str, cores: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        n = len(cores)
        return {(i, j): self.weights @ describe(text, cores[i][0], cores[j - 1][1], j - i) for i in range(n) for j in range(i + 1, min(n, i + MOST_CHUNKS) + 1)}

    def best(self, text: str, cores: list[tuple[int, int]]) -> list[Span]:
        """The best division of an island into spans and single chunks without one."""
        n, scores = len(cores), self.scores(text, cores)
        top, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            top[j], back[j] = top[j - 1], (j - 1, None)
            for i in range(max(0, j - MOST_CHUNKS), j):
                kind = int(scores[i, j].argmax())
                s = top[i] + scores[i, j][kind] - MARGIN
                if s > top[j]:
                    top[j], back[j] = s, (i, kind)
        out, j = [], n
        while j:
            i, kind = back[j]
            if kind is not None:
                out.append((KINDS[kind], cores[i][0], cores[j - 1][1]))
            j = i
        return out


def _seen(text: str, cores: list[tuple[int, int]], base: list[Span]):
    """Stretches of an island as (from, to, what is seen), and the true kind of those that are pattern spans."""
    n = len(cores)
    stretches = [(i, j, describe(text, cores[i][0], cores[j - 1][1], j - i)) for i in range(n) for j in range(i + 1, min(n, i + MOST_CHUNKS) + 1)]
    true, used = {}, set()
    for kind, s, e in base:
        for i, j, _ in stretches:
            if cores[i][0] == s and cores[j - 1][1] == e and used.isdisjoint(range(i, j)):
                true[i, j] = KINDS.index(kind)
                used |= set(range(i, j))
    return n, stretches, true


def _gradient(weights: np.ndarray, n: int, stretches, true) -> np.ndarray:
    """Of an island's log likelihood: what is seen in the true spans less what is expected."""
    score = {(i, j): weights @ x for i, j, x in stretches}
    fore, aft = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fore[0] = aft[n] = 0.0
    for j in range(1, n + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *(np.logaddexp.reduce(fore[i] + score[i, j]) for i in range(max(0, j - MOST_CHUNKS), j))])
    for i in range(n - 1, -1, -1):
        aft[i] = np.logaddexp.reduce([aft[i + 1], *(np.logaddexp.reduce(score[i, j] + aft[j]) for j in range(i + 1, min(n, i + MOST_CHUNKS) + 1))])
    out = np.zeros_like(weights)
    for i, j, x in stretches:
        p = np.exp(fore[i] + score[i, j] + aft[j] - fore[n])
        if (i, j) in true:
            p[true[i, j]] -= 1
        out -= p[:, None] * x
    return out


def fit(texts: list[str]) -> Field:
    """The field whose likelihood on the texts' islands is best, by averaged gradient steps."""
    cases: dict = {}
    for text in texts:
        base = base_spans(text)
        for island in islands(text):
            for cores in runs(island, base):
                if sum(c[2] for c in cases.values()) < SAMPLE_ISLANDS:
                    n, stretches, true = _seen(text, cores, base)
                    key = (n, tuple(x.tobytes() for _, _, x in stretches), tuple(sorted(true.items())))
                    cases[key] = ((n, stretches, true), 0, cases.get(key, (0, 0, 0))[2] + 1)
    weights, total = np.zeros((len(KINDS), WIDTH)), sum(c[2] for c in cases.values())
    pace = np.zeros_like(weights)
    for _ in range(STEPS if total else 0):
        slope = sum(times * _gradient(weights, *case) for case, _, times in cases.values()) / total - DECAY * weights
        pace += slope**2
        weights = weights + RATE * slope / np.sqrt(pace + 1e-12)
    return Field(weights)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE_TEXTS) -> Field:
    """Fit a field to at most ``sample`` different texts, or units of long ones, that hold a digit, ``@`` or ``+``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(units(t.as_py()), pa.string())], ["text"])

    told = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@+]"))
    rows = told.where(F.length("text") < UNIT).union(told.where(F.length("text") >= UNIT).mapInArrow(cut, "text string")).withColumn("h", F.xxhash64("text"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    # Only hashes are ranked; then the texts up to the last one are fetched.
    texts = rows.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")) if last is not None else rows.limit(0)
    return fit([r.text for r in sorted(texts.collect(), key=lambda r: r.h)])


def find_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """(pattern spans, added spans)."""
    if not text:
        return [], []
    base, added = base_spans(text), []
    if field.weights.any():
        for cores in islands(text):
            for kind, s, e in field.best(text, cores):
                if not any(s < e2 and s2 < e for _, s2, e2 in base):
                    added.append((kind, s, e))
    return base, added


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def spans_of(field: Field, text: str) -> Column:
    """Counts of pattern spans, their digest, all spans, and the number of added ones."""

    @F.pandas_udf(_FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                base, added = find_spans(t, field)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return find(F.col(text))


def redacted(field: Field, text: str) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""

    def mask(t: str | None) -> str | None:
        out, at = [], 0
        for kind, s, e in sorted((x for part in find_spans(t, field) for x in part), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [t[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return t if not at else "".join(out) + t[at:]

    @F.pandas_udf("string")
    def hide(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([mask(t) for t in batch], dtype=object)

    return hide(F.col(text))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_TEXTS) -> DataFrame:
    field = train(docs, text, sample)
    return docs.select(F.col(key).alias("doc_id"), spans_of(field, text).alias("_f")).select("doc_id", "_f.*")
