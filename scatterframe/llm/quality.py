"""Text quality from document statistics: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text are standardised over the training rows and mapped
to cosines that stand for a Gaussian kernel.  Each partition sums its normal
equations, fold by fold, in whole numbers, so sums do not depend on the order of
tasks; the sums are added in a tree and solved on the driver, where their size
is fixed.  The ridge weight is the one with the least error over the folds, and
scores of rows that their fold's fit has not seen are calibrated by an isotonic
fit of counts per score bin.

Defined results: null and empty texts have statistics of 0 and get a score
like any other.  Labels of one id are averaged and count as 1 from one half on;
null labels are none.  Without training rows every score is 0.5; with one class
only it is that class's share.  Repeated rows score alike, null ids count as
held out.  Neither ids nor other columns enter a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, table

FEATURES = 256
WIDTH = 3.0
FOLDS = 4
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2)
UNIT = 1 << 10
CUT = 0.3
_STATS = 16
_BINS = 400


def _classes() -> np.ndarray:
    """Kinds of UTF-8 bytes: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 full stop or comma, 5 other marks, 6 outside ASCII, 7 control."""
    kind = np.full(256, 5, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:], kind[:32], kind[127] = 0, 1, 2, 6, 7, 7
    kind[[32, 9, 10, 11, 12, 13]], kind[[44, 46]] = 3, 4
    return kind


_KIND = _classes()


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(_STATS)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    share = np.bincount(_KIND, count, 8) / len(data)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    seen = count[count > 0] / len(data)
    out[:8] = share
    out[8] = math.log1p(len(text))
    out[9] = -(seen * np.log2(seen)).sum()
    out[10] = count[[35, 36, 37, 38, 42, 64, 94, 126]].sum() / len(data)
    out[11] = count[[33, 63, 124]].sum() / len(data)
    out[12] = len(set(lines)) / len(lines)
    if n:
        out[13] = math.log1p(len(text) / n)
        out[14] = math.log1p(len(set(words))) / math.log1p(n)
        out[15] = sum(map(str.__eq__, words, words[1:])) / n
    return out


@dataclass
class Model:
    """What a score needs; a few arrays of fixed size."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), float(self.values[0]))
        raw = features(stats, self.centre, self.scale) @ self.weights / UNIT
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def _waves() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    return draw.normal(0, 1 / WIDTH, (_STATS, FEATURES)), draw.uniform(0, 2 * math.pi, FEATURES)


def features(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Whole numbers up to ``UNIT``: the cosines, and a constant."""
    slopes, phases = _waves()
    x = np.clip((stats - centre) / scale, -5, 5)
    return np.hstack([np.rint(UNIT * np.cos(x @ slopes + phases)), np.full((len(x), 1), UNIT)])


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def isotonic(x: np.ndarray, rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest rising rates."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight):
        pools.append([r, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            r2, w2, n2 = pools.pop()
            r1, w1, n1 = pools.pop()
            pools.append([(r1 * w1 + r2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, r) for r, _, n in pools])


def _solve(gram: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the features from the summed equations, whose last row and column hold the label."""
    a, b = gram[:-1, :-1] / UNIT**2, gram[:-1, -1] / UNIT
    n = max(1.0, a[-1, -1])
    penalty = np.full(len(a), ridge * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(penalty), b)


def _error(gram: np.ndarray, w: np.ndarray) -> float:
    a, b = gram[:-1, :-1] / UNIT**2, gram[:-1, -1] / UNIT
    return float(w @ a @ w - 2 * w @ b + gram[-1, -1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    marks = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(sized(marks, 24), "_id").select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in b["text"]], "y": b["y"], "fold": b["fold"]})

    measured = table(rows.mapInPandas(measure, "x array<double>, y double, fold long"), "stats")
    add = lambda a, b: a + b

    def gathered(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = list(part)
        return np.array([r.x for r in part]).reshape(-1, _STATS), np.array([r.y for r in part]), np.array([r.fold for r in part])

    def moments(part) -> Iterator[np.ndarray]:
        x, y, _ = gathered(part)
        yield np.vstack([np.full(_STATS, len(x)), np.full(_STATS, y.sum()), x.sum(0), (x**2).sum(0)])

    n, positive, first, second = measured.rdd.mapPartitions(moments).treeReduce(add)
    if not 0 < positive[0] < n[0]:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.array([positive[0] / n[0] if n[0] else 0.5]))
    centre = np.round(first / n, 4)
    scale = np.maximum(np.round(np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)), 4), 1e-3)

    def equations(part) -> Iterator[np.ndarray]:
        x, y, fold = gathered(part)
        out = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        rows = np.hstack([features(x, centre, scale), y[:, None]])
        for f in range(FOLDS):
            here = rows[fold == f]
            out[f] = here.T @ here
        yield out.astype(np.int64)

    grams = measured.rdd.mapPartitions(equations).treeReduce(add)
    whole = grams.sum(0)
    ridge = min(RIDGES, key=lambda r: sum(_error(g, _solve(whole - g, r)) for g in grams))
    unseen = np.array([_solve(whole - g, ridge) for g in grams])

    def bins(part) -> Iterator[np.ndarray]:
        x, y, fold = gathered(part)
        raw = (features(x, centre, scale) * unseen[fold.astype(int)]).sum(1) / UNIT if len(x) else np.zeros(0)
        at = np.clip(np.rint((raw + 0.5) * _BINS / 2), 0, _BINS).astype(int)
        yield np.array([np.bincount(at, minlength=_BINS + 1), np.bincount(at, y, _BINS + 1)])

    total, ones = measured.rdd.mapPartitions(bins).treeReduce(add)
    used = np.flatnonzero(total)
    knots = used * 2 / _BINS - 0.5
    return Model(centre, scale, _solve(whole, ridge), knots, isotonic(knots, ones[used] / total[used], total[used]))


def score(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(np.array([statistics(t) for t in batch]).reshape(-1, _STATS)))

    return judge(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels, key, text, label)
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), score(model, text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
