"""Hard negatives by inner product, filtered by rotated one-bit codes.

Vectors become whole numbers.  A candidate is stored with the signs of its
coordinates under a few fixed random rotations, the length of the code vector
``z`` that these signs stand for, its own alignment with it, and the length of
what the code leaves over.  An anchor is rotated once and cut into a few bit
planes; popcounts of planes and codes give its product with ``z``, up to the
known rounding of the planes.  By Cauchy-Schwarz the rest of the score is at
most the product of both residuals, so each pair has an interval that is
certain to hold its score.  Pairs whose interval cannot matter are dropped, the
others are scored in whole numbers.

The first pass finds each anchor's best rows of its own label, the second for
each of these the best rows of other labels within a band of its score.
Anchors and candidates are dealt in blocks; a pair of blocks is a task's tile.

Defined results: rows without an id or a label, and vectors that are null or
hold a null, NaN or infinite component, take no part.  Rows repeated with id,
label and vector count once; rows that share an id but not the rest are
anchors of their own, and no row meets candidates of its own id.  Labels are
compared as text.  Shorter vectors are padded with 0; an empty vector scores 0.
Components beyond ``sqrt((2**63 - 1) / width)`` saturate there, so that scores
fit.  Ties go to the smaller id.  Without anchors, positives or rows in the
band there are no rows.  Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

ANCHOR_BLOCK = 1024
CANDIDATE_BLOCK = 16384
#: Candidates of a tile that are compared at once, and pairs that are scored at once.
STEP, PAIRS = 512, 1 << 16
#: Rotations whose signs make a code, bit planes of an anchor, seed of the rotations.
TURNS, PLANES, SEED = 4, 6, 20
_SLACK = 1e-9
_LEAST, _MOST = -(2**63), 2**63 - 1


@lru_cache(maxsize=2)
def rotations(width: int, turns: int = TURNS, seed: int = SEED) -> np.ndarray:
    """``turns`` orthogonal matrices, one below the other."""
    draw = np.random.default_rng(seed)
    return np.vstack([np.linalg.qr(draw.normal(size=(width, width)))[0] for _ in range(turns)])


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    whole = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), bool)
    whole[..., : bits.shape[-1]] = bits
    return np.packbits(whole, -1).view(np.uint64)


class Codes:
    """Codes of candidates with what their intervals need."""

    def __init__(self, bits, length, along, rest):
        self.bits, self.length, self.along, self.rest = bits, length, along, rest

    @classmethod
    def of(cls, m: np.ndarray) -> Codes:
        turn, x = rotations(m.shape[1]), m.astype(np.float64)
        bits = x @ turn.T >= 0
        z = np.where(bits, 1.0, -1.0) @ turn
        length = np.sqrt((z * z).sum(1))
        unit = np.divide(z, length[:, None], out=np.zeros_like(z), where=length[:, None] > 0)
        along = (x * unit).sum(1)
        return cls(_packed(bits), length, along, np.sqrt(((x - along[:, None] * unit) ** 2).sum(1)))

    def part(self, here) -> Codes:
        return Codes(self.bits[here], self.length[here], self.along[here], self.rest[here])


class Anchors:
    """Bit planes of rotated anchors, their step, offset and rounding."""

    def __init__(self, m: np.ndarray):
        y = m.astype(np.float64) @ rotations(m.shape[1]).T
        low, high = y.min(1, initial=0), y.max(1, initial=0)
        self.low, self.step = low, (high - low) / ((1 << PLANES) - 1)
        level = np.rint(np.divide(y - low[:, None], self.step[:, None], out=np.zeros_like(y), where=self.step[:, None] > 0)).astype(np.int64)
        self.off = np.abs(y - low[:, None] - self.step[:, None] * level).sum(1)
        self.planes = [_packed(level >> b & 1 > 0) for b in range(PLANES)]
        self.total, self.bits = level.sum(1), y.shape[1]
        self.square = (m.astype(np.float64) ** 2).sum(1)

    def bounds(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each pair can have."""
        shape = (len(self.low), len(codes.length))
        hits = np.zeros(shape, np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(plane.shape[1]):
                hits += np.bitwise_count(plane[:, w, None] & codes.bits[None, :, w]).astype(np.int64) << b
        ones = np.bitwise_count(codes.bits).sum(1, dtype=np.int64)
        product = self.low[:, None] * (2 * ones - self.bits)[None] + self.step[:, None] * (2 * hits - self.total[:, None])
        inverse = np.divide(1.0, codes.length, out=np.zeros(shape[1]), where=codes.length > 0)
        along, off = product * inverse, self.off[:, None] * inverse
        left = np.sqrt(np.maximum(self.square[:, None] - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        norms = np.sqrt(self.square)[:, None] * np.sqrt(codes.along**2 + codes.rest**2)
        middle, half = codes.along * along, np.abs(codes.along) * off + codes.rest * left + _SLACK * norms + _SLACK
        return middle - half, middle + half


class Best:
    """The first ``k`` (score, id) of each of ``n`` lists, and the score that a list no longer looks below."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.list, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -np.inf)

    def add(self, list_: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        list_, score, ids = (np.concatenate(x) for x in ((self.list, list_), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, list_))
        list_, score, ids = list_[order], score[order], ids[order]
        rank = np.arange(len(list_)) - np.searchsorted(list_, np.arange(self.n))[list_]
        last = rank == self.k - 1
        self.floor[list_[last]] = np.maximum(self.floor[list_[last]], score[last])
        keep = rank < self.k
        self.list, self.score, self.id = list_[keep], score[keep], ids[keep]

    def sure(self, low: np.ndarray) -> None:
        """Raise floors to the k-th greatest of scores that are certain to be reached."""
        if low.shape[1] >= self.k:
            self.floor = np.maximum(self.floor, np.partition(low, -self.k, axis=1)[:, -self.k])


def _scores(a: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), PAIRS):
        at = slice(s, s + PAIRS)
        out[at] = np.einsum("ij,ij->i", a[i[at]], c[j[at]])
    return out


def search(anchor_ids, anchors, ids, vectors, codes: Codes, allowed, k: int, least=None, most=None) -> list[Best]:
    """For each column of ``least`` and ``most`` the k best allowed candidates of each anchor with a score between them.

    ``allowed(step)`` tells for all anchors and the candidates of a slice whether a pair counts.
    """
    if least is None:
        least, most = np.full((len(anchors), 1), _LEAST), np.full((len(anchors), 1), _MOST)
    planes = Anchors(anchors)
    best = [Best(len(anchors), k) for _ in range(least.shape[1])]
    for s in range(0, len(ids), STEP):
        here = slice(s, s + STEP)
        counts = allowed(here) & (anchor_ids[:, None] != ids[None, here])
        low, high = planes.bounds(codes.part(here))
        low[~counts], high[~counts] = -np.inf, -np.inf
        alive = np.zeros(counts.shape, bool)
        for b, lo, hi in zip(best, least.T, most.T):
            b.sure(np.where((low >= lo[:, None]) & (high <= hi[:, None]), low, -np.inf))
            alive |= (high >= np.maximum(lo, b.floor)[:, None]) & (low <= hi[:, None])
        i, j = np.nonzero(alive & counts)
        score = _scores(anchors, vectors, i, s + j)
        for b, lo, hi in zip(best, least.T, most.T):
            good = (score >= lo[i]) & (score <= hi[i]) & (score >= b.floor[i])
            b.add(i[good], score[good], ids[s + j[good]])
    return best


def _matrix(cells, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i8").reshape(-1, width)


def coded(vectors: DataFrame, anchors: Column, scale: int, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """Written rows (id, label, row, asks, v, code) with vectors as bytes of whole numbers, and the width of the vectors."""
    good = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").dropDuplicates(["id", "label", "v"])
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    top = isqrt((2**63 - 1) // width)
    rows = rows.withColumn("row", F.md5(F.concat_ws(",", "label", F.col("v").cast("string"))))

    def encode(batches):
        for batch in batches:
            m = np.zeros((batch.num_rows, width), np.int64)
            for i, v in enumerate(batch.column("v")):
                m[i, : len(v)] = np.clip(v.values.to_numpy(zero_copy_only=False), -top, top)
            c = Codes.of(m)
            code = np.hstack([c.bits.view(np.uint8), *(np.ascontiguousarray(x[:, None]).view(np.uint8) for x in (c.length, c.along, c.rest))])
            cells = [[bytes(x) for x in y] for y in (m.astype("<i8").view(np.uint8), code)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "label", "row", "asks")), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())], names=["id", "label", "row", "asks", "v", "code"])

    return table(rows.mapInArrow(encode, "id long, label string, row string, asks boolean, v binary, code binary"), "codes"), width


def _decoded(cells, width: int) -> Codes:
    m = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
    numbers = np.ascontiguousarray(m[:, -24:]).view(np.float64)
    return Codes(np.ascontiguousarray(m[:, :-24]).view(np.uint64), *numbers.T)


def _tiles(rows: DataFrame, asking: DataFrame, width: int, k: int, same: bool, schema: str) -> DataFrame:
    """Search every pair of an anchor block and a candidate block.

    ``asking`` has id, label, row, v and ``bands``, the (of, least, most) of its
    lists.  The best ``k`` of each list come back as (anchor, row, of, id, score).
    """
    n, m = rows.count(), asking.count()
    across, down = -(-n // CANDIDATE_BLOCK) or 1, -(-m // ANCHOR_BLOCK) or 1
    h, every = F.xxhash64("id", "row"), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = F.lit(None)
    here = rows.select("id", "label", none.cast("string").alias("row"), "v", "code", none.cast(asking.schema["bands"].dataType).alias("bands"), every(down).alias("i"), F.pmod(h, F.lit(across)).cast("int").alias("j"))
    asks = asking.select("id", "label", "row", "v", none.cast("binary").alias("code"), "bands", F.pmod(h, F.lit(down)).cast("int").alias("i"), every(across).alias("j"))

    def tile(block: pd.DataFrame) -> pd.DataFrame:
        asked, others = block[block["code"].isna()], block[block["code"].notna()]
        if not len(asked) or not len(others):
            return pd.DataFrame({c: np.empty(0, object if c == "row" else np.int64) for c in ("anchor", "row", "of", "id", "score")})
        names = {x: i for i, x in enumerate(sorted(set(block["label"])))}
        mine, theirs = (x["label"].map(names).to_numpy() for x in (asked, others))
        bands = [[(b["of"], b["least"], b["most"]) for b in x] for x in asked["bands"]]
        deep = max(map(len, bands))
        of, least, most = np.full((len(asked), deep), -1), np.full((len(asked), deep), _MOST), np.full((len(asked), deep), _LEAST)
        for r, x in enumerate(bands):
            for c, (o, lo, hi) in enumerate(x):
                of[r, c], least[r, c], most[r, c] = o, _LEAST if lo is None else lo, _MOST if hi is None else hi
        ids = asked["id"].to_numpy(np.int64)
        best = search(ids, _matrix(asked["v"], width), others["id"].to_numpy(np.int64), _matrix(others["v"], width), _decoded(others["code"].tolist(), width),
                      lambda step: (mine[:, None] == theirs[None, step]) == same, k, least, most)
        row = asked["row"].to_numpy()
        return pd.concat([pd.DataFrame({"anchor": ids[b.list], "row": row[b.list], "of": of[b.list, c], "id": b.id, "score": b.score}) for c, b in enumerate(best)])

    found = here.union(asks).groupBy("i", "j").applyInPandas(tile, schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "row", "of").orderBy(F.desc("score"), "id"))
    return found.select("*", rank.alias("rank")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95, scale: int = 256,
         key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives are the best rows of the anchor's label.  A negative has another
    label and a score from ``least_percent`` to ``most_percent`` of the positive's.
    """
    rows, width = coded(vectors, anchors, scale, key, vector, label)
    schema = "anchor long, row string, of long, id long, score long"
    asking = rows.where("asks").select("id", "label", "row", "v")
    free = asking.withColumn("bands", F.expr("array(struct(0L as of, cast(null as long) as least, cast(null as long) as most))"))
    chosen = table(_tiles(rows, free, width, positives, True, schema), "positives")
    # percentages of a score in whole numbers, split so that nothing overflows; upwards for the least, downwards for the most
    down = lambda p, s: f"({p} * ({s} div 100) + ({p} * ({s} % 100) - pmod({p} * ({s} % 100), 100)) div 100)"
    band = F.expr(f"struct(id as of, -{down(least_percent, '(-score)')} as least, {down(most_percent, 'score')} as most)")
    bands = chosen.groupBy(F.col("anchor").alias("id"), "row").agg(F.collect_list(band).alias("bands"))
    found = _tiles(rows, asking.join(bands, ["id", "row"]), width, negatives, False, schema).withColumnRenamed("id", "negative_id")
    scored = chosen.select("anchor", "row", F.col("id").alias("of"), F.col("score").alias("positive_score"))
    return found.join(scored, ["anchor", "row", "of"]).select(F.col("anchor").alias("anchor_id"), F.col("of").alias("positive_id"), "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
