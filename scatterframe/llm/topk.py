"""Exact top-k search by inner product: branch and bound over blocks of dimensions.

Queries and candidates are dealt in blocks, and each pair of blocks is one
task's tile.  In a tile vectors stand column by column.  Candidates come by
falling norm; scores grow block of dimensions by block, and after each block a
pair goes on only if its sum plus the largest product of the remaining masses
can still reach the query's k-th best score.  Once few pairs are left, they are
compacted into a list.  The best of all tiles are ranked at the end.

Defined results: components become ``floor(scale * x)`` with x as double.
Vectors that are null or hold a null, NaN or infinite component, and rows
without an id, take no part.  Rows repeated with id and vector count once; a
query never meets candidates of its own id.  Vectors of unequal length are
compared over their common components; an empty vector scores 0.  Equal scores
go to the smaller id.  A table without queries gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Components of the candidates of a tile that holds several blocks, at most.
COMPONENTS = 1 << 21
DIMENSIONS = 16
STEP = 1024
#: Share of pairs alive below which they are compacted.
DENSE = 0.25
#: Sums below these are exact as 32-bit and as 64-bit floats.
_EXACT_32, _EXACT = 1 << 24, 1 << 53


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    n = vectors.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = vectors.flatten().to_numpy()
    return out


def _tail_norms(m: np.ndarray, starts: range) -> np.ndarray:
    """Euclidean norms of what is left from each start on, and 0 at the end."""
    square = m.astype(np.float64) ** 2
    return np.sqrt(np.array([square[:, s:].sum(1) for s in starts] + [np.zeros(len(m))]))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> Best:
    """The k best candidates of each query by integer inner product."""
    best = Best(len(query_ids), k)
    width = queries.shape[1]
    top = lambda m: int(max(m.max(initial=0), -m.min(initial=0)))
    bound = width * top(queries) * top(candidates)
    kind = np.float32 if bound < _EXACT_32 else np.float64 if bound < _EXACT else np.int64
    real = np.float32 if kind == np.float32 else np.float64
    slack = 1e-6 if real == np.float32 else 1e-9
    least = np.iinfo(np.int64).min if kind == np.int64 else -np.inf
    mass = (queries.astype(np.float64) ** 2).sum(0) * (candidates.astype(np.float64) ** 2).sum(0)
    by_mass = np.argsort(-mass, kind="stable")
    order = np.argsort(-(candidates.astype(np.float64) ** 2).sum(1), kind="stable")
    ids, candidates = ids[order], candidates[order][:, by_mass].astype(kind)
    queries = queries[:, by_mass].astype(kind)
    starts = range(0, width, DIMENSIONS)
    q_tail, c_tail = _tail_norms(queries, starts).astype(real), _tail_norms(candidates, starts).astype(real)
    columns = np.ascontiguousarray(candidates.T)
    for at in range(0, len(ids), STEP):
        here = slice(at, at + STEP)
        own = np.nonzero(query_ids[:, None] == ids[None, here])
        scores, pairs = np.zeros((len(queries), len(ids[here])), kind), None
        for b, s in enumerate(starts):
            dims = slice(s, s + DIMENSIONS)
            if pairs is None:
                scores += queries[:, dims] @ columns[dims, here]
                reach = np.outer(q_tail[b + 1], c_tail[b + 1][here])
                reach += np.outer(slack * q_tail[0], c_tail[0][here])
                reach += scores
                alive = reach >= best.floor[:, None].astype(real)
                alive[own] = False
                if s + DIMENSIONS >= width:
                    _keep_best(alive, scores, k, least)
                if s + DIMENSIONS >= width or alive.mean() < DENSE:
                    pairs = np.nonzero(alive)
                    left = scores[pairs]
            else:
                q, c = pairs
                left = left + (queries[q, dims] * candidates[at + c, dims]).sum(1)
                go = left + (1 + slack) * q_tail[b + 1][q] * c_tail[b + 1][at + c] + slack * np.abs(left) >= best.floor[q]
                pairs, left = (q[go], c[go]), left[go]
        if pairs is None:  # no dimensions at all
            alive = np.ones(scores.shape, bool)
            alive[own] = False
            pairs = np.nonzero(alive)
            left = scores[pairs]
        best.add(pairs[0], left.astype(np.int64), ids[at + pairs[1]])
    return best


def _keep_best(alive: np.ndarray, scores: np.ndarray, k: int, least: float) -> None:
    """Of each row's whole scores, leave only those alive that reach the k-th best."""
    if scores.shape[1] > k:
        reached = np.where(alive, scores, np.asarray(least, scores.dtype))
        alive &= scores >= np.partition(reached, -k, axis=1)[:, -k, None]


def top_k(vectors: DataFrame, queries: Column, k: int, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every row for which ``queries`` holds."""
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("v"))
    rows = rows.where("v is not null").dropDuplicates(["id", "v"])
    counts = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("v"))).first()
    across, down = -(-counts[0] // CANDIDATE_BLOCK) or 1, -(-counts[1] // QUERY_BLOCK) or 1
    # beyond one tile for each task, tiles take several blocks of candidates, so that fewer rows are ranked
    together = min(COMPONENTS // (CANDIDATE_BLOCK * (counts[2] or 1)), across * down // tasks(vectors.sparkSession))
    across = -(-across // max(1, together))
    h = F.xxhash64("id")
    as_candidate = rows.select("id", "v", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), F.pmod(h, F.lit(across)).cast("int").alias("j"))
    as_query = rows.where("is_query").select("id", "v", F.lit(True).alias("asks"), F.pmod(h, F.lit(down)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))

    def tile(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asks, ids, found = block["asks"].to_numpy(), block["id"].to_numpy(), block["v"].combine_chunks()
        v = _matrix(found, found.value_lengths().to_numpy().max(initial=0))
        best = search(ids[asks], v[asks], ids[~asks], v[~asks], k)
        return pa.table({"query_id": ids[asks][best.query], "vec_id": best.id, "score": best.score})

    tiles = as_candidate.union(as_query.select(as_candidate.columns)).repartition(max(across * down, tasks(vectors.sparkSession)), "i", "j")
    found = tiles.groupBy("i", "j").applyInArrow(tile, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.repartition("query_id").distinct().select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
