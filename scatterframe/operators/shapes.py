"""Shape and parameter jobs: candidate searches over many frame lengths at once.

The functions at the top give the parameters of one length as plain integers
(a few divisions); the jobs below do the same for a table of lengths.
"""

from __future__ import annotations

from functools import partial
from itertools import count, takewhile
from math import ceil, floor, gcd, isqrt, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import attach, settle, spread
from ..functions.numeric import as_col, big, idiv, modpow
from ..functions.numeric import gcd as gcd_col

GOLDEN = (1 + sqrt(5)) / 2


def largest_divisor(n: int, least: int = 2) -> int:
    """Largest divisor of n that is at most sqrt(n) and at least ``least``; 1 if none."""
    return next((a for a in range(isqrt(n), least - 1, -1) if n % a == 0), 1)


def first_splittable(n: int, extend: float, least: int = 2) -> tuple[int, int]:
    """First length from n up whose largest divisor reaches ``least``: (divisor, cofactor)."""
    for m in range(n, floor(n * (1 + extend)) + 1):
        a = largest_divisor(m, least)
        if a >= least:
            return a, m // a
    raise ValueError(f"no split of {n} within {extend:.0%}")


def coprime_stride(n: int, fallback: int = 2) -> int:
    return next((c for c in range(2, n) if gcd(c, n) == 1), fallback)


def balanced_pair(n: int, extend: float) -> tuple[int, int]:
    """Coprime L <= K with L*K in [n, n(1+extend)]; see ``balanced_shapes`` for the order."""
    ranked = []
    for m in range(n, floor(n * (1 + extend)) + 1):
        root, reach = sqrt(m), min(20, isqrt(m) // 2)
        for a in range(max(2, floor(root) - reach), ceil(root) + reach + 1):
            b = m // a
            if m % a == 0 and b >= 2 and gcd(a, b) == 1:
                lo, hi = sorted((a, b))
                stops = hi - lo < 2 and m - n < 0.1 * n
                ranked.append((hi - lo + 0.1 * (m - n), m, a, lo, hi, stops))
                if stops:
                    best = min(ranked)
                    return best[3], best[4]
    if ranked:
        best = min(ranked)
        return best[3], best[4]
    return _far_pair(n, floor(n * (1 + extend)))


def _far_pair(n: int, most: int) -> tuple[int, int]:
    """Where no near-square rectangle fits: the best coprime sides at all, else neighbours, else two columns."""
    pairs = [(m // a - a + 0.1 * (m - n), m, a) for m in range(n, most + 1) for a in range(2, isqrt(m) + 1) if m % a == 0 and gcd(a, m // a) == 1]
    if pairs:
        _, m, a = min(pairs)
        return a, m // a
    r = floor(sqrt(n) + 0.5)
    if r >= 2 and r * (r + 1) <= most:
        return r, r + 1
    return 2, max(3, -(-n // 2) | 1)


def prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        while n % d == 0:
            out.append(d)
            n //= d
        d += 1
    return out + ([n] if n > 1 else [])


def _products(m: int, k: int, least: int = 2) -> list[tuple[int, ...]]:
    """All ways to write m as k rising factors of at least ``least``."""
    if k == 1:
        return [(m,)] if m >= least else []
    return [(a, *rest) for a in takewhile(lambda a: a**k <= m, count(least)) if m % a == 0 for rest in _products(m // a, k - 1, a)]


def balanced_dims(n: int, k: int, extend: float) -> list[int]:
    """k sides for the first length from n up that has k factors.

    A box of given volume is the nearer to a cube the smaller the sum of its
    sides; of equal sums the one with the smaller longest side is taken.
    """
    for m in range(n, floor(n * (1 + extend)) + 1):
        if boxes := _products(m, k):
            return list(min(boxes, key=lambda s: (sum(s), s[-1])))
    raise ValueError(f"no {k}-way split of {n} within {extend:.0%}")


def golden_stride_of(n: int) -> int:
    target = floor(n / GOLDEN + 0.5)
    return min((p for p in range(1, n) if gcd(p, n) == 1), key=lambda p: (abs(p - target), p), default=1)


def next_prime_root(n: int) -> tuple[int, int]:
    """Smallest prime p >= n+1 and its smallest primitive root."""
    p = n + 1
    while len(prime_factors(p)) != 1:
        p += 1
    qs = set(prime_factors(p - 1))
    return p, next(g for g in range(1, p) if all(pow(g, (p - 1) // q, p) != 1 for q in qs) or p == 2)


# --- jobs over tables of lengths ------------------------------------------

#: Numbers of one segment of the sieve.
SEGMENT = 1 << 20


def smallest_factors(top: int, spark, segment: int = SEGMENT) -> DataFrame:
    """(n, spf) for 2 <= n <= top: the smallest prime factor of each number, by a segmented sieve.

    The primes up to the square root of ``top``, few beside ``top``, come from
    the same sieve.  Each row of the first step is one segment; it crosses out
    the multiples of one prime at a time, from its square on.
    """
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("spf", T.LongType())])
    segments = max(1, -(-(top + 1) // segment))
    starts = spark.range(segments, numPartitions=min(segments, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return starts.mapInPandas(partial(_sieved, top=top, segment=segment), schema)


def _sieved(batches, top: int, segment: int):
    base = _base_primes(isqrt(top))
    for batch in batches:
        for s in batch["id"]:
            lo, hi = max(2, s * segment), min(top + 1, (s + 1) * segment)
            spf = np.arange(lo, hi)
            for p in base[base * base < hi][::-1]:  # the smallest comes last and stays
                first = max(p * p, -(-lo // p) * p)
                spf[first - lo :: p] = p
            yield pd.DataFrame({"n": np.arange(lo, hi), "spf": spf})


def _base_primes(top: int) -> np.ndarray:
    keep = np.ones(top + 1, bool)
    keep[:2] = False
    for i in range(2, isqrt(top) + 1):
        if keep[i]:
            keep[i * i :: i] = False
    return np.flatnonzero(keep)


def primes(numbers: DataFrame, col: str = "n") -> DataFrame:
    """The rows of a number table that are prime: met by the sieve as their own smallest factor."""
    top = numbers.agg(F.max(col)).first()[0] or 0
    if top < 2:
        return numbers.limit(0)
    found = smallest_factors(int(top), numbers.sparkSession).where(F.col("n") == F.col("spf")).select(F.col("n").alias("_p"))
    return numbers.join(found, numbers[col] == F.col("_p"), "left_semi")


def factor_pairs(numbers: DataFrame, col: str = "n") -> DataFrame:
    """(n, a, b) with a*b = n and 2 <= a <= b.

    Every factor up to the square root of the largest number is written against
    its multiples from its square on, so all pairs of all numbers come without a
    division; they meet the table on n.
    """
    top = numbers.agg(F.max(col)).first()[0] or 0
    if top < 4:
        return numbers.where(F.lit(False)).select(F.col(col).alias("n"), big(F.lit(2)).alias("a"), big(F.lit(2)).alias("b"))
    sides = numbers.sparkSession.range(2, isqrt(int(top)) + 1).select(F.col("id").alias("a"))
    # a factor has top/a multiples: long rows of them are cut into even stretches
    width = F.lit(SEGMENT).cast("long")
    cut = sides.withColumn("_from", F.explode(F.sequence(F.col("a"), F.floor(F.lit(int(top)) / F.col("a")).cast("long"), width)))
    last = F.least(F.col("_from") + width - 1, F.floor(F.lit(int(top)) / F.col("a")).cast("long"))
    pairs = spread(cut, "a", "_from").select("a", F.explode(F.sequence("_from", last)).alias("b"))
    pairs = pairs.select((F.col("a") * F.col("b")).alias("_n"), "a", "b")
    return numbers.join(pairs, numbers[col] == F.col("_n")).select(F.col(col).alias("n"), "a", "b")


def best_pairs(pairs: DataFrame, min_factor: int = 2) -> DataFrame:
    """Per n the min-sum and the min-factor pair; the floor on factors relaxes until some pair fits."""
    w = Window.partitionBy("n")
    reach = F.least(F.lit(min_factor), F.max("a").over(w))
    ok = pairs.withColumn("floor_used", reach).where(F.col("a") >= F.col("floor_used"))
    pick = lambda key: F.min_by(F.struct("a", "b"), key)
    return ok.groupBy("n").agg(
        F.count("*").alias("n_pairs"), F.max("floor_used").alias("floor_used"),
        pick(F.col("a") + F.col("b")).alias("s"), pick(F.col("a")).alias("f"),
    ).select(
        "n", "n_pairs", "floor_used", F.col("s.a").alias("sum_a"), F.col("s.b").alias("sum_b"),
        F.col("f.a").alias("fac_a"), F.col("f.b").alias("fac_b"),
    )


def balanced_shapes(lengths: DataFrame, extend: float) -> DataFrame:
    """Coprime rectangle per length.

    Candidates run by padded length m and then by trial divisor a near sqrt(m).
    The first one that is nearly square (sides differ by less than 2, padding
    under a tenth) ends the search; among the candidates seen by then the
    smallest |L-K| + 0.1*padding wins, the earliest on ties.  A length without
    one takes the best coprime sides at all, else neighbouring sides, else two
    columns.
    """
    n, m, a = F.col("n"), F.col("m"), F.col("a")
    root = F.sqrt(m)
    reach = F.least(F.lit(20), F.floor(root / 2))
    padded = lengths.select(big("n").alias("n")).distinct().withColumn(
        "m", F.explode(F.sequence(n, F.floor(n * (1 + extend)).cast("bigint"))))
    cand = (
        spread(padded, "n", "m")
        .withColumn("a", F.explode(F.sequence(F.greatest(F.lit(2), F.floor(root) - reach).cast("bigint"),
                                              (F.ceil(root) + reach).cast("bigint"))))
        .where((m % a == 0) & (m >= 2 * a))
        .withColumn("b", idiv(m, a)).where(gcd_col(a, F.col("b")) == 1)
        .select("n", "m", "a", F.least("a", "b").alias("l"), F.greatest("a", "b").alias("k"))
        .withColumn("score", F.round(F.col("k") - F.col("l") + (m - n) * 0.1, 6))
        .withColumn("stops", (F.col("k") - F.col("l") < 2) & (m - n < n * 0.1))
    )
    first_stop = F.min(F.when(F.col("stops"), m * 1000000 + a)).over(Window.partitionBy("n"))
    seen = cand.withColumn("end", first_stop).where(F.col("end").isNull() | (m * 1000000 + a <= F.col("end")))
    near = seen.groupBy("n").agg(F.min_by(F.struct("l", "k", "m"), F.struct("score", "m", "a")).alias("s"))
    rest = padded.join(near, "n", "left_anti")
    side = F.sequence(F.lit(2).cast("bigint"), F.greatest(F.lit(2), F.floor(root)).cast("bigint"))
    far = rest.withColumn("a", F.explode(side)).withColumn("b", idiv(m, a))
    fits = (m % a == 0) & (a < F.col("b")) & (gcd_col(a, F.col("b")) == 1)
    far = far.groupBy("n").agg(F.max("m").alias("most"), F.min_by(
        F.when(fits, F.struct(a.alias("l"), F.col("b").alias("k"), "m")),
        F.when(fits, F.struct(F.round(F.col("b") - a + (m - n) * 0.1, 6), m, a))).alias("s"))
    r = F.floor(F.sqrt(n) + 0.5).cast("bigint")
    wide = F.greatest(F.lit(3).cast("bigint"), F.ceil(n / 2).cast("bigint").bitwiseOR(F.lit(1).cast("bigint")))
    near_square = F.when((r >= 2) & (r * (r + 1) <= F.col("most")), F.struct(r.alias("l"), (r + 1).alias("k"), (r * (r + 1)).alias("m")))
    far = far.select("n", F.coalesce("s", near_square, F.struct(F.lit(2).cast("bigint").alias("l"), wide.alias("k"), (2 * wide).alias("m"))).alias("s"))
    return near.union(far).select("n", F.col("s.l").alias("l"), F.col("s.k").alias("k"), (F.col("s.m") - n).alias("pad"))


def golden_strides(lengths: DataFrame) -> DataFrame:
    """Nearest coprime to n/phi, the lower on ties.

    64 numbers either way always contain one: the longest run without a number
    coprime to n is shorter for every n below 7e12.
    """
    n, p = F.col("n"), F.col("p")
    target = F.floor(n / F.lit(GOLDEN) + 0.5).cast("bigint")
    near = F.sequence(F.greatest(F.lit(1).cast("bigint"), target - 64), F.least(n - 1, target + 64))
    return (
        lengths.select(big("n").alias("n")).distinct().where(n >= 3).withColumn("p", F.explode(near))
        .where(gcd_col(p, n) == 1)
        .groupBy("n").agg(F.min_by(p, F.struct(F.abs(p - target), p)).alias("stride"))
    )


def primitive_roots(prime_table: DataFrame, tries: int = 16) -> DataFrame:
    """Smallest g with g^((p-1)/q) != 1 mod p for every prime q dividing p-1.

    Each of the first ``tries`` candidates is tried only if none before it is a
    root, and so is each stretch of later ones, as long as all before it.
    """
    p = F.col("p")
    d = F.sequence(F.lit(2).cast("bigint"), F.greatest(F.lit(2), F.floor(F.sqrt(p - 1))).cast("bigint"))
    qs = (
        prime_table.select(big("p").alias("p")).distinct().where(p > 2)
        .withColumn("d", F.explode(d)).where((p - 1) % F.col("d") == 0)
        .select("p", F.explode(F.array(F.col("d"), idiv(p - 1, F.col("d")))).alias("n")).distinct()
    )
    qs = primes(qs).groupBy("p").agg(F.sort_array(F.collect_list("n")).alias("qs"))
    only_two = prime_table.select(big("p").alias("p")).distinct().where(p == 3).select("p", F.array(F.lit(2).cast("bigint")).alias("qs"))
    qs = qs.where(p > 3).unionByName(only_two)

    def is_root(c):
        return F.forall("qs", lambda q: modpow(c, idiv(p - 1, q), p) != 1)

    def stretch(low, high):
        return F.when(p > low, F.get(F.filter(F.sequence(F.lit(low).cast("bigint"), F.least(p - 1, F.lit(high).cast("bigint"))), is_root), F.lit(0)))

    head = [F.when((p > g) & is_root(F.lit(g)), F.lit(g).cast("bigint")) for g in range(2, tries + 2)]
    starts = [tries + 2]
    while starts[-1] < 1 << 31:  # the bound of modpow
        starts.append(2 * starts[-1])
    tail = [stretch(low, high - 1) for low, high in zip(starts, starts[1:])]
    return spread(qs, "p").select("p", F.coalesce(*head, *tail).alias("root"))


def all_lags(n: Column) -> Column:
    """Lags beyond which lag + distance cannot be the least: some lag up to sqrt(n) has a distance below 2 sqrt(n)."""
    return F.sequence(F.lit(1), F.least((n - 1).cast("int"), (F.ceil(2 * F.sqrt(n - 1.0)) + 1).cast("int")))


#: Lags that rank all candidates of a search before the others are looked at.
FIRST_LAGS = 4


def _best_candidate(cand: DataFrame, by: list[str], choice: list[str], at_lag) -> DataFrame:
    """Per key the candidate with the greatest least score over all lags, the first in ``choice`` order on ties.

    Branch and bound: the shortest lags give every candidate an upper bound.  The
    best by that bound is scored over all lags, and only candidates whose bound
    reaches its score are scored further.
    """
    n = F.col("n")
    least = lambda lags: F.array_min(F.transform(lags, at_lag)).cast("bigint")
    order = [-F.col(c) for c in choice]
    bounded = settle(cand.withColumn("bound", least(F.slice(all_lags(n), 1, FIRST_LAGS))))
    lead = bounded.groupBy(*by).agg(F.max_by(F.struct(*choice), F.struct("bound", *order)).alias("c"), F.count("*").alias("tried"))
    reached = lead.select(*by, "tried", "c.*").withColumn("reached", least(all_lags(n))).select(*by, "tried", "reached")
    left = attach(bounded, reached, by).where(F.col("bound") >= F.col("reached"))
    scored = spread(left, *by, *choice).withColumn("score", least(all_lags(n)))
    return scored.groupBy(*by).agg(F.max_by(F.struct(*choice, "score"), F.struct("score", *order)).alias("c"), F.max("tried").alias("tried")).select(*by, "c.*", "tried")


def qpp_lag_score(n: Column, f1: Column, f2: Column, d: Column) -> Column:
    """lag + least cyclic distance of images ``d`` apart under f1*x + f2*x^2 mod n, f2 a multiple of the radical of n.

    The distances are f1*d + f2*d^2 + 2*f2*d*x mod n.  Over n/g values of x,
    g = gcd(2*f2*d, n), they take every residue that is congruent to the first
    modulo g; with fewer values, in short frames only, they are gone through.
    """
    first = (f1 * d + f2 * (d * d % n)) % n
    g = gcd_col(2 * f2 % n * d % n, n)
    g = F.when(g == 0, n).otherwise(g)
    cyclic = lambda v, m: F.least(v % m, m - v % m)
    walked = F.array_min(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1 - d), lambda x: cyclic(first + 2 * f2 % n * (d * x % n) % n, n)))
    return d + F.when((n - d) * g >= n, cyclic(first, g)).otherwise(walked)


def qpp_search(lengths: DataFrame) -> DataFrame:
    """Best quadratic map f1*x + f2*x^2 mod n by cyclic spread, one row per length.

    f1 is coprime to n and f2 a multiple of the radical of n, which makes every
    such map a bijection; ``tried`` is their number.  The first in (f1, f2)
    order wins ties.
    """
    n, f1, f2 = F.col("n"), F.col("f1"), F.col("f2")
    base = lengths.select(big("n").alias("n")).distinct()
    prime_divisors = primes(base.select(F.explode(F.sequence(F.lit(2).cast("bigint"), n)).alias("q")).distinct(), "q")
    rad = base.join(prime_divisors, n % F.col("q") == 0).groupBy("n").agg(F.aggregate(F.collect_list("q"), F.lit(1).cast("bigint"), lambda s, q: s * q).alias("rad"))
    firsts = rad.withColumn("f1", F.explode(F.sequence(F.lit(1).cast("bigint"), n - 1))).where(gcd_col(f1, n) == 1)
    cand = spread(firsts, "n", "f1").withColumn("f2", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.col("rad")))).select("n", "f1", "f2")
    best = _best_candidate(cand, ["n"], ["f1", "f2"], lambda d: qpp_lag_score(n, f1, f2, d.cast("bigint")))
    return best.select("n", "f1", "f2", F.col("score").alias("spread"), "tried")


def snew_array(p: Column, lags: Column) -> Column:
    """min over lags of lag + |p(i+lag) - p(i)|, for one permutation held as an array."""
    def at_lag(d):
        return d + F.array_min(F.zip_with(F.slice(p, F.lit(1), F.size(p) - d), F.slice(p, d + 1, F.size(p) - d),
                                          lambda u, v: F.abs(v - u)))

    return F.array_min(F.transform(lags, at_lag))


def dither_search(lengths: DataFrame) -> DataFrame:
    """Coordinate search of the dithered relative-prime map, all lengths side by side.

    Eight steps: stride, phase, read dither, write dither, twice over.  A step
    scores every candidate of one coordinate with the others held and replaces
    the incumbent only by a strictly better score, the first candidate on ties.
    Dithers are the affine maps k -> (a*k + b) mod M, held as the pair (a, b).
    """
    n = F.col("n")
    want = F.when(n <= 200, 4).when(n <= 1000, 8).otherwise(16)
    m = F.coalesce(*[F.when((want >= c) & (n % c == 0), F.lit(c)) for c in (16, 8, 4)])
    root = F.sqrt(n)
    lo = F.greatest(F.lit(2), F.floor(root / 2)).cast("bigint")
    hi = F.least(n - 2, F.ceil(4 * root)).cast("bigint")
    strides = F.filter(F.sequence(lo, hi), lambda c: gcd_col(c, n) == 1)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    now = (
        lengths.select(big("n").alias("n")).distinct().withColumn("m", m.cast("bigint")).where(F.col("m").isNotNull())
        .withColumn("strides", strides)
        .select("n", "m", "strides", F.element_at("strides", 1).alias("p"), zero.alias("s"),
                one.alias("ra"), zero.alias("rb"), one.alias("wa"), zero.alias("wb"), F.lit(-1).cast("bigint").alias("best"))
    )
    mm = F.col("m")
    units = F.filter(F.sequence(one, mm - 1), lambda a: gcd_col(a, mm) == 1)
    bank = F.flatten(F.transform(units, lambda a: F.transform(F.sequence(zero, mm - 1), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    coords = [
        (F.col("strides"), {"p": lambda c: c}),
        (F.sequence(zero, mm - 1), {"s": lambda c: c}),
        (bank, {"ra": lambda c: c["a"], "rb": lambda c: c["b"]}),
        (bank, {"wa": lambda c: c["a"], "wb": lambda c: c["b"]}),
    ]
    lags = all_lags(n)
    for _ in range(2):
        for cands, sets in coords:
            tried = spread(now.select("*", F.posexplode(cands).alias("i", "c")), "n", "i")
            for name, get in sets.items():
                tried = tried.withColumn(name, get(F.col("c")))

            def image(i):
                iw = mm * idiv(i, mm) + (F.col("wa") * (i % mm) + F.col("wb")) % mm
                ib = (F.col("s") + iw * F.col("p")) % n
                return mm * idiv(ib, mm) + (F.col("ra") * (ib % mm) + F.col("rb")) % mm

            tried = tried.withColumn("v", snew_array(F.transform(F.sequence(zero, n - 1), image), lags).cast("bigint"))
            win = tried.groupBy("n").agg(
                F.max_by(F.struct(F.col("v"), *sets), F.struct(F.col("v"), -F.col("i"))).alias("w"))
            better = F.col("w.v") > F.col("best")
            now = now.join(win, "n").select(
                "n", "m", "strides",
                *[F.when(better, F.col(f"w.{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
                  for c in ("p", "s", "ra", "rb", "wa", "wb")],
                F.greatest("best", "w.v").alias("best"),
            )
            now = settle(now)
    return now.drop("strides")


def arp_image(p0, p1, p2, p3, n, j) -> Column:
    """1-based source of slot j (0-based) under the 4-phase almost regular permutation."""
    phase = F.when(j % 4 == 0, F.lit(0)).when(j % 4 == 1, idiv(n, 2) + p1).when(j % 4 == 2, p2).otherwise(idiv(n, 2) + p3)
    return (p0 * j + phase + 1) % n + 1


def arp_strides(lengths: DataFrame) -> DataFrame:
    """(n, p0): the coprime of n nearest sqrt(2n), the lower on ties."""
    n, p = F.col("n"), F.col("p")
    d = lengths.select(big("n").alias("n")).distinct().withColumn("p", F.explode(F.sequence(F.lit(1).cast("bigint"), n - 1)))
    d = d.where(gcd_col(p, n) == 1)
    return d.groupBy("n").agg(F.min_by(p, F.struct(F.abs(p - F.sqrt(2.0 * n)), p)).alias("p0"))


def arp_lag_score(n: Column, p0: Column, phases: list[Column], d: Column) -> Column:
    """lag + least image difference of slots ``d`` apart under the 4-phase map.

    Slots of phase r differ by c = p0*d + phase(r+d) - phase(r) mod n, as c or,
    where the image wraps, as n - c.  The images of a phase are every fourth
    number, and at most d/4 + 1 of them have no partner; so from n = 48 on, where
    all lags stay below n/2 - 8, the smaller of the two always occurs.  Shorter
    frames are gone through slot by slot.
    """
    phase = lambda r: F.element_at(F.array(*phases), (r % 4 + 1).cast("int"))
    image = lambda j: (p0 * j + phase(j) + 1) % n
    gap = lambda r: (p0 * d + phase(F.lit(r) + d) - phases[r] + 2 * n) % n
    closed = F.least(*[F.least(gap(r), n - gap(r)) for r in range(4)])
    walked = F.array_min(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1 - d), lambda j: F.abs(image(j + d) - image(j))))
    return d + F.when(n >= 48, closed).otherwise(walked)


def arp_offset_search(lengths: DataFrame) -> DataFrame:
    """Best offsets of the 4-phase map over the whole admissible set, by S_min, smaller triples on ties.

    Admissible: P1 even, P2 a multiple of 4, P3 congruent to P1 modulo 4, n^3/32
    triples for a length that is a multiple of 4.  A triple is feasible if the
    four phases land on different residues modulo 4.  S_min is the least
    lag + |image difference|.
    """
    n, p0, p1, p2, p3 = (F.col(c) for c in ("n", "p0", "p1", "p2", "p3"))
    zero = F.lit(0).cast("bigint")
    steps = lambda lo, by: F.sequence(lo, n - 1, F.lit(by).cast("bigint"))
    phases = [zero, idiv(n, 2) + p1, p2, idiv(n, 2) + p3]
    firsts = arp_strides(lengths.where(n % 4 == 0)).withColumn("p1", F.explode(steps(zero, 2))).withColumn("p2", F.explode(steps(zero, 4)))
    cand = spread(firsts, "n", "p1", "p2").withColumn("p3", F.explode(steps(p1 % 4, 4)))
    lands = F.array(*[(p0 * r + phases[r]) % 4 for r in range(4)])
    cand = cand.where(F.size(F.array_distinct(lands)) == 4)
    best = _best_candidate(cand, ["n", "p0"], ["p1", "p2", "p3"], lambda d: arp_lag_score(n, p0, phases, d.cast("bigint")))
    return best.select("n", "p0", "p1", "p2", "p3", F.col("score").alias("s_min"), F.col("tried").alias("feasible"))
