"""Frame reordering: a permutation is a table (n_rows, pos, src).

Interleaved position ``pos`` carries source row ``src`` (both 1-based).  A rule
is a closed-form column expression in the 0-based position, or a sort key over
source cells.  The table of one frame length has as many rows as a frame, so it
is broadcast to the data; frames themselves never move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import gcd, isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import fits_broadcast, spread, union_all
from ..functions.numeric import big, hash32, idiv
from . import shapes as sh

# Published parameters (N, P0, P1, P2, P3) of the 4-phase almost
# regular permutation, by frame length.
ARP_TABLE = [
    (24, 5, 0, 0, 0),
    (36, 11, 18, 0, 18),
    (48, 13, 24, 0, 24),
    (72, 11, 6, 0, 6),
    (96, 7, 48, 24, 72),
    (108, 11, 54, 56, 2),
    (120, 13, 60, 0, 60),
    (144, 17, 74, 72, 2),
    (180, 11, 90, 0, 90),
    (192, 11, 96, 48, 144),
    (216, 13, 108, 0, 108),
    (240, 13, 120, 60, 180),
    (480, 53, 62, 12, 2),
    (960, 43, 64, 300, 824),
    (1440, 43, 720, 360, 540),
    (1920, 31, 8, 24, 16),
    (2400, 53, 66, 24, 2),
]


@dataclass
class Rule:
    """How to fill one frame length: ``src`` by formula, or cells sorted by ``order``."""

    n_out: int
    src: Callable[[Column], Column]
    order: Callable[[Column], list[Column]] | None = None
    keep: int | None = None
    params: dict[str, int] = field(default_factory=dict)


def _refuse(why: str):
    raise ValueError(why)


def _grid(n_out: int, src, **params) -> Rule:
    return Rule(n_out, src, params=params)


def block(n: int, width: int | None = None) -> Rule:
    w = width or (sh.largest_divisor(n) if sh.largest_divisor(n) > 1 else 2)
    r = -(-n // w)
    return _grid(r * w, lambda q: (q % r) * w + idiv(q, r) + 1, width=w, rows=r)


def block_matched(n: int, codeword: int = 15) -> Rule:
    return block(n, codeword)


def matrix(n: int, extend: float = 0.5) -> Rule:
    l, k = sh.balanced_pair(n, extend)
    return _grid(l * k, lambda q: (q % l) * k + idiv(q, l) + 1, l=l, k=k)


def snake(n: int) -> Rule:
    m = n if sh.largest_divisor(n) > 1 else n + 1
    k = sh.largest_divisor(m)
    l = m // k

    def src(q):
        row = idiv(q, l)
        col = F.when(row % 2 == 1, l - 1 - q % l).otherwise(q % l)
        return col * k + row + 1

    return _grid(m, src, l=l, k=k)


def helical(n: int, extend: float = 0.5) -> Rule:
    l, k = sh.balanced_pair(n, extend)
    return _grid(l * k, lambda q: ((idiv(q, l) + q % l) % k) * l + q % l + 1, l=l, k=k)


def helical_scan(n: int, extend: float = 0.5) -> Rule:
    root = max(1, isqrt(n))
    cap = -(-n * (100 + round(extend * 100)) // 100)
    tries = [*range(root, 0, -1), *range(root + 1, 2 * root + 1)]
    r = next(a for a in tries if a * -(-n // a) <= cap)
    c = -(-n // r)
    return _grid(r * c, lambda q: ((idiv(q, c) + q % c) % r) * c + q % c + 1, r=r, c=c)


def diagonal(n: int, extend: float = 0.5) -> Rule:
    r, c = sh.first_splittable(n, extend)
    return Rule(r * c, lambda q: q + 1, lambda q: [idiv(q, c) + q % c, q % c], params={"r": r, "c": c})


def spiral(n: int, extend: float = 0.5) -> Rule:
    l, k = sh.balanced_pair(n, extend)

    def order(q):
        r, c = q % l, idiv(q, l)
        ring = F.least(r, c, l - 1 - r, k - 1 - c)
        side = F.when(r == ring, 0).when(c == k - 1 - ring, 1).when(r == l - 1 - ring, 2).otherwise(3)
        along = F.when(side == 0, c).when(side == 1, r).when(side == 2, -c).otherwise(-r)
        return [ring, side, along]

    return Rule(l * k, lambda q: q + 1, order, params={"l": l, "k": k})


def hierarchical(n: int, extend: float = 0.5) -> Rule:
    """Coarse and fine block; the length is raised until both split."""
    fits = lambda m: 1 < sh.largest_divisor(m) < m and 1 < sh.largest_divisor(m // sh.largest_divisor(m)) < m // sh.largest_divisor(m)
    n = next((m for m in range(n, n + max(1, round(n * extend)) + 1) if fits(m)), None) or _refuse(f"no length near {n} splits twice")
    qr = sh.largest_divisor(n)
    r = n // qr
    s = sh.coprime_stride(r)

    def src(q):
        f = idiv(q, r) * r + ((q % r) * s) % r
        return (f % qr) * r + idiv(f, qr) + 1

    return _grid(n, src, q=qr, r=r, stride=s)


def multi_dim(n: int, dims: int = 3, extend: float = 0.5) -> Rule:
    d = sh.balanced_dims(n, dims, extend)
    total = 1
    for x in d:
        total *= x

    def src(q):
        # Digits of q, the last axis fastest, written back with the first axis fastest.
        rest, digits = q, []
        for x in reversed(d):
            digits.append(rest % x)
            rest = idiv(rest, x)
        digits.reverse()
        out, weight = F.lit(1).cast("bigint"), 1
        for x, g in zip(d, digits):
            out, weight = out + g * weight, weight * x
        return out

    return _grid(total, src, **{f"d{i + 1}": x for i, x in enumerate(d)})


def latin_square(n: int) -> Rule:
    k = isqrt(n - 1) + 1

    def src(q):
        r, j = q % k, idiv(q, k)
        shift = F.when(j % 2 == 1, -1).otherwise(1) * F.ceil(j / 2)
        return r * k + F.pmod(r - shift, F.lit(k)) + 1

    return Rule(k * k, src, lambda q: [q], keep=n, params={"k": k})


def time_depth(n: int, depth: int = 1, extend: float = 0.5) -> Rule:
    """At least three symbols; the length is raised until it splits so."""
    sym, sc = sh.first_splittable(n, extend, 3)
    if gcd(depth, sym) != 1:
        _refuse(f"depth {depth} shares a factor with {sym} symbols")

    def src(q):
        s = q % sc
        return ((idiv(q, sc) + s * depth) % sym) * sc + s + 1

    return _grid(sym * sc, src, sc=sc, sym=sym, depth=depth)


def freq_determ(n: int, extend: float = 0.5) -> Rule:
    sym, sc = sh.first_splittable(n, extend, 3)
    a = sh.coprime_stride(sc, 1)

    def src(q):
        t = idiv(q, sc)
        return t * sc + (((q % sc) * a) % sc + t) % sc + 1

    return _grid(sym * sc, src, sc=sc, sym=sym, stride=a)


def freq_random(n: int, seed: int = 42, extend: float = 0.5) -> Rule:
    """One hash order of the subcarriers, rotated by the symbol number."""
    sym, sc = sh.first_splittable(n, extend, 3)

    def order(q):
        t, b = idiv(q, sc), q % sc
        return [t, b]

    return Rule(sym * sc, lambda q: q + 1, order, params={"sc": sc, "sym": sym, "seed": seed})


def random_order(n: int, seed: int = 42, draw: int = 0) -> Rule:
    return Rule(n, lambda q: q + 1, lambda q: [hash32(F.lit(seed), F.lit(draw), q + 1), q], params={"seed": seed})


def golden(n: int, offset: int = 0) -> Rule:
    p = sh.golden_stride_of(n)
    return _grid(n, lambda q: (offset + q * p) % n + 1, stride=p)


def prime(n: int) -> Rule:
    """Powers of the primitive root: p-1 positions, g^q mod p."""
    from ..functions.numeric import modpow

    p, g = sh.next_prime_root(n)
    return _grid(p - 1, lambda q: modpow(F.lit(g), q, F.lit(p)), p=p, g=g)


def quadratic(n: int, f1: int, f2: int) -> Rule:
    if len({(f1 * q + f2 * q * q) % n for q in range(n)}) != n:
        _refuse(f"{f1}, {f2} give no permutation of {n} rows")
    return _grid(n, lambda q: (f1 * q + f2 * (q * q % n)) % n + 1, f1=f1, f2=f2)


def convolutional(n: int, branches: int | None = None, depth: int = 1) -> Rule:
    """A prime length takes one row of padding; the delay is 1 to rows - 1."""
    n += int(branches is None and len(sh.prime_factors(n)) == 1)
    m = branches or sh.largest_divisor(n)
    if n % m:
        _refuse(f"{m} branches do not divide {n} rows")
    r = n // m
    if r > 1 and not 1 <= depth < r:
        _refuse(f"delay {depth} is not within 1 to {r - 1}")

    def src(q):
        b = q % m
        return F.pmod(idiv(q, m) - b * depth, F.lit(r)) * m + b + 1

    return _grid(n, src, branches=m, rows=r, depth=depth)


def convolutional_matched(n: int, codeword: int = 15) -> Rule:
    """Branches of a codeword's length, or of the nearest divisor's where that does not divide."""
    m = min((d for d in range(2, n) if n % d == 0), key=lambda d: (abs(d - codeword), d), default=None) if n % codeword else codeword
    return convolutional(n, m, max(1, n // m // m)) if m else convolutional(n)


def arp(n: int) -> Rule:
    row = next((r for r in ARP_TABLE if r[0] == n), None)
    if row is None:
        raise ValueError(f"no published parameters for {n} rows")
    p0, p1, p2, p3 = row[1:]
    return _grid(n, lambda q: sh.arp_image(p0, F.lit(p1), F.lit(p2), F.lit(p3), F.lit(n), q), p0=p0, p1=p1, p2=p2, p3=p3)


def drp(n: int, p: int, s: int = 0, read: list[int] | None = None, write: list[int] | None = None) -> Rule:
    m = len(read or write or [0, 1, 2, 3])
    r_, w_ = read or list(range(m)), write or list(range(m))
    if gcd(p, n) != 1 or n % m or sorted(r_) != list(range(m)) or sorted(w_) != list(range(m)):
        _refuse(f"stride {p} and dithers of {m} give no permutation of {n} rows")
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))

    def src(q):
        iw = m * idiv(q, m) + at(w_, q % m)
        ib = (s + iw * p) % n
        return m * idiv(ib, m) + at(r_, ib % m) + 1

    return _grid(n, src, p=p, s=s, m=m)


def swap(n: int) -> Rule:
    """Odd rows and odd columns trade places across the middle, then columns are read."""
    m = n if len(sh.prime_factors(n)) > 1 else n + 1
    l = sh.largest_divisor(m)
    k = m // l

    def across(x, size):
        y, h, f = x + 1, (size + 1) // 2, size // 2
        return (
            F.when((y <= f) & (y % 2 == 1), x + h)
            .when((y > h) & (y - h <= f) & ((y - h) % 2 == 1), x - h).otherwise(x)
        )

    return _grid(m, lambda q: across(q % l, l) * k + across(idiv(q, l), k) + 1, l=l, k=k)


def identity(n: int) -> Rule:
    return _grid(n, lambda q: q + 1)


RULES: dict[str, Callable[..., Rule]] = {
    "identity": identity, "block": block, "blockCM": block_matched, "matrix": matrix, "snake": snake,
    "helical": helical, "helicalScan": helical_scan, "diagonal": diagonal, "spiral": spiral,
    "hierarchical": hierarchical, "multiDim": multi_dim, "latinSquare": latin_square, "time": time_depth,
    "freqDeterm": freq_determ, "freqRandom": freq_random, "random": random_order, "goldenRP": golden,
    "prime": prime, "algebraic": quadratic, "turbo": quadratic, "convolutional": convolutional,
    "convCM": convolutional_matched, "arp": arp, "drp": drp, "S": swap,
}


def permutation(spark: SparkSession, rule: str, n: int, **params) -> DataFrame:
    """(n_rows, pos, src) for one frame length; src beyond n marks padding."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    made = RULES[rule](n, **params)
    q = F.col("q")
    cells = spark.range(0, made.n_out, 1, 1).withColumnRenamed("id", "q")  # one frame: one partition
    if rule == "freqRandom":
        sc, seed = made.params["sc"], made.params["seed"]
        one = cells.where(q < sc).withColumn(
            "base", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash32(F.lit(seed), q + 1), q)) - 1)
        # base is the rank of each subcarrier: position base carries subcarrier q.
        one = one.select(big("base").alias("b"), F.col("q").alias("sub"))
        t = idiv(q, sc)
        cells = cells.withColumn("b", q % sc).join(F.broadcast(one), "b")
        return cells.select(F.lit(n).cast("bigint").alias("n_rows"), (q + 1).alias("pos"),
                            big(t * sc + (F.col("sub") + t) % sc + 1).alias("src"))
    cells = cells.withColumn("src", big(made.src(q)))
    if made.keep is not None:
        cells = cells.where(F.col("src") <= made.keep)
    if made.order is None:
        pos = q + 1
    else:
        pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*made.order(q)))
    return cells.select(F.lit(n).cast("bigint").alias("n_rows"), big(pos).alias("pos"), "src")


def permutations(spark: SparkSession, rules, n: int) -> DataFrame:
    """Several rules for one length, with a ``method`` column; items are names or (name, params)."""
    items = [(r, {}) if isinstance(r, str) else r for r in rules]
    return union_all([permutation(spark, r, n, **p).withColumn("method", F.lit(r)) for r, p in items])


def listed(rule: str, n: int) -> bool:
    """Whether a rule has parameters for frames of ``n`` rows; only published tables leave lengths out."""
    return rule != "arp" or any(r[0] == n for r in ARP_TABLE)


def permutations_of(frames: DataFrame, rules, where_listed: bool = False) -> DataFrame:
    """The rules for every frame length that occurs, of which there are few.

    With ``where_listed`` a rule without parameters for a length is passed over there.
    """
    lengths = sorted(r["n_rows"] for r in frames.select("n_rows").distinct().collect())
    items = [(r, {}) if isinstance(r, str) else r for r in rules]
    return union_all([permutations(frames.sparkSession, [i for i in items if not where_listed or listed(i[0], n)], n) for n in lengths])


def number_rows(df: DataFrame, frame_cols: list[str], order_col: str) -> DataFrame:
    """1-based row number inside each frame and the frame length; frames are bounded."""
    w = Window.partitionBy(*frame_cols)
    return df.withColumn("pos", big(F.row_number().over(w.orderBy(order_col)))).withColumn("n_rows", F.count("*").over(w))


def small_perm(perm: DataFrame) -> DataFrame:
    """Broadcast a permutation table after measuring it; a larger one is left to a shuffle join."""
    return F.broadcast(perm) if fits_broadcast(perm) else perm


def ruled(col: str) -> Column:
    """``col`` of a joined rule; an error where no rule has the frame's length."""
    return F.coalesce(F.col(col), F.raise_error(F.concat(F.lit("no rule for a frame of length "), F.col("n_rows").cast("string"))).cast("bigint")).alias(col)


def reorder(frames: DataFrame, perm: DataFrame, values: list[str], frame: str = "frame_id") -> DataFrame:
    """Carry every row to its new position; padding appears as rows with NULL values.

    Frames must hold one row per position 1..n_rows, and every frame length must
    have its rule, else the query fails.  While ``perm`` is within
    the broadcast bound the frames are not shuffled.
    """
    extra = [c for c in perm.columns if c not in ("n_rows", "pos", "src")]
    # A padding cell is carried by one data row of its frame, in turn, so that
    # rows and padding leave the same equi-join.
    real = F.col("src") <= F.col("n_rows")
    carrier = F.when(real, F.col("src")).otherwise((F.col("src") - F.col("n_rows") - 1) % F.col("n_rows") + 1)
    p = small_perm(perm.withColumn("_row", carrier))
    rows = frames.select(frame, "n_rows", F.col("pos").alias("_row"), *values).join(p, ["n_rows", "_row"], "left")
    return rows.select(frame, "n_rows", *extra, ruled("pos"), "src", *[F.when(real, F.col(v)).alias(v) for v in values])


def restore(reordered: DataFrame, perm: DataFrame, values: list[str], frame: str = "frame_id") -> DataFrame:
    """Undo ``reorder``: swap the two columns of the permutation and drop padding."""
    back = small_perm(perm.where(F.col("src") <= F.col("n_rows")))
    return (
        reordered.where(F.col("src") <= F.col("n_rows")).select(frame, "n_rows", "pos", *values).join(back, ["n_rows", "pos"], "left")
        .select(frame, "n_rows", ruled("src").alias("pos"), *values)
    )


def extension(perm: DataFrame, keys: list[str]) -> DataFrame:
    """Padded length and bandwidth efficiency n/n_out per permutation."""
    return perm.groupBy(*keys, "n_rows").agg(F.max("pos").alias("n_out")).withColumn("be", F.col("n_rows") / F.col("n_out"))


def perm_valid(perm: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Bijection, identity and duplicate checks per permutation.

    Twins are counted among the permutations that share ``within`` (for example
    the rules of one frame), which are few.
    """
    # One shuffle by permutation serves both levels of the grouping.
    per_src = spread(perm, *(within or keys)).groupBy(*keys, "src").agg(
        F.count("*").alias("c"), F.sum((F.col("pos") == F.col("src")).cast("bigint")).alias("f"), F.bit_xor(F.xxhash64("pos", "src")).alias("h"))
    s = per_src.groupBy(*keys).agg(
        F.sum("c").alias("n_out"), F.count("*").alias("n_src"), F.min("src").alias("lo"), F.max("src").alias("hi"),
        F.sum("f").alias("fixed_points"), F.bit_xor("h").alias("print"))
    same = Window.partitionBy(*(within or []), "n_out", "print")
    return s.withColumn("copies", F.count("*").over(same)).select(
        *keys, "n_out", ((F.col("n_src") == F.col("n_out")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n_out"))).alias("bijection"),
        (F.col("fixed_points") == F.col("n_out")).alias("is_identity"), "fixed_points", "copies",
    )


def perm_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise comparison of two permutation tables: (keys, rows, mismatches, equal)."""
    j = a.select(*keys, "pos", F.col("src").alias("sa")).join(b.select(*keys, "pos", F.col("src").alias("sb")), [*keys, "pos"], "full")
    bad = (~F.col("sa").eqNullSafe(F.col("sb"))).cast("bigint")
    return j.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(bad).alias("mismatches")).withColumn("equal", F.col("mismatches") == 0)


def union_draws(spark: SparkSession, rule: str, n: int, draws: int) -> DataFrame:
    """Several seeded draws of a random rule, with methods named rule#draw."""
    return union_all([permutation(spark, rule, n, draw=d).withColumn("method", F.lit(f"{rule}#{d}")) for d in range(draws)])
