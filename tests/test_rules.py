"""Reorder rules against matrices filled and read cell by cell."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterframe.operators import reorder as ro
from scatterframe.operators import shapes as sh
from scatterframe.plans import catalog
from tests.compare import compare


def seq(spark, rule, n, **kw):
    return [r["src"] for r in ro.permutation(spark, rule, n, **kw).orderBy("pos").collect()]


def swap_halves(m, parity, axis):
    m = m.copy() if axis == 0 else m.T.copy()
    half = (m.shape[0] + 1) // 2
    for r in range(parity - 1, m.shape[0] // 2, 2):
        m[[r, r + half]] = m[[r + half, r]]
    return m if axis == 0 else m.T


def spiral_walk(l, k):
    m = (np.arange(l * k) + 1).reshape(k, l).T
    out = []
    while m.size:
        out += list(m[0])
        m = np.rot90(m[1:]) if m.shape[0] > 1 else np.empty((0, 0))
    return out


def test_block(spark):
    assert seq(spark, "block", 240) == list((np.arange(240) + 1).reshape(16, 15).T.ravel())
    assert seq(spark, "block", 7, width=3) == [1, 4, 7, 2, 5, 8, 3, 6, 9]


def test_snake(spark):
    m = (np.arange(240) + 1).reshape(16, 15).T.copy()
    m[1::2] = m[1::2, ::-1]
    assert seq(spark, "snake", 240) == list(m.ravel())


@pytest.mark.parametrize("n", [30, 42, 200, 240])
def test_spiral(spark, n):
    l, k = sh.balanced_pair(n, 0.5)
    assert seq(spark, "spiral", n) == spiral_walk(l, k)


def test_diagonal(spark):
    r, c = sh.first_splittable(60, 0.5)
    cells = sorted(((i + j, j), i * c + j + 1) for i in range(r) for j in range(c))
    assert seq(spark, "diagonal", 60) == [v for _, v in cells]


def test_helical_scan_example(spark):
    made = ro.RULES["helicalScan"](12)
    assert (made.params["r"], made.params["c"]) == (3, 4)
    assert seq(spark, "helicalScan", 12) == [1, 6, 11, 4, 5, 10, 3, 8, 9, 2, 7, 12]


@pytest.mark.parametrize("n", [60, 62, 49, 240])
def test_swap(spark, n):
    p = ro.RULES["S"](n).params
    l, k = p["l"], p["k"]
    m = (np.arange(l * k) + 1).reshape(l, k)
    m = swap_halves(swap_halves(m, 1, 0), 1, 1)
    assert seq(spark, "S", n) == list(m.T.ravel())


def test_latin_square(spark):
    n, k = 200, 15
    sq = np.zeros((k, k), int)
    sq[:, 0] = np.arange(1, k + 1)
    for col in range(1, k):
        shift = (-1 if col % 2 else 1) * -(-col // 2)
        sq[:, col] = np.roll(np.arange(1, k + 1), shift)
    want = [r * k + sq[r, c] for c in range(k) for r in range(k)]
    assert seq(spark, "latinSquare", n) == [v for v in want if v <= n]


def test_multi_dim(spark):
    d = sh.balanced_dims(60, 3, 0.5)
    assert seq(spark, "multiDim", 60) == list((np.arange(60) + 1).reshape(d[::-1]).transpose(2, 1, 0).ravel())


def test_hierarchical(spark):
    p = ro.RULES["hierarchical"](60).params
    q, r, s = p["q"], p["r"], p["stride"]
    coarse = (np.arange(60) + 1).reshape(q, r).T.ravel()
    want = [coarse[(i // r) * r + (i % r) * s % r] for i in range(60)]
    assert seq(spark, "hierarchical", 60) == want


def test_prime_is_powers_of_root(spark):
    assert seq(spark, "prime", 6) == [1, 3, 2, 6, 4, 5]


@pytest.mark.parametrize("rule", [r for r in ro.RULES if r not in ("algebraic", "turbo", "drp", "arp")])
@pytest.mark.parametrize("n", [60, 240])
def test_bijection(spark, rule, n):
    p = seq(spark, rule, n)
    assert sorted(p) == list(range(1, len(p) + 1)) and len(p) >= n


def test_published_offsets(spark):
    """All 17 published rows are bijections with the published S_min."""
    # Published S_min by frame length.
    published = {24: 6, 36: 6, 48: 8, 72: 6, 96: 6, 108: 6, 120: 12, 144: 16, 180: 12, 192: 12, 216: 14, 240: 10,
                 480: 20, 960: 32, 1440: 30, 1920: 38, 2400: 42}
    for n, s in published.items():
        p = np.array(seq(spark, "arp", n))
        assert sorted(p) == list(range(1, n + 1))
        assert min(d + np.abs(p[d:] - p[:-d]).min() for d in range(1, n)) == s
    with pytest.raises(ValueError):
        ro.permutation(spark, "arp", 25)


def test_derived_offsets(spark):
    lengths = spark.createDataFrame([(24,), (36,), (48,)], "n bigint")
    got = {r["n"]: (r["p0"], r["p1"], r["p2"], r["p3"], r["s_min"]) for r in sh.arp_offset_search(lengths).collect()}
    assert got == {24: (7, 0, 0, 0, 6), 36: (7, 0, 0, 0, 6), 48: (11, 0, 0, 0, 8)}


@pytest.mark.parametrize("rule", ["block", "helical", "prime", "random", "S", "latinSquare"])
def test_round_trip(spark, rule):
    f = spark.range(300).select(F.floor(F.col("id") / 100).alias("frame_id"), (F.col("id") % 100 + 1).alias("pos"),
                                F.lit(100).cast("bigint").alias("n_rows"), (F.col("id") * 7).alias("v"))
    perm = ro.permutation(spark, rule, 100)
    moved = ro.reorder(f, perm, ["v"])
    assert moved.count() == 3 * perm.count()
    back = ro.restore(moved, perm, ["v"])
    assert sorted(map(tuple, back.select("frame_id", "pos", "v").collect())) == sorted(map(tuple, f.select("frame_id", "pos", "v").collect()))


def test_number_rows(spark):
    d = spark.createDataFrame([("a", 5), ("a", 2), ("b", 9)], "f string, t int")
    got = {(r["f"], r["t"]): (r["pos"], r["n_rows"]) for r in ro.number_rows(d, ["f"], "t").collect()}
    assert got == {("a", 2): (1, 2), ("a", 5): (2, 2), ("b", 9): (1, 1)}


def test_golden_and_shapes_match_one_length_functions(spark):
    ns = [60, 97, 200, 240, 1200]
    d = spark.createDataFrame([(n,) for n in ns], "n bigint")
    assert {r["n"]: r["stride"] for r in sh.golden_strides(d).collect()} == {n: sh.golden_stride_of(n) for n in ns}
    got = {r["n"]: (r["l"], r["k"]) for r in sh.balanced_shapes(d, 0.5).collect()}
    assert got == {n: sh.balanced_pair(n, 0.5) for n in ns}
    odd = spark.createDataFrame([(n,) for n in (2, 3, 4, 5, 7, 8, 9, 13, 16, 97, 2053)], "n bigint")
    rest = {r["n"]: (r["l"], r["k"], r["pad"]) for r in sh.balanced_shapes(odd, 0.02).collect()}
    assert {n: (l, k) for n, (l, k, _) in rest.items()} == {r.n: sh.balanced_pair(r.n, 0.02) for r in odd.collect()}
    assert all(l * k == n + pad >= n and np.gcd(l, k) == 1 for n, (l, k, pad) in rest.items())
    p = spark.createDataFrame([(3,), (7,), (41,), (191,), (409,)], "p bigint")
    assert {r["p"]: r["root"] for r in sh.primitive_roots(p).collect()} == {3: 2, 7: 3, 41: 6, 191: 19, 409: 21}


def test_dither_search_improves_on_identity(spark):
    d = spark.createDataFrame([(48,), (60,)], "n bigint")
    for r in sh.dither_search(d).collect():
        n, m = r["n"], r["m"]
        read = [(r["ra"] * k + r["rb"]) % m for k in range(m)]
        write = [(r["wa"] * k + r["wb"]) % m for k in range(m)]
        p = np.array(seq(spark, "drp", n, p=r["p"], s=r["s"], read=read, write=write))
        assert sorted(p) == list(range(1, n + 1))
        assert min(k + np.abs(p[k:] - p[:-k]).min() for k in range(1, 17)) == r["best"]


@pytest.mark.parametrize(("n", "best"), [(256, 20), (400, 24), (512, 32)])
def test_dither_search_over_all_lags(spark, n, best):
    r = sh.dither_search(spark.createDataFrame([(n,)], "n bigint")).first()
    m = r.m
    image = []
    for i in range(n):
        ib = (r.s + (m * (i // m) + (r.wa * (i % m) + r.wb) % m) * r.p) % n
        image.append(m * (ib // m) + (r.ra * (ib % m) + r.rb) % m)
    assert sorted(image) == list(range(n))
    assert min(d + abs(image[i + d] - image[i]) for d in range(1, n) for i in range(n - d)) == r.best == best


@pytest.mark.parametrize("n", [13, 14, 61, 120, 200])
def test_rules_are_permutations_at_any_length(spark, n):
    rules = [r for r in ro.RULES if r not in ("arp", "algebraic", "turbo", "drp")]
    d = ro.permutations(spark, rules, n).groupBy("method").agg(F.count("*").alias("k"), F.count_distinct("src").alias("d"), F.min("src").alias("lo"), F.max("src").alias("hi"), F.max("pos").alias("top"))
    for r in d.collect():
        assert r.k == r.d == r.hi == r.top >= n and r.lo == 1, (n, r)
        assert r.method in ("identity", "helicalScan") or r.k > 1


def test_rules_refuse_what_is_no_permutation():
    for rule, kw in (("algebraic", {"f1": 6, "f2": 30}), ("drp", {"p": 24}), ("time", {"depth": 15}), ("convolutional", {"depth": 16}), ("drp", {"p": 23, "read": [0, 0, 1, 2], "write": [0, 1, 2, 3]})):
        with pytest.raises(ValueError):
            ro.RULES[rule](240, **kw)
    assert ro.time_depth(13).params["sym"] >= 3 and ro.hierarchical(13).n_out > 13


def test_a_length_without_a_rule_fails(spark):
    frames = spark.createDataFrame([(f, p, n, 1, 1.0) for f, n in ((0, 4), (1, 3)) for p in range(1, n + 1)], "frame_id bigint, pos bigint, n_rows bigint, hit int, value double")
    with pytest.raises(Exception, match="no rule for a frame of length 3"):
        ro.reorder(frames, ro.permutation(spark, "block", 4), ["value"]).collect()
    assert ro.reorder(frames, ro.permutations_of(frames, ["block"]), ["value"]).where("value is not null").count() == 7


def test_sieve_in_segments(spark):
    got = {r["n"]: r["spf"] for r in sh.smallest_factors(3000, spark, 100).collect()}
    assert got == {n: next(d for d in range(2, n + 1) if n % d == 0) for n in range(2, 3001)}
    few = spark.createDataFrame([(n,) for n in (-3, 0, 1, 2, 4, 4, 97, 97, 2999)] + [(None,)], "n long")
    assert sorted(r["n"] for r in sh.primes(few).collect()) == [2, 97, 97, 2999]
    assert sh.primes(few.where("n < 2")).count() == 0


def test_factor_pairs(spark, monkeypatch):
    monkeypatch.setattr(sh, "SEGMENT", 50)
    numbers = spark.createDataFrame([(n,) for n in [-4, 0, 1, 2, 3, 4, 36, 36, 97, *range(400, 1001, 7)]], "n long")
    got = sorted((r["n"], r["a"], r["b"]) for r in sh.factor_pairs(numbers).collect())
    assert got == sorted((r["n"], a, r["n"] // a) for r in numbers.collect() for a in range(2, 40) if r["n"] >= a * a and r["n"] % a == 0)
    assert sh.factor_pairs(numbers.where("n < 4")).count() == 0


def _least(p, cyclic):
    n = len(p)
    cut = (lambda v: min(v, n - v)) if cyclic else (lambda v: v)
    return min(d + cut(abs(p[i + d] - p[i])) for d in range(1, n) for i in range(n - d))


@pytest.mark.parametrize("n", [4, 5, 6, 9, 12, 25, 36, 49])
def test_qpp_search_brute_force(spark, n):
    rad = int(np.prod([q for q in range(2, n + 1) if n % q == 0 and all(q % d for d in range(2, q))]))
    maps = {(a, b): [(a * x + b * x * x) % n for x in range(n)] for a in range(1, n) if np.gcd(a, n) == 1 for b in range(0, n, rad)}
    assert all(len(set(p)) == n for p in maps.values())
    best = max(maps, key=lambda k: (_least(maps[k], True), -k[0], -k[1]))
    r = sh.qpp_search(spark.createDataFrame([(n,)], "n long")).collect()
    assert [tuple(x) for x in r] == [(n, *best, _least(maps[best], True), len(maps))]


@pytest.mark.parametrize("n", [4, 8, 12, 20, 44, 48, 52])
def test_offset_search_brute_force(spark, n):
    p0 = sh.arp_strides(spark.createDataFrame([(n,)], "n long")).collect()[0]["p0"]
    step, best, count = max(1, n // 20 // 2 * 2), None, 0
    scored = {}
    for p1 in range(0, n, 2):
        for p2 in range(0, n, 4):
            for p3 in range(p1 % 4, n, 4):
                ph = [0, n // 2 + p1, p2, n // 2 + p3]
                p = [(p0 * j + ph[j % 4] + 1) % n for j in range(n)]
                if len(set(p)) == n:
                    count += 1
                    if n <= 12 or (p1 * 7 + p2 * 3 + p3) % (step * 30) == 0:  # scored in full for a part of the larger sets
                        scored[p1, p2, p3] = _least(p, False)
    r, = sh.arp_offset_search(spark.createDataFrame([(n,)], "n long")).collect()
    assert r["feasible"] == count
    ph = [0, n // 2 + r["p1"], r["p2"], n // 2 + r["p3"]]
    assert r["s_min"] == _least([(p0 * j + ph[j % 4] + 1) % n for j in range(n)], False) >= max(scored.values(), default=0)
    if n <= 12:
        assert (r["p1"], r["p2"], r["p3"]) == max(scored, key=lambda k: (scored[k], *(-x for x in k)))


def test_box_sides():
    assert sh.balanced_dims(240, 3, 0.5) == [5, 6, 8] and sh.balanced_dims(360, 3, 0.5) == [5, 8, 9] and sh.balanced_dims(7, 3, 0.5) == [2, 2, 2]
    with pytest.raises(ValueError):
        sh.balanced_dims(11, 4, 0.1)


@pytest.mark.parametrize("name, table, key", [("F1_primes", "orders", "o_orderkey"), ("F2_factor_pairs", "part", "p_partkey"), ("F5_primitive_root", "part", "p_partkey")])
def test_sql_beyond_a_million(spark, tmp_path, name, table, key):
    """Squares of primes above 1,000, large primes, and primes whose least root is 60 or more."""
    numbers = [1, 2, 3, 4, 5, 7, 9, 97, 1009 * 1009, 1009 * 1013, 1018081 + 2, 110881, 999983, 1000003, 200003, 1200007]
    spark.createDataFrame([(n,) for n in numbers], f"{key} bigint").write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert compare(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLES[name], con) is None


def test_roots_are_searched_no_further_than_needed(spark, monkeypatch):
    """A prime whose least root is 69: no candidate beyond twice that is tried."""
    plain = sh.modpow
    late = lambda c, e, m: F.when(c > 138, F.raise_error(F.lit("a late candidate"))).otherwise(plain(c, e, m))
    monkeypatch.setattr(sh, "modpow", late)
    numbers = [3, 5, 7, 17, 19, 23, 41, 191, 409, 36721, 110881]
    got = {r["p"]: r["root"] for r in sh.primitive_roots(spark.createDataFrame([(n,) for n in numbers], "p bigint")).collect()}
    assert got == {n: next(g for g in range(2, n) if all(pow(g, (n - 1) // q, n) != 1 for q in set(sh.prime_factors(n - 1)))) for n in numbers}
    assert got[110881] == 69
