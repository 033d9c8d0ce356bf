"""F1-F8: parameter searches for the frame lengths found in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import big
from ..operators import shapes as sh
from ..sources.tables import table
from .registry import register


def supplier_lengths(spark, sf):
    """Every supplier's shipments are one frame; its length is their number."""
    return table(spark, sf, "lineitem").groupBy(big("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"))


def part_lengths(spark, sf):
    return table(spark, sf, "lineitem").groupBy(big("l_partkey").alias("part")).agg(F.count("*").alias("n"))


SQL_SUP = "sl AS (SELECT l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY ALL), ln AS (SELECT DISTINCT n FROM sl)"
SQL_PART = "pl AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY ALL), ln AS (SELECT DISTINCT n FROM pl WHERE n >= 4)"


@register("F1_primes", "WITH rt AS (SELECT unnest(range(2, CAST(floor(sqrt(max(o_orderkey))) AS BIGINT) + 2)) AS d FROM orders) SELECT o_orderkey AS n FROM orders o WHERE o_orderkey >= 2 AND NOT EXISTS (SELECT 1 FROM rt r WHERE d * d <= o.o_orderkey AND o.o_orderkey % d = 0)")
def f1(spark, sf):
    return sh.primes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("n")))


@register("F2_factor_pairs", """WITH rt AS (SELECT unnest(range(2, CAST(floor(sqrt(max(p_partkey))) AS BIGINT) + 2)) AS d FROM part),
  pr AS (SELECT p_partkey AS n, d AS a, p_partkey // d AS b FROM part JOIN rt r ON d * d <= p_partkey AND p_partkey % d = 0),
  fl AS (SELECT n, least(3, max(a)) AS floor_used FROM pr GROUP BY n), ok AS (SELECT pr.*, floor_used FROM pr JOIN fl USING (n) WHERE a >= floor_used)
  SELECT n, count(*) AS n_pairs, CAST(any_value(floor_used) AS BIGINT) AS floor_used, CAST(arg_min(a, a + b) AS BIGINT) AS sum_a, CAST(arg_min(b, a + b) AS BIGINT) AS sum_b, CAST(min(a) AS BIGINT) AS fac_a, CAST(arg_min(b, a) AS BIGINT) AS fac_b FROM ok GROUP BY n""")
def f2(spark, sf):
    d = sh.best_pairs(sh.factor_pairs(table(spark, sf, "part").select(F.col("p_partkey").alias("n"))), 3)
    return d.select(*[big(c).alias(c) for c in d.columns])


@register("F3_balanced_shape", f"""WITH {SQL_SUP}, mm AS (SELECT n, unnest(range(n, floor(n * 1.1::DOUBLE)::BIGINT + 1)) AS m FROM ln),
  ca AS (SELECT n, m, a, m // a AS b FROM (SELECT *, unnest(range(greatest(2, floor(sqrt(m)) - least(20, floor(sqrt(m) / 2)))::BIGINT, (ceil(sqrt(m)) + least(20, floor(sqrt(m) / 2)))::BIGINT + 1)) AS a FROM mm) WHERE m % a = 0 AND m // a >= 2 AND gcd(a, m // a) = 1),
  sc AS (SELECT *, least(a, b) AS l, greatest(a, b) AS k, round(abs(a - b) + (m - n) * 0.1::DOUBLE, 6) AS score, abs(a - b) < 2 AND m - n < n * 0.1::DOUBLE AS stops, row_number() OVER (PARTITION BY n ORDER BY m, a) AS i FROM ca),
  en AS (SELECT n, min(i) FILTER (stops) AS e FROM sc GROUP BY n), bs AS (SELECT sc.*, row_number() OVER (PARTITION BY n ORDER BY score, m, a) AS r FROM sc JOIN en USING (n) WHERE e IS NULL OR i <= e)
  SELECT supplier, n, l, k, m - n AS pad FROM sl JOIN bs USING (n) WHERE r = 1""")
def f3(spark, sf):
    s = supplier_lengths(spark, sf)
    return s.join(sh.balanced_shapes(s, 0.1), "n").select("supplier", "n", "l", "k", "pad")


@register("F4_golden_stride", f"""WITH {SQL_SUP}, ca AS (SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY abs(p - floor(n / {sh.GOLDEN!r}::DOUBLE + 0.5)), p) AS r FROM (SELECT n, unnest(range(1, n)) AS p FROM ln) WHERE gcd(p, n) = 1)
  SELECT supplier, n, p AS stride FROM sl JOIN ca USING (n) WHERE r = 1""")
def f4(spark, sf):
    s = supplier_lengths(spark, sf)
    return s.join(sh.golden_strides(s), "n").select("supplier", "n", "stride")


@register("F5_primitive_root", """WITH RECURSIVE rt AS (SELECT unnest(range(1, CAST(floor(sqrt(max(p_partkey))) AS BIGINT) + 2)) AS d FROM part),
  pr AS (SELECT p_partkey AS p FROM part o WHERE p_partkey > 2 AND NOT EXISTS (SELECT 1 FROM rt WHERE d > 1 AND d * d <= o.p_partkey AND o.p_partkey % d = 0)),
  dv AS (SELECT DISTINCT p, unnest([d, (p - 1) // d]) AS q FROM pr JOIN rt ON d * d <= p - 1 AND (p - 1) % d = 0),
  qs AS (SELECT p, list(q) AS qs FROM dv WHERE q > 1 AND NOT EXISTS (SELECT 1 FROM rt WHERE d > 1 AND d * d <= dv.q AND dv.q % d = 0) GROUP BY p),
  ca AS (SELECT p, qs, 1::BIGINT AS g, false AS root FROM qs UNION ALL SELECT p, qs, g + 1, len(list_filter(qs, lambda q:
    list_reduce(list_transform(range(CAST(floor(log2(p)) AS BIGINT), -1, -1), lambda i: (((p - 1) // q) >> i) & 1), lambda acc, b: (acc * acc % p) * (CASE WHEN b = 1 THEN g + 1 ELSE 1 END) % p, 1::BIGINT) = 1)) = 0
    FROM ca WHERE NOT root AND g < p - 1)
  SELECT p, g AS root FROM ca WHERE root""")
def f5(spark, sf):
    p = sh.primes(table(spark, sf, "part").select(F.col("p_partkey").alias("n")).where(F.col("n") > 2)).select(F.col("n").alias("p"))
    return sh.primitive_roots(p)


@register("F6_qpp_search", f"""WITH {SQL_PART}, rd AS (SELECT n, CAST(product(d) AS BIGINT) AS rad FROM ln JOIN range(2, 1000) r(d) ON d <= n AND n % d = 0 WHERE NOT EXISTS (SELECT 1 FROM range(2, 100) s(e) WHERE e * e <= d AND d % e = 0) GROUP BY n),
  ca AS (SELECT n, f1, f2 FROM rd, LATERAL (SELECT unnest(range(1, n)) AS f1), LATERAL (SELECT unnest(range(0, n, rad)) AS f2) WHERE gcd(f1, n) = 1),
  mp AS (SELECT n, f1, f2, x, (f1 * x + f2 * x * x) % n AS y FROM ca, LATERAL (SELECT unnest(range(0, n)) AS x)), ok AS (SELECT n, f1, f2 FROM mp GROUP BY ALL HAVING count(DISTINCT y) = n),
  sp AS (SELECT n, f1, f2, min(b.x - a.x + least(abs(b.y - a.y), n - abs(b.y - a.y))) AS spread FROM ok JOIN mp a USING (n, f1, f2) JOIN mp b USING (n, f1, f2) WHERE b.x > a.x GROUP BY ALL),
  bs AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY spread DESC, f1, f2) AS r, count(*) OVER (PARTITION BY n) AS tried FROM sp)
  SELECT part, n, f1, f2, spread, tried FROM pl JOIN bs USING (n) WHERE r = 1""")
def f6(spark, sf):
    s = part_lengths(spark, sf).where(F.col("n") >= 4)
    d = s.join(sh.qpp_search(s), "n")
    return d.select("part", "n", "f1", "f2", big("spread").alias("spread"), "tried")


def _dither_sql() -> str:
    """The eight steps one after another; every step is a table of all its candidates' scores over all lags."""
    bank = "(SELECT list({'a': a, 'b': b} ORDER BY a, b) FROM (SELECT unnest(range(1, m)) AS a) x, (SELECT unnest(range(0, m)) AS b) y WHERE gcd(a, m) = 1)"
    strides = "list_filter(range(greatest(2, floor(sqrt(n) / 2))::BIGINT, least(n - 2, ceil(4 * sqrt(n)))::BIGINT + 1), lambda c: gcd(c, n) = 1)"
    coords = [(strides, {"p": "c"}), ("range(0, m)", {"s": "c"}), (bank, {"ra": "c.a", "rb": "c.b"}), (bank, {"wa": "c.a", "wb": "c.b"})]
    names = ("p", "s", "ra", "rb", "wa", "wb")
    out = [f"""st0 AS (SELECT n, m, ({strides})[1] AS p, 0::BIGINT AS s, 1::BIGINT AS ra, 0::BIGINT AS rb, 1::BIGINT AS wa, 0::BIGINT AS wb, -1::BIGINT AS best
      FROM (SELECT n, CASE WHEN n > 1000 AND n % 16 = 0 THEN 16 WHEN n > 200 AND n % 8 = 0 THEN 8 ELSE 4 END::BIGINT AS m FROM ln WHERE n >= 12 AND n % 4 = 0))"""]
    for k in range(8):
        cands, sets = coords[k % 4]
        new = ", ".join(f"{sets[c]} AS {c}" if c in sets else c for c in names)
        iw = "(m * (i // m) + (wa * (i % m) + wb) % m)"
        ib = f"((s + {iw} * p) % n)"
        out += [
            f"c{k} AS (SELECT * EXCLUDE (cs), unnest(cs) AS c, unnest(range(0, len(cs))) AS k FROM (SELECT *, {cands} AS cs FROM st{k}))",
            f"n{k} AS (SELECT n, m, best, k, {new} FROM c{k})",
            f"a{k} AS (SELECT *, list_transform(range(0, n), lambda i: m * ({ib} // m) + (ra * ({ib} % m) + rb) % m) AS a FROM n{k})",
            f"v{k} AS (SELECT * EXCLUDE (a), list_min(list_transform(range(1, n), lambda d: d + list_min(list_transform(range(1, n - d + 1), lambda j: abs(a[j + d] - a[j]))))) AS v FROM a{k})",
            f"w{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY v DESC, k) AS r FROM v{k}) WHERE r = 1)",
            f"st{k + 1} AS (SELECT n, o.m, " + ", ".join(f"CASE WHEN w.v > o.best THEN w.{c} ELSE o.{c} END AS {c}" if c in sets else f"o.{c}" for c in names) + f", greatest(o.best, w.v) AS best FROM st{k} o JOIN w{k} w USING (n))",
        ]
    return f"WITH {SQL_PART}, {', '.join(out)} SELECT part, n, m, p, s, ra, rb, wa, wb, best FROM pl JOIN st8 USING (n)"


@register("F7_dither_search", _dither_sql())
def f7(spark, sf):
    s = part_lengths(spark, sf).where((F.col("n") >= 12) & (F.col("n") % 4 == 0))
    return s.join(sh.dither_search(s), "n").select("part", "n", "m", "p", "s", "ra", "rb", "wa", "wb", "best")


@register("F8_offset_search", f"""WITH {SQL_PART}, l4 AS (SELECT n FROM ln WHERE n % 4 = 0), st AS (SELECT n, p0 FROM (SELECT n, p AS p0, row_number() OVER (PARTITION BY n ORDER BY abs(p - sqrt(2.0::DOUBLE * n)), p) AS r FROM (SELECT n, unnest(range(1, n)) AS p FROM l4) WHERE gcd(p, n) = 1) WHERE r = 1),
  ca AS (SELECT n, p0, p1, p2, p3 FROM st, LATERAL (SELECT unnest(range(0, n, 2)) AS p1), LATERAL (SELECT unnest(range(0, n, 4)) AS p2), LATERAL (SELECT unnest(range(p1 % 4, n, 4)) AS p3)),
  mp AS (SELECT n, p0, p1, p2, p3, j, (p0 * j + CASE j % 4 WHEN 0 THEN 0 WHEN 1 THEN n // 2 + p1 WHEN 2 THEN p2 ELSE n // 2 + p3 END + 1) % n AS y FROM ca, LATERAL (SELECT unnest(range(0, n)) AS j)),
  ls AS (SELECT n, p0, p1, p2, p3, list(y ORDER BY j) AS a FROM mp GROUP BY ALL HAVING count(DISTINCT y) = n),
  sm AS (SELECT n, p0, p1, p2, p3, min(d + list_min(list_transform(range(1, n - d + 1), lambda i: abs(a[i + d] - a[i])))) AS s_min FROM ls, LATERAL (SELECT unnest(range(1, n)) AS d) GROUP BY ALL),
  bs AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s_min DESC, p1, p2, p3) AS r, count(*) OVER (PARTITION BY n) AS feasible FROM sm)
  SELECT part, n, p0, p1, p2, p3, s_min, feasible FROM pl JOIN bs USING (n) WHERE r = 1""")
def f8(spark, sf):
    s = part_lengths(spark, sf).where(F.col("n") >= 4)
    return s.join(sh.arp_offset_search(s), "n").select("part", "n", "p0", "p1", "p2", "p3", "s_min", "feasible")
