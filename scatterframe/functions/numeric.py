"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: double-precision machine epsilon, used as a denominator guard.
EPS = 2.220446049250313e-16


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int = 9) -> Column:
    """Round a reported double so that summation order cannot show; -0.0 becomes 0.0."""
    return F.round(as_col(x).cast("double"), digits) + F.lit(0.0)


def big(x) -> Column:
    return as_col(x).cast("bigint")


def finite(x) -> Column:
    """NaN and infinities become NULL, which Spark aggregates skip."""
    c = as_col(x).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), as_col(x)))


def idiv(a, b) -> Column:
    """Floor division of non-negative integers, kept in BIGINT."""
    return F.floor(as_col(a) / (as_col(b) if not isinstance(b, int) else F.lit(b))).cast("bigint")


def hash32(*parts) -> Column:
    """Reproducible integer in [0, 2^32) from the joined text of the parts."""
    key = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def gcd(a, b) -> Column:
    """Euclid in 48 fixed steps, enough for any pair below 2^31."""
    seed = F.struct(as_col(a).cast("bigint").alias("a"), as_col(b).cast("bigint").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(48)),
        seed,
        lambda s, _: F.when(s["b"] == 0, s).otherwise(
            F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))
        ),
        lambda s: s["a"],
    )


def modpow(base, exponent, modulus) -> Column:
    """base^exponent mod modulus by squaring over the bits of the exponent; modulus must stay below 2^31."""
    m = as_col(modulus).cast("bigint")
    e = as_col(exponent).cast("bigint")
    seed = F.struct((F.lit(1).cast("bigint") % m).alias("r"), (as_col(base).cast("bigint") % m).alias("b"))
    return F.aggregate(
        F.sequence(F.lit(0), F.floor(F.log2(F.greatest(e, F.lit(1)).cast("double"))).cast("int")),
        seed,
        lambda s, i: F.struct(
            F.when(F.getbit(e, i) == 1, s["r"] * s["b"] % m).otherwise(s["r"]).alias("r"),
            (s["b"] * s["b"] % m).alias("b"),
        ),
        lambda s: s["r"],
    )


def atanh_clipped(r, bound: float = 0.999999) -> Column:
    return F.atanh(clip(r, -bound, bound))
