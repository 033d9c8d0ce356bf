"""Bindings of the test tables to the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import as_col, big, idiv

EVENT_W = 200
ORDER_W = 240


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hundredths(c: str) -> Column:
    """A non-negative amount in whole hundredths; plain arithmetic, cheaper than decimal rounding."""
    return F.floor(F.col(c) * 100 + 0.5).cast("bigint")


def _frames(df: DataFrame, key: str, width: int, hit, value: str | Column, whole: bool) -> DataFrame:
    """Frames of ``width`` consecutive keys; keys run 0..n-1 without gaps.

    The last frame is shorter where the width does not divide the table; with
    ``whole`` (designs that need equal frames) it is left out.
    """
    rows = df.agg(big(F.max(key) + 1).alias("n")).select("n").scalar()
    fid = idiv(F.col(key), width)
    frames = df.select(
        fid.alias("frame_id"), (big(key) % width + 1).alias("pos"),
        F.least(F.lit(width).cast("bigint"), rows - fid * width).alias("n_rows"), hit.cast("int").alias("hit"), as_col(value).alias("value"),
    )
    return frames.where(F.col("n_rows") == width) if whole else frames


def frames_events(spark, sf, width: int = EVENT_W, whole: bool = True) -> DataFrame:
    return _frames(table(spark, sf, "events"), "event_id", width, F.col("event_type") == "error", "value", whole)


def frames_orders(spark, sf, width: int = ORDER_W, whole: bool = True, value: str | Column = "o_totalprice") -> DataFrame:
    return _frames(table(spark, sf, "orders"), "o_orderkey", width, F.col("o_orderstatus") == "F", value, whole)


def obs(spark, sf) -> DataFrame:
    """Line items as trials.  Money and rates are whole numbers, so their sums are exact."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_returnflag").alias("condition"), F.col("p_brand").alias("method"),
        (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("block"),
        (hundredths("l_tax") + 1).alias("bin"),
        F.col("l_quantity").cast("bigint").alias("x1"), hundredths("l_discount").alias("x2"),
        F.col("p_size").cast("bigint").alias("x3"), hundredths("l_tax").alias("x4"),
        (hundredths("l_extendedprice") * (100 - hundredths("l_discount"))).alias("y"),
    )


def kpi_in(spark, sf) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    bin_ = hundredths("l_tax") + 1
    enc = F.col("l_quantity")
    inter = enc + F.col("l_linenumber") - 1
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_returnflag").alias("condition"), F.col("p_brand").alias("method"),
        (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("block"), bin_.alias("bin"),
        enc.alias("enc_len"), inter.alias("int_len"),
        (0.10 + 0.02 * bin_).alias("target"), (F.floor((0.10 + 0.02 * bin_) * enc + 0.5) / inter).alias("actual"),
        (F.col("l_tax") + 0.01).alias("err_base"),
        (5 * F.col("l_discount") * (F.col("l_tax") + 0.01)).alias("err"),
    )


# --- the same bindings for the oracle side -------------------------------

def sql_frames(name: str = "f", source: str = "events", width: int | None = None, whole: bool = True) -> str:
    tab, key, hit, val, w = {
        "events": ("events", "event_id", "event_type = 'error'", "value", EVENT_W),
        "orders": ("orders", "o_orderkey", "o_orderstatus = 'F'", "o_totalprice", ORDER_W),
    }[source]
    w = width or w
    return (
        f"{name} AS (SELECT {key} // {w} AS frame_id, {key} % {w} + 1 AS pos, CAST(least({w}, total - {key} // {w} * {w}) AS BIGINT) AS n_rows, "
        f"CAST({hit} AS INTEGER) AS hit, {val} AS value FROM {tab}, (SELECT max({key}) + 1 AS total FROM {tab})"
        + (f" WHERE total - {key} // {w} * {w} >= {w})" if whole else ")")
    )


SQL_OBS = """obs AS (SELECT l_returnflag AS condition, p_brand AS method,
  CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS INTEGER) AS block,
  CAST(round(l_tax * 100) AS BIGINT) + 1 AS bin, CAST(l_quantity AS BIGINT) AS x1,
  CAST(round(l_discount * 100) AS BIGINT) AS x2, CAST(p_size AS BIGINT) AS x3,
  CAST(round(l_tax * 100) AS BIGINT) AS x4,
  CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SQL_KPI_IN = """k0 AS (SELECT l_returnflag AS condition, p_brand AS method,
  CAST(year(l_shipdate) * 10 + quarter(l_shipdate) AS INTEGER) AS block,
  CAST(round(l_tax * 100) AS BIGINT) + 1 AS bin, l_quantity AS enc_len,
  l_quantity + l_linenumber - 1 AS int_len, l_tax, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey),
kpi_in AS (SELECT condition, method, block, bin, enc_len, int_len, 0.10::DOUBLE + 0.02::DOUBLE * bin AS target,
  floor((0.10::DOUBLE + 0.02::DOUBLE * bin) * enc_len + 0.5::DOUBLE) / int_len AS actual, l_tax + 0.01::DOUBLE AS err_base,
  5 * l_discount * (l_tax + 0.01::DOUBLE) AS err FROM k0)"""
