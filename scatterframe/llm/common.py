"""Helpers shared by the corpus operators: written tables, row keys, size-checked joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of joins are broadcast up to this many bytes, as measured; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode, where none is named, an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """32 characters that name the row's contents; null and empty differ."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]))


def small(df: DataFrame, width: int, more: Column | None = None) -> bool:
    """Whether ``df``, at ``width`` bytes a row and ``more`` besides, may be broadcast."""
    each = F.lit(width) if more is None else F.lit(width) + F.coalesce(more, F.lit(0))
    return df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()["b"] <= BROADCAST_BYTES


def sized(df: DataFrame, width: int, more: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, else as it is."""
    return F.broadcast(df) if small(df, width, more) else df


def slices(df: DataFrame, key: str, width: int) -> list[Callable[[str], Column]]:
    """Ranges of the whole number ``key``, as conditions, that hold about as many rows of ``df`` as may be broadcast.

    Every key is in one of them, null in the first.  A large table that is too
    wide to shuffle meets ``df`` slice by slice; files that are clustered by the key are read in part.
    """
    parts = -(-df.count() * width // BROADCAST_BYTES)
    cuts = sorted({int(c) for c in df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.1 / parts)}) if parts > 1 else []

    def between(low: int | None, high: int | None) -> Callable[[str], Column]:
        def holds(column: str) -> Column:
            c = F.col(column).cast("long")
            if low is None:
                return F.lit(True) if high is None else c.isNull() | (c < high)
            return c >= low if high is None else (c >= low) & (c < high)

        return holds

    return [between(low, high) for low, high in zip([None, *cuts], [*cuts, None])]


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node it reaches.

    Alternating large-star and small-star steps: every step attaches nodes to
    smaller neighbours and no step makes more edges than there were; it ends
    when a round changes nothing.  Each round is a written table.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ordered = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = table(ordered, "edges")
    while True:
        near = both(now)
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = large.where("u > v")
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        star = up.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        then = table(star.where("u > v").distinct(), "edges")
        if not then.exceptAll(now).take(1) and not now.exceptAll(then).take(1):
            break
        now = then
    roots = then.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
