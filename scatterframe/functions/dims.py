"""Joining small tables to large ones with a size check, and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
#: Bytes of a row of a summary table, about: a word for each column and a short string for each text.
_WIDTH = {"string": 32, "binary": 32}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where none is named, an own one, removed at the end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(remove, spark, named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, if the session still lives."""
    try:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    except Exception:  # noqa: BLE001
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, counted, stay below ``most`` bytes."""
    return df.count() * sum(_WIDTH.get(t, 16) for _, t in df.dtypes) <= most


def attach(df: DataFrame, dim: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join a summary table to the rows it summarises; NULL keys meet NULL keys.

    ``dim`` is computed once and measured.  Up to ``most`` bytes it is broadcast,
    so ``df`` is not shuffled; beyond that adaptive execution splits hot keys.
    """
    on = [on] if isinstance(on, str) else list(on)
    dim = settle(dim)
    small = fits_broadcast(dim, most)
    dim = dim.withColumnsRenamed({k: f"_on_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(dim[f"_on_{k}"]) for k in on])
    return df.join(F.broadcast(dim) if small else dim, same, how).drop(*[f"_on_{k}" for k in on])


def with_totals(df: DataFrame, keys: list[str], *aggs) -> DataFrame:
    """Attach per-key aggregates to every row, without a window over the key."""
    if keys:
        return attach(df, df.groupBy(*keys).agg(*aggs), keys)
    one = df.agg(*aggs)
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def spread(df: DataFrame, *cols, least: int = 0) -> DataFrame:
    """Hash-partition into the session's shuffle width, ahead of a step that grows its rows.

    The explicit width keeps adaptive execution from merging partitions that are
    small now and large after the growth.  ``least`` widens it, so that a task's
    share need not grow with the table.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *cols)


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
