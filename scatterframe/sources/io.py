"""Reading, writing and reshaping experiment tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import attach, remove, shared_dir, spread
from ..functions.numeric import as_col, finite
from ..functions.rank import row_numbers

# Condition names look like <variable>_<regime>_<grid>_<yymmdd>_<version>.
NAME = r"([A-Za-z]+)_([a-z0-9]+)_([a-z0-9]+)_(\d{6})_(\d+)"

SCORECARD = T.StructType([
    T.StructField("metric", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("cell", "trial", "between", "med_len", "IQR_len", "ci_lo", "ci_hi")],
    T.StructField("pass", T.IntegerType()), T.StructField("nCond", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("ratio_to_ref", "ratio_lo", "ratio_hi")]])


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder the cluster shares, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def name_parts(name) -> dict[str, Column]:
    """Variable, regime, grid, date and version parsed from a condition name."""
    p = lambda i: F.regexp_extract(as_col(name), NAME, i)
    return {"variable": p(1), "regime": p(2), "grid": p(3), "run_date": F.to_date(p(4), "yyMMdd"), "version": p(5).cast("int")}


def scan_conditions(spark: SparkSession, path: str) -> DataFrame:
    """All condition files under ``path`` with what their names say attached."""
    df = spark.read.parquet(path)
    return df.withColumns(name_parts(F.col("file") if "file" in df.columns else F.col("_metadata.file_path")))


def write_named(df: DataFrame, path: str, name: Column) -> None:
    """One directory per condition, named by ``name``; written in one distributed job."""
    df.withColumn("file", name).write.mode("overwrite").partitionBy("file").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions saved under ``path``, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def write_conditioned(df: DataFrame, path: str, keys: tuple[str, ...] = ("regime", "grid")) -> int:
    """Save as the next version, partitioned by condition; earlier versions stay.  Returns the version."""
    version = max(versions(df.sparkSession, path), default=0) + 1
    df.write.partitionBy(*keys).parquet(f"{path}/version={version}")
    return version


def read_conditioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One saved version, the latest unless named."""
    found = versions(spark, path)
    if not found or version not in (None, *found):
        raise ValueError(f"no version {version or ''} under {path}")
    return spark.read.parquet(f"{path}/version={version or found[-1]}")


def inventory(df: DataFrame, keys: list[str], variable: str) -> DataFrame:
    """What was saved per condition: rows and the sorted set of variables."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(variable)), ",").alias("variables"))


def grid_filter(df: DataFrame, grid: str) -> DataFrame:
    """Rows of one grid; on the partitioned layout this prunes directories."""
    return df.where(F.col("grid") == grid)


def dictionary_encode(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Dense ids 1..k in sorted order: (encoded rows, dictionary)."""
    d = row_numbers(df.select(col).where(F.col(col).isNotNull()).distinct(), col, f"{col}_id").select(f"{col}_id", col)
    return attach(df, d, [col]).drop(col), d


def decode_category(df: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    """Ids back to names; fails when the dictionary is not 1..k or a code is unknown."""
    key = f"{col}_id"
    s = dim.agg(F.count("*").alias("k"), F.count_distinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if not (s["k"] == s["d"] == s["hi"] and s["lo"] == 1):
        raise ValueError(f"codes of {key} are not 1..{s['k']}")
    if df.where(F.col(key).isNull() | (F.col(key) < 1) | (F.col(key) > s["k"])).limit(1).count():
        raise ValueError(f"unknown codes in {key}")
    return attach(df, dim, [key]).drop(key)


def export_csv_gz(df: DataFrame, path: str, allow: DataFrame, drop: list[str] = (), col: str = "method") -> None:
    """Write gzip CSV after dropping rows; refuses when a name outside the allow-list remains."""
    kept = df.where(~F.coalesce(F.col(col).isin(list(drop)), F.lit(False))) if drop else df
    extra = kept.select(col).distinct().join(allow.select(col), col, "left_anti").limit(20)
    names = [r[0] for r in extra.toLocalIterator()]
    if names:
        raise ValueError(f"names not on the allow-list: {', '.join(sorted(map(str, names)))}")
    kept.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_scorecard_csv(scores: DataFrame, path: str) -> None:
    scores.select(*SCORECARD.fieldNames()).write.mode("overwrite").option("header", True).csv(path)


def read_scorecard_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORECARD).option("header", True).option("enforceSchema", False).csv(path)


def wide_to_long(df: DataFrame, ids: list[str], metrics: list[str], least: int = 3) -> DataFrame:
    """(ids, metric, value) with finite values only, for metrics that keep at least ``least`` rows."""
    long = df.select(*ids, *[finite(m).alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("metric").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return attach(long, counts, ["metric"]).drop("_n")


def size_list(config: dict) -> list[int]:
    """Explicit lengths (rounded, positive, distinct) or min:step:max."""
    if config.get("list"):
        out = sorted({round(x) for x in config["list"] if round(x) >= 1})
    else:
        out = list(range(config["min"], config["max"] + 1, max(1, round(config.get("step", 1)))))
    if not out:
        raise ValueError("no usable length")
    return out


#: Lengths of a condition that one row carries to a task.
STRETCH = 4096


def design_grid(conditions: DataFrame, lengths: Column, levels: dict[str, list[float]], runs: int) -> DataFrame:
    """Every (condition, length, noise bin, run) of an experiment.

    ``lengths`` is an array; stretches of it are dealt to tasks and meet levels and
    runs, which are short lists, there.  A level range (lo, hi, n) is spaced evenly.
    """
    level = F.lit(None)
    for cond, (lo, hi, n) in levels.items():
        arr = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("bin"), F.lit(lo + (hi - lo) * i / max(1, n - 1)).alias("level")) for i in range(int(n))])
        level = F.when(F.col("condition") == cond, arr).otherwise(level) if cond != "*" else F.coalesce(level, arr)
    own = conditions.columns
    d = conditions.distinct().withColumn("_all", F.array_distinct(lengths)).where(F.size("_all") > 0)
    d = d.withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(STRETCH))))
    d = spread(d.select(*own, "_at", F.slice("_all", F.col("_at"), STRETCH).alias("_part")), *own, "_at")
    d = d.select(*own, F.explode("_part").alias("length")).select("*", F.inline(level))
    return d.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def encoded_length(df: DataFrame, size: str, k: int, n: int) -> DataFrame:
    """Encoded length ceil(size/k)*n; sizes that collapse to one length are kept once."""
    return df.select((F.ceil(F.col(size) / k) * n).cast("bigint").alias("enc_len")).dropDuplicates()


def row_alignment(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tol: float = 0.0) -> DataFrame:
    """Do two tables hold the same rows?  Rows missing on either side and mismatches per column."""
    ja = a.select(*keys, F.lit(1).alias("_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    jb = b.select(*keys, F.lit(1).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    j = ja.join(jb, keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def differs(v):
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        return both & F.coalesce(F.abs(x - y) > tol, x.isNull() != y.isNull())

    return j.agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
        *[F.count(F.when(differs(v), 1)).alias(f"diff_{v}") for v in values])


def standardization_constants(df: DataFrame, keys: list[str], cols: list[str], scope: Column) -> DataFrame:
    """Mean, deviation and number of in-scope rows per condition and quantity."""
    one = F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).alias("v")) for c in cols])
    return df.where(scope).select(*keys, F.inline(one)).groupBy(*keys, "quantity").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))


def ensemble_mean(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Average of a metric over the seeded draws of a random method."""
    return df.groupBy(*keys).agg(F.count("*").alias("draws"), *[F.avg(m).alias(m) for m in metrics])
