"""Failures that reading and exporting must raise."""

import pytest
from pyspark.sql import functions as F

from scatterframe.functions import dims
from scatterframe.operators import blockload as bl
from scatterframe.operators import reorder as ro
from scatterframe.sources import io


def test_decode_refuses_gaps_and_unknown_codes(spark):
    d = spark.createDataFrame([(1,), (2,)], "method_id bigint")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "method_id bigint, method string")
    assert {r["method"] for r in io.decode_category(d, good, "method").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        io.decode_category(d, spark.createDataFrame([(1, "a"), (3, "b")], "method_id bigint, method string"), "method")
    with pytest.raises(ValueError):
        io.decode_category(spark.createDataFrame([(5,)], "method_id bigint"), good, "method")


def test_export_refuses_unlisted_names(spark):
    d = spark.createDataFrame([("a", 1), ("z", 2)], "method string, v int")
    allow = spark.createDataFrame([("a",)], "method string")
    with pytest.raises(ValueError, match="z"):
        io.export_csv_gz(d, io.shared_folder(spark), allow)
    path = io.shared_folder(spark)
    io.export_csv_gz(d, path, allow, ["z"])
    assert spark.read.option("header", True).csv(path).count() == 1


def test_name_parts(spark):
    d = spark.createDataFrame([("trials_ge1p00_common_260912_3",)], "n string").select(*[c.alias(k) for k, c in io.name_parts("n").items()])
    r = d.first()
    assert (r["variable"], r["regime"], r["grid"], str(r["run_date"]), r["version"]) == ("trials", "ge1p00", "common", "2026-09-12", 3)


def test_size_list():
    assert io.size_list({"list": [3.2, 3, 0, 9]}) == [3, 9]
    assert io.size_list({"min": 60, "step": 60, "max": 200}) == [60, 120, 180]
    with pytest.raises(ValueError):
        io.size_list({"list": [0]})


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        dims.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b", "c"])


def test_frames_without_hits_keep_their_defaults(spark):
    f = spark.range(60).select(F.floor(F.col("id") / 30).alias("frame_id"), (F.col("id") % 30 + 1).alias("pos"), F.lit(30).cast("bigint").alias("n_rows"),
                               ((F.col("id") >= 30) & (F.col("id") < 36)).cast("int").alias("hit"))
    perm = ro.permutations(spark, ["block"], 30)
    for dense in (False, True):
        s = bl.load_stats(bl.block_loads(f, perm, 10, dense=dense), 10, 2).where("phase = 'after'").orderBy("frame_id").collect()
        assert [r["blocks"] for r in s] == [3, 3]
        assert (s[0]["hits"], s[0]["uniformity"], s[0]["gini"], s[0]["eta_es"]) == (0, 1.0, 0.0, 1.0)
        assert (s[1]["hits"], s[1]["noisy_blocks"]) == (6, 3)


def test_design_grid_is_dealt_by_stretches(spark, monkeypatch):
    """One condition's lengths unfold in many tasks; repeated conditions and lengths count once."""
    monkeypatch.setattr(io, "STRETCH", 7)
    c = spark.createDataFrame([("A", 300), ("N", 40), ("A", 300)], "condition string, top bigint")
    lengths = F.concat(F.sequence(F.lit(1).cast("bigint"), "top"), F.array(F.lit(3).cast("bigint")))
    d = io.design_grid(c, lengths, {"A": (0.0, 1.0, 2), "N": (0.5, 0.5, 1)}, 3)
    got = [(r["condition"], r["length"], r["bin"], r["run"]) for r in d.collect()]
    want = {("A", n, b, r) for n in range(1, 301) for b in (1, 2) for r in (1, 2, 3)} | {("N", n, 1, r) for n in range(1, 41) for r in (1, 2, 3)}
    assert len(got) == len(want) and set(got) == want
    tasks = d.where(F.col("condition") == "A").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
