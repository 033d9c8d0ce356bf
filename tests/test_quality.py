"""A clean generated campaign passes; each damage makes exactly its own check fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scatterframe.operators import kpi as kp
from scatterframe.operators import quality as qa

LEVELS = [0.02, 0.06, 0.10]
METHODS = ["S", "block", "drp", "goldenRP"]


@pytest.fixture(scope="module")
def campaign(spark):
    rng = np.random.default_rng(9)
    rows = []
    for cond in ("single_common", "multi_common"):
        for length in range(120, 1381, 60):
            for b, level in enumerate(LEVELS, 1):
                for run in range(10):
                    base = 0.30 + 0.05 * rng.random()
                    for m in METHODS:
                        inter = round(1.012 * length) if m == "block" else length
                        rows.append((cond, f"{length}-{b}-{run}", m, float(length), float(inter), b, level, round(level * length) / inter, base, base * (0.10 + 0.40 * rng.random())))
    pdf = pd.DataFrame(rows, columns=["condition", "trial", "method", "enc_len", "int_len", "bin", "target", "actual", "err_base", "err"])
    d = kp.res_composite(kp.zscore(kp.kpi_core(spark.createDataFrame(pdf)), ["condition"], ["cr", "be"]))
    return d.withColumn("cr_again", F.col("cr")).cache()


KEY = ["condition"]


def ok(df):
    return all(r["ok"] for r in df.collect())


def checks(d):
    return {
        "inventory": ok(qa.condition_inventory(d.select("condition").distinct(), 2)),
        "occupancy": ok(qa.cell_occupancy(d, KEY, ["method", "enc_len", "bin"], 10)),
        "pairing": ok(qa.pairing(d, KEY, ["trial"], ["enc_len", "bin"])),
        "resolution": ok(qa.length_resolution(d, KEY, "enc_len", 22)),
        "integrity": ok(qa.field_integrity(d, KEY, ["res", "cr", "be", "actual", "err"])),
        "kpi": ok(qa.kpi_reconstruction(d, KEY)),
    }


def test_clean_campaign(campaign):
    assert all(checks(campaign).values())


def damaged(campaign, what):
    if what == "inventory":
        return campaign.where(F.col("condition") != "multi_common")
    if what == "occupancy":
        return campaign.where(~((F.col("method") == "S") & (F.col("trial") == "120-1-3")))
    if what == "pairing":
        moved = F.when((F.col("method") == "drp") & (F.col("trial") == "180-2-4"), F.lit("240-2-4")).otherwise(F.col("trial"))
        return campaign.withColumn("trial", moved)
    if what == "resolution":
        return campaign.withColumn("enc_len", F.when(F.col("enc_len") < 700, 300.0).otherwise(900.0))
    if what == "integrity":
        return campaign.withColumn("res", F.when(F.col("trial").endswith("-9"), F.lit(float("nan"))).otherwise(F.col("res")))
    return campaign.withColumn("res", F.when(F.col("method") == "S", F.col("res") * 1.05 + 0.01).otherwise(F.col("res")))


@pytest.mark.parametrize("what", ["inventory", "occupancy", "pairing", "resolution", "integrity", "kpi"])
def test_damage_is_found(campaign, what):
    assert checks(damaged(campaign, what))[what] is False


@pytest.mark.parametrize("out", [[], ["drp"], ["block", "S"]])
def test_excluded_methods_are_named(campaign, out):
    d = campaign.drop("cr_z", "be_z", "res")
    d = kp.res_composite(kp.zscore(d, KEY, ["cr", "be"], ~F.col("method").isin(out) if out else None))
    got = qa.kpi_reconstruction(d, KEY).collect()
    if out == ["block", "S"]:  # without block every length ratio is 1 and nothing can be standardised
        assert not any(r["ok"] for r in got)
    else:
        assert all(r["ok"] and r["left_out"] == ",".join(sorted(out)) for r in got)


def test_residual_shape_matches_residuals(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"c": "a", "k": rng.integers(0, 9, 500), "v": rng.gamma(2, size=500)})
    r = pdf.v - pdf.groupby("k").v.transform("mean")
    z = (r - r.mean()) / r.std()
    got = qa.residual_shape(spark.createDataFrame(pdf), ["c"], ["k"], "v").first()
    assert got["skewness"] == pytest.approx((z**3).mean()) and got["kurtosis"] == pytest.approx((z**4).mean())


def test_verdict(spark):
    d = spark.createDataFrame([("x", "a", True, True), ("y", "a", False, False), ("x", "b", True, False), ("x", "c", True, True)],
                              "check string, condition string, blocking boolean, ok boolean")
    assert {r["condition"]: r["verdict"] for r in qa.verdict(d).collect()} == {"a": "QUOTABLE WITH CAVEATS", "b": "NOT QUOTABLE", "c": "QUOTABLE"}
