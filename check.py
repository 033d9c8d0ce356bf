"""Compare registered queries with their SQL: python check.py [sf] [name prefix ...]."""

import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from scatterframe.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tests.compare import compare, oracle_connection  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    pick = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    path = f"/root/testdata/{sf}"
    con = oracle_connection(path)
    bad = 0
    for name, fn in QUERIES.items():
        if pick and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in pick):
            continue
        t = time.time()
        try:
            df = fn(spark, path)
            if name in ORACLES:
                msg = compare(df, ORACLES[name], con, empty_ok=sf == "sf0.001")
            else:
                msg = None if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.2f}s {'' if name in ORACLES else '(rows only) '}{msg or ''}", flush=True)
    print("failures:", bad)
