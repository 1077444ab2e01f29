"""The embedded database: what was written is read, also by processes that didn't write it."""

import json
import os
import subprocess
import sys

import pyspark
import pytest
from pyspark.sql import functions as F

from tallyforge.sources import embedded, loaders

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DIR = "/root/testdata/sf0.001"

CLUSTER = """
import json, sys
from pyspark.sql import SparkSession, functions as F
from tallyforge.plans import catalog
from tallyforge.sources import embedded
shared, d = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.checkpoint.dir": f"file://{shared}", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
nations = catalog.queries()["scan_jdbc"](spark, d)
first = [r.asDict() for r in nations.collect()]
again = [r.asDict() for r in nations.collect()]
found = embedded.write_jdbc(spark, spark.range(400), "IDS")
ids = spark.read.format("jdbc").options(dbtable="IDS", partitionColumn="id", lowerBound="0", upperBound="400", numPartitions="8", **found).load()
print("FOUND" + json.dumps([first, again, ids.agg(F.count("id"), F.sum("id")).first()]))
"""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_every_executor_reads(spark, tmp_path):
    """On a driver and two executors, the shared folder given with its scheme."""
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    home.mkdir()
    for x in os.listdir(os.path.dirname(pyspark.__file__)):
        if x != "work":
            (home / x).symlink_to(os.path.join(os.path.dirname(pyspark.__file__), x))
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path / "shared"), DIR], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    first, again, ids = json.loads(done.stdout.rpartition("FOUND")[2])
    want = [r.asDict() for r in spark.read.parquet(f"{DIR}/nation.parquet").selectExpr("n_nationkey", "n_name", "round(n_regionkey / sum(n_regionkey) over (), 9) AS share").collect()]
    for rows in (first, again):
        assert sorted(rows, key=lambda r: r["n_nationkey"]) == sorted(want, key=lambda r: r["n_nationkey"])
    assert ids == [400, 400 * 399 // 2]


def test_values_come_back(spark):
    rows = [(1, "a", 0.5, 2**62 + 1), (2, None, None, None), (None, "x" * 50_000 + "ü", 1e-300, -5), (3, "", 0.1 + 0.2, 0), (4, ' a "q" , ,\n\r\n b ', 1 / 3, 1), (5, '"', 1.0, 1), (6, "NULL", 1.0, -(2**63))]
    df = spark.createDataFrame(rows, 'K int, NAME string, W double, `l"x` long')
    got = loaders.read_jdbc(spark, table="T", **embedded.write_jdbc(spark, df, "T"))
    assert got.dtypes == df.dtypes and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    assert loaders.read_jdbc(spark, table="T", weight="W", **embedded.write_jdbc(spark, df.limit(0), "T")).count() == 0
    with pytest.raises(ValueError):
        embedded.write_jdbc(spark, df.select(F.current_date().alias("d")), "T")
