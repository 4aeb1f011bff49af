"""Tables in databases: embedded ones on several executors, odd values, and a server's."""

import json
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pyspark
import pytest
from compare import rows_of, rows_of_sql

from lakeloom.plans import catalog
from lakeloom.sources import databases, formats

CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from lakeloom.plans import catalog
home, data = sys.argv[1:]
b = SparkSession.builder.master("local-cluster[2,2,1024]").config("spark.executor.memory", "1g").config("spark.driver.host", "127.0.0.1")
spark = b.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{home}/shared").config("spark.sql.session.timeZone", "UTC").getOrCreate()
df = catalog.QUERIES["io_jdbc"](spark, data)
print(json.dumps([[r.c_custkey, r.c_name, str(r.balance)] for r in df.collect()]))
spark.stop()
"""


def test_customers_on_executors_with_folders_of_their_own(tmp_path, medium):
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    repo = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"PYTHONPATH": repo, "SPARK_HOME": f"{tmp_path}/home", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), medium], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    names, want = rows_of_sql("SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS s FROM customer WHERE c_custkey >= 100", medium)
    assert names == ["c_custkey", "c_name", "s"] and sorted(map(tuple, json.loads(run.stdout.splitlines()[-1]))) == sorted(want)


def test_odd_values_in_several_databases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(databases, "ROWS", 2)
    odd = [None, "", " ", "  x ", 'a "q", é\n,\\ z\r\n', '"', ",", "\t", "null", "a\0b", "'", "😀\u2028", "y" * 40_000]
    rows = [(None if i == 3 else -(2**63) if i == 4 else i, x, None if i % 3 == 0 else Decimal(-i).scaleb(-2), i % 2 == 0, i / 3) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, 'k long, `a "b"` string, m decimal(12,2), f boolean, d double')
    out = databases.embedded(df, f"{tmp_path}/jdbc")
    assert len(list((tmp_path / "jdbc").iterdir())) == 7
    assert out.schema.simpleString() == df.schema.simpleString() and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))
    none = databases.embedded(df.filter("d > 1000"), f"{tmp_path}/none")
    assert none.collect() == [] and none.columns == df.columns


def test_each_database_gets_the_filter(spark, small):
    df = catalog.QUERIES["io_jdbc"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan JDBCRelation") == plan.count("GreaterThanOrEqual(c_custkey,100)") == databases.PARTS


def test_a_folder_that_is_not_mounted_is_refused(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    with pytest.raises(ValueError, match="mounted"):
        databases.embedded(spark.range(3), "viewfs://store/in/jdbc")


def test_a_server_takes_and_gives_the_rows(spark, small, monkeypatch):
    monkeypatch.setattr(formats, "JDBC", {"driver": databases.DERBY, "url": "jdbc:derby:memory:tests;create=true"})
    assert rows_of(catalog.QUERIES["io_jdbc"](spark, small)) == rows_of_sql(catalog.ORACLES["io_jdbc"], small)
