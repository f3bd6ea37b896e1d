"""Embedded databases while tasks run in other processes than the driver's."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
from tarnlake import catalogue, sources
from tarnlake.plans import publish

home, data = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1000]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{home}/shared", "spark.sql.warehouse.dir": f"{home}/warehouse", "spark.driver.extraJavaOptions": f"-Dderby.system.home={home}"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
told = {n: [list(r) for r in catalogue.QUERIES[n](spark, data).collect()] for n in ("publish", "jdbc_partitions", "jdbc_where", "schema_exists")}

url = f"jdbc:derby:{home}/db;create=true"
rows = spark.range(2_500).selectExpr("id - 10 AS id", "CASE WHEN id % 3 > 0 THEN repeat('x', CAST(id % 3 - 1 AS INT)) END AS s").union(spark.createDataFrame([(None, "none")], "id bigint, s string"))
sources.jdbc.READ_ROWS = 1000
told["many"] = [list(r) for r in publish(spark, {"big": rows}, url, batch_size=700, attempts=2).collect()]
same = lambda df: df.count() == rows.count() and df.exceptAll(rows).isEmpty()
told["plain"] = same(sources.read_jdbc(spark, url, "big"))
told["parted"] = [same(sources.read_jdbc(spark, url, **how, parts=sources.Parts("id", 0, 900, 4))) for how in ({"table": "big"}, {"query": 'SELECT "id", "s" FROM big'})]
sources.write_jdbc(rows, url, "big", mode="ignore")
sources.write_jdbc(rows.limit(3), url, "big", mode="append")
told["appended"] = sources.read_jdbc(spark, url, "big").count()
told["empty"] = sources.read_jdbc(spark, url, query='SELECT "s" FROM big WHERE 1 = 0').collect()
try:
    sources.write_jdbc(rows.selectExpr("raise_error('no') AS s"), url, "big", mode="append")
except Exception:
    told["after failure"] = sources.read_jdbc(spark, url, "big").count()
print("TOLD" + json.dumps(told))
spark.stop()
"""


@pytest.fixture(scope="module")
def told(tmp_path_factory):
    home = tmp_path_factory.mktemp("embedded")
    (home / "spark/work").mkdir(parents=True)  # the executors' logs go there
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / "spark" / p.name).symlink_to(p)
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "SPARK_HOME": str(home / "spark"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(home), "/root/testdata/sf0.001"], env=env, cwd=home, capture_output=True, text=True, timeout=300)
    found = [line[4:] for line in out.stdout.splitlines() if line.startswith("TOLD")]
    assert found, out.stderr[-3000:]
    return json.loads(found[0])


def test_publish(told):
    assert [r[0] for r in told["publish"]] == ["nation", "region", "supplier"] and all(r[1] == r[2] > 0 and r[3] for r in told["publish"])
    assert told["many"] == [["big", 2_501, 2_501, True]] and told["plain"]
    assert told["appended"] == 2_504 and told["empty"] == [] and told["after failure"] == 2_504


def test_parts(told):
    assert sorted(r[0] for r in told["jdbc_partitions"]) == list(range(25)) and told["parted"] == [True, True]


def test_filter(told):
    assert sorted(told["jdbc_where"]) == sorted([f"NATION_{i}", 1] for i in range(1, 25, 5))


def test_schemas(told):
    assert sorted(told["schema_exists"]) == [["APP", True], ["NOPE", False]]
