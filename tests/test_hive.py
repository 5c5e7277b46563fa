"""Hive tables and functions, in a process of their own: a session has a Hive catalog from its start or never."""

from __future__ import annotations

import subprocess
import sys

SCRIPT = """
import sys
from tessera.sources import hive
spark = hive.session(sys.argv[1])
assert hive.available(spark)
x = spark.range(100).selectExpr("id", "CAST(id AS STRING) AS v", "IF(id % 10 = 0, NULL, id * 0.5D) AS d", "CAST(id % 3 AS INT) AS p")
for fmt in ("PARQUET", "ORC", "TEXTFILE"):
    hive.create(spark, f"t_{fmt}", x, fmt, ["p"])
    hive.insert(spark, f"t_{fmt}", x)
    back = spark.table(f"t_{fmt}")
    assert back.select(*x.columns).exceptAll(x).count() == 0 and back.count() == 100, fmt
    one = back.where("p = 1 AND id > 50")
    assert one.count() == x.where("p = 1 AND id > 50").count()
    print(fmt, one._jdf.queryExecution().executedPlan().toString())
    hive.insert(spark, f"t_{fmt}", x.where("p = 2").limit(5), overwrite=True)
    assert {(r.p, r["count"]) for r in spark.table(f"t_{fmt}").groupBy("p").count().collect()} == {(0, 34), (1, 33), (2, 5)}, fmt
hive.create(spark, "none", x)
assert spark.table("none").count() == 0
hive.function(spark, "h_upper", "org.apache.hadoop.hive.ql.udf.generic.GenericUDFUpper")
hive.function(spark, "h_max", "org.apache.hadoop.hive.ql.udf.generic.GenericUDAFMax")
hive.function(spark, "h_explode", "org.apache.hadoop.hive.ql.udf.generic.GenericUDTFExplode")
assert spark.sql("SELECT h_upper('ab') AS u, h_upper(CAST(NULL AS STRING)) AS n").first() == ("AB", None)
assert spark.sql("SELECT h_max(id) AS m FROM t_ORC").first().m == spark.table("t_ORC").agg({"id": "max"}).first()[0]
assert [r[0] for r in spark.sql("SELECT h_explode(array(1, 2))").collect()] == [1, 2]
print("all well")
"""


def test_hive_tables_and_functions(tmp_path):
    import os

    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    got = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "all well" in got.stdout, got.stderr[-3000:]
    text = got.stdout.split("TEXTFILE ")[1]
    assert "Scan hive" in text and "p#" in text and "FileScan parquet" in got.stdout and "FileScan orc" in got.stdout and "PartitionFilters: [isnotnull(p" in got.stdout


def test_without_hive(spark):
    from tessera.sources import hive

    assert not hive.available(spark)
