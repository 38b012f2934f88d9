"""The driver contract works from another working directory (no installed package)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("se", {os.path.join(REPO, "__spark_entry__.py")!r})
se = importlib.util.module_from_spec(spec)
spec.loader.exec_module(se)
n = se.entry(spark).count()
m = se.queries()["udf_02"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n, m)
"""


def test_entry_from_elsewhere():
    cwd = tempfile.mkdtemp(prefix="issuelens-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                       text=True, timeout=600)
    line = [x for x in r.stdout.splitlines() if x.startswith("ROWS")]
    assert r.returncode == 0 and line, r.stderr[-2000:]
    n, m = map(int, line[0].split()[1:])
    assert n > 0 and m > 0
