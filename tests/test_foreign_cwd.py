"""Queries with Python workers must run from any working directory with a
plain session (the package is shipped to the workers)."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as E
print("entry", E.entry(spark).count())
print("exec", E.queries()["execute_examples"](spark, "/root/testdata/sf0.001").count())
"""


def test_runs_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", CODE], cwd=str(tmp_path), env=env,
                       capture_output=True, text=True, timeout=900)
    assert r.returncode == 0, r.stderr[-2000:]
    lines = [ln for ln in r.stdout.splitlines() if ln.startswith(("entry", "exec"))]
    assert lines[0] == "entry 50" and int(lines[1].split()[1]) > 0
