import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys; sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["html_extract"](spark, {data!r}).count())
"""


def test_workers_find_the_package_from_any_folder(data, tmp_path):
    home = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(home=home, data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
