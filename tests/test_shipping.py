import os
import subprocess
import sys
from pathlib import Path

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as driver
print("ROWS", driver.entry(spark).count())
"""


def test_workers_get_the_package(tmp_path):
    """A session that neither starts in this folder nor has it in PYTHONPATH."""
    root = str(Path(__file__).parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout and int(done.stdout.split()[-1]) > 0, done.stderr[-2000:]
