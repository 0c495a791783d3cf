"""Workers need no copy of the package: it lies on the driver's path only."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HEAD = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {at!r} + "/ck").getOrCreate()
"""

TRACES = """
from stackwave.sources import archives, sinks
rows = [("AA", "S1", "", "HHZ", 1_600_000_000_000_000, 1_600_000_001_000_000, 10.0, [float(i) for i in range(11)])]
sinks.write_traces(spark.createDataFrame(rows, archives.SEGMENTS), {at!r} + "/sds").collect()
x = archives.read_traces(spark, {at!r} + "/sds").collect()
assert len(x) == 1 and list(x[0].samples) == [float(i) for i in range(11)], x
from stackwave.plans import problems
assert problems.p3_found(spark, "/root/testdata/sf0.001").count() > 0 and problems.p5_found(spark, "/root/testdata/sf0.001").count() > 0
"""


def run_elsewhere(tmp_path, body):
    script = tmp_path / "job.py"
    script.write_text(HEAD.format(repo=REPO, at=str(tmp_path)) + body.format(at=str(tmp_path)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-3000:]


def test_traces_and_queries_from_another_folder(tmp_path):
    run_elsewhere(tmp_path, TRACES)
