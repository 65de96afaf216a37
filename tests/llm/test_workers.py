"""Every query of a numbered operator where workers can't import the repository."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op"):
        query(spark, {sf!r}).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_workers_need_not_import_the_repository(tmp_path, sf):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=sf, folder=f"file://{tmp_path}/checkpoints")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert sorted(x.split()[1].split("_")[0] for x in done.stdout.splitlines() if x.startswith("ran ")) == sorted(f"op{n}" for n in range(1, 14))
