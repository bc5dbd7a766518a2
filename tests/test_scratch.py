"""Scratch tables where the session names no folder, in a session of its own."""

import os
import subprocess
import sys
import tempfile
import time

from pyspark.sql import functions as F

from newsloom.scratch import CLEANUP, Scratch

CODE = """
from pyspark.sql import SparkSession
from newsloom.operators.components import connected_components
from newsloom.scratch import Scratch, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "u long, v long")
found = {r.id: r.component for r in connected_components(spark.range(1, 10).where("id < 4 or id > 6 and id < 9"), edges).collect()}
assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}, found
assert shared_dir(spark) == shared_dir(spark)
with Scratch(spark, "t") as scratch:
    assert scratch.save(spark.range(3)).count() == 3
print("done")
"""


def test_session_without_a_folder():
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="spark-conf-")}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]


def test_shuffle_files_go_with_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    was, before = spark.conf.get(CLEANUP), names()
    with Scratch(spark, "t") as scratch:
        sums = spark.range(0, 1000, 1, 4).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
        saved, end = scratch.save(sums), time.time() + 20
        while (left := names() - before) and time.time() < end:  # executors delete by themselves
            time.sleep(0.1)
        assert not left
        assert sorted(map(tuple, scratch.save(sums).collect())) == sorted(map(tuple, saved.collect())) == sorted(map(tuple, sums.collect()))
    assert spark.conf.get(CLEANUP) == was
