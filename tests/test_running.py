"""Running sums over hot groups against Spark's own windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.operators.running import running_sums
from newsloom.scratch import Scratch


def plain(df, group):
    w = Window.partitionBy(*group).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return {(r.id, r.n) for r in df.withColumn("n", F.coalesce(F.sum("v").over(w), F.lit(0))).collect()}


def test_one_hot_group_is_spread(spark):
    df = spark.range(100_000).select("id", F.lit("2024-01").alias("month"), (F.col("id") * 7919 % 1000).alias("at"), (F.col("id") % 5 - 1).alias("v"), F.lit("own").alias("sum"))
    scratch = Scratch(spark, "running")
    out = running_sums(df, [F.col("month")], [F.col("at"), F.col("id")], F.col("v"), pieces=8, scratch=scratch)
    assert out.columns == [*df.columns, "before"] and {(r.id, r.before) for r in out.collect()} == plain(df, ["month"])
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch.root}/1").groupBy("__piece").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 100_000 / 8


def test_many_groups_nulls_and_ties(spark):
    rows = [(i, ["a", "b", None, "c" * (i % 3)][i % 4], i * 31 % 17, None if i % 11 == 0 else i % 7 - 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, at long, v long")
    for pieces in (1, 3, 16):
        out = running_sums(df, [F.col("g")], [F.col("at"), F.col("id")], F.col("v"), pieces=pieces)
        assert {(r.id, r.before) for r in out.collect()} == plain(df, ["g"])
    down = running_sums(df, [], [F.desc("id")], F.lit(1), "later").collect()
    assert all(r.later == 2999 - r.id for r in down)
    assert running_sums(df.limit(0), [F.col("g")], [F.col("id")], F.col("v")).collect() == []
