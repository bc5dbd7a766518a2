"""A log of changes of a table, and tables that follow it.

Every write of the table adds a version to the log: the rows that came or changed, and the ids of those that went. Followers are streams over the log's files, each with its own checkpoint, so each has
its own offset, and one that was away catches up. What a follower derives is kept by version: a version that is applied again writes the same part again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.scratch import Scratch
from newsloom.streaming.streams import Parts


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``after`` that ``before`` doesn't have so, and of keys that are gone rows of nulls; ``gone`` tells which. Both tables have one row a key; a null key is no row."""
    same = F.xxhash64(*after.columns), F.hash(*after.columns)  # nearly 96 bits for each row of one key
    was = before.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.struct(*same).alias("__was"))
    now = after.where(F.col(key).isNotNull()).withColumns({"__is": F.struct(*same)})
    both = was.join(now, F.col("__key") == F.col(key), "full").where(~F.col("__was").eqNullSafe(F.col("__is")))
    out = both.withColumn("gone", F.col(key).isNull()).withColumn(key, F.coalesce(key, "__key"))
    return out.select(*after.columns, "gone")


class ChangeLog:
    """The log of one table at ``path``: a file set a version, in folders of no meaning to readers, named so that a version that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.key = spark, path.rstrip("/"), "id"
        self.schema = T.StructType([*schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("version", T.LongType())])

    def record(self, changes: DataFrame, version: int) -> None:
        """Adds ``changes`` (rows of the table with ``gone``) as a version. One that is there already stays as it is: followers may have read it."""
        if version not in self.versions():
            rows = changes.withColumn("version", F.lit(version).cast("long")).select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
            rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}", "_SUCCESS")))

    def replace(self, before: DataFrame, after: DataFrame, version: int) -> DataFrame:
        """Records what a repair or an upsert changed, and gives ``after`` back."""
        self.record(changed_rows(before, after, self.key), version)
        return after

    def stream(self, files: int | None = None) -> DataFrame:
        """The log as a stream, ``files`` a micro-batch."""
        reader = self.spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{self.path}/v*")


class Derived:
    """A table at ``path`` that ``make`` derives from rows of the logged one, each row for itself, with the row's ``id`` among its columns."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], schema: str):
        self.spark, self.make, self.schema = spark, make, schema
        self.rows, self.seen = Parts(spark, f"{path.rstrip('/')}/rows"), Parts(spark, f"{path.rstrip('/')}/seen")

    def apply(self, batch: DataFrame, n: int) -> None:
        """Applies the changes of batch ``n``: of each id the last version counts."""
        with Scratch(self.spark, "derived") as scratch:
            columns = [c for c in batch.columns if c != "id"]
            last = batch.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("row")).select("id", "row.*").withColumn("batch", F.lit(n).cast("long"))
            last = scratch.save(last)
            self.rows.write(self.make(last.where("not gone").drop("gone", "version", "batch")).join(last.select("id", "version", "batch"), "id"), n)
            self.seen.write(last.select("id", "version", "batch"), n)

    def _last(self, below: int | None) -> DataFrame:
        """Of each id the last version, and the last batch that brought it."""
        last = self.seen.read("id long, version long, batch long", below).groupBy("id").agg(F.max(F.struct("version", "batch")).alias("last"))
        return last.select("id", "last.*")

    def _rows(self, below: int | None) -> DataFrame:
        return self.rows.read(f"{self.schema}, version long, batch long", below).join(self._last(below), ["id", "version", "batch"], "left_semi")

    def read(self, below: int | None = None) -> DataFrame:
        """The derived rows of each id's last version. Versions count, whatever batches they came in; an id that is gone has a last version without rows."""
        return self._rows(below).drop("version", "batch")

    def compact(self, before: int) -> None:
        """Puts the parts before batch ``before`` together."""
        if self.rows.last(before) < before - 1:
            with Scratch(self.spark, "derived") as scratch:
                rows, last = scratch.save(self._rows(before)), scratch.save(self._last(before))
                self.rows.compact(rows, before)
                self.seen.compact(last, before)

    def follow(self, log: ChangeLog, checkpoint: str, files: int | None = None, **trigger) -> StreamingQuery:
        """Applies what the log holds beyond this follower's offset."""
        stream = log.stream(files)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
