"""Ordered running sums over groups of any size, without a task for a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.scratch import Scratch

#: Partial sums of up to so many (group, piece) pairs are broadcast; more are joined.
BROADCAST_ROWS = 1_000_000


def running_sums(df: DataFrame, group: list[Column], order: list[Column], value: Column, out_col: str = "before", pieces: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``out_col`` (long): the sum of ``value`` over the rows of the same group that come before in ``order``.

    Rows are dealt by ranges of (group, order), so that a group of any size is spread over pieces of about one size; each piece is added up as it
    streams by, and only the pieces' totals are put in order: one row for each group in a piece. ``order`` must tell all rows apart for the sums to be
    determined; the sum of each row's own group is right in any case. A null group is a group; a null value adds nothing. Rows and other columns stay.
    """
    scratch = scratch or Scratch(df.sparkSession, "running")
    keys = [f"__g{i}" for i in range(len(group))]
    rows = df.withColumns({**{k: g for k, g in zip(keys, group, strict=True)}, "__value": F.coalesce(value.cast("long"), F.lit(0).cast("long"))})
    by = [*(F.col(k).asc() for k in keys), *order]
    dealt = rows.repartitionByRange(pieces, *by) if pieces else rows.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(*by).withColumns({"__group": F.to_json(F.struct(*(F.col(k) for k in keys))) if keys else F.lit(""), "__piece": F.lit(0), "__local": F.lit(0).cast("long")})
    kind = dealt.schema

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = np.asarray(table.column("__group").combine_chunks().dictionary_encode().indices)
            words = table.column("__group").combine_chunks()
            value = np.asarray(table.column("__value"), dtype=np.int64)
            new = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else names
            total = np.cumsum(value) - value
            base = total[new].copy() if len(new) else total
            if len(new) and words[0].as_py() == last:
                base[0] -= held  # the group goes on from the batch before
            local = total - np.repeat(base, np.diff(np.r_[new, len(names)]))
            if len(names):
                last, held = words[len(names) - 1].as_py(), int(local[-1] + value[-1])
            for name, column in (("__piece", pa.array(np.full(len(names), piece, dtype=np.int32))), ("__local", pa.array(local))):
                table = table.set_column(table.schema.get_field_index(name), name, column)
            yield from table.to_batches()

    local = scratch.save(dealt.mapInArrow(summed, kind))
    totals = scratch.save(local.groupBy("__group", "__piece").agg(F.sum("__value").alias("sum")))
    before = F.sum("sum").over(Window.partitionBy("__group").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__group", "__piece", F.coalesce(before, F.lit(0)).alias("__offset"))
    offsets = F.broadcast(offsets) if totals.count() <= BROADCAST_ROWS else offsets
    out = local.join(offsets, ["__group", "__piece"])
    return out.select(*df.columns, (F.col("__local") + F.col("__offset")).cast("long").alias(out_col))
