"""Distributed prefix sums over range-sorted rows: no task owns a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import stored

#: Columns that prefix_sums adds.
BEFORE, TOTAL = "_before", "_total"


def _running(group: str, value: str, names: list[str]):
    """Sums of value over the earlier rows of the same group in the same partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, held = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(group).to_pylist()
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(values)
            first = np.fromiter((i == 0 or groups[i] != groups[i - 1] for i in range(n)), bool, n)
            begins = np.flatnonzero(first)
            run_of = np.cumsum(first) - 1
            before = upto - values - (upto - values)[begins][run_of]
            if groups[0] == last:
                before[run_of == 0] += held
            last, held = groups[-1], int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(n, part, np.int64))], names=names)

    return run


def prefix_sums(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add _before, the sum of value over the rows of the same group that come earlier, and _total, the group's sum.

    Rows are range-sorted by (group, order), so a group that holds a third of all rows is spread over
    a third of the partitions. Each partition sums its own rows as they stream by; one sum per
    partition and group is ordered, and joined back. The group must not be null (the string column
    is made by the caller), value is a non-negative long; null order values come first. Rows equal
    in all order columns get their places in any order. Rows are stored before the sort, as range
    sorting reads them twice. No rows give no rows.
    """
    kept = stored(rows, f"{name}-rows")
    schema = StructType(kept.schema.fields).add(BEFORE, LongType()).add("_part", LongType())
    placed = kept.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = stored(placed.mapInArrow(_running(group, value, schema.names), schema), f"{name}-sorted")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(group, "_part").agg(F.sum(value).alias("_own"))
    sums = sums.select(group, "_part", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_base"), F.sum("_own").over(Window.partitionBy(group)).alias(TOTAL))
    return local.join(sums, [group, "_part"]).withColumn(BEFORE, F.col(BEFORE) + F.col("_base")).drop("_base", "_part")


__all__ = ["BEFORE", "TOTAL", "prefix_sums"]
