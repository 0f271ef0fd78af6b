"""Exact row numbers of one global order, without a single-task window.

Rows are range-partitioned and sorted, numbered within their partition, and moved up by the rows of the
earlier partitions: one count per partition, which is all that reaches the driver's plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.session import cut_lineage, fresh, shuffle_width


def _local(added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(seen, seen + n, dtype=np.int64))], names=[*b.schema.names, *added])
            seen += n

    return run


def numbered(df: DataFrame, *order: Column, name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: its place from 1 in the given order, which should be total; a column of that name is replaced."""
    ranged = df.repartitionByRange(partitions or shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    part, place, other, earlier = fresh(df, "_part", "_local", "_p", "_before")
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])
    local = cut_lineage(ranged.mapInArrow(_local([part, place]), schema))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    counts = local.groupBy(part).agg(F.count("*").alias("n")).select(F.col(part).alias(other), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(earlier))
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return local.join(F.broadcast(counts), F.col(part) == F.col(other)).select(*kept, (F.col(earlier) + F.col(place) + 1).alias(name))
