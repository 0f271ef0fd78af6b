"""Exact running sums within groups of any size.

The rows are range-partitioned and sorted on (groups, order); each partition sums while it streams, the
sums per partition and group are prefix-summed, and each row adds the sum of its group's earlier
partitions.  The sums are integers, so the result does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.llm.topn import _differs
from pipeloom.session import cut_lineage, fresh, shuffle_width


def _local_sums(groups: list[str], value: str, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        total = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            for g in groups:
                starts[1:] |= _differs(batch.column(g))
            starts[0] = True
            at = np.flatnonzero(starts)
            sizes = np.diff(np.append(at, n))
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            before -= np.repeat(before[at], sizes)
            if tuple(batch.column(g)[0].as_py() for g in groups) == last:
                before[: sizes[0]] += total
            last = tuple(batch.column(g)[-1].as_py() for g in groups)
            total = int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(before)], names=[*batch.schema.names, *added]
            )

    return run


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (whole numbers, no NULL) over the group's earlier rows.

    ``order`` must tell the rows of a group apart; rows alike in it get their sums in either order.
    NULL group values form a group; a column named ``name`` is replaced.  Groups may be of any size and number: only the first group of
    a partition can have begun before it, so at most one row per partition is broadcast.
    """
    parts = shuffle_width(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    part, before, other, offset = fresh(df, "_part", "_before", "_p", "_offset")
    keyed = fresh(df, *[f"_g_{g}" for g in groups])
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(before, T.LongType())])
    local = cut_lineage(ranged.mapInArrow(_local_sums(groups, value, [part, before]), schema))
    sums = local.groupBy(*groups, part).agg(F.sum(value).alias("sum_of_part"))
    earlier = W.partitionBy(*groups).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("sum_of_part").over(earlier), F.lit(0))
    offsets = sums.select(*[F.col(g).alias(k) for g, k in zip(groups, keyed)], F.col(part).alias(other), begun.alias(offset)).where(F.col(offset) != 0)
    same = F.col(part) == F.col(other)
    for g, k in zip(groups, keyed):
        same = same & F.col(g).eqNullSafe(F.col(k))
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return local.join(F.broadcast(offsets), same, "left").select(*kept, (F.col(before) + F.coalesce(F.col(offset), F.lit(0))).alias(name))
