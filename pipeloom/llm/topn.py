"""Top N items within every group, by exact positions in one global order.

The rows are range-partitioned and sorted on (groups, score descending, identifier), so a group of
any size is spread over neighbouring partitions.  Each partition counts its rows per group while it
streams; the counts are prefix-summed over the partitions of a group, which turns local ranks into
exact positions in the group, and positions up to N are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeloom.session import fresh, shuffle_width


def _differs(column: pa.Array) -> np.ndarray:
    """True where a value is not that of the row before; NULL equals NULL."""
    a, b = column[1:], column[:-1]
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) ^ b.is_null().to_numpy(zero_copy_only=False))


def _local_positions(groups: list[str], n: int, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        seen = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(g) for g in groups]
            starts = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                starts[1:] |= _differs(k)
            first = tuple(k[0].as_py() for k in keys)
            carried = seen if first == last else 0
            starts[0] = True
            at = np.flatnonzero(starts)
            sizes = np.diff(np.append(at, batch.num_rows))
            local = np.arange(batch.num_rows) - np.repeat(at, sizes) + 1
            local[: sizes[0]] += carried
            last, seen = tuple(k[-1].as_py() for k in keys), int(local[-1])
            keep = np.flatnonzero(local <= n)
            if len(keep):
                out = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(np.full(len(keep), part, dtype=np.int32)), pa.array(local[keep].astype(np.int64))],
                    names=[*out.schema.names, *added],
                )

    return run


def top_n_per_group(
    df: DataFrame, groups: list[str], score: str, ident: str, n: int, *, partitions: int | None = None, position: str = "position"
) -> DataFrame:
    """The first ``n`` rows of every group by ``score`` descending, then ``ident`` ascending.

    All columns of ``df`` are kept and ``position`` (1 to n) is added.

    * NULL group values form a group of their own; NULL scores come last, NaN counts as the largest.
    * Ties in the score are settled by ``ident``; rows alike in both are kept as separate rows, in
      either order.
    * An empty table gives no rows, ``n`` below 1 too; columns may have any names, one named like
      ``position`` is replaced.
    """
    parts = partitions or shuffle_width(df.sparkSession)
    order = [F.col(g).asc_nulls_first() for g in groups] + [F.col(score).desc_nulls_last(), F.col(ident).asc_nulls_first()]
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    part, local = fresh(df, "_part", "_local")
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(local, T.LongType())])
    kept = ranged.mapInArrow(_local_positions(groups, n, [part, local]), schema)
    # a partition that holds n or more rows of a group has kept n of them, so counts of kept rows decide alike;
    # only the first group of a partition can have begun before it, so at most one row per partition is broadcast
    counts = kept.groupBy(*groups, part).agg(F.count("*").alias("n_of_part"))
    before = W.partitionBy(*groups).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    other, offset, *keyed = fresh(kept, "_p", "_offset", *[f"_g_{g}" for g in groups])
    begun = F.sum("n_of_part").over(before)
    offsets = counts.select(*[F.col(g).alias(k) for g, k in zip(groups, keyed)], F.col(part).alias(other), begun.alias(offset)).where(F.col(offset) > 0)
    same = F.col(part) == F.col(other)
    for g, k in zip(groups, keyed):
        same = same & F.col(g).eqNullSafe(F.col(k))
    place = F.col(local) + F.coalesce(F.col(offset), F.lit(0))
    out = kept.join(F.broadcast(offsets), same, "left").withColumn(position, place.cast("int")).where(F.col(position) <= n)
    return out.drop(part, local, other, offset, *keyed)


def latest_version(df: DataFrame, ident: str, version: str) -> DataFrame:
    """One row per ``ident``: the one with the greatest ``version``; NULL versions come first.

    Among rows of equal version the greatest row counts, so exact copies collapse and the choice
    does not depend on the order of the input.
    """
    rest = [c for c in df.columns if c not in (ident, version)]
    best = df.groupBy(ident).agg(F.max(F.struct(version, *rest)).alias("_best"))
    return best.select(ident, "_best.*").select(*df.columns)
