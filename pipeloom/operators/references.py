"""References to parent rows that do not exist, were deleted, or came later.

References and parent validity events are co-partitioned by key, sorted by time and merged in one
linear pass: a running count of open validity intervals tells at each reference whether some parent
row is valid.  The pass is a window with a running frame, so it streams and spills; a key's rows are
never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MARK, _EVENT, _REF = 0, 1, 2


def validity(parents: DataFrame, key: Column, valid_from: Column, valid_to: Column) -> DataFrame:
    """Parent intervals, pre-aggregated: per key and end only the earliest start is kept.

    The union of intervals with one end is the interval from the earliest start, so copies and
    reloads collapse before the shuffle.
    """
    rows = parents.select(key.alias("_key"), valid_from.alias("_from"), valid_to.alias("_to"))
    return rows.where("_key is not null").groupBy("_key", "_to").agg(F.min("_from").alias("_from"))


def hot_keys(df: DataFrame, key: str, share: float = 0.002) -> list[str]:
    """Superset of the keys that hold more than ``share`` of the rows; at most ``1 / share`` of them."""
    found = df.select(key).stat.freqItems([key], share).first()
    return [k for k in (found[0] if found else None) or [] if k is not None]


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    ref_key: Column,
    ref_time: Column,
    parent_key: Column,
    valid_from: Column,
    valid_to: Column,
    salts: int = 32,
    hot_share: float = 0.002,
) -> DataFrame:
    """Rows of ``refs`` with added ``ref_guid``, ``ref_time`` and ``orphan_kind``.

    ``orphan_kind`` is NULL where some parent row has ``valid_from <= t`` and ``valid_to`` NULL or
    ``> t``; otherwise ``missing`` (no parent row has the key), ``late`` (every one has
    ``valid_from > t``) or ``deleted``.

    * NULL key: no reference, the row is left out.
    * NULL time: only ``missing`` can be told; otherwise the reference counts as fine.
    * A parent without ``valid_from`` proves that the key exists but is never valid; one whose end
      is not after its start is never valid either.
    * Ties: a parent that begins at t is valid at t, one that ends at t is not.
    * Repeated rows are judged each, empty tables give no rows; columns of ``refs`` may have any
      names, those of the three added ones are replaced.

    Keys holding more than ``hot_share`` of the references are spread over ``salts`` tasks; the
    (pre-aggregated) parent rows of just those keys are repeated for each.
    """
    kept = [c for c in refs.columns if c.lower() not in ("ref_guid", "ref_time", "orphan_kind")]
    r = refs.select(F.struct(*kept).alias("_row"), ref_key.alias("_key"), ref_time.alias("_t")).where("_key is not null")
    hot = hot_keys(r, "_key", hot_share)
    is_hot = F.col("_key").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("_t", "_row"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    v = validity(parents, parent_key, valid_from, valid_to)
    real = F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_to") > F.col("_from")))
    event = lambda t, delta, start: F.struct(t.alias("_t"), F.lit(delta).alias("_delta"), start.alias("_start"))
    never = F.lit(None).cast("timestamp")
    events = v.select(
        "_key",
        F.explode(every).alias("_salt"),
        F.filter(
            F.array(
                F.struct(never.alias("_t"), F.lit(0).alias("_delta"), F.col("_from").alias("_start")),
                F.when(real, event(F.col("_from"), 1, never)),
                F.when(real & F.col("_to").isNotNull(), event(F.col("_to"), -1, never)),
            ),
            lambda e: e.isNotNull(),
        ).alias("_e"),
    ).select("_key", "_salt", F.inline("_e"))
    events = events.select(
        "_key", "_salt", "_t", "_start", "_delta", F.when(F.col("_t").isNull(), _MARK).otherwise(_EVENT).alias("_kind")
    )
    both = events.unionByName(
        r.select("_key", salt.alias("_salt"), "_t", "_row", F.lit(0).alias("_delta"), F.lit(_REF).alias("_kind")),
        allowMissingColumns=True,
    )
    run = W.partitionBy("_key", "_salt").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = both.select(
        "_key", "_t", "_row", "_kind",
        F.sum("_delta").over(run).alias("_open"),
        F.min("_start").over(run).alias("_first"),
        F.max(F.when(F.col("_kind") == _MARK, 1)).over(run).alias("_known"),
    ).where(F.col("_kind") == _REF)
    kind = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("_t").isNull() | (F.col("_open") > 0), None)
        .when(F.col("_first") <= F.col("_t"), "deleted")
        .otherwise("late")
    )
    return merged.select("_row.*", F.col("_key").alias("ref_guid"), F.col("_t").alias("ref_time"), kind.alias("orphan_kind"))


def orphan_report(orphans: DataFrame, table: str = "table_name", month: str = "ref_month") -> DataFrame:
    """References and distinct keys per table, period and kind; ``ok`` for references that are fine."""
    kind = F.coalesce("orphan_kind", F.lit("ok")).alias("orphan_kind")
    per_key = orphans.groupBy(table, month, kind, "ref_guid").agg(F.count("*").alias("n"))
    return per_key.groupBy(table, month, "orphan_kind").agg(
        F.sum("n").alias("n_refs"), F.count("*").alias("n_guids")
    )
