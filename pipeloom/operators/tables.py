"""Table maintenance: upsert, incremental refresh, graph and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in their place by key; ``new`` must be unique by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def refresh_plan(computed: DataFrame, stored: DataFrame, key: str, fingerprint: str, status: str = "status") -> DataFrame:
    """(key, action): SAME where the stored row is READY with equal fingerprint, CHANGED, NEW, or STALE where it is computed no more."""
    c = computed.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_c"))
    s = stored.select(F.col(key).alias("_j"), F.col(fingerprint).alias("_s"), F.col(status).alias("_t"))
    action = (
        F.when(F.col("_k").isNull(), "STALE").when(F.col("_j").isNull(), "NEW").when((F.col("_c") == F.col("_s")) & (F.col("_t") == "READY"), "SAME").otherwise("CHANGED")
    )
    return c.join(s, F.col("_k") == F.col("_j"), "full").select(F.coalesce("_k", "_j").alias(key), action.alias("action"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Full refresh (``overwrite``) or append-only log (``append``)."""
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def profile(df: DataFrame, vectors: list[str] = ()) -> DataFrame:
    """One row per column: type, NULLs and blanks; one pass over the data."""
    aggs = [F.count("*").alias("_n")]
    for c, t in df.dtypes:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n_{c}"))
        aggs.append((F.count_if(F.trim(F.col(c)) == "") if t == "string" else F.lit(0).cast("bigint")).alias(f"b_{c}"))
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{c}").alias("nulls"), F.col(f"b_{c}").alias("blanks"), F.col("_n").alias("n_rows")) for c, t in df.dtypes]
    return one.select(F.inline(F.array(*items)))


PROMOTABLE = ("READY", "ACTIVE", "RETIRED")


def promote(manifest: DataFrame, wanted: DataFrame, project: str = "project_scope_key", revision: str = "model_revision_key", status: str = "status") -> DataFrame:
    """``manifest`` with the ``new_status`` of every revision once the ``wanted`` (project, revision) ones are promoted.

    A promotable revision becomes ACTIVE and the project's other ACTIVE one RETIRED, so at most one is
    ACTIVE if one is wanted; ``refused`` marks a wanted revision that is not promotable, whose
    project then stays as it is.  Rows with a NULL key keep their status.
    """
    asked = wanted.select(project, revision).distinct().withColumn("_asked", F.lit(True))
    m = manifest.join(asked, [project, revision], "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    good = F.col("_asked") & F.coalesce(F.col(status).isin(*PROMOTABLE), F.lit(False))
    moved = m.where(good).select(project).distinct().withColumn("_moved", F.lit(True))
    m = m.join(moved, project, "left")
    new = F.when(good, "ACTIVE").when(F.col("_moved") & (F.col(status) == "ACTIVE"), "RETIRED").otherwise(F.col(status))
    return m.select(*manifest.columns, new.alias("new_status"), (F.col("_asked") & ~good).alias("refused"))


def retire(manifest: DataFrame, wanted: DataFrame, *, force: bool = False, project: str = "project_scope_key", revision: str = "model_revision_key", status: str = "status") -> DataFrame:
    """``manifest`` with the ``new_status`` once the ``wanted`` revisions are retired; an ACTIVE one is ``refused`` without ``force``."""
    asked = wanted.select(project, revision).distinct().withColumn("_asked", F.lit(True))
    m = manifest.join(asked, [project, revision], "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    refused = F.col("_asked") & F.coalesce(F.col(status) == "ACTIVE", F.lit(False)) & F.lit(not force)
    return m.select(*manifest.columns, F.when(F.col("_asked") & ~refused, "RETIRED").otherwise(F.col(status)).alias("new_status"), refused.alias("refused"))
