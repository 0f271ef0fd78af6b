"""Aggregations with settled ties: every choice ends with an identifier or value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.operators.order import numbered


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, votes, confidence): the most frequent value; ties: the smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("votes", F.lit(0))).alias("_m"), F.sum("votes").alias("_all"))
    return counts.join(best, keys).where(F.col("votes") == F.col("_m.votes")).groupBy(*keys).agg(
        F.min(value).alias(value), F.first("votes").alias("votes"), (F.first("votes") / F.first("_all")).alias("confidence")
    )


def closest_to_mean(df: DataFrame, keys: list[str], value: str, ident: str) -> DataFrame:
    """(keys, n, mean, representative): the row whose value is nearest to the group's mean; ties: the smaller identifier."""
    means = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = df.alias("r").join(means.alias("m"), same)
    near = joined.groupBy(*[F.col(f"m.{k}") for k in keys]).agg(
        F.first("m.n").alias("n"), F.first("m.mean").alias("mean"), F.min_by(F.col(f"r.{ident}"), F.struct(F.round(F.abs(F.coalesce(F.col(f"r.{value}"), F.lit(0.0)) - F.col("m.mean")), 6), F.col(f"r.{ident}"))).alias("representative")
    )
    return near


def suppressed_peaks(bins: DataFrame, keys: list[str], at: str, weight: str, apart: float, most: int) -> DataFrame:
    """(keys, levels): bins taken in descending weight (ties: the lower), none within ``apart`` of a taken one, at most ``most``."""
    listed = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.round(weight, 6)).alias("w"), F.col(at).alias("at")))).alias("_b"))

    def step(taken: Column, b: Column) -> Column:
        return F.when((F.size(taken) >= most) | F.exists(taken, lambda t: F.abs(t - b["at"]) < apart), taken).otherwise(F.concat(taken, F.array(b["at"])))

    return listed.select(*keys, F.array_sort(F.aggregate("_b", F.array().cast("array<double>"), step)).alias("levels"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order`` (which must be total)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def content_hash(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint per key: the count and the sum of the rows' 64-bit hashes; sums combine before the shuffle."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(h).cast("decimal(38,0)").alias("fingerprint"))


def gap_clusters(df: DataFrame, keys: list[str], value: str, ident: str, gap: float) -> DataFrame:
    """Rows with ``cluster`` (from 0): a new one begins where the gap to the value before exceeds ``gap``."""
    w = W.partitionBy(*keys).orderBy(value, ident)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def round_robin(df: DataFrame, outer: str, inner: list[str], order: str, n: int) -> DataFrame:
    """``n`` rows taken in turn over ``outer``, and within it in turn over ``inner``; the place is ``pick``."""
    a = df.withColumn("_r", F.row_number().over(W.partitionBy(outer, *inner).orderBy(order)))
    b = a.withColumn("_s", F.row_number().over(W.partitionBy(outer).orderBy("_r", *inner, order)))
    top = b.orderBy("_s", outer).limit(n)
    return top.withColumn("pick", F.row_number().over(W.orderBy("_s", outer))).drop("_r", "_s")


def evenly(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at the places floor(i * N / n) of the order (all if there are fewer)."""
    total = df.count()
    if total <= n:
        return df
    places = [i * total // n + 1 for i in range(n)]
    return numbered(df, F.col(order), name="_p").where(F.col("_p").isin(places)).drop("_p")
