"""Exact vector Top-K and hybrid re-ranking.

A single query orders by distance with a limit, which keeps n rows per task.  Many queries meet the
candidates of their bucket in tasks of a bounded number of either; each task keeps its own top k per
query by one matrix product, and only those meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import pattern as P
from pipeloom.functions import vector as V


def route_fetch(k: int) -> int:
    return max(30 * k, 150)


def group_fetch(k: int) -> int:
    return min(max(max(20 * k, 100), 1), 1000)


def bundle_fetch(k: int) -> int:
    return min(max(max(10 * k, 50), 1), 500)


def literal(vec: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vec])


def nearest(df: DataFrame, vec: str, query: Sequence[float], ident: str, n: int, metric: str = "cosine") -> DataFrame:
    """The ``n`` rows nearest to ``query``, with ``distance``; ties by ``ident``."""
    q = literal(query)
    d = 1 - V.cosine(F.col(vec), q) if metric == "cosine" else V.l2(F.col(vec), q)
    return df.withColumn("distance", d).orderBy("distance", ident).limit(n)


def ranked(df: DataFrame, *order: Column, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of a total order, numbered from 1.  The window runs over at most ``k`` rows."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)))


def in_blocks(candidates: DataFrame, queries: DataFrame, run, schema: str, *, rows: int = 20_000, width: int | None = None, arrow: bool = False) -> DataFrame:
    """``run(query rows, candidate rows)`` for every pair of parts of a bucket; both frames have id and bucket.

    A bucket of more than ``rows`` candidates or queries stands in parts of about that many, so no task
    holds more of either, and every query still meets every candidate of its bucket in exactly one task.
    NULL buckets meet nothing.  ``width`` partitions are made where the pairs take long for the rows' bytes.  With ``arrow`` the
    rows are Arrow tables.
    """

    def in_parts(df: DataFrame, part: str) -> tuple[DataFrame, dict]:
        big = {r[0]: -(-r[1] // rows) for r in df.groupBy("bucket").count().where(F.col("count") > rows).collect()}  # at most one in ``rows`` of the table
        return df.withColumn(part, F.pmod(F.xxhash64("id"), _parts(big)).cast("int")), big

    def _parts(big: dict) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in big.items() for x in kv])[F.col("bucket")], F.lit(1)) if big else F.lit(1)

    c, of_c = in_parts(candidates.where("bucket is not null"), "_c")
    q, of_q = in_parts(queries.where("bucket is not null"), "_q")
    c = c.withColumn("_q", F.explode(F.sequence(F.lit(0), _parts(of_q) - 1)))
    q = q.withColumn("_c", F.explode(F.sequence(F.lit(0), _parts(of_c) - 1)))
    key = ["bucket", "_c", "_q"]
    c = c.select(*[F.col(x).alias(x) for x in c.columns])  # both frames may come from one table: columns of their own
    if width is not None:
        q, c = q.repartition(width, *key), c.repartition(width, *key)
    both = q.groupBy(*key).cogroup(c.groupBy(*key))
    return both.applyInArrow(run, schema) if arrow else both.applyInPandas(run, schema)


def batch_top_k(candidates: DataFrame, queries: DataFrame, k: int, *, rows: int = 20_000) -> DataFrame:
    """(query_id, id, cosine, rank): per query the ``k`` most similar candidates of the same bucket, itself excluded.

    Both frames are (id, bucket, vec).
    """

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.stack(vectors.to_numpy())
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def local(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(asked) and len(pdf):
            q, c, ids, names = unit(asked["vec"]), unit(pdf["vec"]), asked["id"].to_numpy(), pdf["id"].to_numpy()
            for at in range(0, len(q), 256):
                sims = q[at : at + 256] @ c.T
                sims[ids[at : at + 256, None] == names[None, :]] = -np.inf
                for i, row in enumerate(sims):
                    ok = np.flatnonzero(row > -np.inf)
                    if len(ok) > k:  # all that tie with the k-th stay
                        ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k] - 1e-12]
                    found += [(ids[at + i], names[j], float(row[j])) for j in ok]
        return pd.DataFrame(found, columns=["query_id", "id", "cosine"])

    each = in_blocks(candidates.select("id", "bucket", "vec"), queries.select("id", "bucket", "vec"), local, "query_id string, id string, cosine double", rows=rows)
    order = W.partitionBy("query_id").orderBy(F.round("cosine", 12).desc(), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def position_score(a: Sequence[Column], b: Sequence[Column], reach: float = 50_000.0) -> Column:
    """1 - distance of two displacements / reach, not below 0."""
    return F.greatest(F.lit(0.0), 1 - V.dist3(*a, *b) / reach)


def hybrid_score(position: Column, pattern: Column, vector: Column, context: Column, weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of the parts; a candidate with context (not NULL) has its own default weights."""
    if weights is not None and (len(weights) != 4 or any(not np.isfinite(w) or w < 0 for w in weights) or sum(weights) <= 0):
        raise ValueError("four finite weights, none negative, not all zero")
    plain = (0.50, 0.30, 0.20, 0.0) if weights is None else weights
    rich = (0.45, 0.27, 0.18, 0.10) if weights is None else weights
    parts = (position, pattern, vector, F.greatest(F.lit(0.0), context))
    with_context = sum(w * p for w, p in zip(rich, parts)) / sum(rich)
    without = sum(w * p for w, p in zip(plain[:3], parts[:3])) / (sum(plain[:3]) or 1.0)
    return F.when(context.isNotNull(), with_context).otherwise(without)


def pattern_part(query: Column, candidate: Column) -> Column:
    """Half the structural similarity: the other half needs bends of the query, which are never known."""
    return 0.5 * P.structural_similarity(query, candidate)


def pair_score(position: Column, pattern: Column, feature: Column, context: Column, size: Column, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Member pair: weighted mean over the parts that are there (pattern and context may be NULL), times the size score."""
    parts = list(zip(weights, (position, pattern, feature, context)))
    parts = [(w, F.when(p.isNotNull(), V.clamp01(p))) for w, p in parts]
    total = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for w, p in parts), F.lit(0.0))
    score = sum((F.coalesce(w * p, F.lit(0.0)) for w, p in parts), F.lit(0.0))
    return F.when(total > 0, score / total * size).otherwise(0.0)
