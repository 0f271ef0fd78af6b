"""Vector arithmetic on array columns, inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corpus-wide scales of the route feature vector (box extents, displacement, length, in mm).
BOX_MAX = (9759.011874999997, 11955.354296875, 11492.00024414066)
DISPLACEMENT_MAX = 11900.982486974623
LENGTH_MAX = 66433.582
#: Fixed values: (first dimension, count, weight) of the feature vector's parts.
PARTS = ((0, 3, 0.20), (3, 3, 0.20), (6, 3, 0.15), (9, 3, 0.15), (12, 3, 0.06), (15, 3, 0.06), (18, 3, 0.06), (21, 4, 0.12), (25, 5, 0.15))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine; 0 if the lengths differ or a norm is not above ``eps``."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (norm(a) > eps) & (norm(b) > eps), dot(a, b) / n).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column, eps: float = 1e-15) -> Column:
    """``a`` scaled to length 1, or zeros if its norm is not above ``eps``."""
    return F.when(norm(a) > eps, F.transform(a, lambda x: x / norm(a))).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def clamp01(c: Column) -> Column:
    return clamp(c)


def dist3(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def gap(a: Column, b: Column) -> Column:
    """Distance of two point structs."""
    return dist3(a["x"], a["y"], a["z"], b["x"], b["y"], b["z"])


def scale_factors(parts: Sequence[tuple[int, int, float]] = PARTS, dims: int = 30) -> list[float]:
    """sqrt(weight * dims / width) for every dimension of every part."""
    out = [0.0] * dims
    for first, count, weight in parts:
        for i in range(first, first + count):
            out[i] = (weight * dims / count) ** 0.5
    return out


def query_vector(sx: Column, sy: Column, sz: Column, ex: Column, ey: Column, ez: Column) -> Column:
    """The 30 dimensions that are known of a request: direction, displacement, extents and chord; scaled and normalised."""
    d = [ex - sx, ey - sy, ez - sz]
    chord = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    direction = [F.when(chord > 1e-9, x / chord).otherwise(F.lit(0.0)) for x in d]
    raw = direction + [-x for x in direction] + [clamp(x / DISPLACEMENT_MAX, -1.0, 1.0) for x in d] + [clamp(F.abs(x) / m, -1.0, 1.0) for x, m in zip(d, BOX_MAX)]
    raw += [F.lit(0.0)] * 9 + [clamp01(chord / LENGTH_MAX)] + [F.lit(0.0)] * 8
    return unit(F.array(*[x * f for x, f in zip(raw, scale_factors())]))


def mean_vector(df: DataFrame, keys: list[str], vec: str, name: str = "mean") -> DataFrame:
    """Per key the mean of the vectors, position by position; one partial sum per position before the shuffle."""
    long = df.select(*keys, F.posexplode(vec).alias("_p", "_v"))
    per = long.groupBy(*keys, "_p").agg(F.avg("_v").alias("_m"))
    both = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_l"))
    return both.select(*keys, F.transform("_l", lambda x: x["_m"]).alias(name))


def centroid(df: DataFrame, keys: list[str], vec: str, name: str = "centroid") -> DataFrame:
    """Mean vector scaled to length 1; vectors of differing lengths raise nothing here and must be filtered before."""
    return mean_vector(df, keys, vec, "_mean").select(*keys, unit(F.col("_mean")).alias(name))
