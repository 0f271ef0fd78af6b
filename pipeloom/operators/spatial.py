"""Spatial joins as equi-joins on grid cells.

A box stands in every cell that it (grown by the radius) touches, at the finest of several grid levels
at which those are few; a point probes the one cell of each level that occurs.  Two boxes meet at the
coarser of their levels.  A pair counts in exactly one cell, so no duplicate has to be removed, and large
boxes cost no more cells than small ones.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeloom.functions.geometry import box_distance
from pipeloom.session import cut_lineage, let_go

LEVELS = 8
FACTOR = 4.0
MAX_CELLS = 64
#: Cells of a box in ``radius_join``: few, as every one of them is a row that moves.
FEW_CELLS = 16


def _sizes(cell: float) -> list[float]:
    return [cell * FACTOR**i for i in range(LEVELS)]


def _level(lo: dict[str, Column], hi: dict[str, Column], cell: float, most: int = MAX_CELLS) -> Column:
    """The finest level at which a box touches few cells."""
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        n = F.lit(1.0)
        for c in lo:
            n = n * (F.floor(hi[c] / _sizes(cell)[i]) - F.floor(lo[c] / _sizes(cell)[i]) + 1)
        level = F.when(n <= most, i).otherwise(level)
    return level


def _occurring(df: DataFrame, level: str) -> list[int]:
    """Levels that occur; at most LEVELS."""
    return sorted(r[0] for r in df.select(level).distinct().collect())


def _in_cells(df: DataFrame, lo: dict[str, Column], hi: dict[str, Column], cell: float) -> DataFrame:
    """``df`` once for every cell of its ``_level`` that it touches."""
    size = F.lit(cell) * F.pow(F.lit(FACTOR), F.col("_level"))
    for c in lo:
        df = df.withColumn("_c" + c, F.explode(F.sequence(F.floor(lo[c] / size), F.floor(hi[c] / size))))
    return df


def _packed(level: Column, cells: list[Column]) -> Column:
    """Level and cell in one number; far cells may share one, which the distance tells apart."""
    key = level.cast("bigint")
    for c in cells:
        key = F.shiftleft(key, 20).bitwiseOR(c.bitwiseAND(F.lit(0xFFFFF).cast("bigint")))
    return key


def radius_join(points: DataFrame, boxes: DataFrame, radius: float, *, cell: float = 1000.0, on: list[str] = ()) -> DataFrame:
    """(points.*, box_id, kind, box corners, distance) for every box whose surface is within ``radius`` (+1e-9) of the point.

    ``points`` has x, y, z, ``boxes`` has id, kind, minx .. maxz; both have ``on``, whose values must be equal.
    Rows with NULL coordinates meet nothing.  Neither side is broadcast: a box stands in many cells, of which Spark's estimate
    knows nothing.
    """
    sides = [f"{e}{c}" for e in ("min", "max") for c in "xyz"]
    p, b = _met(points, boxes.select(*on, F.col("id").alias("box_id"), "kind", *sides), radius, cell)
    joined = p.join(b.hint("merge"), [*on, "_cell"]).drop("_cell")
    at = {c: F.col(c) for c in "xyz"}
    box = {s: F.col(s) for s in sides}
    return joined.withColumn("distance", box_distance(at, box)).where(F.col("distance") <= radius + 1e-9)


def _met(points: DataFrame, boxes: DataFrame, radius: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """Both with ``_cell``: a point in one cell per level that occurs, a box grown by the radius in the few that it touches."""
    lo, hi = {c: F.col("min" + c) - radius for c in "xyz"}, {c: F.col("max" + c) + radius for c in "xyz"}
    b = boxes.withColumn("_level", _level(lo, hi, cell, FEW_CELLS))
    levels = _occurring(b, "_level") or [0]
    keys = [_packed(F.lit(i), [F.floor(F.col(c) / _sizes(cell)[i]) for c in "xyz"]) for i in levels]
    p = points.withColumn("_cell", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))
    return p, _in_cells(b, lo, hi, cell).withColumn("_cell", _packed(F.col("_level"), [F.col("_c" + c) for c in "xyz"])).drop("_level", "_cx", "_cy", "_cz")


def near_some(points: DataFrame, boxes: DataFrame, within: Column, radius: float, *, cell: float = 1000.0) -> DataFrame:
    """The points that have a box no farther than ``within``, a column of theirs that never exceeds ``radius``.

    Of a point's many boxes those up to the first that is near enough are looked at.  A point comes up once for each level that has one.
    """
    sides = [f"{e}{c}" for e in ("min", "max") for c in "xyz"]
    p, b = _met(points.withColumn("_within", within), boxes.select(*sides), radius, cell)
    b = b.select(F.col("_cell").alias("_at"), *[F.col(s).alias("_" + s) for s in sides])
    distance = box_distance({c: F.col(c) for c in "xyz"}, {s: F.col("_" + s) for s in sides})
    return p.join(b.hint("merge"), (F.col("_cell") == F.col("_at")) & (distance <= F.col("_within")), "left_semi").drop("_cell", "_within")


def in_rounds(asked: DataFrame, radii: tuple[float, ...], best: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """What ``best`` finds for every row of ``asked`` (id, ...), sought no farther than it takes.

    ``best(asked, radius)`` gives (id, b, reach) from all that lies within the radius; nothing beyond ``reach`` can be better
    or equal.  Rows whose reach exceeds the radius are sought again with the next one; the last one is the limit.  A round's
    files are let go of before the next one writes its own.
    """
    done: list[DataFrame] = []
    for k, radius in enumerate(radii):
        found = cut_lineage(best(asked, radius))
        let_go(asked.sparkSession)
        if k == len(radii) - 1:
            done.append(found.select("id", "b"))
            break
        found = found.where(F.col("reach") <= radius - 1e-4)
        done.append(found.select("id", "b"))
        asked = cut_lineage(asked.join(found.select("id"), "id", "left_anti"))
        if asked.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done)


def overlap_join(a: DataFrame, b: DataFrame, *, cell: float = 4000.0, axes: str = "xyz", grow: float = 0.0, on: list[str] = ()) -> DataFrame:
    """(a_id, b_id): boxes of ``a`` and ``b`` that overlap on ``axes`` after ``a`` is grown; both have id, min, max (and ``on``).

    Boxes of any size take part: each stands at its own level, and at the coarser levels of the other
    side.  A pair may meet in several cells; it counts in the one that holds the lower corner of
    the overlap.  Boxes with a NULL side meet nothing.
    """
    sides = [f"{e}{c}" for e in ("min", "max") for c in axes]
    whole = " and ".join(f"{s} is not null" for s in sides)
    x = a.where(whole).select(*on, F.col("id").alias("a_id"), *[(F.col(s) - grow if s[:3] == "min" else F.col(s) + grow).alias("a_" + s) for s in sides])
    y = b.where(whole).select(*on, F.col("id").alias("b_id"), *[F.col(s).alias("b_" + s) for s in sides])
    corner = lambda side, end: {c: F.col(f"{side}_{end}{c}") for c in axes}
    x = x.withColumn("_la", _level(corner("a", "min"), corner("a", "max"), cell))
    y = y.withColumn("_lb", _level(corner("b", "min"), corner("b", "max"), cell))
    of_x, of_y = _occurring(x, "_la"), _occurring(y, "_lb")

    def at_levels(df: DataFrame, own: str, side: str, other: list[int]) -> DataFrame:
        coarser = F.filter(F.array(*[F.lit(i) for i in other]), lambda i: i > F.col(own)) if other else F.array().cast("array<int>")
        return _in_cells(df.withColumn("_level", F.explode(F.concat(F.array(own), coarser))), corner(side, "min"), corner(side, "max"), cell)

    x, y = at_levels(x, "_la", "a", of_y), at_levels(y, "_lb", "b", of_x)
    out = x.join(y.hint("merge"), [*on, "_level", *["_c" + c for c in axes]]).where(F.col("_level") == F.greatest("_la", "_lb"))
    size = F.lit(cell) * F.pow(F.lit(FACTOR), F.col("_level"))
    for c in axes:
        out = out.where((F.col(f"a_min{c}") <= F.col(f"b_max{c}")) & (F.col(f"b_min{c}") <= F.col(f"a_max{c}")))
        out = out.where(F.floor(F.greatest(f"a_min{c}", f"b_min{c}") / size) == F.col("_c" + c))
    return out.select(*on, "a_id", "b_id", *["a_" + s for s in sides], *["b_" + s for s in sides])


def endpoint_vectors(points: DataFrame, boxes: DataFrame, *, near: float = 500.0, mid: float = 1000.0) -> DataFrame:
    """(id, v): 13 numbers per point: for columns and beams the near and mid counts, direction to and distance of the
    nearest surface; then whether nothing is near.  Ties in distance: lower corner, upper corner, identifier."""
    found = radius_join(points.select("id", "x", "y", "z"), boxes, mid)
    order = F.struct("distance", "minx", "miny", "minz", "maxx", "maxy", "maxz", "box_id")
    close = [F.greatest(F.col("min" + c), F.least(F.col(c), F.col("max" + c))) - F.col(c) for c in "xyz"]
    found = found.withColumn("_near", F.col("distance") <= near + 1e-9).withColumn("_to", F.array(*close))
    aggs = []
    for kind in ("COLUMN", "BEAM"):
        mine = F.col("kind") == kind
        aggs += [F.count_if(mine & F.col("_near")).alias(f"{kind}_near"), F.count_if(mine & ~F.col("_near")).alias(f"{kind}_mid")]
        aggs += [F.min_by(F.struct("distance", "_to"), F.when(mine, order)).alias(f"{kind}_first")]
    per = points.select("id").distinct().join(found.groupBy("id").agg(*aggs), "id", "left")
    v = []
    for kind, scale in (("COLUMN", 8.0), ("BEAM", 5.0)):
        first, count = F.col(f"{kind}_first"), lambda s, kind=kind: F.coalesce(F.col(f"{kind}_{s}"), F.lit(0))
        v += [F.least(F.lit(1.0), count("near") / scale), F.least(F.lit(1.0), count("mid") / scale)]
        v += [F.coalesce(F.when(first["distance"] > 1e-9, first["_to"][i] / first["distance"]), F.lit(0.0)) for i in range(3)]
        v += [F.when(first.isNull(), 0.0).otherwise(F.least(F.lit(1.0), first["distance"] / mid))]
    empty = F.when(F.col("COLUMN_first").isNull() & F.col("BEAM_first").isNull(), 1.0).otherwise(0.0)
    return per.select("id", F.array(*v, empty).alias("v"))


def line_cells(x0: float, y0: float, x1: float, y1: float, cell: float = 1000.0, most: int = 200) -> list[tuple[int, int]]:
    """Cells of a plane grid that a segment passes, in order; where it passes a corner both steps are taken at once.

    More than ``most`` cells are thinned evenly, ends kept.
    """
    from fractions import Fraction
    from math import floor

    ax, ay, bx, by = (Fraction(v) / Fraction(cell) for v in (x0, y0, x1, y1))
    crossings: dict[Fraction, list[int]] = {}
    for axis, (p, q) in enumerate(((ax, bx), (ay, by))):
        first, last = floor(p), floor(q)
        step = 1 if q > p else -1
        for k in range(abs(last - first)):
            border = first + 1 + k if step > 0 else first - k
            crossings.setdefault((border - p) / (q - p), []).append((axis + 1) * step)
    here = [floor(ax), floor(ay)]
    out = [tuple(here)]
    for t in sorted(crossings):
        for move in crossings[t]:
            here[abs(move) - 1] += 1 if move > 0 else -1
        out.append(tuple(here))
    if len(out) <= most:
        return out
    last = len(out) - 1
    picks = [(2 * last * k + most - 1) // (2 * (most - 1)) for k in range(most)]  # evenly, halves up
    return [out[k] for k in picks]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of (a, b) edges; a component is named by its least node.

    In every round each node points to the neighbour of the lowest rank, ranks being drawn anew, pointers
    are followed twice, and the edges are drawn between what is pointed at; edges within one node vanish.
    Their number falls by a factor each round whatever the graph's shape, and each round is written
    to the shared folder, so a lost executor costs one round.  Minima combine before every shuffle, so a
    node of any degree is fine.
    """
    left = cut_lineage(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while True:
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("_m")).select(F.col("a").alias("node"), F.least(rank("a"), "_m")["id"].alias("to"))
        for _ in range(2):
            ahead = to.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
            to = to.join(ahead, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"))
        to = cut_lineage(to)
        if labels is None:
            labels = to.select("node", F.col("to").alias("root"))
        else:
            moved = to.select(F.col("node").alias("root"), "to")
            labels = cut_lineage(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = [to.select(F.col("node").alias(c), F.col("to").alias("_" + c)) for c in "ab"]
        left = left.join(ends[0], "a").join(ends[1], "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        left = cut_lineage(left)
        turn += 1
        if not left.limit(1).count():
            break
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


def segment_pairs(segments: DataFrame, keys: list[str], *, pitch: float, overlap: float, along: float = 4000.0) -> DataFrame:
    """(a, b, pitch, overlap): parallel segments of different routes, ``a`` < ``b``.

    ``segments`` has id, guid, keys, lo and hi along the axis and u, v across it.  Segments of equal
    keys meet in the cells of the axis that both touch; across it one side stands in its own cell
    and the other in the nine around it.
    """
    s = segments.select("id", "guid", *keys, "lo", "hi", "u", "v")
    spread = s.withColumn("_a", F.explode(F.sequence(F.floor(F.col("lo") / along), F.floor(F.col("hi") / along)))).withColumn("_u", F.floor(F.col("u") / pitch)).withColumn("_v", F.floor(F.col("v") / pitch))
    other = spread.select(*keys, "_a", *[F.col(c).alias("o_" + c) for c in ("id", "guid", "lo", "hi", "u", "v")], F.col("_u").alias("_ou"), F.col("_v").alias("_ov"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    other = other.withColumn("_u", F.explode(F.transform(steps, lambda i: F.col("_ou") + i))).withColumn("_v", F.explode(F.transform(steps, lambda i: F.col("_ov") + i)))
    pairs = spread.join(other, [*keys, "_a", "_u", "_v"]).where("id < o_id and guid <> o_guid")
    apart = F.sqrt((F.col("u") - F.col("o_u")) ** 2 + (F.col("v") - F.col("o_v")) ** 2)
    shared = F.least("hi", "o_hi") - F.greatest("lo", "o_lo")
    pairs = pairs.withColumn("pitch", apart).withColumn("overlap", shared).where((F.col("pitch") <= pitch) & (F.col("overlap") >= overlap))
    pairs = pairs.where(F.floor(F.greatest("lo", "o_lo") / along) == F.col("_a"))  # the cell where the shared part begins
    return pairs.select(*keys, F.col("id").alias("a"), F.col("o_id").alias("b"), "pitch", "overlap")
