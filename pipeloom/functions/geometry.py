"""Geometry of polylines and boxes on array and struct columns; a polyline is ``array<struct<x,y,z>>``.

A polyline stands in one row, so none of this shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipeloom.functions.vector import clamp01, gap

AXIS_NAMES = ("+x", "-x", "+y", "-y", "+z", "-z")
CSF_PLANE_Z = 13_700.0


def axis_snap(dx: Column, dy: Column, dz: Column) -> Column:
    """Signed axis 0..5 of the largest component; x before y before z on ties, not negative -> even."""
    ax, ay, az = F.abs(dx), F.abs(dy), F.abs(dz)
    return (
        F.when((ax >= ay) & (ax >= az), F.when(dx >= 0, 0).otherwise(1)).when(ay >= az, F.when(dy >= 0, 2).otherwise(3)).otherwise(F.when(dz >= 0, 4).otherwise(5))
    )


def axis_label(x: Column, y: Column, z: Column, eps: float = 1e-9) -> Column:
    """Name of the signed axis; NULL if no component exceeds ``eps``."""
    top = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    return F.when(top >= eps, F.element_at(F.array(*[F.lit(n) for n in AXIS_NAMES]), axis_snap(x, y, z) + 1))


def without_repeats(pts: Column, eps: float = 1e-3) -> Column:
    """Points nearer than ``eps`` to the last kept one dropped."""
    first = F.slice(pts, 1, 1)
    return F.when(
        F.size(pts) > 0,
        F.aggregate(pts, first, lambda kept, p: F.when(gap(F.element_at(kept, -1), p) < eps, kept).otherwise(F.concat(kept, F.array(p)))),
    )


def legs(pts: Column) -> Column:
    """Consecutive pairs: from, to, displacement, length, axis."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))

    def leg(a: Column, b: Column) -> Column:
        dx, dy, dz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
        return F.struct(a.alias("a"), b.alias("b"), dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), F.sqrt(dx * dx + dy * dy + dz * dz).alias("len"), axis_snap(dx, dy, dz).alias("axis"))

    return F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), leg)


def total_length(ls: Column) -> Column:
    return F.aggregate(ls, F.lit(0.0), lambda s, x: s + x["len"])


def runs(ls: Column, eps: float = 1e-3) -> Column:
    """Legs of equal axis merged: array of (axis, len); legs shorter than ``eps`` are left out."""
    empty = F.array().cast("array<struct<axis:int,len:double>>")

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        one = F.array(F.struct(x["axis"].alias("axis"), x["len"].alias("len")))
        grown = F.array(F.struct(x["axis"].alias("axis"), (last["len"] + x["len"]).alias("len")))
        return F.when(last["axis"] == x["axis"], F.concat(F.slice(out, 1, F.size(out) - 1), grown)).otherwise(F.concat(out, one))

    return F.aggregate(F.filter(ls, lambda x: x["len"] >= eps), empty, step)


def _collapsed(codes: Column) -> Column:
    return F.regexp_replace(F.array_join(codes, ""), r"(.)\1+", "$1")


def direction_pattern(ls: Column, tol: float = 0.8) -> Column:
    """R (vertical), H (horizontal), D (inclined) of legs of 1 mm or more, repeats collapsed, joined by '-'."""
    code = lambda x: F.when(F.abs(x["dz"]) / x["len"] >= tol, "R").when(F.sqrt(x["dx"] * x["dx"] + x["dy"] * x["dy"]) / x["len"] >= tol, "H").otherwise("D")
    text = _collapsed(F.transform(F.filter(ls, lambda x: x["len"] >= 1.0), code))
    return F.regexp_replace(text, r"(.)(?=.)", "$1-")


def arrow_code(ls: Column, tol: float = 0.9) -> Column:
    """V (vertical), H (along x or y), D (inclined) of legs of 1e-3 mm or more, repeats collapsed."""
    code = lambda x: F.when(F.abs(x["dz"]) / x["len"] >= tol, "V").when(F.greatest(F.abs(x["dx"]), F.abs(x["dy"])) / x["len"] >= tol, "H").otherwise("D")
    return _collapsed(F.transform(F.filter(ls, lambda x: x["len"] >= 1e-3), code))


def count_changes(items: Column, same) -> Column:
    """Neighbours that are not the same."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(items, 1, n), F.slice(items, 2, n), lambda a, b: F.when(same(a, b), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def ortho_bends(rs: Column) -> Column:
    """Changes of the axis (sign ignored) between runs."""
    return count_changes(rs, lambda a, b: F.floor(a["axis"] / 2) == F.floor(b["axis"] / 2))


def vertical_entries(rs: Column) -> Column:
    """Entries into a vertical run."""
    return count_changes(rs, lambda a, b: ~((a["axis"] < 4) & (b["axis"] >= 4)))


def vertical_switches(rs: Column) -> Column:
    """Every change between vertical and horizontal."""
    return count_changes(rs, lambda a, b: (a["axis"] >= 4) == (b["axis"] >= 4))


def corner_dots(ls: Column) -> Column:
    """Cosine between neighbouring legs."""
    n = F.greatest(F.size(ls) - 1, F.lit(0))
    dot = lambda a, b: (a["dx"] * b["dx"] + a["dy"] * b["dy"] + a["dz"] * b["dz"]) / (a["len"] * b["len"])
    return F.zip_with(F.slice(ls, 1, n), F.slice(ls, 2, n), dot)


def at_distance(ls: Column, d: Column) -> Column:
    """The point at arc length ``d`` (clamped to the ends)."""
    start = F.struct(d.alias("left"), ls[0]["a"].alias("p"))

    def step(s: Column, x: Column) -> Column:
        t = F.when(x["len"] > 1e-6, F.least(s["left"], x["len"]) / x["len"]).otherwise(0.0)
        p = F.struct(*[(x["a"][c] + t * (x["b"][c] - x["a"][c])).alias(c) for c in "xyz"])
        return F.struct((s["left"] - x["len"]).alias("left"), F.when(s["left"] > 0, p).otherwise(s["p"]).alias("p"))

    return F.aggregate(ls, start, step)["p"]


def resampled(ls: Column, n: int) -> Column:
    """``n`` + 1 points at equal arc lengths."""
    total = total_length(ls)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda j: at_distance(ls, total * j / n))


def unit_directions(pts: Column) -> Column:
    """Unit directions between the points, flattened; zeros under 1e-6 mm."""
    return F.flatten(F.transform(legs(pts), lambda x: F.when(x["len"] < 1e-6, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(x["dx"] / x["len"], x["dy"] / x["len"], x["dz"] / x["len"]))))


def cut_at(pts: Column, d: float) -> Column:
    """The polyline's first ``d`` mm."""
    ls = legs(pts)
    ends = F.transform(ls, lambda x, i: F.aggregate(F.slice(ls, 1, i + 1), F.lit(0.0), lambda s, y: s + y["len"]))
    kept = F.filter(F.zip_with(F.slice(pts, 2, F.size(ls)), ends, lambda p, e: F.struct(p.alias("p"), e.alias("e"))), lambda x: x["e"] < d)
    head = F.concat(F.slice(pts, 1, 1), F.transform(kept, lambda x: x["p"]))
    return F.when(total_length(ls) <= d, pts).otherwise(F.concat(head, F.array(at_distance(ls, F.lit(float(d))))))


def oriented(pts: Column, front: Column) -> Column:
    """Reversed if the tail is strictly nearer to ``front``."""
    return F.when(gap(F.element_at(pts, -1), front) < gap(F.element_at(pts, 1), front), F.reverse(pts)).otherwise(pts)


def trimmed(pts: Column, start: Column, end: Column) -> Column:
    """The part between the vertices nearest to ``start`` and ``end`` (the first on ties), in the polyline's order."""
    near = lambda q: F.array_min(F.transform(pts, lambda p, i: F.struct(gap(p, q).alias("d"), i.alias("i"))))["i"]
    i, j = F.least(near(start), near(end)), F.greatest(near(start), near(end))
    return F.slice(pts, i + 1, j - i + 1)


def extent(pts: Column) -> Column:
    """Axis-aligned box of the points."""
    side = lambda f, c: f(F.transform(pts, lambda p: p[c]))
    return F.struct(*[side(F.array_min, c).alias("min" + c) for c in "xyz"], *[side(F.array_max, c).alias("max" + c) for c in "xyz"])


def box_distance(p: Column | dict, box: Column | dict) -> Column:
    """Distance of a point to a box's surface; 0 inside."""
    d = [F.greatest(box["min" + c] - p[c], F.lit(0.0), p[c] - box["max" + c]) for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def sampled_box_distance(a: Column, b: Column, box: Column | dict, samples: int = 50) -> Column:
    """Smallest distance of ``samples`` + 1 even points of a segment to a box."""
    at = lambda t: {c: a[c] + (b[c] - a[c]) * t / samples for c in "xyz"}
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda t: box_distance(at(t), box)))


def samples_within(a: Column, b: Column, box: dict, limit: Column, samples: int = 50) -> Column:
    """Whether ``sampled_box_distance`` is at most ``limit``: told by the segment's own box or its ends where they can tell it."""
    at = lambda t: {c: a[c] + (b[c] - a[c]) * F.lit(t) / samples for c in "xyz"}
    gaps = [F.greatest(box["min" + c] - F.greatest(a[c], b[c]), F.lit(0.0), F.least(a[c], b[c]) - box["max" + c]) for c in "xyz"]
    far = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]) > limit + 1e-6
    close = (box_distance(at(0), box) <= limit) | (box_distance(at(samples), box) <= limit)
    return F.when(far, False).when(close, True).otherwise(sampled_box_distance(a, b, box, samples) <= limit)


def hits_box(a: Column, b: Column, box: Column | dict, margin: float = 0.0) -> Column:
    """Slab test of a segment against a box grown by ``margin``."""
    lo, hi, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for c in "xyz":
        d = b[c] - a[c]
        low, high = box["min" + c] - margin - a[c], box["max" + c] + margin - a[c]
        flat = F.abs(d) < 1e-9
        outside = outside | (flat & ((low > 0) | (high < 0)))
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        lo.append(F.when(flat, F.lit(0.0)).otherwise(F.least(low / safe, high / safe)))
        hi.append(F.when(flat, F.lit(1.0)).otherwise(F.greatest(low / safe, high / safe)))
    return ~outside & (F.greatest(*lo) <= F.least(*hi))


def sub_zone(x: Column, y: Column, z: Column) -> Column:
    """Cell number of a 10 x 10 x 10 grid of 3 m cells, clipped."""
    i = [F.least(F.greatest(F.floor(v / 3000.0), F.lit(0)), F.lit(9)) for v in (x, y, z)]
    return i[0] + 10 * i[1] + 100 * i[2]


def distance_band(mm: Column) -> Column:
    return F.when(mm < 5000, "SHORT").when(mm < 15000, "MEDIUM").otherwise("LONG")


def relative_position(p: Column, box: Column | dict) -> Column:
    """Position inside a box per axis, 0..1; 0.5 along a flat axis."""
    one = lambda c: F.when(box["max" + c] - box["min" + c] <= 1e-9, 0.5).otherwise(clamp01((p[c] - box["min" + c]) / (box["max" + c] - box["min" + c])))
    return F.array(*[one(c) for c in "xyz"])


def nearest_face(p: Column, box: Column | dict) -> Column:
    """Face 0..5 (+x -x +y -y +z -z) with the smallest distance, the first on ties."""
    d = [F.abs(box["maxx"] - p["x"]), F.abs(p["x"] - box["minx"]), F.abs(box["maxy"] - p["y"]), F.abs(p["y"] - box["miny"]), F.abs(box["maxz"] - p["z"]), F.abs(p["z"] - box["minz"])]
    return F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d)]))["i"]


def ortho_pattern(diagonal: Column, bends: Column, trunk: Column) -> Column:
    """Shape label from: a diagonal piece, the number of bends, the trunk's length in mm."""
    return (
        F.when(diagonal, "Slope / Diagonal").when((bends == 0) & (trunk < 300), "No-Header / Empty").when(bends == 0, "Direct").when(bends == 1, "L-Shape")
        .when(bends == 2, "Staircase").when(bends == 3, "U-Shape").otherwise(F.concat(F.lit("Complex Multi-bend ("), bends.cast("string"), F.lit(" Bends)")))
    )
