"""Boxes with corners, takeoffs and their layout, stub features and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions.vector import unit


def corners(box: Column | dict) -> Column:
    """The eight corners of an axis-aligned box as points."""
    return F.array(*[F.struct(box[f"{a}x"].alias("x"), box[f"{b}y"].alias("y"), box[f"{c}z"].alias("z")) for c in ("min", "max") for a, b in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"))])


def footprint(vertices: Column) -> Column:
    """The lowest four vertices by their angle about their middle (ties: x, y)."""
    low = F.slice(F.array_sort(F.transform(vertices, lambda p: F.struct(p["z"].alias("z"), p["x"].alias("x"), p["y"].alias("y")))), 1, 4)
    mean = lambda c: F.aggregate(low, F.lit(0.0), lambda s, p: s + p[c]) / 4
    ring = F.array_sort(F.transform(low, lambda p: F.struct(F.atan2(p["y"] - mean("y"), p["x"] - mean("x")).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def frame(box: Column | dict) -> dict[str, Column]:
    """Local frame of an upright box: the longer plan axis is its length, the other its width, z its height."""
    w = {c: box["max" + c] - box["min" + c] for c in "xyz"}
    mid = {c: (box["max" + c] + box["min" + c]) / 2 for c in "xyz"}
    along_x = w["x"] >= w["y"]
    return {"along_x": along_x, "length": F.greatest(w["x"], w["y"]), "width": F.least(w["x"], w["y"]), "height": w["z"], **{"mid" + c: v for c, v in mid.items()}}


def takeoff_face(p: dict[str, Column], box: Column | dict) -> tuple[Column, Column, Column]:
    """(face, place along the length -1..1, place across in mm): END beyond .95 of the half length, else the larger of height and width."""
    f = frame(box)
    dx, dy, dz = (p[c] - f["mid" + c] for c in "xyz")
    along = F.when(f["along_x"], dx).otherwise(dy) / F.greatest(f["length"] / 2, F.lit(1e-9))
    across = F.when(f["along_x"], dy).otherwise(dx)
    h, w = dz / F.greatest(f["height"] / 2, F.lit(1e-9)), across / F.greatest(f["width"] / 2, F.lit(1e-9))
    face = F.when(F.abs(along) >= 0.95, "END").when(F.abs(h) >= F.abs(w), F.when(h >= 0, "TOP").otherwise("BOTTOM")).otherwise(F.when(w >= 0, "SIDE_A").otherwise("SIDE_B"))
    return face, along, across


def layout(n: Column, spread: Column, flips: Column) -> Column:
    """Name of a takeoff layout from the count, the deviation across (mm) and the share of side changes."""
    return F.when(n == 0, "NONE").when(n == 1, "SINGLE").when(spread <= 30, "STRAIGHT").when(flips >= 0.7, "ZIGZAG").when(flips <= 0.3, "SPLIT_ROWS").otherwise("IRREGULAR")


def axis_tokens(text: Column) -> Column:
    """Signed axis 0..5 of every token of a direction text that names one."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, "[＋﹢]", "+"), r"\\u2212|\\u2013|[–−—－]", "-"))
    plain = F.regexp_replace(plain, r"\\uff0b", "+")
    found = F.regexp_extract_all(plain, F.lit(r"([+-][xyz]|[xyz][+-])"), F.lit(1))
    index = lambda t: (F.locate("x", t) > 0).cast("int") * 0 + F.when(t.contains("x"), 0).when(t.contains("y"), 2).otherwise(4) + F.when(t.contains("-"), 1).otherwise(0)
    return F.transform(found, index)


def one_hot(i: Column, n: int = 6) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def stub_vector(face: Column, first: Column, second: Column, rel: Column, direction: Column) -> Column:
    """24 numbers: face, first and second direction as one-hot, relative position, unit direction."""
    return F.concat(one_hot(face), one_hot(first), one_hot(second), rel, direction)


def feature_vectors(lines: DataFrame) -> DataFrame:
    """(guid, v): the 30-number route vector of (guid, pts); the scales are the corpus maxima (1.0 where zero), from one
    aggregate row."""
    d = lines.withColumn("legs", G.legs(F.col("pts"))).where(G.total_length(F.col("legs")) > 0)
    a, b = F.col("pts")[0], F.element_at("pts", -1)
    d = d.select("guid", "legs", *[(b[c] - a[c]).alias("d" + c) for c in "xyz"], G.total_length(F.col("legs")).alias("total"), G.ortho_bends(G.runs(F.col("legs"))).alias("bends"), G.unit_directions(G.resampled(F.col("legs"), 3)).alias("thirds"))
    chord = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    top = d.agg(*[F.max(F.abs("d" + c)).alias("m" + c) for c in "xyz"], F.max(chord).alias("mc"), F.max("total").alias("ml"))
    d = d.crossJoin(F.broadcast(top))  # one row
    safe = lambda c: F.when(F.col(c) != 0, F.col(c)).otherwise(1.0)
    first, last = F.col("legs")[0], F.element_at("legs", -1)
    u = lambda x, s=1.0: [F.when(x["len"] > 1e-9, s * x["d" + c] / x["len"]).otherwise(0.0) for c in "xyz"]
    share = lambda k: F.aggregate(F.filter("legs", lambda x: F.floor(x["axis"] / 2) == k), F.lit(0.0), lambda s, x: s + x["len"]) / F.col("total")
    climb = F.array_max(F.transform("legs", lambda x: F.abs(x["dz"])))
    c01 = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    parts = [
        *u(first), *u(last, -1.0), *[F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("d" + c) / safe("mc"))) for c in "xyz"], *[F.least(F.lit(1.0), F.abs("d" + c) / safe("m" + c)) for c in "xyz"],
        *[F.col("thirds")[i] for i in range(9)], c01(F.col("total") / safe("ml")), F.lit(0.0), F.when(chord > 1e-9, c01((F.col("total") / chord - 1) / 0.5)).otherwise(0.0), c01(climb / 1000.0),
        *[share(k) for k in range(3)], c01(F.col("bends") / 10.0), F.lit(0.0),
    ]
    from pipeloom.functions.vector import scale_factors

    v = unit(F.array(*[p * s for p, s in zip(parts, scale_factors())]))
    return d.select("guid", F.transform(v, lambda x: F.round(x, 6)).alias("v"))
