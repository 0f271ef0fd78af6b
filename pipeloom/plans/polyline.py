"""Polyline, box and voxel queries over the stubs' points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.plans.oracle_views import over
from pipeloom.sources import adapter as A

BOX = {"minx": 20000.0, "miny": 15000.0, "minz": 11000.0, "maxx": 60000.0, "maxy": 45000.0, "maxz": 14000.0}



def _box() -> dict[str, Column]:
    return {k: F.lit(v) for k, v in BOX.items()}


def lines(spark, root) -> DataFrame:
    return A.polylines(spark, root).withColumn("legs", G.legs(F.col("pts")))


def exploded(spark, root) -> DataFrame:
    """A row per leg, in order."""
    return lines(spark, root).select("guid", F.posexplode("legs").alias("i", "l")).select("guid", F.col("i").cast("int").alias("i"), "l.*")


def s01(spark, root):
    d = A.polylines(spark, root).withColumn("p", G.without_repeats(F.col("pts")))
    return d.select("guid", F.size("p").alias("n_points"), F.round(G.total_length(G.legs(F.col("p"))), 3).alias("length_mm"))


def s12(spark, root):
    return A.polylines(spark, root).select("guid", F.posexplode("pts").alias("idx", "p")).select("guid", "idx", "p.*")


def g01(spark, root):
    return exploded(spark, root).select("guid", "i", "axis", G.axis_label(F.col("dx"), F.col("dy"), F.col("dz")).alias("label"))


def g03(spark, root):
    return lines(spark, root).select("guid", G.direction_pattern(F.col("legs")).alias("pattern"), G.arrow_code(F.col("legs")).alias("arrows"))


def g05(spark, root):
    """Unit directions of four equal arc lengths."""
    d = lines(spark, root).where(G.total_length(F.col("legs")) >= 1e-3)
    u = G.unit_directions(G.resampled(F.col("legs"), 4))
    return d.select("guid", u.alias("u")).select("guid", *[F.round(F.col("u")[i], 5).alias(f"u{i}") for i in range(12)])


def g06(spark, root):
    r = G.runs(F.col("legs"))
    d = lines(spark, root).select("guid", F.explode(F.array(r)).alias("r"))
    return d.select("guid", F.size("r").alias("n_runs"), G.ortho_bends(F.col("r")).alias("bends"), G.vertical_entries(F.col("r")).alias("vertical_entries"), G.vertical_switches(F.col("r")).alias("vertical_switches"))


def g07(spark, root):
    """Corners whose legs' cosine is under .996, by the direction of the change."""
    e = exploded(spark, root).where("len > 0")
    w = W.partitionBy("guid").orderBy("i")
    nxt = lambda c: F.lead(c).over(w)
    dot = (F.col("dx") * nxt("dx") + F.col("dy") * nxt("dy") + F.col("dz") * nxt("dz")) / (F.col("len") * nxt("len"))
    c = e.select("guid", "i", dot.alias("dot"), F.col("b").alias("p"), (F.abs("dz") > F.abs("dx") + F.abs("dy")).alias("v1"), (F.abs(nxt("dz")) > F.abs(nxt("dx")) + F.abs(nxt("dy"))).alias("v2"))
    c = c.where("dot < 0.996")
    return c.groupBy("guid").agg(
        F.count("*").alias("bends"), F.count_if(F.col("v1") | F.col("v2")).alias("vertical_elbows"), F.count_if(~F.col("v1") & ~F.col("v2")).alias("horizontal_elbows"),
        F.round(F.min(F.col("p.z")), 1).alias("lowest_z"),
    )


def g12(spark, root):
    """Orthogonal pieces in plan: snapped to X or Y, short ones dropped, like neighbours merged."""
    e = exploded(spark, root).withColumn("l2", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("len >= 1 and l2 >= 300")
    e = e.withColumn("dir", F.when(F.abs(F.col("dx") / F.col("l2")) >= 0.9, "X").when(F.abs(F.col("dy") / F.col("l2")) >= 0.9, "Y").otherwise("D"))
    w = W.partitionBy("guid").orderBy("i")
    new = F.when((F.lag("dir").over(w) == F.col("dir")) & (F.col("dir") != "D"), 0).otherwise(1)
    e = e.withColumn("seg", F.sum(new).over(w))
    return e.groupBy("guid", "seg", "dir").agg(F.count("*").alias("n_legs"), F.round(F.sum("l2"), 3).alias("plan_mm"))


def f17(spark, root):
    e = exploded(spark, root).withColumn("l2", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    per = e.groupBy("guid").agg(
        F.count_if((F.col("l2") >= 300) & (F.greatest(F.abs("dx"), F.abs("dy")) / F.col("l2") < 0.9)).alias("diag"), F.sum(F.when(F.col("l2") >= 300, F.col("l2")).otherwise(0.0)).alias("trunk"),
    ).join(g06(spark, root).select("guid", "bends"), "guid")
    return per.select("guid", G.ortho_pattern(F.col("diag") > 0, F.col("bends"), F.col("trunk")).alias("ortho_pattern"))


def w02(spark, root):
    """Previous and next vertex of every vertex."""
    v = s12(spark, root)
    w = W.partitionBy("guid").orderBy("idx")
    return v.select("guid", "idx", F.lag("x").over(w).alias("prev_x"), F.lead("x").over(w).alias("next_x"), F.row_number().over(w).cast("int").alias("from_start"), (F.count("*").over(W.partitionBy("guid")) - F.row_number().over(w) + 1).alias("from_end"))


def w03(spark, root):
    """Runs of equal axis as rows, by gaps and islands."""
    e = exploded(spark, root).where("len >= 0.001")
    w = W.partitionBy("guid").orderBy("i")
    e = e.withColumn("run", F.sum(F.when(F.lag("axis").over(w) == F.col("axis"), 0).otherwise(1)).over(w))
    return e.groupBy("guid", "run", "axis").agg(F.round(F.sum("len"), 3).alias("len_mm"), F.count("*").alias("n_legs"))


def w04(spark, root):
    """Length so far and progress, per leg."""
    w = W.partitionBy("guid").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = exploded(spark, root).withColumn("so_far", F.sum("len").over(w)).withColumn("total", F.sum("len").over(W.partitionBy("guid")))
    return e.select("guid", "i", F.round("so_far", 3).alias("so_far"), F.when(F.col("total") > 1e-6, F.bround(F.col("so_far") / F.col("total") * 10, 0) / 10).otherwise(0.0).alias("bucket"))


def w07(spark, root):
    """Corners with their transition; the first in the lower part; neighbours that both turn in plan."""
    e = exploded(spark, root).where("len >= 50")
    w = W.partitionBy("guid").orderBy("i")
    a, b = F.floor(F.col("axis") / 2), F.floor(F.lead("axis").over(w) / 2)
    c = e.select("guid", "i", a.alias("a"), b.alias("b"), F.col("b.z").alias("z")).where("b is not null and a <> b")
    kind = F.when((F.col("a") == 2), "V_TO_H").when(F.col("b") == 2, "H_TO_V").otherwise("H_TO_H")
    c = c.withColumn("transition", kind).withColumn("zone", F.when(F.col("z") <= G.CSF_PLANE_Z, "LOWER").otherwise("UPPER"))
    flat = F.col("transition") == "H_TO_H"
    near = (F.lag("transition").over(w) == "H_TO_H") | (F.lead("transition").over(w) == "H_TO_H")
    first = F.row_number().over(W.partitionBy("guid", "zone").orderBy("i")) == 1
    return c.select("guid", "i", "transition", "zone", (first & (F.col("zone") == "LOWER")).alias("first_in_lower"), (flat & F.coalesce(near, F.lit(False))).alias("sequence"))


def g22(spark, root):
    """Distance of every vertex to a box, the nearest face and the relative position."""
    v = s12(spark, root)
    p = {c: F.col(c) for c in "xyz"}
    rel = G.relative_position(p, _box())
    return v.select("guid", "idx", F.round(G.box_distance(p, _box()), 3).alias("distance"), G.nearest_face(p, _box()).alias("face"), *[F.round(rel[i], 9).alias(f"r{i}") for i in range(3)])


def g23(spark, root):
    e = exploded(spark, root)
    return e.select("guid", "i", F.round(G.sampled_box_distance(F.col("a"), F.col("b"), _box()), 3).alias("distance"), G.hits_box(F.col("a"), F.col("b"), _box(), 100.0).alias("hits"))


def g31(spark, root):
    d = A.polylines(spark, root).withColumn("c", G.cut_at(F.col("pts"), 500.0))
    return d.select("guid", F.size("c").alias("n_points"), *[F.round(F.element_at("c", -1)[a], 3).alias("end_" + a) for a in "xyz"])


def g42(spark, root):
    d = A.polylines(spark, root)
    mid = G.at_distance(G.legs(F.col("pts")), F.lit(700.0))
    t = G.trimmed(F.col("pts"), F.element_at("pts", 1), mid)
    return d.select("guid", F.size(t).alias("n_points"), F.round(F.element_at(t, -1)["x"], 3).alias("last_x"))


def e07(spark, root):
    """Reversed when the tail is nearer to the origin of the hall."""
    zero = A.point(F.lit(0), F.lit(0), F.lit(13000))
    d = A.polylines(spark, root).withColumn("o", G.oriented(F.col("pts"), zero))
    return d.select("guid", F.round(F.element_at("o", 1)["x"], 3).alias("head_x"), (F.element_at("o", 1) != F.element_at("pts", 1)).alias("reversed"))


def e10(spark, root):
    """Anchor features: box, first and last faces, first rise."""
    d = lines(spark, root).withColumn("b", G.extent(F.col("pts")))
    return d.select("guid", F.col("legs")[0]["axis"].alias("start_face"), F.element_at("legs", -1)["axis"].alias("end_face"), F.round(F.col("b.maxz") - F.col("b.minz"), 3).alias("height"), F.round(F.col("b.maxx") - F.col("b.minx"), 3).alias("width"))


def f28(spark, root):
    r = A.routes(spark, root)
    return r.select("guid", G.sub_zone(F.col("source_posx"), F.col("source_posy"), F.col("source_posz")).alias("zone"), G.distance_band(F.col("total_length")).alias("band"))


def v10(spark, root):
    """Corners of legs (|cos| < .99) and the trim taken there for an elbow of 50 mm."""
    e = exploded(spark, root).where("len > 0")
    w = W.partitionBy("guid").orderBy("i")
    nxt = lambda c: F.lead(c).over(w)
    dot = (F.col("dx") * nxt("dx") + F.col("dy") * nxt("dy") + F.col("dz") * nxt("dz")) / (F.col("len") * nxt("len"))
    trim = F.least(F.lit(75.0), F.col("len") / 2, nxt("len") / 2)
    return e.select("guid", "i", F.abs(dot).alias("d"), trim.alias("trim")).where("d < 0.99").select("guid", "i", F.round("trim", 3).alias("trim"))


def x10(spark, root):
    """Route validation: zero legs, non-orthogonal legs, bends over the limit."""
    e = exploded(spark, root)
    flat = F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))
    per = e.groupBy("guid").agg(F.count_if(F.col("len") < 1e-3).alias("zero_legs"), F.count_if((F.col("len") >= 1e-3) & (flat / F.col("len") < 0.999)).alias("skew_legs"), F.count("*").alias("n_legs"))
    per = per.join(g06(spark, root).select("guid", "bends"), "guid")
    return per.select("guid", "zero_legs", "skew_legs", (F.col("bends") > 4).alias("too_many_bends"), ((F.col("zero_legs") == 0) & (F.col("skew_legs") == 0) & (F.col("bends") <= 4)).alias("valid"))


def g41(spark, root):
    """Cells of 500 mm along the legs, grown by one cell in every direction."""
    e = exploded(spark, root).where("len > 0")
    n = F.greatest(F.ceil(F.col("len") / 250.0), F.lit(1))
    pts = e.select("guid", "a", "dx", "dy", "dz", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("t"))
    cell = pts.select("guid", *[F.floor((F.col("a")[c] + F.col("d" + c) * F.col("t") / F.col("n")) / 500.0).alias("c" + c) for c in "xyz"]).distinct()
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for c in "xyz":
        cell = cell.withColumn("d", F.explode(steps)).withColumn("c" + c, F.col("c" + c) + F.col("d")).drop("d").distinct()
    return cell.groupBy("guid").agg(F.count("*").alias("cells"))


def a30(spark, root):
    """Occupied cells of a 30 x 30 x 30 grid of 1 m cells, clipped, per kind of obstacle."""
    o = A.obstacles(spark, root)
    span = lambda c: F.sequence(F.greatest(F.floor(F.col("min" + c) / 1000.0), F.lit(0)), F.least(F.ceil(F.col("max" + c) / 1000.0), F.lit(29)))
    keep = " and ".join(f"floor(min{c} / 1000.0) <= 29 and ceil(max{c} / 1000.0) >= 0" for c in "xyz")
    for c in "xyz":
        o = o.where(keep) if c == "x" else o
        o = o.withColumn("i" + c, F.explode(span(c)))
    return o.select("kind", "ix", "iy", "iz").distinct().groupBy("kind").agg(F.count("*").alias("cells"))


QUERIES = {
    "s01_polyline_scan": s01, "s12_geometry_points": s12, "g01_axis_snap": g01, "g03_direction_patterns": g03, "g05_resampled_directions": g05, "g06_bend_counts": g06, "g07_elbows": g07, "g12_ortho_segments": g12,
    "f17_ortho_pattern": f17, "w02_lag_lead": w02, "w03_axis_runs": w03, "w04_progress": w04, "w07_transitions": w07, "g22_box_distance": g22, "g23_segment_box": g23, "g31_cut_polyline": g31, "g42_trimmed": g42,
    "e07_oriented": e07, "e10_anchor_features": e10, "f28_zone_band": f28, "v10_elbow_trims": v10, "x10_validation": x10, "g41_dilated_voxels": g41, "a30_voxel_occupancy": a30,
}

_D = "power(dx, 2) + power(dy, 2)"
_RUNS = """r0 AS (SELECT *, CASE WHEN axis = lag(axis) OVER (PARTITION BY guid ORDER BY i) THEN 0 ELSE 1 END AS f FROM leg WHERE len >= 0.001),
  r1 AS (SELECT *, sum(f) OVER (PARTITION BY guid ORDER BY i) AS run FROM r0), r2 AS (SELECT guid, run, any_value(axis) AS axis, sum(len) AS len, count(*) AS n FROM r1 GROUP BY guid, run),
  r3 AS (SELECT *, lead(axis) OVER (PARTITION BY guid ORDER BY run) AS nxt FROM r2),
  bends AS (SELECT g.guid, count(r3.guid) AS n_runs, count(*) FILTER (nxt // 2 <> axis // 2) AS bends, count(*) FILTER (axis < 4 AND nxt >= 4) AS ve, count(*) FILTER ((axis < 4) <> (nxt < 4)) AS vs FROM (SELECT DISTINCT guid FROM vertex) g LEFT JOIN r3 ON r3.guid = g.guid GROUP BY g.guid)"""
_CODE = "WITH c AS (SELECT guid, i, {0} AS k FROM leg WHERE len >= {1}), d AS (SELECT *, lag(k) OVER (PARTITION BY guid ORDER BY i) AS p FROM c), {2} AS (SELECT guid, string_agg(k, '{3}' ORDER BY i) AS t FROM d WHERE p IS NULL OR p <> k GROUP BY guid)"
_BX = "sqrt(power(greatest(20000 - {0}, 0, {0} - 60000), 2) + power(greatest(15000 - {1}, 0, {1} - 45000), 2) + power(greatest(11000 - {2}, 0, {2} - 14000), 2))"
_LEG2 = "SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, lead(dz) OVER w AS ez, lead(len) OVER w AS elen FROM leg WHERE len > 0 WINDOW w AS (PARTITION BY guid ORDER BY i)"
_SLAB = "CASE WHEN abs(d{0}) < 1e-9 THEN {2} ELSE {3}(({1[0]} - 100 - {0}) / d{0}, ({1[1]} + 100 - {0}) / d{0}) END"
_SIDES = {"x": (20000, 60000), "y": (15000, 45000), "z": (11000, 14000)}
_ALONG = "a0 AS (SELECT *, sum(len) OVER (PARTITION BY guid ORDER BY i) AS so, sum(len) OVER (PARTITION BY guid) AS total, max(i) OVER (PARTITION BY guid) AS last FROM leg)"
SQL = {
    "s01_polyline_scan": over("leg", "WITH k AS (SELECT guid, count(*) FILTER (len >= 0.001) + 1 AS n, sum(len) AS l FROM leg GROUP BY guid) SELECT guid, CAST(n AS INT) AS n_points, round(l, 3) AS length_mm FROM k"),
    "s12_geometry_points": over("vertex", "SELECT guid, CAST(i - 1 AS INT) AS idx, x, y, z FROM vertex"),
    "g01_axis_snap": over("leg", "SELECT guid, CAST(i - 1 AS INT) AS i, CAST(axis AS INT) AS axis, CASE WHEN greatest(abs(dx), abs(dy), abs(dz)) >= 1e-9 THEN ['+x', '-x', '+y', '-y', '+z', '-z'][axis + 1] END AS label FROM leg"),
    "g03_direction_patterns": over("leg", _CODE.format(f"CASE WHEN abs(dz) / len >= 0.8 THEN 'R' WHEN sqrt({_D}) / len >= 0.8 THEN 'H' ELSE 'D' END", 1, "e", "-") + ", " + _CODE[5:].replace("c AS", "c2 AS").replace("FROM c)", "FROM c2)").replace("d AS", "d2 AS").replace("FROM d ", "FROM d2 ").format("CASE WHEN abs(dz) / len >= 0.9 THEN 'V' WHEN greatest(abs(dx), abs(dy)) / len >= 0.9 THEN 'H' ELSE 'D' END", 0.001, "f", "")
        + " SELECT g.guid, coalesce(e.t, '') AS pattern, coalesce(f.t, '') AS arrows FROM (SELECT DISTINCT guid FROM vertex) g LEFT JOIN e ON e.guid = g.guid LEFT JOIN f ON f.guid = g.guid"),
    "g05_resampled_directions": over("leg", f"""WITH {_ALONG}, j AS (SELECT DISTINCT guid, total, unnest([0, 1, 2, 3, 4]) AS j FROM a0 WHERE total >= 0.001),
  h AS (SELECT j.guid, j.j, j.total * j.j / 4 AS d, min(a0.i) AS i FROM j JOIN a0 ON a0.guid = j.guid AND (a0.so >= j.total * j.j / 4 OR a0.i = a0.last) GROUP BY ALL),
  p AS (SELECT h.guid, h.j, x + dx * t AS x, y + dy * t AS y, z + dz * t AS z FROM (SELECT h.*, a0.* EXCLUDE (guid, i, total), CASE WHEN len > 1e-6 THEN greatest(0, least(1, (d - (so - len)) / len)) ELSE 0 END AS t FROM h JOIN a0 ON a0.guid = h.guid AND a0.i = h.i) h),
  q AS (SELECT guid, j, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM p WINDOW w AS (PARTITION BY guid ORDER BY j)),
  u AS (SELECT guid, j, CASE WHEN sqrt({_D} + dz * dz) < 1e-6 THEN [0.0, 0, 0] ELSE [dx / sqrt({_D} + dz * dz), dy / sqrt({_D} + dz * dz), dz / sqrt({_D} + dz * dz)] END AS u FROM q WHERE j < 4)
  SELECT guid, """ + ", ".join(f"round(max(u[{k % 3 + 1}]) FILTER (j = {k // 3}), 5) AS u{k}" for k in range(12)) + " FROM u GROUP BY guid"),
    "g06_bend_counts": over("leg", f"WITH {_RUNS} SELECT guid, CAST(n_runs AS INT) AS n_runs, CAST(bends AS INT) AS bends, CAST(ve AS INT) AS vertical_entries, CAST(vs AS INT) AS vertical_switches FROM bends"),
    "g07_elbows": over("leg", f"WITH l AS ({_LEG2}), c AS (SELECT *, abs(dz) > abs(dx) + abs(dy) AS v1, abs(ez) > abs(ex) + abs(ey) AS v2 FROM l WHERE (dx * ex + dy * ey + dz * ez) / (len * elen) < 0.996) SELECT guid, count(*) AS bends, count(*) FILTER (v1 OR v2) AS vertical_elbows, count(*) FILTER (NOT v1 AND NOT v2) AS horizontal_elbows, round(min(nz), 1) AS lowest_z FROM c GROUP BY guid"),
    "g12_ortho_segments": over("leg", f"WITH e AS (SELECT guid, i, sqrt({_D}) AS l2, CASE WHEN abs(dx) / sqrt({_D}) >= 0.9 THEN 'X' WHEN abs(dy) / sqrt({_D}) >= 0.9 THEN 'Y' ELSE 'D' END AS dir FROM leg WHERE len >= 1 AND sqrt({_D}) >= 300), f AS (SELECT *, CASE WHEN dir <> 'D' AND dir = lag(dir) OVER (PARTITION BY guid ORDER BY i) THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY guid ORDER BY i) AS seg FROM f) SELECT guid, CAST(seg AS BIGINT) AS seg, dir, count(*) AS n_legs, round(sum(l2), 3) AS plan_mm FROM g GROUP BY guid, seg, dir"),
    "f17_ortho_pattern": over("leg", f"WITH {_RUNS}, t AS (SELECT guid, count(*) FILTER (sqrt({_D}) >= 300 AND greatest(abs(dx), abs(dy)) / sqrt({_D}) < 0.9) AS diag, sum(CASE WHEN sqrt({_D}) >= 300 THEN sqrt({_D}) ELSE 0 END) AS trunk FROM leg GROUP BY guid) SELECT t.guid, CASE WHEN diag > 0 THEN 'Slope / Diagonal' WHEN bends = 0 AND trunk < 300 THEN 'No-Header / Empty' WHEN bends = 0 THEN 'Direct' WHEN bends = 1 THEN 'L-Shape' WHEN bends = 2 THEN 'Staircase' WHEN bends = 3 THEN 'U-Shape' ELSE 'Complex Multi-bend (' || bends || ' Bends)' END AS ortho_pattern FROM t JOIN bends ON t.guid = bends.guid"),
    "w02_lag_lead": over("vertex", "SELECT guid, CAST(i - 1 AS INT) AS idx, lag(x) OVER w AS prev_x, lead(x) OVER w AS next_x, CAST(i AS INT) AS from_start, count(*) OVER (PARTITION BY guid) - i + 1 AS from_end FROM vertex WINDOW w AS (PARTITION BY guid ORDER BY i)"),
    "w03_axis_runs": over("leg", f"WITH {_RUNS} SELECT guid, CAST(run AS BIGINT) AS run, CAST(axis AS INT) AS axis, round(len, 3) AS len_mm, n AS n_legs FROM r2"),
    "w04_progress": over("leg", f"WITH {_ALONG} SELECT guid, CAST(i - 1 AS INT) AS i, round(so, 3) AS so_far, CASE WHEN total > 1e-6 THEN round_even(so / total * 10, 0) / 10 ELSE 0.0 END AS bucket FROM a0"),
    "w07_transitions": over("leg", """WITH e AS (SELECT guid, i, nz AS z, axis // 2 AS a, lead(axis) OVER (PARTITION BY guid ORDER BY i) // 2 AS b FROM leg WHERE len >= 50),
  c AS (SELECT *, CASE WHEN a = 2 THEN 'V_TO_H' WHEN b = 2 THEN 'H_TO_V' ELSE 'H_TO_H' END AS transition, CASE WHEN z <= 13700 THEN 'LOWER' ELSE 'UPPER' END AS zone FROM e WHERE b IS NOT NULL AND a <> b),
  d AS (SELECT *, lag(transition) OVER (PARTITION BY guid ORDER BY i) AS p, lead(transition) OVER (PARTITION BY guid ORDER BY i) AS n, row_number() OVER (PARTITION BY guid, zone ORDER BY i) AS r FROM c)
  SELECT guid, CAST(i - 1 AS INT) AS i, transition, zone, r = 1 AND zone = 'LOWER' AS first_in_lower, transition = 'H_TO_H' AND (coalesce(p, '') = 'H_TO_H' OR coalesce(n, '') = 'H_TO_H') AS sequence FROM d"""),
    "g22_box_distance": over("vertex", f"WITH f AS (SELECT *, [abs(60000 - x), abs(x - 20000), abs(45000 - y), abs(y - 15000), abs(14000 - z), abs(z - 11000)] AS d FROM vertex) SELECT guid, CAST(i - 1 AS INT) AS idx, round({_BX.format('x', 'y', 'z')}, 3) AS distance, CAST(list_position(d, list_min(d)) - 1 AS INT) AS face, round(greatest(0, least(1, (x - 20000) / 40000)), 9) AS r0, round(greatest(0, least(1, (y - 15000) / 30000)), 9) AS r1, round(greatest(0, least(1, (z - 11000) / 3000)), 9) AS r2 FROM f"),
    "g23_segment_box": over("leg", f"SELECT guid, CAST(i - 1 AS INT) AS i, round(list_min(list_transform(range(0, 51), lambda t: {_BX.format('(x + dx * t / 50)', '(y + dy * t / 50)', '(z + dz * t / 50)')})), 3) AS distance, "
        + " AND ".join(f"NOT (abs(d{c}) < 1e-9 AND ({c} < {a} - 100 OR {c} > {b} + 100))" for c, (a, b) in _SIDES.items()) + " AND greatest(0, " + ", ".join(_SLAB.format(c, s, 0, "least") for c, s in _SIDES.items()) + ") <= least(1, " + ", ".join(_SLAB.format(c, s, 1, "greatest") for c, s in _SIDES.items()) + ") AS hits FROM leg"),
    "g31_cut_polyline": over("leg", f"WITH {_ALONG}, h AS (SELECT guid, min(i) AS i FROM a0 WHERE so >= 500 OR i = last GROUP BY guid) SELECT h.guid, CAST(h.i + 1 AS INT) AS n_points, " + ", ".join(f"round(CASE WHEN total <= 500 THEN n{c} ELSE {c} + d{c} * (500 - (so - len)) / len END, 3) AS end_{c}" for c in "xyz") + " FROM h JOIN a0 ON a0.guid = h.guid AND a0.i = h.i"),
    "g42_trimmed": over("leg", f"""WITH {_ALONG}, h AS (SELECT guid, min(i) AS i FROM a0 WHERE so >= 700 OR i = last GROUP BY guid), m AS (SELECT h.guid, CASE WHEN len > 1e-6 THEN least(1, (700 - (so - len)) / len) ELSE 0 END AS t, x, y, z, dx, dy, dz FROM h JOIN a0 ON a0.guid = h.guid AND a0.i = h.i),
  k AS (SELECT v.guid, v.i, v.x, row_number() OVER (PARTITION BY v.guid ORDER BY sqrt(power(v.x - m.x - m.dx * t, 2) + power(v.y - m.y - m.dy * t, 2) + power(v.z - m.z - m.dz * t, 2)), v.i) AS r FROM vertex v JOIN m ON m.guid = v.guid) SELECT guid, CAST(i AS INT) AS n_points, round(x, 3) AS last_x FROM k WHERE r = 1"""),
    "e07_oriented": over("vertex", "WITH e AS (SELECT guid, arg_min(x, i) AS hx, arg_max(x, i) AS tx, arg_min(power(x, 2) + power(y, 2) + power(z - 13000, 2), i) AS hd, arg_max(power(x, 2) + power(y, 2) + power(z - 13000, 2), i) AS td, arg_min([x, y, z], i) <> arg_max([x, y, z], i) AS ne FROM vertex GROUP BY guid) SELECT guid, round(CASE WHEN td < hd THEN tx ELSE hx END, 3) AS head_x, td < hd AND ne AS reversed FROM e"),
    "e10_anchor_features": over("leg", "WITH b AS (SELECT guid, max(z) - min(z) AS h, max(x) - min(x) AS w FROM vertex GROUP BY guid), f AS (SELECT guid, CAST(arg_min(axis, i) AS INT) AS start_face, CAST(arg_max(axis, i) AS INT) AS end_face FROM leg GROUP BY guid) SELECT f.guid, start_face, end_face, round(h, 3) AS height, round(w, 3) AS width FROM f JOIN b ON b.guid = f.guid"),
    "f28_zone_band": over("route", "SELECT guid, CAST(least(greatest(floor(source_posx / 3000), 0), 9) + 10 * least(greatest(floor(source_posy / 3000), 0), 9) + 100 * least(greatest(floor(source_posz / 3000), 0), 9) AS BIGINT) AS zone, CASE WHEN total_length < 5000 THEN 'SHORT' WHEN total_length < 15000 THEN 'MEDIUM' ELSE 'LONG' END AS band FROM route"),
    "v10_elbow_trims": over("leg", f"WITH l AS ({_LEG2}) SELECT guid, CAST(i - 1 AS INT) AS i, round(least(75.0, len / 2, elen / 2), 3) AS trim FROM l WHERE abs((dx * ex + dy * ey + dz * ez) / (len * elen)) < 0.99"),
    "x10_validation": over("leg", f"WITH {_RUNS}, t AS (SELECT guid, count(*) FILTER (len < 0.001) AS zero_legs, count(*) FILTER (len >= 0.001 AND greatest(abs(dx), abs(dy), abs(dz)) / len < 0.999) AS skew_legs FROM leg GROUP BY guid) SELECT t.guid, zero_legs, skew_legs, bends > 4 AS too_many_bends, zero_legs = 0 AND skew_legs = 0 AND bends <= 4 AS valid FROM t JOIN bends ON bends.guid = t.guid"),
    "g41_dilated_voxels": over("leg", """WITH p AS (SELECT guid, x, y, z, dx, dy, dz, greatest(ceil(len / 250), 1) AS n, unnest(range(0, CAST(greatest(ceil(len / 250), 1) AS BIGINT) + 1)) AS t FROM leg WHERE len > 0),
  c AS (SELECT DISTINCT guid, floor((x + dx * t / n) / 500) AS cx, floor((y + dy * t / n) / 500) AS cy, floor((z + dz * t / n) / 500) AS cz FROM p),
  d AS (SELECT DISTINCT guid, cx + a.v AS cx, cy + b.v AS cy, cz + e.v AS cz FROM c, (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) e(v)) SELECT guid, count(*) AS cells FROM d GROUP BY guid"""),
    "a30_voxel_occupancy": over("obstacle", """WITH s AS (SELECT kind, unnest(range(CAST(greatest(floor(minx / 1000), 0) AS BIGINT), CAST(least(ceil(maxx / 1000), 29) AS BIGINT) + 1)) AS ix, miny, maxy, minz, maxz FROM obstacle),
  t AS (SELECT kind, ix, unnest(range(CAST(greatest(floor(miny / 1000), 0) AS BIGINT), CAST(least(ceil(maxy / 1000), 29) AS BIGINT) + 1)) AS iy, minz, maxz FROM s),
  u AS (SELECT kind, ix, iy, unnest(range(CAST(greatest(floor(minz / 1000), 0) AS BIGINT), CAST(least(ceil(maxz / 1000), 29) AS BIGINT) + 1)) AS iz FROM t) SELECT kind, count(DISTINCT (ix, iy, iz)) AS cells FROM u GROUP BY kind"""),
}
