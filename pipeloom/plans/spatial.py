"""Spatial joins, context vectors, parallel segments and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions import vector as V
from pipeloom.operators import spatial as O
from pipeloom.operators.order import numbered
from pipeloom.plans import polyline as P
from pipeloom.plans.oracle_views import over
from pipeloom.session import cut_lineage
from pipeloom.sources import adapter as A

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str = ""):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = over(views, sql) if views else sql
        return f

    return put


def _ends(spark, root, which="source"):
    r = A.routes(spark, root)
    return r.select(F.col("guid").alias("id"), *[F.col(f"{which}_pos{c}").alias(c) for c in "xyz"]).where("x is not null and y is not null and z is not null")


_DIST = "sqrt(power(greatest(minx - {0}, 0, {0} - maxx), 2) + power(greatest(miny - {1}, 0, {1} - maxy), 2) + power(greatest(minz - {2}, 0, {2} - maxz), 2))"
_SRC = _DIST.format("source_posx", "source_posy", "source_posz")


@query("j07_radius_join", "route obstacle", f"SELECT r.guid AS id, o.id AS box_id, o.kind, round({_SRC}, 4) AS distance FROM route r JOIN obstacle o ON {_SRC} <= 1000 + 1e-9")
def j07(spark, root):
    return O.radius_join(_ends(spark, root), A.obstacles(spark, root), 1000.0).select("id", "box_id", "kind", F.round("distance", 4).alias("distance"))


@query("j08_nearest_merged", "route obstacle", f"WITH d AS (SELECT r.guid AS id, o.id AS box_id, {_SRC} AS d1, {_DIST.format('target_posx', 'target_posy', 'target_posz')} AS d2 FROM route r JOIN obstacle o ON {_SRC} <= 2000 + 1e-9 OR {_DIST.format('target_posx', 'target_posy', 'target_posz')} <= 2000 + 1e-9) SELECT id, box_id, round(least(d1, d2), 4) AS distance FROM d")
def j08(spark, root):
    """A box near both ends is told of by the source, so every pair comes up once and none has to be merged."""
    o, near = A.obstacles(spark, root), 2000.0
    r = A.routes(spark, root).select(F.col("guid").alias("id"), *[F.col(f"{e}_pos{c}").alias(e[0] + c) for e in ("source", "target") for c in "xyz"])
    ends = r.select("id", F.inline(F.array(*[F.struct(*[F.col(a + c).alias(c) for c in "xyz"], *[F.col(b + c).alias("o" + c) for c in "xyz"], F.lit(a == "s").alias("first")) for a, b in ("st", "ts")])))
    f = O.radius_join(ends.where("x is not null and y is not null and z is not null"), o, near)
    other = G.box_distance({c: F.col("o" + c) for c in "xyz"}, {m + c: F.col(m + c) for m in ("min", "max") for c in "xyz"})
    other = F.when(F.col("ox").isNotNull() & F.col("oy").isNotNull() & F.col("oz").isNotNull(), other)
    f = f.withColumn("other", other).where(F.col("first") | F.col("other").isNull() | (F.col("other") > near + 1e-9))
    return f.select("id", "box_id", F.round(F.least("distance", "other"), 4).alias("distance"))


@query("j10_route_box_overlap", "route obstacle", "SELECT r.guid AS a_id, o.id AS b_id FROM route r JOIN obstacle o ON least(source_posx, target_posx) - 300 <= maxx AND greatest(source_posx, target_posx) + 300 >= minx AND least(source_posy, target_posy) - 300 <= maxy AND greatest(source_posy, target_posy) + 300 >= miny AND least(source_posz, target_posz) - 300 <= maxz AND greatest(source_posz, target_posz) + 300 >= minz")
def j10(spark, root):
    r = A.routes(spark, root).select(F.col("guid").alias("id"), *[f(f"source_pos{c}", f"target_pos{c}").alias(n + c) for n, f in (("min", F.least), ("max", F.greatest)) for c in "xyz"])
    r = r.where(" and ".join(f"min{c} is not null" for c in "xyz"))
    return O.overlap_join(r, A.obstacles(spark, root), grow=300.0).select("a_id", "b_id")


#: Height bands that stand in for the zones, by falling priority.
ZONES = (("CSF", 13600.0, 99999.0), ("CR", 12500.0, 13800.0), ("A/F", 11000.0, 12600.0), ("FSF", -99999.0, 11100.0))


@query("j11_zone_join", "route", "SELECT guid, CASE WHEN source_posz >= 13500 THEN 'CSF' WHEN source_posz BETWEEN 12400 AND 13900 THEN 'CR' WHEN source_posz BETWEEN 10900 AND 12700 THEN 'A/F' WHEN source_posz <= 11200 THEN 'FSF' END AS zone FROM route")
def j11(spark, root):
    """The first zone, by priority, whose band grown by 100 mm holds the source; the zones are a fixed list."""
    zone = F.lit(None).cast("string")
    for name, lo, hi in reversed(ZONES):
        zone = F.when(F.col("source_posz").between(lo - 100, hi + 100), name).otherwise(zone)
    return A.routes(spark, root).select("guid", zone.alias("zone"))


_ANCHORS = """an AS (SELECT DISTINCT anchor_kind || ':' || anchor_name || ':' || anchor_min AS id, anchor_kind AS kind, coalesce(utility, '') AS utility, CAST(anchor_min AS DOUBLE[]) AS lo, CAST(anchor_max AS DOUBLE[]) AS hi FROM stub WHERE anchor_min IS NOT NULL AND anchor_max IS NOT NULL AND anchor_name IS NOT NULL AND anchor_kind IS NOT NULL)"""


def anchors(spark, root):
    s = A.stubs(spark, root).where("anchor_min is not null and anchor_max is not null and anchor_name is not null and anchor_kind is not null")
    lo, hi = F.from_json("anchor_min", "array<double>"), F.from_json("anchor_max", "array<double>")
    s = s.select(F.concat_ws(":", "anchor_kind", "anchor_name", "anchor_min").alias("id"), F.col("anchor_kind").alias("kind"), F.coalesce("utility", F.lit("")).alias("utility"), *[lo[i].alias("min" + c) for i, c in enumerate("xyz")], *[hi[i].alias("max" + c) for i, c in enumerate("xyz")])
    return s.distinct()


#: Millimetres in which an anchor is sought; the last one is the limit.
WIDER = (200.0, 1000.0, 5000.0)


@query("j12_nearest_anchor", "route stub", f"""WITH {_ANCHORS}, d AS (SELECT r.guid, an.id AS anchor, CASE WHEN r.utility <> '' AND an.utility <> '' AND (contains(upper(an.utility), upper(r.utility)) OR contains(upper(r.utility), upper(an.utility))) THEN 0 ELSE 1 END AS hint,
    sqrt(power(greatest(lo[1] - source_posx, 0, source_posx - hi[1]), 2) + power(greatest(lo[2] - source_posy, 0, source_posy - hi[2]), 2) + power(greatest(lo[3] - source_posz, 0, source_posz - hi[3]), 2)) AS d FROM route r, an),
  k AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY hint, CASE WHEN d <= 1 THEN 0 ELSE 1 END, round(d, 6), anchor) AS n FROM d WHERE d <= 5000) SELECT guid, anchor, hint = 0 AS by_utility, round(d, 3) AS distance FROM k WHERE n = 1""")
def j12(spark, root):
    """Best anchor within 5 m of the source: same utility first (ignored if none is there), inside before near, then distance.

    Anchors of a utility that goes with the route's are sought first, then, for routes without one within 5 m, any anchor.  What moves
    has numbers for identifiers, those of the anchors in the order of their names.
    """
    r = A.routes(spark, root).select("guid", F.upper("utility").alias("ru"), *[F.col(f"source_pos{c}").alias(c) for c in "xyz"])
    r = cut_lineage(r.where("x is not null and y is not null and z is not null").withColumn("id", F.monotonically_increasing_id()))
    named = cut_lineage(numbered(anchors(spark, root).withColumn("au", F.upper("utility")).drop("utility", "kind"), F.col("id"), name="place"))
    a = named.drop("id").withColumnRenamed("place", "id").withColumn("kind", F.lit(""))
    alike = (F.col("ru") != "") & (F.col("au") != "") & (F.col("au").contains(F.col("ru")) | F.col("ru").contains(F.col("au")))
    both = cut_lineage(r.select("ru").distinct().join(a.select("au").distinct(), alike))

    def best(hint: int):
        def f(asked, radius):
            asked = asked.join(both, "ru").drop("ru") if hint == 0 else asked.drop("ru")
            found = O.radius_join(asked, a, radius, cell=2 * radius, on=["au"] if hint == 0 else [])
            d = F.round("distance", 6)
            per = found.groupBy("id").agg(F.min(F.struct(F.when(F.col("distance") <= 1, 0).otherwise(1).alias("out"), d.alias("d"), F.col("box_id").alias("place"))).alias("b"))
            return per.select("id", F.struct("b.place", F.lit(hint == 0).alias("by_utility"), "b.d").alias("b"), F.col("b.d").alias("reach"))

        return f

    asked = r.drop("guid")
    hinted = O.in_rounds(asked, WIDER, best(0))
    any_ = O.in_rounds(cut_lineage(asked.join(hinted.select("id"), "id", "left_anti")), WIDER, best(1))
    found = hinted.unionByName(any_).select("id", "b.*").join(r.select("id", "guid"), "id").drop("id")
    return found.join(named.select("place", F.col("id").alias("anchor")), "place").select("guid", "anchor", "by_utility", F.round("d", 3).alias("distance"))


@query("j14_route_matching", "route stub vertex", """WITH e AS (SELECT guid, arg_min([x, y, z], i) AS a, arg_max([x, y, z], i) AS b FROM vertex GROUP BY guid),
  d AS (SELECT r.guid AS task, e.guid AS line, list_distance([source_posx, source_posy, source_posz], a) AS f, list_distance([source_posx, source_posy, source_posz], b) AS v FROM route r JOIN e ON least(list_distance([source_posx, source_posy, source_posz], a), list_distance([source_posx, source_posy, source_posz], b)) < 3000),
  k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(least(f, v), 6), line) AS n FROM d) SELECT task, line, round(least(f, v), 3) AS cost, v < f AS reversed FROM k WHERE n = 1""")
def j14(spark, root):
    """The line with an end nearest to the route's source, under 3 m; reversed if that end is its tail."""
    end = lambda i: F.element_at("pts", i)
    lines = A.polylines(spark, root).select(F.col("guid").alias("line"), end(1).alias("h"), end(-1).alias("l"))
    tips = cut_lineage(lines.select("line", "h", "l", F.explode(F.array("h", "l")).alias("p")).select("line", "h", "l", "p.x", "p.y", "p.z"))
    asked = cut_lineage(_ends(spark, root))

    def best(asked, radius):
        # the few that ask are what stands in several cells
        found = O.radius_join(tips, asked.select("id", F.lit("").alias("kind"), *[F.col(c).alias(m + c) for m in ("min", "max") for c in "xyz"]), radius, cell=4 * radius).where("distance < 3000")
        f, v = (G.box_distance(F.col(p), {m + c: F.col(m + c) for m in ("min", "max") for c in "xyz"}) for p in "hl")
        b = F.min(F.struct(F.round(F.least(f, v), 6).alias("d"), "line", (v < f).alias("r"))).alias("b")
        return found.groupBy(F.col("box_id").alias("id")).agg(b).select("id", "b", F.col("b.d").alias("reach"))

    best = O.in_rounds(asked, (300.0, 1000.0, 3000.0), best)
    return best.select(F.col("id").alias("task"), "b.line", F.round("b.d", 3).alias("cost"), F.col("b.r").alias("reversed"))


def segments(spark, root, least=300.0):
    """Straight legs with their place along and across their axis."""
    e = P.exploded(spark, root).where(F.col("len") >= least)
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "utility_group")
    e = e.join(s, "guid").withColumn("utility_group", F.coalesce("utility_group", F.lit("")))
    mid = {c: (F.col("a")[c] + F.col("b")[c]) / 2 for c in "xyz"}
    along = F.floor(F.col("axis") / 2)
    pick = lambda x, y, z: F.when(along == 0, x).when(along == 1, y).otherwise(z)
    side = lambda f: pick(*[f(F.col("a")[c], F.col("b")[c]) for c in "xyz"])
    return e.select(F.concat_ws("#", "guid", F.col("i").cast("string")).alias("id"), "guid", "utility_group", "axis", side(F.least).alias("lo"), side(F.greatest).alias("hi"), pick(mid["y"], mid["x"], mid["x"]).alias("u"), pick(mid["z"], mid["z"], mid["y"]).alias("v"))


_SEG = """sg AS (SELECT l.guid || '#' || (l.i - 1) AS id, l.guid, coalesce(s.utility_group, '') AS utility_group, CAST(axis AS INT) AS axis,
  CASE axis // 2 WHEN 0 THEN least(l.x, nx) WHEN 1 THEN least(l.y, ny) ELSE least(l.z, nz) END AS lo, CASE axis // 2 WHEN 0 THEN greatest(l.x, nx) WHEN 1 THEN greatest(l.y, ny) ELSE greatest(l.z, nz) END AS hi,
  CASE axis // 2 WHEN 0 THEN (l.y + ny) / 2 ELSE (l.x + nx) / 2 END AS u, CASE axis // 2 WHEN 2 THEN (l.y + ny) / 2 ELSE (l.z + nz) / 2 END AS v FROM leg l JOIN stub s ON s.pattern_id = l.guid WHERE len >= 300),
  pr AS (SELECT a.utility_group, a.axis, a.id AS a, b.id AS b, sqrt(power(a.u - b.u, 2) + power(a.v - b.v, 2)) AS pitch, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM sg a JOIN sg b ON a.utility_group = b.utility_group AND a.axis = b.axis AND a.id < b.id AND a.guid <> b.guid WHERE sqrt(power(a.u - b.u, 2) + power(a.v - b.v, 2)) <= 1500 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 100)"""


@query("j16_parallel_segments", "leg stub", f"WITH {_SEG} SELECT utility_group, axis, a, b, round(pitch, 3) AS pitch, round(overlap, 3) AS overlap FROM pr")
def j16(spark, root):
    p = O.segment_pairs(segments(spark, root), ["utility_group", "axis"], pitch=1500.0, overlap=100.0)
    return p.select("utility_group", "axis", "a", "b", F.round("pitch", 3).alias("pitch"), F.round("overlap", 3).alias("overlap"))


@query("g16_segment_clusters", "leg stub", f"""WITH {_SEG}, ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), rc AS (SELECT a AS node, a AS component FROM ed UNION SELECT ed.b, rc.component FROM rc JOIN ed ON ed.a = rc.node),
  lb AS (SELECT node, min(component) AS component FROM rc GROUP BY node) SELECT component, count(*) AS n_segments, count(DISTINCT guid) AS n_lines, round(max(hi) - min(lo), 3) AS length_mm FROM lb JOIN sg ON sg.id = lb.node GROUP BY component""")
def g16(spark, root):
    s = cut_lineage(segments(spark, root))  # read twice
    pairs = O.segment_pairs(s, ["utility_group", "axis"], pitch=1500.0, overlap=100.0)
    c = O.components(pairs)
    j = c.join(s, F.col("node") == F.col("id"))
    return j.groupBy("component").agg(F.count("*").alias("n_segments"), F.count_distinct("guid").alias("n_lines"), F.round(F.max("hi") - F.min("lo"), 3).alias("length_mm"))


SQL["g16_segment_clusters"] = SQL["g16_segment_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("g17_plan_clusters", "route", """WITH p AS (SELECT guid, source_posx AS x, source_posy AS y, utility FROM route WHERE source_posx IS NOT NULL AND source_posy IS NOT NULL),
  ed AS (SELECT a.guid AS a, b.guid AS b FROM p a JOIN p b ON a.utility = b.utility AND a.guid <> b.guid AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 3000), rc AS (SELECT guid AS node, guid AS component FROM p UNION SELECT ed.b, rc.component FROM rc JOIN ed ON ed.a = rc.node)
  SELECT component, count(*) AS n FROM (SELECT node, min(component) AS component FROM rc GROUP BY node) GROUP BY component HAVING count(*) >= 2""")
def g17(spark, root):
    """Sources of one utility chained by distances of up to 3 m in plan."""
    p = A.routes(spark, root).where("source_posx is not null and source_posy is not null").select(F.col("guid").alias("id"), "utility", F.col("source_posx").alias("x"), F.col("source_posy").alias("y"))
    a = p.withColumn("_x", F.floor(F.col("x") / 3000)).withColumn("_y", F.floor(F.col("y") / 3000))
    b = a.select("utility", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("_x").alias("gx"), F.col("_y").alias("gy"))
    steps = F.sequence(F.lit(-1), F.lit(1))
    b = b.withColumn("_x", F.explode(F.transform(steps, lambda i: F.col("gx") + i))).withColumn("_y", F.explode(F.transform(steps, lambda i: F.col("gy") + i)))
    near = a.join(b, ["utility", "_x", "_y"]).where("id < b").where(F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2) <= 3000)
    c = O.components(near.select(F.col("id").alias("a"), "b"))
    return c.groupBy("component").agg(F.count("*").alias("n"))


SQL["g17_plan_clusters"] = SQL["g17_plan_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("g26_endpoint_vectors", "route obstacle", f"""WITH d AS (SELECT r.guid AS id, o.*, {_SRC} AS d, least(greatest(source_posx, minx), maxx) - source_posx AS tx, least(greatest(source_posy, miny), maxy) - source_posy AS ty FROM route r JOIN obstacle o ON {_SRC} <= 1000 + 1e-9),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY d, minx, miny, minz, maxx, maxy, maxz, id_1) AS n FROM d), a AS (SELECT id, count(*) FILTER (kind = 'COLUMN' AND d <= 500 + 1e-9) AS cn, count(*) FILTER (kind = 'COLUMN' AND d > 500 + 1e-9) AS cm, count(*) FILTER (kind = 'BEAM' AND d <= 500 + 1e-9) AS bn,
  max(d) FILTER (kind = 'COLUMN' AND n = 1) AS cd, max(d) FILTER (kind = 'BEAM' AND n = 1) AS bd, max(tx) FILTER (kind = 'COLUMN' AND n = 1) AS ctx FROM k GROUP BY id)
  SELECT r.guid AS id, round(least(1, coalesce(cn, 0) / 8.0), 6) AS v0, round(least(1, coalesce(cm, 0) / 8.0), 6) AS v1, round(CASE WHEN cd > 1e-9 THEN ctx / cd ELSE 0 END, 6) AS v2, round(coalesce(cd / 1000, 0), 6) AS v5, round(least(1, coalesce(bn, 0) / 5.0), 6) AS v6, round(coalesce(bd / 1000, 0), 6) AS v11, CASE WHEN cd IS NULL AND bd IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v12
  FROM route r LEFT JOIN a ON a.id = r.guid WHERE source_posx IS NOT NULL AND source_posy IS NOT NULL AND source_posz IS NOT NULL""".replace("SELECT r.guid AS id, o.*,", "SELECT r.guid AS id, o.id AS id_1, o.kind, o.minx, o.miny, o.minz, o.maxx, o.maxy, o.maxz,"))
def g26(spark, root):
    v = O.endpoint_vectors(_ends(spark, root), A.obstacles(spark, root))
    return v.select("id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in (0, 1, 2, 5, 6, 11, 12)])


def _cells(batches):
    for pdf in batches:
        cells = [[{"cx": a, "cy": b} for a, b in O.line_cells(*row)] for row in zip(pdf["ax"], pdf["ay"], pdf["bx"], pdf["by"])]
        yield pdf.drop(columns=["ax", "ay", "bx", "by"]).assign(cells=pd.Series(cells, dtype=object, index=pdf.index))


def route_cells(spark, root):
    """(id, cx, cy): 1 m cells of the plan that the chord passes."""
    a, b = _ends(spark, root), _ends(spark, root, "target")
    both = a.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id")
    return both.mapInPandas(_cells, "id string, cells array<struct<cx:bigint,cy:bigint>>").select("id", F.inline("cells"))


@query("g27_chord_cells")
def g27(spark, root):
    return route_cells(spark, root).groupBy("id").agg(F.count("*").alias("n_cells"))


@query("e02_context_vectors")
def e02(spark, root):
    """The whole 30-number context vector of every route, scaled to length 1.

    Both ends meet the boxes in one join, whose pairs are hashed where they arise to a row an end: distance and the box's place
    in the order of ties make one number.  A cell of the chord needs but one column.
    """
    near, mid = 500.0, 1000.0
    r = A.routes(spark, root).select(F.col("guid").alias("id"), *[F.col(f"{e}_pos{c}").alias(e[0] + c) for e in ("source", "target") for c in "xyz"])
    # what moves has a route's number, which is shorter than its identifier
    r = cut_lineage(r.dropna(subset=[e + c for e in "st" for c in "xyz"]).withColumn("n", F.monotonically_increasing_id()))
    corners = [m + c for m in ("min", "max") for c in "xyz"]
    o = numbered(A.obstacles(spark, root).select((F.col("kind") == "COLUMN").alias("kind"), "id", *corners), *corners, F.col("id"), name="id")
    ends = r.select("n", F.inline(F.array(*[F.struct(*[F.col(a + c).alias(c) for c in "xyz"], *[F.col(b + c).alias("o" + c) for c in "xyz"], F.lit(a == "s").alias("first")) for a, b in ("st", "ts")])))
    f = O.radius_join(ends, o, mid, cell=5000.0)  # boxes stand in few cells, as they are many and what moves counts as disk
    bits = max(1, o.count().bit_length())
    # below 1024 mm a distance has ten bits before the point
    key = F.shiftleft((F.col("distance") * float(2 ** (53 - bits))).cast("bigint"), bits).bitwiseOR(F.col("box_id"))
    column, close = F.col("kind"), F.col("distance") <= near + 1e-9
    other = G.box_distance({c: F.col("o" + c) for c in "xyz"}, {s: F.col(s) for s in corners})
    once = ~column & (F.col("first") | (other > mid + 1e-9))  # a beam near both ends counts once
    wx, wy, wz = (F.col("max" + c) - F.col("min" + c) for c in "xyz")
    along_x = (wx >= wy) & (wx >= wz)
    per = f.groupBy("n", "first").agg(
        *[F.count_if(k & c).alias(n) for n, k, c in (("cn", column, close), ("cm", column, ~close), ("bn", ~column, close), ("bm", ~column, ~close), ("ax", once, along_x), ("ay", once, ~along_x & (wy >= wz)))],
        F.min(F.when(column, key)).alias("ck"), F.min(F.when(~column, key)).alias("bk"))
    per = per.withColumns({k: F.col(k).bitwiseAND(F.lit(2**bits - 1)) for k in ("ck", "bk")})
    for k in ("ck", "bk"):
        per = per.join(o.select(F.col("id").alias(k), F.struct(*corners).alias(k + "_box")), k, "left")
    figures = F.struct("cn", "cm", "bn", "bm", "ck_box", "bk_box")
    per = per.groupBy("n").agg(F.max(F.when(F.col("first"), figures)).alias("s"), F.max(F.when(~F.col("first"), figures)).alias("t"), F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))

    def end(e):
        v, p = [], {c: F.col(e + c) for c in "xyz"}
        for k, scale in (("c", 8.0), ("b", 5.0)):
            box, count = F.col(e)[k + "k_box"], lambda i, k=k: F.coalesce(F.col(e)[k + i], F.lit(0))
            d = G.box_distance(p, {s: box[s] for s in corners})
            v += [F.least(F.lit(1.0), count("n") / scale), F.least(F.lit(1.0), count("m") / scale)]
            v += [F.coalesce(F.when(d > 1e-9, (F.greatest(box["min" + c], F.least(p[c], box["max" + c])) - p[c]) / d), F.lit(0.0)) for c in "xyz"]
            v += [F.when(box.isNull(), 0.0).otherwise(F.least(F.lit(1.0), d / mid))]
        return [*v, F.when(F.col(e).isNull(), 1.0).otherwise(0.0)]

    chords = r.select("n", ((F.col("sz") + F.col("tz")) / 2).alias("z"), F.col("sx").alias("ax"), F.col("sy").alias("ay"), F.col("tx").alias("bx"), F.col("ty").alias("by"))
    cells = chords.mapInPandas(_cells, "n bigint, z double, cells array<struct<cx:bigint,cy:bigint>>").select("n", "z", F.inline("cells"))
    probes = cells.select("n", ((F.col("cx") + 0.5) * 1000).alias("x"), ((F.col("cy") + 0.5) * 1000).alias("y"), "z")
    hit = O.near_some(probes, o.where("kind"), F.lit(600.0 + 1e-9), 600.0).groupBy("n").agg(F.count_distinct("x", "y").alias("columns"))
    u = r.join(per, "n", "left").join(hit, "n", "left")
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    level = F.hypot(dx, dy)
    beams = F.col("ax") + F.col("ay")
    parallel = F.coalesce(F.when((level > 1e-9) & (beams > 0), (F.col("ax") * (F.abs(dx) / level) + F.col("ay") * (F.abs(dy) / level)) / beams), F.lit(0.0))
    z = lambda c: F.bround(F.col(c) / 500.0, 0) * 500.0
    tier = F.array(F.when(z("sz") != z("tz"), F.lit(1 / 3)).otherwise(0.0), F.least(F.lit(1.0), F.coalesce("columns", F.lit(0)) / 15.0), parallel, F.when(level > 1e-9, dx / level).otherwise(0.0))
    v = V.unit(F.concat(F.array(*end("s"), *end("t")), tier), 1e-12)
    return u.select("id", F.transform(v, lambda x: F.round(x, 6)).alias("context_vector"))


@query("e04_context_coverage")
def e04(spark, root):
    v = e02(spark, root)
    c = F.col("context_vector")
    return v.agg(F.count("*").alias("n"), F.avg(((c[0] + c[1] + c[6] + c[7]) == 0).cast("int")).alias("empty_start_share"), F.percentile(c[5], 0.5).alias("p50"), F.percentile(c[5], 0.95).alias("p95"), F.min(V.norm(c)).alias("least_norm"))


@query("r15_voxel_cosine", "leg", """WITH c AS (SELECT DISTINCT guid, CAST(floor(x / 3000) AS BIGINT) AS a, CAST(floor(y / 3000) AS BIGINT) AS b, CAST(floor(z / 3000) AS BIGINT) AS c FROM vertex), n AS (SELECT guid, count(*) AS n FROM c GROUP BY guid), q AS (SELECT guid FROM n WHERE CAST('0x' || right(guid, 12) AS BIGINT) % 100 = 0),
  s AS (SELECT x.guid AS q, y.guid AS o, count(*) AS k FROM c x JOIN q ON q.guid = x.guid JOIN c y ON x.a = y.a AND x.b = y.b AND x.c = y.c AND x.guid <> y.guid GROUP BY 1, 2) SELECT s.q AS query_guid, s.o AS guid, round(k / sqrt(CAST(a.n * b.n AS DOUBLE)), 6) AS cosine FROM s JOIN n a ON a.guid = s.q JOIN n b ON b.guid = s.o""")
def r15(spark, root):
    """Cosine of occupied 3 m cells between the lines whose identifier is divisible by 100 and all lines, as a sparse join."""
    v = P.s12(spark, root)
    c = v.select("guid", *[F.floor(F.col(k) / 3000).alias("c" + k) for k in "xyz"]).distinct()
    n = c.groupBy("guid").agg(F.count("*").alias("n"))
    q = n.where(F.conv(F.substring("guid", -12, 12), 16, 10).cast("bigint") % 100 == 0).select(F.col("guid").alias("query_guid"), F.col("n").alias("qn"))
    mine = c.join(q, F.col("guid") == F.col("query_guid")).drop("guid")
    s = mine.join(c, ["cx", "cy", "cz"]).where("guid <> query_guid").groupBy("query_guid", "qn", "guid").agg(F.count("*").alias("k")).join(n, "guid")
    return s.select("query_guid", "guid", F.round(F.col("k") / F.sqrt((F.col("n") * F.col("qn")).cast("double")), 6).alias("cosine"))


QUERIES = Q
