"""Scene scans, profiles, relations to obstacles, matching of existing lines, and streaming twins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions import vector as V
from pipeloom.operators import aggregate as AG
from pipeloom.operators import spatial as SP
from pipeloom.operators.order import numbered
from pipeloom.operators.search import in_blocks
from pipeloom.plans import polyline as P
from pipeloom.plans.oracle_views import over
from pipeloom.session import cut_lineage
from pipeloom.sources import adapter as A
from pipeloom.streaming import pairing

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str = ""):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = over(views, sql) if views else sql
        return f

    return put


# ---- scans


@query("s03_scoped_scan", "route", "SELECT guid, coalesce(nullif(equipment_key, ''), 'UNKNOWN') AS equipment_key, coalesce(nullif(utility, ''), 'UNKNOWN') AS utility FROM route WHERE project = 'PX-ALDER' AND revision = 'R202507-3'")
def s03(spark, root, project="PX-ALDER", revision="R202507-3"):
    """Routes of one scope; both keys or neither must be given."""
    if (project is None) != (revision is None):
        raise ValueError("project and revision must be given together")
    r = A.routes(spark, root)
    if project is not None:
        r = r.where((F.col("project") == project) & (F.col("revision") == revision))
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("UNKNOWN")).alias(c)
    return r.select("guid", name("equipment_key"), name("utility"))


@query("s05_structures", "obstacle", "SELECT kind || '|' || id || '|' || CAST(CAST(minx AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(maxz AS BIGINT) AS VARCHAR) AS stable_id, kind FROM obstacle WHERE kind IN ('COLUMN', 'BEAM')")
def s05(spark, root):
    o = A.obstacles(spark, root).where(F.col("kind").isin("COLUMN", "BEAM"))
    return o.select(F.concat_ws("|", "kind", F.col("id").cast("string"), F.col("minx").cast("bigint").cast("string"), F.col("maxz").cast("bigint").cast("string")).alias("stable_id"), "kind")


@query("s08_scene_load", "route obstacle", "WITH p AS (SELECT project AS id, min(source_posx) - 500 AS lx, max(source_posx) + 500 AS hx, min(source_posy) - 500 AS ly, max(source_posy) + 500 AS hy FROM route WHERE project IS NOT NULL GROUP BY 1) SELECT p.id AS project, o.kind, count(*) AS boxes FROM p JOIN obstacle o ON lx <= maxx AND hx >= minx AND ly <= maxy AND hy >= miny GROUP BY 1, 2")
def s08(spark, root):
    """Boxes that touch each project's plan box grown by 500 mm."""
    r = A.routes(spark, root).where("project is not null").groupBy("project")
    p = r.agg(*[f(f"source_pos{c}").alias(n + c) for n, f in (("min", F.min), ("max", F.max)) for c in "xy"]).withColumnRenamed("project", "id")
    o = A.obstacles(spark, root)
    pairs = SP.overlap_join(p, o, axes="xy", grow=500.0)
    return pairs.join(o.select(F.col("id").alias("b_id"), "kind"), "b_id").groupBy(F.col("a_id").alias("project"), "kind").agg(F.count("*").alias("boxes"))


@query("s13_fallback_lines", "route stub leg", "WITH s AS (SELECT r.guid, 1 AS pr, l.len FROM route r JOIN stub s ON nullif(regexp_replace(regexp_replace(lower(s.route_path_guid), '[\\s{}-]', '', 'g'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'), '') = r.guid JOIN (SELECT guid, sum(len) AS len FROM leg GROUP BY guid) l ON l.guid = s.pattern_id), a AS (SELECT guid, pr, sum(len) AS len FROM s GROUP BY 1, 2 UNION ALL SELECT guid, 2, sqrt(power(target_posx - source_posx, 2) + power(target_posy - source_posy, 2) + power(target_posz - source_posz, 2)) FROM route), k AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY pr) AS n FROM a) SELECT guid, pr AS source, round(len, 3) AS length_mm FROM k WHERE n = 1")
def s13(spark, root):
    """Length of a route's drawn stubs, or of its chord where none is drawn."""
    from pipeloom.functions.text import norm_guid

    r = A.routes(spark, root)
    length = P.exploded(spark, root).groupBy("guid").agg(F.sum("len").alias("len")).withColumnRenamed("guid", "pattern_id")
    s = A.stubs(spark, root).select("pattern_id", norm_guid(F.col("route_path_guid")).alias("guid")).join(length, "pattern_id").join(r.select("guid"), "guid", "left_semi")
    first = s.groupBy("guid").agg(F.sum("len").alias("len")).select("guid", F.lit(1).alias("source"), "len")
    chord = V.dist3(*[F.col(f"{e}_pos{c}") for e in ("target", "source") for c in "xyz"])
    both = first.unionByName(r.select("guid", F.lit(2).alias("source"), chord.alias("len")))
    best = both.groupBy("guid").agg(F.min(F.struct("source", "len")).alias("b"))
    return best.select("guid", "b.source", F.round("b.len", 3).alias("length_mm"))


@query("e36_leg_directions", "leg", "SELECT guid, CAST(i - 1 AS INT) AS i, CASE WHEN len < 1e-9 THEN 'None' WHEN abs(dz) >= abs(dx) AND abs(dz) >= abs(dy) THEN CASE WHEN dz > 0 THEN '+z' ELSE '-z' END WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN '+x' ELSE '-x' END ELSE CASE WHEN dy > 0 THEN '+y' ELSE '-y' END END AS direction FROM leg")
def e36(spark, root):
    """Leg directions with z first on ties, 'None' for no length."""
    ax, ay, az = F.abs("dx"), F.abs("dy"), F.abs("dz")
    sign = lambda c: F.when(F.col("d" + c) > 0, "+" + c).otherwise("-" + c)
    d = F.when(F.col("len") < 1e-9, "None").when((az >= ax) & (az >= ay), sign("z")).when(ax >= ay, sign("x")).otherwise(sign("y"))
    return P.exploded(spark, root).select("guid", "i", d.alias("direction"))


@query("e18_group_points", "member", "WITH e AS (SELECT group_vector_id, guid, member_order, 0 AS e, start_x AS x FROM member UNION ALL SELECT group_vector_id, guid, member_order, 1, end_x FROM member), l AS (SELECT *, lag(x) OVER (PARTITION BY group_vector_id ORDER BY guid, member_order, e) AS p FROM e) SELECT group_vector_id, count(*) AS points, count(*) FILTER (x IS DISTINCT FROM p) AS kept FROM l GROUP BY 1")
def e18(spark, root):
    m = A.members(spark, root)
    both = m.select("group_vector_id", "guid", "member_order", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("start_x").alias("x")), F.struct(F.lit(1).alias("e"), F.col("end_x").alias("x")))).alias("p")).select("group_vector_id", "guid", "member_order", "p.*")
    w = W.partitionBy("group_vector_id").orderBy("guid", "member_order", "e")
    both = both.withColumn("q", F.lag("x").over(w))
    return both.groupBy("group_vector_id").agg(F.count("*").alias("points"), F.count_if(~F.col("x").eqNullSafe(F.col("q"))).alias("kept"))


@query("e19_group_status", "grp", "SELECT status, count(*) AS n, CAST(sum(member_count) AS BIGINT) AS members, min(updated_at) AS first_update, max(updated_at) AS last_update FROM grp GROUP BY status")
def e19(spark, root):
    return A.groups(spark, root).groupBy("status").agg(F.count("*").alias("n"), F.sum("member_count").alias("members"), F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update"))


@query("e13_group_profile", "leg stub", "WITH f AS (SELECT s.utility_group, CAST(arg_min(l.axis, l.i) AS INT) AS face FROM leg l JOIN stub s ON s.pattern_id = l.guid WHERE s.utility_group IS NOT NULL GROUP BY s.utility_group, l.guid), c AS (SELECT utility_group, face, count(*) AS n FROM f GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY utility_group) AS s, row_number() OVER (PARTITION BY utility_group ORDER BY n DESC, face) AS k FROM c), z AS (SELECT s.utility_group, round(min(least(l.z, nz)), 3) AS lowest, round(max(greatest(l.z, nz)), 3) AS highest FROM leg l JOIN stub s ON s.pattern_id = l.guid GROUP BY 1) SELECT t.utility_group, face, round(n / CAST(s AS DOUBLE), 6) AS confidence, lowest, highest FROM t JOIN z ON z.utility_group = t.utility_group WHERE k = 1")
def e13(spark, root):
    """Per utility group the face its lines leave by, with the share of votes, and its height range."""
    s = A.stubs(spark, root).where("utility_group is not null").select(F.col("pattern_id").alias("guid"), "utility_group")
    d = P.lines(spark, root).join(s, "guid")
    face = AG.majority(d.select("utility_group", F.col("legs")[0]["axis"].alias("face")), ["utility_group"], "face").select("utility_group", "face", F.round("confidence", 6).alias("confidence"))
    box = G.extent(F.col("pts"))
    z = d.groupBy("utility_group").agg(F.round(F.min(box["minz"]), 3).alias("lowest"), F.round(F.max(box["maxz"]), 3).alias("highest"))
    return face.join(z, "utility_group")


@query("e12_bundle_templates", "grp", "SELECT group_vector_id, project_scope_key || ':' || utility AS template_key, CASE WHEN aabb_maxx - aabb_minx >= aabb_maxy - aabb_miny THEN 'X' ELSE 'Y' END AS trunk_axis, len(CAST(member_guids AS VARCHAR[])) AS n_members FROM grp")
def e12(spark, root):
    g = A.groups(spark, root)
    axis = F.when(F.col("aabb_maxx") - F.col("aabb_minx") >= F.col("aabb_maxy") - F.col("aabb_miny"), "X").otherwise("Y")
    key = F.when(F.col("project_scope_key").isNotNull() & F.col("utility").isNotNull(), F.concat_ws(":", "project_scope_key", "utility"))
    return g.select("group_vector_id", key.alias("template_key"), axis.alias("trunk_axis"), F.size(F.from_json("member_guids", "array<string>")).cast("bigint").alias("n_members"))


# ---- relations to obstacles


_GAP = "sqrt(power(greatest(o.minx - l.nx, 0, l.nx - o.maxx), 2) + power(greatest(o.miny - l.ny, 0, l.ny - o.maxy), 2) + power(greatest(o.minz - l.nz, 0, l.nz - o.maxz), 2))"


@query("g25_obstacle_relations", "leg obstacle", f"WITH d AS (SELECT l.guid, l.i, o.id, {_GAP} AS d, l.nz - (o.minz + o.maxz) / 2 AS dz FROM leg l JOIN obstacle o ON {_GAP} <= 1800 + 1e-9), k AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY round(d, 6), id, i) AS n, count(*) OVER (PARTITION BY guid) AS c FROM d) SELECT guid, id AS box_id, round(d, 3) AS margin, round(dz, 3) AS dz, c AS n_relations FROM k WHERE n = 1")
def g25(spark, root):
    """Nearest box of every line within 1.8 m of a vertex, its margin and height difference, and how many relations there are.

    The distance in millionths of a millimetre and the box's place among the identifiers make one number, so a vertex's many
    relations are hashed to one row where they arise, without being sorted.
    """
    v = P.exploded(spark, root).select("guid", "i", "b.x", "b.y", "b.z")
    o = cut_lineage(numbered(A.obstacles(spark, root), F.col("id"), name="place"))
    f = SP.radius_join(v, o.withColumn("id", F.col("place")), 1800.0)
    d = F.floor(F.col("distance") * 1e6 + 0.5)
    per = f.groupBy("guid", "i", "z").agg(F.min(F.shiftleft(d, 32).bitwiseOR(F.col("box_id"))).alias("k"), F.count("*").alias("n"))
    best = per.groupBy("guid").agg(F.min(F.struct("k", "i", "z")).alias("b"), F.sum("n").alias("n"))
    best = best.select("guid", F.shiftright("b.k", 32).alias("d"), F.col("b.k").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place"), "b.z", "n")
    dz = F.col("z") - (F.col("minz") + F.col("maxz")) / 2
    return best.join(o, "place").select("guid", F.col("id").alias("box_id"), F.round(F.col("d") / 1e6, 3).alias("margin"), F.round(dz, 3).alias("dz"), F.col("n").alias("n_relations"))


@query("g24_bypass_side", "leg obstacle", f"WITH d AS (SELECT l.guid, l.i, o.id, {_GAP} AS d, l.nx - (o.minx + o.maxx) / 2 AS dx, l.ny - (o.miny + o.maxy) / 2 AS dy, l.nz - (o.minz + o.maxz) / 2 AS dz FROM leg l JOIN obstacle o ON {_GAP} <= 1000 + 1e-9) SELECT guid, CAST(i - 1 AS INT) AS i, id AS box_id, CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN CASE WHEN dx >= 0 THEN '+x' ELSE '-x' END WHEN abs(dy) >= abs(dz) THEN CASE WHEN dy >= 0 THEN '+y' ELSE '-y' END ELSE CASE WHEN dz >= 0 THEN '+z' ELSE '-z' END END AS side FROM d")
def g24(spark, root):
    v = P.exploded(spark, root).select("guid", "i", "b.x", "b.y", "b.z")
    f = SP.radius_join(v, A.obstacles(spark, root), 1000.0)
    off = [F.col(c) - (F.col("min" + c) + F.col("max" + c)) / 2 for c in "xyz"]
    return f.select("guid", "i", "box_id", G.axis_label(*off, eps=0.0).alias("side"))


@query("a29_density", "obstacle", "SELECT id, round(least(1, (maxx - minx) * (maxy - miny) * (maxz - minz) / 27e9), 6) AS density, (maxx - minx) * (maxy - miny) * (maxz - minz) >= 1e7 AS solid FROM obstacle")
def a29(spark, root):
    v = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) * (F.col("maxz") - F.col("minz"))
    return A.obstacles(spark, root).select("id", F.round(F.least(F.lit(1.0), v / 27e9), 6).alias("density"), (v >= 1e7).alias("solid"))


# ---- matching of lines, vertical bundles, roll-ups


@query("v01_existing_lines", "route stub vertex", """WITH e AS (SELECT guid, arg_min([x, y, z], i) AS a FROM vertex GROUP BY guid), d AS (SELECT r.guid AS task, e.guid AS line, list_distance([source_posx, source_posy, source_posz], a) AS d, abs(source_posz - a[3]) AS zg, upper(coalesce(s.main_equipment_name, '')) AS en, upper(r.equipment_key) AS ek
  FROM route r JOIN stub s ON upper(coalesce(s.utility, '')) = upper(r.utility) AND upper(coalesce(s.utility_group, '')) = upper(r.utility_group) JOIN e ON e.guid = s.pattern_id WHERE list_distance([source_posx, source_posy, source_posz], a) <= 2000 + 1e-9),
  s AS (SELECT *, d + 0.5 * zg - CASE WHEN en <> '' AND ek <> '' AND (contains(en, ek) OR contains(ek, en)) THEN 1000 ELSE 0 END AS score FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 6), line) AS n FROM s) SELECT task, line, round(score, 6) AS score FROM k WHERE n = 1""")
def v01(spark, root):
    """Best drawn line per route: same group and utility, start within 2 m, scored by distance, height gap and equipment name."""
    r = A.routes(spark, root)
    heads = A.polylines(spark, root).select(F.col("guid").alias("id"), F.lit("").alias("kind"), *[F.col("pts")[0][c].alias(n + c) for n in ("min", "max") for c in "xyz"])
    tasks = r.select(F.col("guid").alias("task"), F.upper("utility").alias("u"), F.upper("utility_group").alias("g"), F.upper("equipment_key").alias("ek"), *[F.col(f"source_pos{c}").alias(c) for c in "xyz"])
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("box_id"), F.upper(F.coalesce("utility", F.lit(""))).alias("u"), F.upper(F.coalesce("utility_group", F.lit(""))).alias("g"), F.upper(F.coalesce("main_equipment_name", F.lit(""))).alias("en"))
    f = SP.radius_join(tasks, heads, 2000.0).join(s, ["box_id", "u", "g"])
    name = (F.col("en") != "") & (F.col("ek") != "") & (F.col("en").contains(F.col("ek")) | F.col("ek").contains(F.col("en")))
    score = F.col("distance") + 0.5 * F.abs(F.col("z") - F.col("minz")) - F.when(name, 1000).otherwise(0)
    best = f.groupBy("task").agg(F.min(F.struct(F.round(score, 6).alias("s"), F.col("box_id"))).alias("b"))
    return best.select("task", F.col("b.box_id").alias("line"), F.col("b.s").alias("score"))


@query("v03_waypoints", "leg", "WITH m AS (SELECT guid, i, axis, (x + nx) / 2 AS mx, (y + ny) / 2 AS my, (z + nz) / 2 AS mz, len FROM leg WHERE len >= 250 AND greatest(abs(dx), abs(dy), abs(dz)) / len > 0.85), k AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY CASE WHEN axis >= 4 THEN 0 ELSE 1 END, i) AS n FROM m) SELECT guid, CAST(i - 1 AS INT) AS i, round(mx, 6) AS x, round(mz, 6) AS z FROM k WHERE n <= 28")
def v03(spark, root):
    """Middles of the straight legs of 250 mm or more, risers first, 28 at most (the viewer's own bound)."""
    e = P.exploded(spark, root).where("len >= 250").where(F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz")) / F.col("len") > 0.85)
    w = W.partitionBy("guid").orderBy(F.when(F.col("axis") >= 4, 0).otherwise(1), "i")
    e = e.withColumn("n", F.row_number().over(w)).where("n <= 28")
    mid = lambda c: F.round((F.col("a")[c] + F.col("b")[c]) / 2, 6)
    return e.select("guid", "i", mid("x").alias("x"), mid("z").alias("z"))


@query("g18_vertical_bundles", "leg stub", "WITH v AS (SELECT l.guid, coalesce(s.utility_group, '') AS g, CAST(floor(l.x / 1500) AS BIGINT) AS cx, CAST(floor(l.y / 1500) AS BIGINT) AS cy, least(l.z, nz) AS lo, greatest(l.z, nz) AS hi, axis FROM leg l JOIN stub s ON s.pattern_id = l.guid WHERE len >= 100 AND axis >= 4) SELECT g AS utility_group, cx, cy, count(DISTINCT guid) AS n_lines, round(max(hi) - min(lo), 3) AS extent, CAST(count(*) FILTER (axis = 4) AS BIGINT) AS up FROM v GROUP BY g, cx, cy HAVING count(DISTINCT guid) >= 2 AND max(hi) - min(lo) >= 500")
def g18(spark, root):
    """Vertical legs of two or more lines that share a plan cell of 1.5 m and span 500 mm or more."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), F.coalesce("utility_group", F.lit("")).alias("utility_group"))
    e = P.exploded(spark, root).where("len >= 100 and axis >= 4").join(s, "guid")
    g = e.groupBy("utility_group", F.floor(F.col("a.x") / 1500).alias("cx"), F.floor(F.col("a.y") / 1500).alias("cy")).agg(
        F.count_distinct("guid").alias("n_lines"), F.round(F.max(F.greatest("a.z", "b.z")) - F.min(F.least("a.z", "b.z")), 3).alias("extent"), F.count_if(F.col("axis") == 4).alias("up"))
    return g.where("n_lines >= 2 and extent >= 500")


@query("r16_box_match", "obstacle", "WITH q AS (SELECT id, (maxx - minx) * (maxy - miny) * (maxz - minz) AS v, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM obstacle WHERE (maxx - minx) * (maxy - miny) * (maxz - minz) >= 1e7), a AS (SELECT * FROM q WHERE id % 100 = 0), s AS (SELECT a.id, max(0.5 * least(a.v, b.v) / greatest(a.v, b.v) + 0.5 * greatest(0, 1 - sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 30000)) AS best FROM a JOIN q b ON a.id <> b.id GROUP BY a.id) SELECT CAST(id AS BIGINT) AS id, round(best, 6) AS best FROM s")
def r16(spark, root):
    """Boxes whose identifier is divisible by 100 against all: the best of half volume ratio and half nearness (30 m)."""
    o = A.obstacles(spark, root)
    v = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) * (F.col("maxz") - F.col("minz"))
    q = o.select(F.col("id").cast("bigint").alias("id"), v.alias("v"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y")).where("v >= 1e7")
    q = q.withColumn("bucket", F.lit(0))

    def best(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        tops = []
        for i, w, x, y in zip(*(asked[c].to_numpy() for c in ("id", "v", "x", "y"))):
            near = np.maximum(0.0, 1 - np.hypot(pdf["x"].to_numpy() - x, pdf["y"].to_numpy() - y) / 30_000)
            s = 0.5 * np.minimum(w, pdf["v"].to_numpy()) / np.maximum(w, pdf["v"].to_numpy()) + 0.5 * near
            s = s[pdf["id"].to_numpy() != i]
            if len(s):
                tops.append((i, s.max()))
        return pd.DataFrame(tops, columns=["id", "s"])

    each = in_blocks(q, q.where("id % 100 = 0"), best, "id bigint, s double")
    return each.groupBy("id").agg(F.round(F.max("s"), 6).alias("best"))


@query("r19_group_verdict", "member", "SELECT group_vector_id, count(DISTINCT utility) = 1 AS one_utility, median(step_count) >= 2 AS bent, coalesce(stddev_pop(total_length_mm) / nullif(avg(total_length_mm), 0) <= 0.3, false) AS even, count(DISTINCT utility) = 1 AND median(step_count) >= 2 AND coalesce(stddev_pop(total_length_mm) / nullif(avg(total_length_mm), 0) <= 0.3, false) AS accepted FROM member GROUP BY 1")
def r19(spark, root):
    m = A.members(spark, root).groupBy("group_vector_id").agg((F.count_distinct("utility") == 1).alias("one_utility"), (F.median("step_count") >= 2).alias("bent"), F.coalesce(F.stddev_pop("total_length_mm") / F.nullif(F.avg("total_length_mm"), F.lit(0.0)) <= 0.3, F.lit(False)).alias("even"))
    return m.withColumn("accepted", F.col("one_utility") & F.col("bent") & F.col("even"))


@query("j05_open_requests", "ablog", "SELECT DISTINCT request_key FROM ablog WHERE reason = 'error' EXCEPT SELECT request_key FROM ablog GROUP BY request_key, run_id HAVING count(DISTINCT arm) = 2 AND bool_and(success)")
def j05(spark, root):
    """Requests with a failure and no run in which both arms succeeded throughout."""
    a = A.ab_log(spark, root)
    done = a.groupBy("request_key", "run_id").agg(F.count_distinct("arm").alias("n"), F.bool_and("success").alias("ok")).where("n = 2 and ok").select("request_key")
    return a.where("reason = 'error'").select("request_key").distinct().join(done, "request_key", "left_anti")


@query("u06_distinct_lists", "route", "SELECT utility_group, string_agg(DISTINCT utility, ',' ORDER BY utility) AS utilities, count(DISTINCT bay) AS bays FROM route WHERE utility <> '' GROUP BY 1")
def u06(spark, root):
    r = A.routes(spark, root).where("utility <> ''")
    return r.groupBy("utility_group").agg(F.array_join(F.array_sort(F.collect_set("utility")), ",").alias("utilities"), F.count_distinct("bay").alias("bays"))


@query("p06_semi_join", "route grp", "SELECT guid, size FROM route WHERE guid IN (SELECT unnest(CAST(member_guids AS VARCHAR[])) FROM grp WHERE status = 'READY')")
def p06(spark, root):
    ready = A.groups(spark, root).where("status = 'READY'").select(F.explode(F.from_json("member_guids", "array<string>")).alias("guid"))
    return A.routes(spark, root).select("guid", "size").join(ready, "guid", "left_semi")


@query("p13_terminal_class", "route stub", "SELECT r.guid, CASE WHEN r.owner IN (SELECT anchor_name FROM stub WHERE anchor_kind = 'EQUIP') THEN 'EQUIP' WHEN r.owner IN (SELECT anchor_name FROM stub WHERE anchor_kind = 'DUCT') THEN 'DUCT' WHEN r.owner IN (SELECT anchor_name FROM stub WHERE anchor_kind = 'LATERAL') THEN 'LATERAL' ELSE '' END AS terminal FROM route r")
def p13(spark, root):
    """Kind of the object a route ends at, by the first list that has its owner."""
    rank = F.when(F.col("anchor_kind") == "EQUIP", 0).when(F.col("anchor_kind") == "DUCT", 1).when(F.col("anchor_kind") == "LATERAL", 2)
    names = A.stubs(spark, root).select(F.col("anchor_name").alias("owner"), rank.alias("k")).where("k is not null and owner is not null").groupBy("owner").agg(F.min("k").alias("k"))
    kind = F.when(F.col("k") == 0, "EQUIP").when(F.col("k") == 1, "DUCT").when(F.col("k") == 2, "LATERAL").otherwise("")
    return A.routes(spark, root).select("guid", "owner").join(names, "owner", "left").select("guid", kind.alias("terminal"))


@query("f15_vector_text", "gvec", "SELECT group_vector_id, 30 AS dims, round(feature_centroid[1], 6) AS first FROM gvec")
def f15(spark, root):
    """Vectors written as text and read back."""
    from pipeloom.plans.search import valid_groups

    t = valid_groups(spark, root).select("group_vector_id", F.concat(F.lit("["), F.array_join(F.transform("feature_centroid", lambda x: F.format_string("%.9f", x)), ","), F.lit("]")).alias("t"))
    v = F.transform(F.split(F.regexp_replace("t", r"[\[\]]", ""), ","), lambda x: x.cast("double"))
    return t.select("group_vector_id", F.size(v).alias("dims"), F.round(v[0], 6).alias("first"))


@query("e29_utility_map", "stub", "SELECT k AS key, max_by(utility, (created_at, pattern_id)) AS utility FROM (SELECT pattern_id AS k, utility, created_at, pattern_id FROM stub UNION ALL SELECT anchor_name, utility, created_at, pattern_id FROM stub) WHERE k IS NOT NULL AND trim(coalesce(utility, '')) <> '' GROUP BY k")
def e29(spark, root):
    """Utility by stub and by anchor name; later rows win."""
    s = A.stubs(spark, root).where("trim(coalesce(utility, '')) <> ''")
    both = s.select("utility", "created_at", "pattern_id", F.explode(F.array("pattern_id", "anchor_name")).alias("key")).where("key is not null")
    return both.groupBy("key").agg(F.max_by("utility", F.struct("created_at", "pattern_id")).alias("utility"))


@query("e40_scope_stamp", "route", "SELECT guid, coalesce(project, 'PX-NEW') AS project, coalesce(revision, 'R0') AS revision, project IS NULL AS stamped FROM route")
def e40(spark, root):
    return A.routes(spark, root).select("guid", F.coalesce("project", F.lit("PX-NEW")).alias("project"), F.coalesce("revision", F.lit("R0")).alias("revision"), F.col("project").isNull().alias("stamped"))


@query("v12_corridor_cells", "route", "WITH p AS (SELECT guid, unnest([source_posx, (source_posx + target_posx) / 2, target_posx]) AS x, unnest([source_posy, (source_posy + target_posy) / 2, target_posy]) AS y FROM route) SELECT guid, count(DISTINCT (CAST(floor(x / 1000) AS BIGINT), CAST(floor(y / 1000) AS BIGINT))) AS cells FROM p GROUP BY guid")
def v12(spark, root):
    """Cells of a three-point spine given as JSON."""
    x = lambda c: [F.col(f"source_pos{c}"), (F.col(f"source_pos{c}") + F.col(f"target_pos{c}")) / 2, F.col(f"target_pos{c}")]
    j = A.routes(spark, root).select("guid", F.to_json(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in zip(x("x"), x("y"))])).alias("spine"))
    p = j.select("guid", F.explode(F.from_json("spine", "array<struct<x:double,y:double>>")).alias("p"))
    return p.select("guid", F.floor(F.col("p.x") / 1000).alias("cx"), F.floor(F.col("p.y") / 1000).alias("cy")).distinct().groupBy("guid").agg(F.count("*").alias("cells"))


@query("k08_graph_edges", "route member", "SELECT 'BELONGS_TO' AS kind, count(*) AS n FROM route WHERE project IS NOT NULL UNION ALL SELECT 'CONNECTED_TO', count(*) FROM route WHERE equipment_key <> '' UNION ALL SELECT 'MEMBER_OF', count(*) FROM (SELECT DISTINCT guid, group_vector_id FROM member)")
def k08(spark, root):
    """Edges of the property graph, counted by kind."""
    r = A.routes(spark, root)
    e = r.where("project is not null").select(F.lit("BELONGS_TO").alias("kind"), F.col("guid").alias("a"), F.col("project").alias("b"))
    e = e.unionByName(r.where("equipment_key <> ''").select(F.lit("CONNECTED_TO").alias("kind"), F.col("guid").alias("a"), F.col("equipment_key").alias("b")))
    e = e.unionByName(A.members(spark, root).select(F.lit("MEMBER_OF").alias("kind"), F.col("guid").alias("a"), F.col("group_vector_id").alias("b")).distinct())
    return e.groupBy("kind").agg(F.count("*").alias("n"))


# ---- the stream's functions over a batch


@query("stream_pairs", "ablog", "SELECT b.request_key, b.run_id, count(*) AS pairs, round(sum(c.length_mm - b.length_mm), 6) AS delta FROM ablog b JOIN ablog c ON b.request_key = c.request_key AND b.run_id = c.run_id AND b.arm = 'BASELINE' AND c.arm = 'CONTEXT' GROUP BY 1, 2")
def stream_pairs(spark, root):
    p = pairing.pair_arms(A.ab_log(spark, root))
    return p.groupBy("request_key", "run_id").agg(F.count("*").alias("pairs"), F.round(F.sum("length_delta"), 6).alias("delta"))


@query("stream_rates", "ablog", "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS window_start, arm, count(*) AS n, round(avg(CAST(success AS INT)), 6) AS success_rate FROM ablog GROUP BY 1, 2")
def stream_rates(spark, root):
    return pairing.windowed_rates(A.ab_log(spark, root))


QUERIES = Q
