"""Operators in their full form where another query shows only a part of them: matching, templates, causes, lifecycle, profiles, rules."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions import sizes as S
from pipeloom.functions import vector as V
from pipeloom.operators import aggregate as AG
from pipeloom.operators import design as D
from pipeloom.operators import sequential as SQ
from pipeloom.operators import spatial as SP
from pipeloom.operators import tables as K
from pipeloom.plans import polyline as P
from pipeloom.plans import sequential as PS
from pipeloom.plans.oracle_views import over
from pipeloom.session import cut_lineage
from pipeloom.sources import adapter as A
from pipeloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str = ""):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = over(views, sql) if views else sql
        return f

    return put


def R6(c):
    return F.round(c, 6)


def _outer(v: str) -> str:
    return "CASE CAST(floor(" + v + ") AS INT) " + " ".join(f"WHEN {a} THEN {b}" for a, b in S.OUTER_MM.items()) + f" ELSE {v} * 1.3 END"


@query("f07_outer_diameters", "route", f"""WITH t AS (SELECT DISTINCT size, upper(size) AS u, TRY_CAST(nullif(regexp_extract(upper(size), '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS v FROM route)
  SELECT size, round(CASE WHEN v IS NULL THEN 0.0 WHEN contains(u, 'A') THEN {_outer('v')} WHEN contains(u, 'INCH') OR contains(u, '"') THEN v * 25.4 ELSE v END, 6) AS outer_mm FROM t""")
def _(spark, root):
    return A.routes(spark, root).select("size").distinct().select("size", R6(S.outer_diameter(F.col("size"))).alias("outer_mm"))


# ---- matching, templates


@query("j14_both_ends", "route vertex", """WITH e AS (SELECT guid, arg_min([x, y, z], i) AS a, arg_max([x, y, z], i) AS b FROM vertex GROUP BY guid),
  r AS (SELECT guid, [source_posx, source_posy, source_posz] AS s, [target_posx, target_posy, target_posz] AS t FROM route WHERE source_posx IS NOT NULL AND source_posy IS NOT NULL AND source_posz IS NOT NULL AND target_posx IS NOT NULL AND target_posy IS NOT NULL AND target_posz IS NOT NULL),
  d AS (SELECT r.guid AS task, e.guid AS line, list_distance(s, a) + list_distance(t, b) AS f, list_distance(s, b) + list_distance(t, a) AS v FROM r JOIN e ON least(list_distance(s, a) + list_distance(t, b), list_distance(s, b) + list_distance(t, a)) < 6000),
  k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(least(f, v), 6), line) AS n FROM d) SELECT task, line, round(least(f, v), 3) AS cost, v < f AS reversed FROM k WHERE n = 1""")
def _(spark, root):
    """The line whose two ends are nearest to the route's two ends, forwards or backwards, under 6 m in all; a line may serve many routes."""
    most = 6000.0
    end = lambda i: F.element_at("pts", i)
    middle = lambda p, q: [((p[c] + q[c]) / 2).alias(c) for c in "xyz"]
    lines = A.polylines(spark, root).select(F.col("guid").alias("line"), end(1).alias("h"), end(-1).alias("l"))
    lines = cut_lineage(lines.select("line", "h", "l", *middle(F.col("h"), F.col("l"))))
    r = A.routes(spark, root).select(F.col("guid").alias("id"), *[F.struct(*[F.col(f"{e}_pos{c}").alias(c) for c in "xyz"]).alias(e[0]) for e in ("source", "target")])
    r = r.where(" and ".join(f"{e}.{c} is not null" for e in "st" for c in "xyz")).select("id", "s", "t", *middle(F.col("s"), F.col("t")))
    apart = lambda p, q: F.sqrt(sum((F.col(p)[c] - F.col(q)[c]) ** 2 for c in "xyz"))

    def best(asked, total):
        # the middles of two lines are no farther apart than half of what their ends are together
        boxes = asked.select("id", F.struct("s", "t").alias("kind"), *[F.col(c).alias(m + c) for m in ("min", "max") for c in "xyz"])
        x = SP.radius_join(lines, boxes, total / 2 + 0.001, cell=total).select(F.col("box_id").alias("id"), "line", "h", "l", "kind.s", "kind.t")
        x = x.select("id", "line", (apart("s", "h") + apart("t", "l")).alias("f"), (apart("s", "l") + apart("t", "h")).alias("v")).where(F.least("f", "v") < most)
        per = x.groupBy("id").agg(F.min(F.struct(R6(F.least("f", "v")).alias("d"), "line", (F.col("v") < F.col("f")).alias("r"))).alias("b"))
        return per.select("id", "b", F.col("b.d").alias("reach"))

    found = SP.in_rounds(cut_lineage(r), (1000.0, 2500.0, 4000.0, most), best)
    return found.select(F.col("id").alias("task"), "b.line", F.round("b.d", 3).alias("cost"), F.col("b.r").alias("reversed"))


_KEYS = ["stub_kind", "anchor_kind", "main_equipment_name", "utility_group", "utility", "pipe_size", "face", "dir_seq"]
_MEANS = ["rise_mm", "offset_mm", "diameter_mm", "stub_length_mm"]
_KEY = ", ".join(_KEYS)


@query("a14_full_templates", "stub", f"""WITH s AS (SELECT *, TRY_CAST(dir_unit_json AS DOUBLE[]) AS u FROM stub),
  g AS (SELECT {_KEY}, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in _MEANS)}, avg(u[1]) AS ux, avg(u[2]) AS uy, avg(u[3]) AS uz FROM s GROUP BY ALL HAVING count(*) >= 2),
  r AS (SELECT g.*, s.pattern_id, row_number() OVER (PARTITION BY {", ".join("g." + k for k in _KEYS)} ORDER BY round(abs(coalesce(s.stub_length_mm, 0) - coalesce(g.stub_length_mm, 0)), 6), s.pattern_id) AS k FROM g JOIN s ON {" AND ".join(f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in _KEYS)})
  SELECT {_KEY}, n, {", ".join(f"round({c}, 6) AS {c}" for c in [*_MEANS, "ux", "uy", "uz"])}, pattern_id AS representative FROM r WHERE k = 1""")
def _(spark, root):
    """Templates by all eight keys: means of the figures and of the direction, and the stub whose length is nearest to the mean."""
    s = A.stubs(spark, root).select("pattern_id", *_KEYS, *_MEANS, F.from_json("dir_unit_json", "array<double>").alias("u"))
    g = s.groupBy(*_KEYS).agg(F.count("*").alias("n"), *[F.avg(c).alias("m_" + c) for c in _MEANS], *[F.avg(F.get("u", F.lit(i))).alias("u" + c) for i, c in enumerate("xyz")]).where("n >= 2")
    t = g.select(*[F.col(k).alias("k_" + k) for k in _KEYS], F.col("m_stub_length_mm").alias("_mean"))
    same = F.lit(True)
    for k in _KEYS:
        same = same & F.col(k).eqNullSafe(F.col("k_" + k))
    away = F.round(F.abs(F.coalesce("stub_length_mm", F.lit(0.0)) - F.coalesce("_mean", F.lit(0.0))), 6)
    first = s.join(t, same).groupBy(*_KEYS).agg(F.min(F.struct(away.alias("d"), "pattern_id")).alias("b")).select(*[F.col(k).alias("k_" + k) for k in _KEYS], F.col("b.pattern_id").alias("representative"))
    return g.join(first, same).select(*_KEYS, "n", *[R6("m_" + c).alias(c) for c in _MEANS], *[R6("u" + c).alias("u" + c) for c in "xyz"], "representative")


_INSIDE = "CASE WHEN hi[{0}] - lo[{0}] <= 1e-9 THEN 0.5 ELSE greatest(0, least(1, (p[{0}] - lo[{0}]) / (hi[{0}] - lo[{0}]))) END"


@query("e05_positions", "stub", f"""WITH s AS (SELECT pattern_id, TRY_CAST(anchor_min AS DOUBLE[]) AS lo, TRY_CAST(anchor_max AS DOUBLE[]) AS hi, TRY_CAST(CASE WHEN stub_kind = 'END' THEN target_pos ELSE source_pos END AS DOUBLE[]) AS p, TRY_CAST(dir_unit_json AS DOUBLE[]) AS u FROM stub)
  SELECT pattern_id, {", ".join(f"round(coalesce({_INSIDE.format(i)}, 0.0), 6) AS v{17 + i}" for i in (1, 2, 3))}, {", ".join(f"round(coalesce(u[{i}], 0.0), 6) AS v{20 + i}" for i in (1, 2, 3))} FROM s""")
def _(spark, root):
    """The last six of the stub vector's 24 numbers: place of the connection within its anchor's box, and unit direction."""
    s = A.stubs(spark, root)
    json = lambda c: F.from_json(c, "array<double>")
    s = s.select("pattern_id", "dir_seq", json(F.col("anchor_min")).alias("lo"), json(F.col("anchor_max")).alias("hi"), json(F.when(F.col("stub_kind") == "END", F.col("target_pos")).otherwise(F.col("source_pos"))).alias("p"), json(F.col("dir_unit_json")).alias("u"))
    at = lambda c, i: F.get(c, F.lit(i))
    box = {m + c: at(a, i) for m, a in (("min", "lo"), ("max", "hi")) for i, c in enumerate("xyz")}
    place = F.transform(G.relative_position({c: at("p", i) for i, c in enumerate("xyz")}, box), lambda x: F.coalesce(x, F.lit(0.0)))
    unit = F.array(*[F.coalesce(at("u", i), F.lit(0.0)) for i in range(3)])
    none = F.lit(None).cast("int")
    v = D.stub_vector(none, none, none, place, unit)
    s = s.select("pattern_id", F.slice(v, 19, 6).alias("v"))
    return s.select("pattern_id", *[R6(F.col("v")[i]).alias(f"v{18 + i}") for i in range(6)])


# ---- causes of bends


_CORNER = """e AS (SELECT guid, i, x, y, z, nx, ny, nz, axis // 2 AS a, lead(axis) OVER w // 2 AS b, lead(nx) OVER w AS mx, lead(ny) OVER w AS my, lead(nz) OVER w AS mz, last_value(axis) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) // 2 AS entry FROM leg WHERE len >= 50 WINDOW w AS (PARTITION BY guid ORDER BY i)),
  c AS (SELECT e.*, row_number() OVER (PARTITION BY e.guid ORDER BY i) = 1 AS first, s.stub_kind, s.main_equipment_name AS eq, s.utility_group AS ug, TRY_CAST(s.anchor_min AS DOUBLE[]) AS lo, TRY_CAST(s.anchor_max AS DOUBLE[]) AS hi, TRY_CAST(s.source_pos AS DOUBLE[]) AS p,
    greatest(1.5 * (coalesce(s.diameter_mm, 0) / 2 + 150), 600) AS lim FROM e JOIN stub s ON s.pattern_id = e.guid WHERE b IS NOT NULL AND a <> b)"""
_SEGDIST = "list_min(list_transform(range(0, 51), lambda t: sqrt(power(greatest(o.minx - ({0}x + ({1}x - {0}x) * t / 50), 0, ({0}x + ({1}x - {0}x) * t / 50) - o.maxx), 2) + power(greatest(o.miny - ({0}y + ({1}y - {0}y) * t / 50), 0, ({0}y + ({1}y - {0}y) * t / 50) - o.maxy), 2) + power(greatest(o.minz - ({0}z + ({1}z - {0}z) * t / 50), 0, ({0}z + ({1}z - {0}z) * t / 50) - o.maxz), 2))))"
_FACE = "list_position([abs(hi[1] - p[1]), abs(p[1] - lo[1]), abs(hi[2] - p[2]), abs(p[2] - lo[2]), abs(hi[3] - p[3]), abs(p[3] - lo[3])], list_min([abs(hi[1] - p[1]), abs(p[1] - lo[1]), abs(hi[2] - p[2]), abs(p[2] - lo[2]), abs(hi[3] - p[3]), abs(p[3] - lo[3])])) - 1"
_WIDE = "CASE WHEN abs(nx - p[1]) >= abs(ny - p[2]) AND abs(nx - p[1]) >= abs(nz - p[3]) THEN 0 WHEN abs(ny - p[2]) >= abs(nz - p[3]) THEN 1 ELSE 2 END"


@query("g35_all_causes", "leg obstacle stub", f"""WITH {_CORNER},
  q AS (SELECT eq, ug, avg(nz) AS trunk FROM c GROUP BY eq, ug),
  h AS (SELECT eq, ug, px - lag(px) OVER (PARTITION BY eq, ug ORDER BY px, pattern_id) AS gap FROM (SELECT pattern_id, main_equipment_name AS eq, utility_group AS ug, TRY_CAST(source_pos AS DOUBLE[])[1] AS px FROM stub) WHERE px IS NOT NULL),
  g AS (SELECT eq, ug FROM h WHERE gap IS NOT NULL GROUP BY eq, ug HAVING count(*) >= 2 AND avg(gap) > 0 AND stddev_pop(gap) / avg(gap) <= 0.8),
  n AS (SELECT c.guid, c.i, min(least({_SEGDIST.format('', 'n')}, {_SEGDIST.format('n', 'm')})) AS d FROM c JOIN obstacle o ON least(x, nx, mx) - lim <= maxx AND greatest(x, nx, mx) + lim >= minx AND least(y, ny, my) - lim <= maxy AND greatest(y, ny, my) + lim >= miny AND least(z, nz, mz) - lim <= maxz AND greatest(z, nz, mz) + lim >= minz GROUP BY 1, 2)
  SELECT c.guid, CAST(c.i - 1 AS INT) AS i, CASE WHEN abs(nz - 13700) < 50 THEN 'ZONE_CONSTRAINT' WHEN stub_kind = 'END' AND entry = b THEN 'DESTINATION_ENTRY' WHEN coalesce(stub_kind = 'START' AND first AND ({_FACE}) // 2 = {_WIDE}, false) THEN 'DESTINATION_ENTRY'
    WHEN n.d <= lim THEN 'OBSTACLE_AVOID' WHEN g.eq IS NOT NULL AND abs(nz - trunk) <= 50 THEN 'GROUP_ALIGNMENT' ELSE 'UNKNOWN' END AS cause
  FROM c LEFT JOIN n ON n.guid = c.guid AND n.i = c.i LEFT JOIN q ON q.eq IS NOT DISTINCT FROM c.eq AND q.ug IS NOT DISTINCT FROM c.ug LEFT JOIN g ON g.eq = c.eq AND g.ug = c.ug""")
def _(spark, root):
    """Cause of each corner, the first that holds: the floor plane; entry at the destination (an END stub turning into its last
    axis, or a START stub leaving its anchor's face); a box within the pipe's limit of either adjacent leg; the level of an
    evenly spaced group; else unknown."""
    w = W.partitionBy("guid").orderBy("i")
    e = P.exploded(spark, root).where("len >= 50").select("guid", "i", "a", "b", F.floor(F.col("axis") / 2).alias("ax"))
    entry = F.last("ax").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    e = e.select("*", F.lead("ax").over(w).alias("bx"), F.lead("b").over(w).alias("m"), entry.alias("entry")).where("bx is not null and ax <> bx")
    json = lambda c: F.from_json(c, "array<double>")
    s = A.stubs(spark, root).select(
        F.col("pattern_id").alias("guid"), "stub_kind", F.col("main_equipment_name").alias("eq"), F.col("utility_group").alias("ug"), json("anchor_min").alias("lo"), json("anchor_max").alias("hi"), json("source_pos").alias("p"),
        F.greatest(1.5 * (F.coalesce("diameter_mm", F.lit(0.0)) / 2 + 150), F.lit(600.0)).alias("lim"),
    )
    c = e.join(s, "guid").withColumn("first", F.row_number().over(w) == 1)
    # boxes of the two legs, grown by the pipe's own limit
    span = lambda f, k: f(F.col("a")[k], F.col("b")[k], F.col("m")[k])
    around = c.select(F.struct("guid", "i", "a", "b", "m", "lim").alias("id"), *[(span(F.least, k) - F.col("lim")).alias("min" + k) for k in "xyz"], *[(span(F.greatest, k) + F.col("lim")).alias("max" + k) for k in "xyz"])
    hits = SP.overlap_join(around, A.obstacles(spark, root))
    box = {m + k: F.col(f"b_{m}{k}") for m in ("min", "max") for k in "xyz"}
    leg = lambda u, v: G.samples_within(F.col(f"a_id.{u}"), F.col(f"a_id.{v}"), box, F.col("a_id.lim"))
    near = hits.where(leg("a", "b") | leg("b", "m")).select("a_id.guid", "a_id.i").distinct().withColumn("near", F.lit(True))
    # evenly spaced groups and the level of their corners
    trunk = c.groupBy("eq", "ug").agg(F.avg("b.z").alias("trunk"))
    px = s.select("guid", "eq", "ug", F.get("p", F.lit(0)).alias("px")).where("px is not null")
    step = px.withColumn("gap", F.col("px") - F.lag("px").over(W.partitionBy("eq", "ug").orderBy("px", "guid"))).where("gap is not null")
    even = step.groupBy("eq", "ug").agg(F.count("*").alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd")).where("n >= 2 and m > 0 and sd / m <= 0.8 and eq is not null and ug is not null")
    level = even.join(trunk, ["eq", "ug"]).select("eq", "ug", "trunk")
    at = lambda col, i: F.get(col, F.lit(i))
    anchor = {m + k: at(a, i) for m, a in (("min", "lo"), ("max", "hi")) for i, k in enumerate("xyz")}
    source = {k: at("p", i) for i, k in enumerate("xyz")}
    face = F.floor(G.nearest_face(source, anchor) / 2)
    wide = F.floor(G.axis_snap(*[F.col("b")[k] - source[k] for k in "xyz"]) / 2)
    whole = F.size("p") == 3
    cause = (
        F.when(F.abs(F.col("b.z") - G.CSF_PLANE_Z) < 50, "ZONE_CONSTRAINT")
        .when((F.col("stub_kind") == "END") & (F.col("entry") == F.col("bx")), "DESTINATION_ENTRY")
        .when((F.col("stub_kind") == "START") & F.col("first") & whole & (F.size("lo") == 3) & (F.size("hi") == 3) & (face == wide), "DESTINATION_ENTRY")
        .when(F.col("near"), "OBSTACLE_AVOID").when(F.abs(F.col("b.z") - F.col("trunk")) <= 50, "GROUP_ALIGNMENT").otherwise("UNKNOWN")
    )
    return c.join(near, ["guid", "i"], "left").join(level, ["eq", "ug"], "left").select("guid", "i", cause.alias("cause"))


@query("g18_riser_bundles", "leg stub", """WITH v AS (SELECT l.guid || '#' || l.i AS id, l.guid, coalesce(s.utility_group, '') AS g, l.x, l.y, least(l.z, nz) AS lo, greatest(l.z, nz) AS hi, axis FROM leg l JOIN stub s ON s.pattern_id = l.guid WHERE len >= 100 AND axis >= 4),
  pr AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.g = b.g AND a.id < b.id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 500), ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
  rc AS (SELECT a AS node, a AS component FROM ed UNION SELECT ed.b, rc.component FROM rc JOIN ed ON ed.a = rc.node), lb AS (SELECT node, min(component) AS component FROM rc GROUP BY node)
  SELECT component, any_value(g) AS utility_group, count(DISTINCT guid) AS n_lines, count(*) AS n_legs, round(max(hi) - min(lo), 3) AS extent, CASE WHEN count(*) FILTER (axis = 4) * 2 >= count(*) THEN '+z' ELSE '-z' END AS direction FROM lb JOIN v ON v.id = lb.node GROUP BY component HAVING count(DISTINCT guid) >= 2 AND max(hi) - min(lo) >= 500""")
def _(spark, root):
    """Vertical legs of one utility group chained by distances of up to 500 mm in plan, two or more lines, 500 mm or more in height."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), F.coalesce("utility_group", F.lit("")).alias("utility_group"))
    v = P.exploded(spark, root).where("len >= 100 and axis >= 4").join(s, "guid").select(
        F.concat_ws("#", "guid", (F.col("i") + 1).cast("string")).alias("id"), "guid", "utility_group", "axis", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.least("a.z", "b.z").alias("lo"), F.greatest("a.z", "b.z").alias("hi"))
    cell = [F.floor(F.col(c) / 500).alias("c" + c) for c in "xy"]
    one = v.select("id", "utility_group", "x", "y", *cell)
    steps = F.sequence(F.lit(-1), F.lit(1))
    other = one.select(F.col("id").alias("b"), "utility_group", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.transform(steps, lambda k: F.col("cx") + k)).alias("cx"), "cy")
    other = other.select("b", "utility_group", "ox", "oy", "cx", F.explode(F.transform(steps, lambda k: F.col("cy") + k)).alias("cy"))
    near = one.join(other, ["utility_group", "cx", "cy"]).where("id < b").where(F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2) <= 500)
    c = SP.components(near.select(F.col("id").alias("a"), "b"))
    g = c.join(v, F.col("node") == F.col("id")).groupBy("component").agg(
        F.first("utility_group").alias("utility_group"), F.count_distinct("guid").alias("n_lines"), F.count("*").alias("n_legs"), F.round(F.max("hi") - F.min("lo"), 3).alias("extent"),
        F.when(F.count_if(F.col("axis") == 4) * 2 >= F.count("*"), "+z").otherwise("-z").alias("direction"))
    return g.where("n_lines >= 2 and extent >= 500")


SQL["g18_riser_bundles"] = SQL["g18_riser_bundles"].replace("WITH ", "WITH RECURSIVE ", 1)


# ---- lifecycle, evaluation, profiles


@query("l03_promotion", "", """WITH m AS (SELECT * FROM tb_route_source_scope_manifest WHERE project_scope_key IS NOT NULL AND model_revision_key IS NOT NULL),
  w AS (SELECT project_scope_key AS p, max_by(model_revision_key, (applied_at, model_revision_key)) AS v FROM m WHERE applied_at IS NOT NULL GROUP BY 1), o AS (SELECT m.*, w.v = m.model_revision_key AS asked FROM m LEFT JOIN w ON w.p = m.project_scope_key),
  k AS (SELECT *, coalesce(bool_or(asked AND status IN ('READY', 'ACTIVE', 'RETIRED')) OVER (PARTITION BY project_scope_key), false) AS moved FROM o)
  SELECT project_scope_key, model_revision_key, status, CASE WHEN asked AND status IN ('READY', 'ACTIVE', 'RETIRED') THEN 'ACTIVE' WHEN moved AND status = 'ACTIVE' THEN 'RETIRED' ELSE status END AS new_status, coalesce(asked, false) AND NOT coalesce(status IN ('READY', 'ACTIVE', 'RETIRED'), false) AS refused,
    CASE WHEN status = 'ACTIVE' THEN 'ACTIVE' ELSE 'RETIRED' END AS retired_status, coalesce(status = 'ACTIVE', false) AS retire_refused FROM k""")
def _(spark, root):
    """Every project's latest revision promoted; and, beside it, every revision retired without force."""
    m = table(spark, root, "tb_route_source_scope_manifest").where("project_scope_key is not null and model_revision_key is not null").select("project_scope_key", "model_revision_key", "status", "applied_at")
    latest = m.where("applied_at is not null").groupBy("project_scope_key").agg(F.max_by("model_revision_key", F.struct("applied_at", "model_revision_key")).alias("model_revision_key"))
    up = K.promote(m.drop("applied_at"), latest)
    down = K.retire(m.drop("applied_at"), m).select("project_scope_key", "model_revision_key", F.col("new_status").alias("retired_status"), F.col("refused").alias("retire_refused"))
    return up.join(down, ["project_scope_key", "model_revision_key"])


_CONTENT = "CAST(sum(CAST('0x' || left(md5(guid || '|' || CAST(member_order AS VARCHAR) || '|' || coalesce(pipe_size, '') || '|' || coalesce(direction_pattern, '')), 12) AS BIGINT)) AS DECIMAL(38,0))"
_SINCE = "2025-06-01"


def _contents(spark, root):
    """Fingerprints of the groups' members now and as of ``_SINCE``: every value of every member counts, their order does not."""
    m = A.members(spark, root)
    columns = ["guid", "member_order", "pipe_size", "direction_pattern"]
    return AG.content_hash(m, ["group_vector_id"], columns), AG.content_hash(m.where(F.col("created_at") < F.lit(_SINCE).cast("timestamp")), ["group_vector_id"], columns)


@query("k03_content_refresh", "grp member", f"""WITH c AS (SELECT group_vector_id AS g, {_CONTENT} AS h FROM member GROUP BY 1), o AS (SELECT group_vector_id AS g, {_CONTENT} AS h FROM member WHERE created_at < TIMESTAMP '{_SINCE}' GROUP BY 1),
  s AS (SELECT o.g, o.h, grp.status FROM o JOIN grp ON grp.group_vector_id = o.g) SELECT coalesce(c.g, s.g) AS group_vector_id, CASE WHEN c.g IS NULL THEN 'STALE' WHEN s.g IS NULL THEN 'NEW' WHEN c.h = s.h AND status = 'READY' THEN 'SAME' ELSE 'CHANGED' END AS action FROM c FULL JOIN s ON c.g = s.g""")
def _(spark, root):
    """What a rebuild has to do since a date: groups by the fingerprint of their members' content."""
    now, then = _contents(spark, root)
    stored = then.join(A.groups(spark, root).select("group_vector_id", "status"), "group_vector_id")
    return K.refresh_plan(now, stored, "group_vector_id", "fingerprint")


@query("l08_content_drift", "grp member", f"""WITH c AS (SELECT group_vector_id AS g, {_CONTENT} AS h FROM member GROUP BY 1), o AS (SELECT group_vector_id AS g, {_CONTENT} AS h FROM member WHERE created_at < TIMESTAMP '{_SINCE}' GROUP BY 1)
  SELECT grp.group_vector_id, coalesce(abs(sqrt(list_dot_product(feature_centroid, feature_centroid)) - 1) <= 1e-5, false) AS unit_norm, o.h IS DISTINCT FROM c.h AS drift FROM grp LEFT JOIN c ON c.g = grp.group_vector_id LEFT JOIN o ON o.g = grp.group_vector_id""")
def _(spark, root):
    now, then = _contents(spark, root)
    g = A.groups(spark, root).select("group_vector_id", F.coalesce(F.abs(V.norm(F.col("feature_centroid")) - 1) <= 1e-5, F.lit(False)).alias("unit_norm"))
    j = g.join(now.select("group_vector_id", F.col("fingerprint").alias("a")), "group_vector_id", "left").join(then.select("group_vector_id", F.col("fingerprint").alias("b")), "group_vector_id", "left")
    return j.select("group_vector_id", "unit_norm", (~F.col("a").eqNullSafe(F.col("b"))).alias("drift"))


@query("a21_outcomes", "ablog", """WITH a AS (SELECT request_key, run_id, arm, bool_and(success) AS ok, list(DISTINCT reason) AS r FROM ablog GROUP BY ALL),
  p AS (SELECT b.ok AS b, c.ok AS c, len(list_intersect(b.r, c.r)) / CAST(len(list_distinct(list_concat(b.r, c.r))) AS DOUBLE) AS j FROM a b JOIN a c ON b.request_key = c.request_key AND b.run_id = c.run_id AND b.arm = 'BASELINE' AND c.arm = 'CONTEXT')
  SELECT CASE WHEN b AND c THEN 'BOTH' WHEN b THEN 'ONLY_BASELINE' WHEN c THEN 'ONLY_CONTEXT' ELSE 'NEITHER' END AS outcome, count(*) AS pairs, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, round(avg(j), 6) AS mean_jaccard FROM p GROUP BY 1""")
def _(spark, root):
    """Outcome matrix of the paired arms, and how alike their kinds of results are."""
    a = A.ab_log(spark, root).groupBy("request_key", "run_id", "arm").agg(F.bool_and("success").alias("ok"), F.collect_set("reason").alias("r"))
    b = a.where("arm = 'BASELINE'").select("request_key", "run_id", F.col("ok").alias("b"), F.col("r").alias("rb"))
    p = a.where("arm = 'CONTEXT'").join(b, ["request_key", "run_id"])
    j = F.size(F.array_intersect("r", "rb")) / F.size(F.array_union("r", "rb"))
    outcome = F.when(F.col("b") & F.col("ok"), "BOTH").when(F.col("b"), "ONLY_BASELINE").when(F.col("ok"), "ONLY_CONTEXT").otherwise("NEITHER")
    g = p.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("pairs"), F.avg(j).alias("j"))
    return g.select("outcome", "pairs", R6(F.col("pairs") / F.sum("pairs").over(W.partitionBy())).alias("share"), R6("j").alias("mean_jaccard"))  # four rows


#: The columns a source table should have, and their types.
EXPECTED = {
    "tb_route_path": "route_path_guid string, process_name string, equipment_name string, equipment_tag string, utility_group string, source_utility string, source_size string, target_owner_name string, bay string, project_scope_key string, model_revision_key string, source_posx double, source_posy double, source_posz double, target_posx double, target_posy double, target_posz double, total_length double, bend_count double, loaded_at timestamp, deleted_at timestamp",
    "tb_route_stub_pattern": "pattern_id string, route_path_guid string, stub_kind string, anchor_kind string, utility string, face string, dir_seq string, n_bends int, stub_length_mm double, stub_points string, feat_json string, created_at timestamp, feat_vector array<double>",
    "tb_route_utility_group_member": "group_vector_id string, route_path_guid string, member_order int, pipe_size string, direction_pattern string, step_count bigint, created_at timestamp",
}


def _schema_sql() -> str:
    parts = []
    for t, columns in EXPECTED.items():
        for c, kind in (x.split() for x in columns.split(", ")):
            missing = c == "feat_vector"
            blanks = f"count(*) FILTER (trim({c}) = '')" if kind == "string" else "0"
            fits = "NULL" if missing else "FALSE" if c == "step_count" else "TRUE"
            counts = "NULL AS nulls, NULL AS blanks" if missing else f"count(*) FILTER ({c} IS NULL) AS nulls, {blanks} AS blanks"
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", {str(not missing).upper()} AS present, CAST({fits} AS BOOLEAN) AS type_fits, {counts}, count(*) AS n_rows FROM {t}")
    return " UNION ALL ".join(parts)


@query("s17_full_schema", "", _schema_sql())
def _(spark, root):
    """Expected columns of three tables: whether they are there, with the expected type, their NULLs and blanks; one pass a table."""
    out = None
    for t, columns in EXPECTED.items():
        df = table(spark, root, t)
        types = dict(df.dtypes)
        want = [x.split() for x in columns.split(", ")]
        found = K.profile(df.select(*[c for c, _ in want if c in types]))
        wished = spark.createDataFrame([(c, kind) for c, kind in want], "column string, wished string")
        rows = found.agg(F.max("n_rows").alias("n_all"))
        one = wished.join(found, "column", "left").crossJoin(rows)  # a row per expected column, and one row
        like = F.regexp_replace("type", "timestamp_ntz", "timestamp")
        one = one.select(F.lit(t).alias("table_name"), "column", F.col("type").isNotNull().alias("present"), (like == F.col("wished")).alias("type_fits"), "nulls", "blanks", F.col("n_all").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


#: Least and recommended distance in mm between pipes of a material and nominal size.
SPACING = [
    ("GALV", "100A", 150.0, 170.0), ("GALV", "125A", 170.0, 200.0), ("GALV", "150A", 200.0, 230.0), ("GALV", "200A", 250.0, 280.0), ("GALV", "250A", 300.0, 330.0),
    ("구조관", "50A", 90.0, 120.0), ("구조관", "100A", 150.0, 170.0), ("구조관", "125A", 170.0, 200.0), ("구조관", "150A", 200.0, 230.0), ("구조관", "200A", 250.0, 280.0), ("구조관", "250A", 300.0, 330.0),
    ("FM PVC", "100A", 160.0, 190.0), ("FM PVC", "125A", 190.0, 220.0),
]


@query("l10_pipe_spacing", "member", f"WITH r(material, size, least_mm, recommended_mm) AS (VALUES {', '.join(map(str, SPACING))}) SELECT m.group_vector_id, m.guid, m.member_order, r.material, r.least_mm::DOUBLE AS least_mm, r.recommended_mm::DOUBLE AS recommended_mm FROM member m JOIN r ON r.size = regexp_replace(upper(regexp_replace(coalesce(m.pipe_size, ''), '\\s+', '', 'g')), '^0*(\\d+(?:\\.\\d+)?[A-Z]*)$', '\\1')")
def _(spark, root):
    """Spacing rules that apply to each member, by its size; the rules are a fixed short list."""
    rules = F.broadcast(spark.createDataFrame(SPACING, "material string, size string, least_mm double, recommended_mm double"))
    m = A.members(spark, root).select("group_vector_id", "guid", "member_order", S.normalize_size(F.col("pipe_size")).alias("size"))
    return m.join(rules, "size").drop("size")


# ---- group search: order and evaluation


#: How members' sizes are compared, weights of position, pattern, feature and context, share of the arrangement.
PROFILES = {
    "Baseline-PreferExact": ("PreferExact", (1, 1, 1, 1), 0.2), "Size-ExactOnly": ("ExactOnly", (1, 1, 1, 1), 0.2), "Size-Ignore": ("Ignore", (1, 1, 1, 1), 0.2),
    "Context-Off": ("PreferExact", (1, 1, 1, 0), 0.2), "Arrangement-Off": ("PreferExact", (1, 1, 1, 1), 0.0),
}


def _rung(size: str) -> int | None:
    digits = "".join(c for c in size if c.isdigit() or c == ".")
    try:
        v = float(digits)
    except ValueError:
        return None
    return min(range(len(S.LADDER)), key=lambda i: (abs(S.LADDER[i] - v), i))


@functools.lru_cache(100_000)
def _size_score(a: str, b: str, mode: str) -> float | None:
    """Factor of a pair; None where the two may not be paired."""
    if mode == "Ignore" or a == b:
        return 1.0
    if mode == "ExactOnly":
        return None
    x, y = _rung(a), _rung(b)
    return 0.0 if x is None or y is None else {0: 1.0, 1: 0.8, 2: 0.5}.get(abs(x - y), 0.0)


def _vectors(rows: list[dict], name: str) -> list[np.ndarray | None]:
    return [None if r[name] is None else np.asarray(r[name], dtype=float) for r in rows]


def _cosines(rows: list[dict], others: list[dict], name: str, none: float) -> np.ndarray:
    """Cosines of the two sides' vectors; 0 for another length or no length, ``none`` where either is missing."""
    a, b = _vectors(rows, name), _vectors(others, name)
    out = np.full((len(a), len(b)), none)
    for dim in {len(v) for v in a if v is not None}:
        i = [k for k, v in enumerate(a) if v is not None and len(v) == dim]
        j = [k for k, v in enumerate(b) if v is not None and len(v) == dim]
        if j:
            x, y = np.stack([a[k] for k in i]), np.stack([b[k] for k in j])
            m, n = (np.linalg.norm(v, axis=1) for v in (x, y))
            good = (m[:, None] > 1e-12) & (n[None, :] > 1e-12)
            out[np.ix_(i, j)] = np.where(good, x @ y.T / np.where(good, m[:, None] * n[None, :], 1.0), 0.0)
        other = [k for k, v in enumerate(b) if v is not None and len(v) != dim]
        out[np.ix_(i, other)] = 0.0
    return out


def _searched(pairs, profiles: dict) -> dict:
    """Query groups against candidate groups under every profile, which stands in front."""
    q, c = pairs.q.rows, pairs.c.rows
    feature, context = _cosines(q, c, "feature", 0.0), _cosines(q, c, "context", np.nan)
    shape = pairs.positions.shape
    parts = [pairs.positions, pairs.patterns, *[np.broadcast_to(v[:, :, None, None], shape) for v in (feature, context)]]
    known = [~np.isnan(p) for p in parts]
    parts = [np.where(k, np.clip(p, 0.0, 1.0), 0.0) for k, p in zip(known, parts)]
    sizes: dict = {}
    chosen: dict = {}
    out = []
    for mode, weights, share in profiles.values():
        if (mode, weights) not in chosen:
            if mode not in sizes:
                sizes[mode] = pairs.sizes(lambda x, y, mode=mode: -1.0 if (v := _size_score(x, y, mode)) is None else v)
            size = sizes[mode]
            total = sum(w * k for w, k in zip(weights, known))
            score = np.where((size >= 0) & (total > 0), sum(w * p for w, p in zip(weights, parts)) / np.maximum(total, 1e-300) * size, -1.0)
            chosen[mode, weights] = pairs.chosen(np.maximum(score, 0.0))
        out.append(SQ.group_scores(*chosen[mode, weights], pairs.members, pairs.arrangement, 1 - share, share))
    total, coverage, mean = (np.stack(x) for x in zip(*out))
    return {"profile": np.array([*profiles], dtype=object)[:, None, None], "distance": 1 - feature, "score": total, "coverage": coverage, "matched": mean, "arrangement": pairs.arrangement}


def group_search(groups: DataFrame, queries: DataFrame, k: int = 5, profiles: dict = PROFILES) -> DataFrame:
    """The ``k`` best other groups of a query's utility group and utility under every profile, ranked by similarity, mean of the
    matched members, arrangement (all falling), vector distance and identifier (rising)."""
    side = lambda df: df.select(F.col("group_vector_id").alias("id"), F.concat("utility_group", F.lit("\n"), "utility").alias("bucket"), "ms", F.col("feature_centroid").alias("feature"), F.col("ctx").alias("context"))
    found = PS.in_pairs(side(groups), side(queries), lambda pairs: _searched(pairs, profiles), "profile string, query_id string, group_vector_id string, distance double, score double, coverage double, matched double, arrangement double")
    down = lambda c: F.round(c, 9).desc()
    order = W.partitionBy("profile", "query_id").orderBy(down("score"), down("matched"), down("arrangement"), F.round("distance", 9), "group_vector_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searchable(spark, root):
    from pipeloom.plans.search import valid_groups

    g = valid_groups(spark, root).select("group_vector_id", "utility_group", "utility", "feature_centroid", F.when(A.is_vector(F.col("context_centroid"), 30), F.col("context_centroid")).alias("ctx"))
    return cut_lineage(g.join(PS._members(spark, root), "group_vector_id"))


BASELINE = {"Baseline-PreferExact": PROFILES["Baseline-PreferExact"]}


@query("r12_group_top_k")
def _(spark, root):
    """The five best groups for every group whose identifier is divisible by 100, with the whole chain of ties."""
    g = _searchable(spark, root)
    top = group_search(g, g.where(PS.hundredth("group_vector_id")), profiles=BASELINE)
    return top.select("query_id", "rank", "group_vector_id", *[R6(c).alias(c) for c in ("score", "coverage", "matched", "arrangement")])


@query("r22_group_profiles")
def _(spark, root):
    """Five search profiles over the groups whose identifier is divisible by 100: results, means of the first place, how often it is the
    baseline's, whether a repeated run over rows in another order gives the same first places, and whether no group finds itself."""
    g = _searchable(spark, root)
    asked = PS.hundredth("group_vector_id")
    found = cut_lineage(group_search(g, g.where(asked)))
    again = group_search(g.repartition(7, "utility"), g.where(asked), profiles=BASELINE).where("rank = 1").select("query_id", F.col("group_vector_id").alias("again"))
    base = found.where("rank = 1 and profile = 'Baseline-PreferExact'").select("query_id", F.col("group_vector_id").alias("base"))
    returned = found.groupBy("profile", "query_id").agg(F.count("*").alias("n"), F.bool_and(F.col("query_id") != F.col("group_vector_id")).alias("others"))
    first = found.where("rank = 1").drop("rank").join(returned, ["profile", "query_id"]).join(base, "query_id").join(again, "query_id")
    return first.groupBy("profile").agg(
        F.count("*").alias("queries"), R6(F.avg("n")).alias("mean_returned"), *[R6(F.avg(c)).alias(f"mean_top1_{c}") for c in ("score", "coverage", "arrangement")],
        R6(F.avg((F.col("group_vector_id") == F.col("base")).cast("int"))).alias("baseline_kept"), F.bool_and(F.col("base") == F.col("again")).alias("deterministic"), F.bool_and("others").alias("self_excluded"))


_AXIS2 = "CASE WHEN abs({0}x) >= abs({0}y) AND abs({0}x) >= abs({0}z) THEN CASE WHEN {0}x >= 0 THEN 0 ELSE 1 END WHEN abs({0}y) >= abs({0}z) THEN CASE WHEN {0}y >= 0 THEN 2 ELSE 3 END ELSE CASE WHEN {0}z >= 0 THEN 4 ELSE 5 END END"
_EVALUATED = f"""v AS (SELECT g.group_vector_id AS id, g.utility, g.feature_centroid AS f, x.context_centroid AS c, {_AXIS2.format('g.d')} AS a1, g.member_count AS mc, p.pattern AS pt FROM
    (SELECT *, end_centroid_x - start_centroid_x AS dx, end_centroid_y - start_centroid_y AS dy, end_centroid_z - start_centroid_z AS dz FROM gvec) g LEFT JOIN gctx x ON x.group_vector_id = g.group_vector_id LEFT JOIN
    (SELECT group_vector_id, arg_min(pattern, (-n, pattern)) AS pattern FROM (SELECT group_vector_id, upper(regexp_replace(coalesce(direction_pattern, ''), '[^RHDrhd]', '', 'g')) AS pattern, count(*) AS n FROM member GROUP BY ALL) GROUP BY 1) p ON p.group_vector_id = g.group_vector_id),
  n AS (SELECT q.id AS q, o.id AS o, q.c IS NOT NULL AS qc, o.c IS NOT NULL AS oc, q.a1 = o.a1 AS axis, coalesce(q.pt = o.pt AND q.pt <> '', false) AS pattern, q.a1 = o.a1 AND coalesce(q.pt = o.pt AND q.pt <> '', false) AS both_, list_cosine_similarity(q.f, o.f) AS fs, CASE WHEN q.c IS NOT NULL AND o.c IS NOT NULL THEN list_cosine_similarity(q.c, o.c) END AS cs
    FROM v q JOIN v o ON o.utility = q.utility AND o.id <> q.id WHERE CAST('0x' || right(q.id, 12) AS BIGINT) % 100 = 0),
  k AS (SELECT n.*, w, row_number() OVER (PARTITION BY q, w ORDER BY round((1 - w) * fs + w * greatest(0, coalesce(cs, 0)), 9) DESC, o) AS r FROM n, (VALUES (0.0), (0.1), (0.2), (0.3)) t(w)),
  m AS (SELECT CAST(w AS DOUBLE) AS weight, count(DISTINCT q) AS queries, avg(CAST(axis AS INT)) FILTER (r = 1) AS axis_at1, avg(CAST(pattern AS INT)) FILTER (r = 1) AS pattern_at1, avg(CAST(both_ AS INT)) FILTER (r = 1) AS both_at1, avg(CAST(axis AS INT)) FILTER (r <= 5) AS axis_at5, avg(CAST(pattern AS INT)) FILTER (r <= 5) AS pattern_at5,
    avg(fs) FILTER (r = 1) AS mean_feature, avg(cs) FILTER (r = 1) AS mean_context, avg(CAST(qc AS INT)) FILTER (r = 1) AS query_context, avg(CAST(oc AS INT)) FILTER (r <= 5) AS candidate_context FROM k GROUP BY w)"""
_FIGURES = ["axis_at1", "pattern_at1", "both_at1", "axis_at5", "pattern_at5", "mean_feature", "mean_context", "query_context", "candidate_context"]


def _evaluated(spark, root):
    """Ranking figures at four context weights over the groups whose identifier is divisible by 100."""
    from pipeloom.plans.search import valid_groups

    move = [F.col(f"end_centroid_{c}") - F.col(f"start_centroid_{c}") for c in "xyz"]
    letters = F.upper(F.regexp_replace(F.coalesce("direction_pattern", F.lit("")), "[^RHDrhd]", ""))
    usual = A.members(spark, root).groupBy("group_vector_id", letters.alias("p")).agg(F.count("*").alias("n")).groupBy("group_vector_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "p"))["p"].alias("pt"))
    g = valid_groups(spark, root).select("group_vector_id", "utility", F.col("feature_centroid").alias("f"), F.when(A.is_vector(F.col("context_centroid"), 30), F.col("context_centroid")).alias("c"), G.axis_snap(*move).alias("a1")).join(usual, "group_vector_id", "left")
    q = g.where(PS.hundredth("group_vector_id")).select("utility", *[F.col(c).alias("q_" + c) for c in ("group_vector_id", "f", "c", "a1", "pt")])
    j = g.join(q, "utility").where("group_vector_id <> q_group_vector_id")
    pattern = F.coalesce((F.col("pt") == F.col("q_pt")) & (F.col("pt") != ""), F.lit(False))
    axis = F.col("a1") == F.col("q_a1")
    j = j.select(
        F.col("q_group_vector_id").alias("q"), F.col("group_vector_id").alias("o"), F.col("q_c").isNotNull().alias("qc"), F.col("c").isNotNull().alias("oc"), axis.alias("axis"), pattern.alias("pattern"), (axis & pattern).alias("both"),
        V.cosine(F.col("f"), F.col("q_f")).alias("fs"), F.when(F.col("c").isNotNull() & F.col("q_c").isNotNull(), V.cosine(F.col("c"), F.col("q_c"))).alias("cs"), F.explode(F.array(*[F.lit(w) for w in (0.0, 0.1, 0.2, 0.3)])).alias("weight"))
    score = F.round((1 - F.col("weight")) * F.col("fs") + F.col("weight") * F.greatest(F.lit(0.0), F.coalesce("cs", F.lit(0.0))), 9)
    k = j.withColumn("r", F.row_number().over(W.partitionBy("q", "weight").orderBy(score.desc(), "o"))).where("r <= 5")
    at = lambda c, n: F.avg(F.when(F.col("r") <= n, F.col(c).cast("double")))
    return k.groupBy("weight").agg(
        F.count_distinct("q").alias("queries"), at("axis", 1).alias("axis_at1"), at("pattern", 1).alias("pattern_at1"), at("both", 1).alias("both_at1"), at("axis", 5).alias("axis_at5"), at("pattern", 5).alias("pattern_at5"),
        at("fs", 1).alias("mean_feature"), at("cs", 1).alias("mean_context"), at("qc", 1).alias("query_context"), at("oc", 5).alias("candidate_context"))


@query("a22_axis_pattern_metrics", "gvec gctx member", f"WITH {_EVALUATED} SELECT weight, queries, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)} FROM m")
def _(spark, root):
    """Share of right axes, patterns and both at the first and the first five places, and mean cosines, for four context weights."""
    return _evaluated(spark, root).select("weight", "queries", *[R6(c).alias(c) for c in _FIGURES])


#: The gate's thresholds.
GATE = {"query_context": 0.9, "candidate_context": 0.5, "both_axes_gain": 0.0, "pattern_gain": 0.0, "feature_drop": 0.05, "queries": 10, "weight": 0.1}


@query("r20_seven_checks", "gvec gctx member", f"""WITH {_EVALUATED}, p AS (SELECT {', '.join(f'max({c}) FILTER (weight = 0.1) AS {c}' for c in ('query_context', 'candidate_context', 'both_at1', 'pattern_at1', 'mean_feature', 'queries'))}, max(both_at1) FILTER (weight = 0.0) AS b0, max(pattern_at1) FILTER (weight = 0.0) AS p0, max(mean_feature) FILTER (weight = 0.0) AS f0, arg_max(weight, (round(both_at1, 9), round(pattern_at1, 9), -weight)) AS best FROM m),
  c AS (SELECT coalesce(query_context >= {GATE['query_context']}, false) AS query_context, coalesce(candidate_context >= {GATE['candidate_context']}, false) AS candidate_context, coalesce((both_at1 - b0) * 100 >= {GATE['both_axes_gain']}, false) AS both_axes_gain, coalesce((pattern_at1 - p0) * 100 >= {GATE['pattern_gain']}, false) AS pattern_gain,
    coalesce(f0 - mean_feature <= {GATE['feature_drop']}, false) AS feature_drop, coalesce(queries >= {GATE['queries']}, false) AS queries, coalesce(abs(best - {GATE['weight']}) < 1e-12, false) AS weight FROM p)
  SELECT *, CASE WHEN {' AND '.join(GATE)} THEN 'PASS' ELSE 'BLOCK' END AS status FROM c""")
def _(spark, root):
    """The deployment gate: seven checks of the present weight against weight 0; a missing figure fails."""
    m = _evaluated(spark, root)
    nine = lambda c: F.round(c, 9)
    of = lambda c, w: F.max(F.when(F.col("weight") == w, F.col(c)))
    r = m.agg(
        *[of(c, GATE["weight"]).alias(c) for c in ("query_context", "candidate_context", "both_at1", "pattern_at1", "mean_feature", "queries")], *[of(c, 0.0).alias(c + "_0") for c in ("both_at1", "pattern_at1", "mean_feature")],
        F.max(F.struct(nine("both_at1").alias("b"), nine("pattern_at1").alias("p"), (-F.col("weight")).alias("w")))["w"].alias("best"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "query_context": F.col("query_context") >= GATE["query_context"], "candidate_context": F.col("candidate_context") >= GATE["candidate_context"],
        "both_axes_gain": (F.col("both_at1") - F.col("both_at1_0")) * 100 >= GATE["both_axes_gain"], "pattern_gain": (F.col("pattern_at1") - F.col("pattern_at1_0")) * 100 >= GATE["pattern_gain"],
        "feature_drop": F.col("mean_feature_0") - F.col("mean_feature") <= GATE["feature_drop"], "queries": F.col("queries") >= GATE["queries"], "weight": F.abs(-F.col("best") - GATE["weight"]) < 1e-12,
    }
    everything = F.lit(True)
    for c in checks.values():
        everything = everything & sure(c)
    return r.select(*[sure(c).alias(k) for k, c in checks.items()], F.when(everything, "PASS").otherwise("BLOCK").alias("status"))


QUERIES = Q
