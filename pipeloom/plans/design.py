"""Boxes, takeoffs, stub features, templates, causes of bends, exports and the remaining report queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions import vector as V
from pipeloom.functions.text import norm_text
from pipeloom.operators import design as O
from pipeloom.operators.order import numbered
from pipeloom.operators import spatial as SP
from pipeloom.operators.search import in_blocks
from pipeloom.plans import polyline as P
from pipeloom.plans import sequential as PS
from pipeloom.plans.oracle_views import over
from pipeloom.plans.sequential import hundredth
from pipeloom.plans.spatial import _ANCHORS, anchors
from pipeloom.session import cut_lineage, shuffle_width
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


_BOXES = "bx AS (SELECT id, kind, hi[1] - lo[1] AS wx, hi[2] - lo[2] AS wy, hi[3] - lo[3] AS wz, (hi[1] + lo[1]) / 2 AS mx, (hi[2] + lo[2]) / 2 AS my, (hi[3] + lo[3]) / 2 AS mz, lo, hi FROM (SELECT DISTINCT id, kind, lo, hi FROM an))"


def boxes(spark, root):
    return anchors(spark, root).drop("utility").distinct()


@query("e26_box_sizes", "stub", f"WITH {_ANCHORS}, {_BOXES} SELECT id, round(greatest(wx, wy), 3) AS length, round(least(wx, wy), 3) AS width, round(wz, 3) AS height, wx >= wy AS along_x FROM bx")
def _(spark, root):
    b = boxes(spark, root)
    f = O.frame({c: F.col(c) for c in b.columns})
    return b.select("id", F.round(f["length"], 3).alias("length"), F.round(f["width"], 3).alias("width"), F.round(f["height"], 3).alias("height"), f["along_x"].alias("along_x"))


@query("e25_footprints", "stub", f"WITH {_ANCHORS}, {_BOXES} SELECT id, 4 AS n, round(lo[1], 3) AS first_x, round(lo[2], 3) AS first_y, round(hi[1], 3) AS third_x, round(hi[2], 3) AS third_y FROM bx")
def _(spark, root):
    b = boxes(spark, root)
    d = b.withColumn("f", O.footprint(O.corners({c: F.col(c) for c in b.columns})))
    return d.select("id", F.size("f").alias("n"), F.round(F.col("f")[0]["x"], 3).alias("first_x"), F.round(F.col("f")[0]["y"], 3).alias("first_y"), F.round(F.col("f")[2]["x"], 3).alias("third_x"), F.round(F.col("f")[2]["y"], 3).alias("third_y"))


@query("e31_oriented_boxes")
def _(spark, root):
    """Axes and half extents of the corner clouds, by singular values."""
    b = boxes(spark, root)
    d = b.select("id", O.corners({c: F.col(c) for c in b.columns}).alias("vs"))

    def run(batches):
        for pdf in batches:
            out = []
            for ident, vs in zip(pdf["id"], pdf["vs"]):
                p = np.array([[v["x"], v["y"], v["z"]] for v in vs])
                m = p - p.mean(axis=0)
                half = np.abs(m @ np.linalg.svd(m)[2].T).max(axis=0)
                out.append((ident, round(float(8 * half.prod()), 2), round(float(half.max()), 3)))
            yield pd.DataFrame(out, columns=["id", "volume", "longest_half"])

    return d.mapInPandas(run, "id string, volume double, longest_half double")


_TAKE = f"""WITH {_ANCHORS}, {_BOXES}, tk AS (SELECT s.pattern_id, bx.id, CAST(s.source_pos AS DOUBLE[]) AS p, bx.* EXCLUDE (id) FROM stub s JOIN bx ON bx.id = s.anchor_kind || ':' || s.anchor_name || ':' || s.anchor_min WHERE s.source_pos IS NOT NULL),
  fr AS (SELECT pattern_id, id, CASE WHEN wx >= wy THEN p[1] - mx ELSE p[2] - my END / greatest(greatest(wx, wy) / 2, 1e-9) AS al, CASE WHEN wx >= wy THEN p[2] - my ELSE p[1] - mx END AS ac, (p[3] - mz) / greatest(wz / 2, 1e-9) AS h, least(wx, wy) AS w FROM tk),
  fa AS (SELECT *, CASE WHEN abs(al) >= 0.95 THEN 'END' WHEN abs(h) >= abs(ac / greatest(w / 2, 1e-9)) THEN CASE WHEN h >= 0 THEN 'TOP' ELSE 'BOTTOM' END ELSE CASE WHEN ac >= 0 THEN 'SIDE_A' ELSE 'SIDE_B' END END AS face FROM fr)"""


def takeoffs(spark, root):
    b = boxes(spark, root)
    p = F.from_json("source_pos", "array<double>")
    s = A.stubs(spark, root).where("source_pos is not null").select("pattern_id", F.concat_ws(":", "anchor_kind", "anchor_name", "anchor_min").alias("id"), *[p[i].alias(c) for i, c in enumerate("xyz")])
    j = s.join(b, "id")
    face, along, across = O.takeoff_face({c: F.col(c) for c in "xyz"}, {c: F.col(c) for c in b.columns})
    return j.select("pattern_id", "id", face.alias("face"), along.alias("along"), across.alias("across"))


@query("g37_takeoff_faces", "stub", _TAKE + " SELECT pattern_id, face, round(al, 6) AS along FROM fa")
def _(spark, root):
    return takeoffs(spark, root).select("pattern_id", "face", F.round("along", 6).alias("along"))


@query("g38_takeoff_layout", "stub", _TAKE + """, sg AS (SELECT *, CASE WHEN ac >= avg(ac) OVER (PARTITION BY id) THEN 1 ELSE -1 END AS s FROM fa), fl AS (SELECT *, s <> lag(s) OVER (PARTITION BY id ORDER BY al, pattern_id) AS f FROM sg),
  ag AS (SELECT id, count(*) AS n, stddev_pop(ac) AS sd, coalesce(count(*) FILTER (f) / nullif(CAST(count(*) - 1 AS DOUBLE), 0), 0) AS r FROM fl GROUP BY id) SELECT id, n, CASE WHEN n = 1 THEN 'SINGLE' WHEN sd <= 30 THEN 'STRAIGHT' WHEN r >= 0.7 THEN 'ZIGZAG' WHEN r <= 0.3 THEN 'SPLIT_ROWS' ELSE 'IRREGULAR' END AS layout FROM ag""")
def _(spark, root):
    t = takeoffs(spark, root)
    t = t.withColumn("s", F.when(F.col("across") >= F.avg("across").over(W.partitionBy("id")), 1).otherwise(-1))
    t = t.withColumn("f", F.col("s") != F.lag("s").over(W.partitionBy("id").orderBy("along", "pattern_id")))
    a = t.groupBy("id").agg(F.count("*").alias("n"), F.stddev_pop("across").alias("sd"), F.count_if("f").alias("k"))
    flips = F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(0.0)
    return a.select("id", "n", O.layout(F.col("n"), F.col("sd"), flips).alias("layout"))


@query("g39_takeoff_spacing", "stub", _TAKE + ", sp AS (SELECT id, face, al - lag(al) OVER (PARTITION BY id, face ORDER BY al, pattern_id) AS d FROM fa) SELECT id, face, count(*) AS n, round(avg(d), 6) AS mean_gap, coalesce(stddev_pop(d) / nullif(avg(d), 0) <= 0.15, false) AS even FROM sp GROUP BY id, face")
def _(spark, root):
    t = takeoffs(spark, root)
    t = t.withColumn("d", F.col("along") - F.lag("along").over(W.partitionBy("id", "face").orderBy("along", "pattern_id")))
    cv = F.stddev_pop("d") / F.nullif(F.avg("d"), F.lit(0.0))
    return t.groupBy("id", "face").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_gap"), F.coalesce(cv <= 0.15, F.lit(False)).alias("even"))


@query("g40_equipment_takeoffs", "stub", _TAKE + " SELECT s.main_equipment_name, count(*) AS n, round(max(ac) - min(ac), 3) AS width, round(max(ac + coalesce(diameter_mm, 0) / 2) - min(ac - coalesce(diameter_mm, 0) / 2), 3) AS width_with_radius FROM fa JOIN stub s ON s.pattern_id = fa.pattern_id WHERE s.main_equipment_name IS NOT NULL GROUP BY 1")
def _(spark, root):
    s = A.stubs(spark, root).where("main_equipment_name is not null").select("pattern_id", "main_equipment_name", (F.coalesce("diameter_mm", F.lit(0.0)) / 2).alias("r"))
    j = takeoffs(spark, root).join(s, "pattern_id")
    a, r = F.col("across"), F.col("r")
    return j.groupBy("main_equipment_name").agg(F.count("*").alias("n"), F.round(F.max(a) - F.min(a), 3).alias("width"), F.round(F.max(a + r) - F.min(a - r), 3).alias("width_with_radius"))


@query("e05_stub_vectors", "stub", r"""WITH t AS (SELECT pattern_id, face, regexp_extract_all(regexp_replace(regexp_replace(lower(translate(dir_seq, '＋–−', '+--')), '\\u(2212|2013)', '-', 'g'), '\\uff0b', '+', 'g'), '[+-][xyz]|[xyz][+-]') AS d FROM stub),
  x AS (SELECT pattern_id, list_position(['+x', '-x', '+y', '-y', '+z', '-z'], face) - 1 AS f, [CASE WHEN contains(d[k], 'x') THEN 0 WHEN contains(d[k], 'y') THEN 2 WHEN contains(d[k], 'z') THEN 4 END + CASE WHEN contains(d[k], '-') THEN 1 ELSE 0 END for k in [1, 2]] AS a FROM t)
  SELECT pattern_id, CAST(f AS INT) AS face_dim, CAST(a[1] + 6 AS INT) AS first_dim, CAST(a[2] + 12 AS INT) AS second_dim FROM x""")
def _(spark, root):
    """Which dimensions of the stub vector are set by the face and the first two directions."""
    s = A.stubs(spark, root)
    d = O.axis_tokens(F.col("dir_seq"))
    face = F.array_position(F.array(*[F.lit(a) for a in G.AXIS_NAMES]), F.col("face")).cast("int") - 1
    zero = F.array(*[F.lit(0.0)] * 3)
    v = O.stub_vector(F.col("f"), F.get("d", F.lit(0)), F.get("d", F.lit(1)), zero, zero)
    s = s.select("pattern_id", F.when(face >= 0, face).alias("f"), d.alias("d")).withColumn("v", v)
    at = lambda lo: F.array_position(F.slice("v", lo + 1, 6), 1.0).cast("int")
    dim = lambda lo: F.when(at(lo) > 0, at(lo) - 1 + lo)
    return s.select("pattern_id", F.when(F.col("f").isNull(), F.lit(None)).otherwise(dim(0)).alias("face_dim"), dim(6).alias("first_dim"), dim(12).alias("second_dim"))


SQL["e05_stub_vectors"] = SQL["e05_stub_vectors"].replace("list_position(['+x', '-x', '+y', '-y', '+z', '-z'], face) - 1 AS f", "nullif(coalesce(list_position(['+x', '-x', '+y', '-y', '+z', '-z'], face), 0), 0) - 1 AS f")


@query("g29_stub_samples", "stub leg", """WITH f AS (SELECT l.guid, l.axis, min(l.i) AS i FROM leg l WHERE len >= 1 GROUP BY 1, 2), d AS (SELECT guid, string_agg(CAST(axis AS VARCHAR), '-' ORDER BY i) AS dirs FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY i) AS k FROM f) WHERE k <= 4 GROUP BY guid),
  r AS (SELECT v.guid, max(abs(CASE WHEN s.face IN ('+x', '-x') THEN v.x - o.x WHEN s.face IN ('+y', '-y') THEN v.y - o.y ELSE v.z - o.z END)) AS rise FROM vertex v JOIN vertex o ON o.guid = v.guid AND o.i = 1 JOIN stub s ON s.pattern_id = v.guid GROUP BY v.guid) SELECT r.guid, d.dirs, round(rise, 3) AS rise FROM r JOIN d ON d.guid = r.guid""")
def _(spark, root):
    """Directions without any repeat, four at most, and the rise along the face's axis."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "face")
    d = P.lines(spark, root).join(s, "guid")
    dirs = F.slice(F.array_distinct(F.transform(F.filter("legs", lambda x: x["len"] >= 1), lambda x: x["axis"].cast("string"))), 1, 4)
    c = lambda p: F.when(F.col("face").isin("+x", "-x"), p["x"]).when(F.col("face").isin("+y", "-y"), p["y"]).otherwise(p["z"])
    rise = F.array_max(F.transform("pts", lambda p: F.abs(c(p) - c(F.col("pts")[0]))))
    return d.where(F.size(dirs) > 0).select("guid", F.array_join(dirs, "-").alias("dirs"), F.round(rise, 3).alias("rise"))


@query("g33_template_points", "stub", r"""WITH t AS (SELECT pattern_id, CAST(source_pos AS DOUBLE[]) AS p, rise_mm, stub_length_mm, regexp_extract_all(regexp_replace(regexp_replace(lower(translate(dir_seq, '＋–−', '+--')), '\\u(2212|2013)', '-', 'g'), '\\uff0b', '+', 'g'), '[+-][xyz]|[xyz][+-]') AS d FROM stub WHERE source_pos IS NOT NULL AND rise_mm IS NOT NULL AND stub_length_mm IS NOT NULL),
  u AS (SELECT pattern_id, p, rise_mm AS r, least(800, greatest(0, stub_length_mm - rise_mm)) AS l, d FROM t WHERE len(d) >= 2)
  SELECT pattern_id, """ + ", ".join(f"round(p[{k}] + CASE WHEN contains(d[1], '{c}') THEN CASE WHEN contains(d[1], '-') THEN -r ELSE r END ELSE 0 END + CASE WHEN contains(d[2], '{c}') THEN CASE WHEN contains(d[2], '-') THEN -l ELSE l END ELSE 0 END, 3) AS end_{c}" for k, c in ((1, "x"), (2, "y"), (3, "z"))) + " FROM u")
def _(spark, root):
    """Where a stub ends that rises along its first direction and leads up to 800 mm along its second."""
    p = F.from_json("source_pos", "array<double>")
    s = A.stubs(spark, root).where("source_pos is not null and rise_mm is not null and stub_length_mm is not null")
    s = s.select("pattern_id", p.alias("p"), F.col("rise_mm").alias("r"), F.least(F.lit(800.0), F.greatest(F.lit(0.0), F.col("stub_length_mm") - F.col("rise_mm"))).alias("l"), O.axis_tokens(F.col("dir_seq")).alias("d")).where("size(d) >= 2")
    move = lambda i, k: F.when(F.floor(F.col("d")[i] / 2) == k, F.when(F.col("d")[i] % 2 == 1, -1.0).otherwise(1.0)).otherwise(0.0)
    return s.select("pattern_id", *[F.round(F.col("p")[k] + move(0, k) * F.col("r") + move(1, k) * F.col("l"), 3).alias("end_" + c) for k, c in enumerate("xyz")])


@query("e01_feature_vectors")
def _(spark, root):
    return O.feature_vectors(A.polylines(spark, root))


@query("g35_bend_causes", "leg obstacle stub", """WITH e AS (SELECT guid, i, x, y, z, nx, ny, nz, axis // 2 AS a, lead(axis) OVER w // 2 AS b, lead(nx) OVER w AS mx, lead(ny) OVER w AS my, lead(nz) OVER w AS mz FROM leg WHERE len >= 50 WINDOW w AS (PARTITION BY guid ORDER BY i)),
  c AS (SELECT e.*, greatest(1.5 * (coalesce(s.diameter_mm, 0) / 2 + 150), 600) AS lim FROM e JOIN stub s ON s.pattern_id = e.guid WHERE b IS NOT NULL AND a <> b),
  n AS (SELECT c.guid, c.i, min(sqrt(power(greatest(o.minx - nx, 0, nx - o.maxx), 2) + power(greatest(o.miny - ny, 0, ny - o.maxy), 2) + power(greatest(o.minz - nz, 0, nz - o.maxz), 2))) AS d FROM c JOIN obstacle o ON sqrt(power(greatest(o.minx - nx, 0, nx - o.maxx), 2) + power(greatest(o.miny - ny, 0, ny - o.maxy), 2) + power(greatest(o.minz - nz, 0, nz - o.maxz), 2)) <= 1000 GROUP BY 1, 2)
  SELECT c.guid, CAST(c.i - 1 AS INT) AS i, CASE WHEN abs(nz - 13700) < 50 THEN 'ZONE_CONSTRAINT' WHEN n.d <= lim THEN 'OBSTACLE_AVOID' ELSE 'UNKNOWN' END AS cause FROM c LEFT JOIN n ON n.guid = c.guid AND n.i = c.i""")
def _(spark, root):
    """Cause of each corner: the floor plane, else a box within the pipe's own limit of the corner; one such box is enough."""
    legs = F.filter(F.transform("legs", lambda x, i: F.struct(i.cast("int").alias("i"), F.floor(x["axis"] / 2).alias("a"), x["len"].alias("len"), x["b"].alias("b"))), lambda x: x["len"] >= 50)
    corner = lambda x, y: F.when(x["a"] != y["a"], F.struct(x["i"].alias("i"), x["b"].alias("b")))
    e = P.lines(spark, root).select("guid", F.explode(F.array(legs)).alias("ls")).where("size(ls) > 1")
    e = e.select("guid", F.explode(F.zip_with(F.slice("ls", 1, F.size("ls") - 1), F.slice("ls", 2, F.size("ls") - 1), corner)).alias("c")).where("c is not null")
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), F.greatest(1.5 * (F.coalesce("diameter_mm", F.lit(0.0)) / 2 + 150), F.lit(600.0)).alias("lim"))
    c = cut_lineage(e.join(s, "guid").select("guid", "c.i", "lim", "c.b.x", "c.b.y", "c.b.z"))
    floor = F.abs(F.col("z") - G.CSF_PLANE_Z) < 50
    near = SP.near_some(c.where(~floor), A.obstacles(spark, root), F.least("lim", F.lit(1000.0)), 1000.0)
    near = near.select("guid", "i").distinct().withColumn("near", F.lit(True))
    cause = F.when(floor, "ZONE_CONSTRAINT").when(F.col("near"), "OBSTACLE_AVOID").otherwise("UNKNOWN")
    return c.join(near, ["guid", "i"], "left").select("guid", "i", cause.alias("cause"))


#: Points at which the directions of two lines are compared.
SAMPLES = 8


def _path_similarity(asked: pa.Table, others: pa.Table) -> Iterator[pa.RecordBatch]:
    """(q_guid, guid, similarity) of every two lines, some queries at once: shape, direction, length, extent."""
    def side(t: pa.Table) -> tuple:
        numbers = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        shapes = t.column("arrows").combine_chunks().dictionary_encode()
        return t.column("guid").combine_chunks(), shapes.indices.to_numpy(), shapes.dictionary.to_pylist(), numbers("u"), t.column("len").to_numpy(), numbers("ext")

    q_guid, q_at, q_words, q_u, q_len, q_ext = side(asked)
    guid, at, words, u, length, ext = side(others)
    longer = np.maximum(*np.ix_([len(w) for w in q_words], [len(w) for w in words]))
    alike = np.where(longer == 0, 1.0, 1 - PS._edits(q_words, words) / np.maximum(longer, 1))
    back = -u.reshape(len(u), SAMPLES, 3)[:, ::-1].reshape(u.shape)
    names = guid.to_numpy(zero_copy_only=False)
    step = max(1, 100_000 // len(u))
    for part in (slice(k, k + step) for k in range(0, len(q_u), step)):
        direction = np.minimum(1.0, np.maximum(0.0, np.maximum(q_u[part] @ u.T, q_u[part] @ back.T) / SAMPLES))
        top = np.maximum(q_len[part, None], length)
        size = np.where(top < 1e-3, 1.0, 1 - np.abs(length - q_len[part, None]) / np.maximum(top, 1e-3))
        scale = 0.0
        for k in range(3):
            a, b = q_ext[part, None, k], ext[None, :, k]
            low, high = np.minimum(a, b), np.maximum(a, b)
            scale = scale + np.where(high < 1, 1.0, np.where(low < 1, 0.0, low / np.maximum(high, 1.0)))
        score = 0.3 * alike[q_at[part, None], at] + 0.3 * direction + 0.2 * size + 0.2 * (scale / 3)
        mine = q_guid[part]
        q, c = np.nonzero(mine.to_numpy(zero_copy_only=False)[:, None] != names)
        yield pa.RecordBatch.from_arrays([mine.take(pa.array(q)), guid.take(pa.array(c)), pa.array(np.floor(score[q, c] * 1e6 + 0.5) / 1e6)], ["q_guid", "guid", "similarity"])


@query("r05_path_similarity")
def _(spark, root):
    """Lines whose identifier is divisible by 100 against the lines of their utility group: shape, direction, length, extent."""
    d = P.lines(spark, root).join(A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "utility_group"), "guid").where("utility_group is not null")
    box = G.extent(F.col("pts"))
    d = d.select("guid", F.col("utility_group").alias("bucket"), G.arrow_code(F.col("legs")).alias("arrows"), G.unit_directions(G.resampled(F.col("legs"), SAMPLES)).alias("u"), G.total_length(F.col("legs")).alias("len"), F.array(*[box["max" + c] - box["min" + c] for c in "xyz"]).alias("ext"))
    d = cut_lineage(d)  # read several times
    schema = "q_guid string, guid string, similarity double"
    empty = pa.schema([("q_guid", pa.string()), ("guid", pa.string()), ("similarity", pa.float64())])

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_path_similarity(asked, others) if asked.num_rows and others.num_rows else [], empty)

    d = d.withColumn("id", F.col("guid"))
    return in_blocks(d, d.where(hundredth("guid")), run, schema, rows=1000, width=4 * shuffle_width(spark), arrow=True)


@query("j20_lateral", "grp", "SELECT group_vector_id, x.g AS guid, CAST(x.n AS INT) AS n FROM grp, LATERAL (SELECT unnest(CAST(member_guids AS VARCHAR[])) AS g, unnest(range(len(CAST(member_guids AS VARCHAR[])))) AS n) x")
def _(spark, root):
    return A.groups(spark, root).select("group_vector_id", F.posexplode(F.from_json("member_guids", "array<string>")).alias("n", "guid"))


@query("j18_last_row_wins", "", "SELECT utility, arg_max(pattern_id, (created_at, pattern_id)) AS last_pattern, count(DISTINCT pattern_id) AS n FROM tb_route_stub_pattern WHERE utility IS NOT NULL GROUP BY utility")
def _(spark, root):
    s = table(spark, root, "tb_route_stub_pattern").where("utility is not null")
    return s.groupBy("utility").agg(F.max_by("pattern_id", F.struct("created_at", "pattern_id")).alias("last_pattern"), F.count_distinct("pattern_id").alias("n"))


@query("j22_project_of_route", "route", "WITH p AS (SELECT project, process, min(source_posx) AS lx, max(source_posx) AS hx FROM route WHERE project IS NOT NULL AND process <> '' GROUP BY 1, 2), k AS (SELECT r.guid, p.project, row_number() OVER (PARTITION BY r.guid ORDER BY CASE WHEN r.source_posx BETWEEN lx AND hx THEN 0 ELSE 1 END, p.project) AS n FROM route r JOIN p ON p.process = r.process) SELECT guid, project FROM k WHERE n = 1")
def _(spark, root):
    """First project of the same process whose span holds the source, else the first of that process."""
    r = A.routes(spark, root)
    p = r.where("project is not null and process <> ''").groupBy("project", "process").agg(F.min("source_posx").alias("lx"), F.max("source_posx").alias("hx"))
    j = r.select("guid", "process", "source_posx").join(p, "process")
    rank = F.struct(F.when(F.col("source_posx").between(F.col("lx"), F.col("hx")), 0).otherwise(1).alias("o"), "project")
    return j.groupBy("guid").agg(F.min(rank).alias("b")).select("guid", "b.project")


@query("j09_leg_box_candidates", "leg obstacle", "SELECT l.guid, count(DISTINCT (l.i, o.id)) AS n FROM leg l JOIN obstacle o ON least(l.x, nx) - 600 <= maxx AND greatest(l.x, nx) + 600 >= minx AND least(l.y, ny) - 600 <= maxy AND greatest(l.y, ny) + 600 >= miny AND least(l.z, nz) - 600 <= maxz AND greatest(l.z, nz) + 600 >= minz GROUP BY l.guid")
def _(spark, root):
    e = P.exploded(spark, root).select(F.struct("guid", "i").alias("id"), *[f(F.col("a")[c], F.col("b")[c]).alias(n + c) for n, f in (("min", F.least), ("max", F.greatest)) for c in "xyz"])
    return SP.overlap_join(e, A.obstacles(spark, root), grow=600.0).groupBy("a_id.guid").agg(F.count("*").alias("n"))


@query("t11_rank_policy", "leg", "WITH c AS (SELECT DISTINCT guid, CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy FROM vertex), r AS (SELECT guid, CAST(row_number() OVER (ORDER BY sum(len) DESC, guid) AS INT) AS rank FROM leg GROUP BY guid) SELECT cx, cy, min(rank) AS best_rank, count(*) AS lines FROM c JOIN r ON r.guid = c.guid GROUP BY 1, 2")
def _(spark, root):
    """Per cell the best rank of the lines that pass it, lines ranked by length."""
    length = P.exploded(spark, root).groupBy("guid").agg(F.sum("len").alias("l"))
    rank = numbered(length, F.col("l").desc(), F.col("guid"), name="rank").withColumn("rank", F.col("rank").cast("int"))
    c = P.s12(spark, root).select("guid", F.floor(F.col("x") / 2000).alias("cx"), F.floor(F.col("y") / 2000).alias("cy")).distinct()
    return c.join(rank, "guid").groupBy("cx", "cy").agg(F.min("rank").alias("best_rank"), F.count("*").alias("lines"))


@query("a23_weight_sweep", "gvec gctx", """WITH n AS (SELECT q.group_vector_id AS q, g.group_vector_id AS c, q.process_name = g.process_name AS hit, list_cosine_similarity(q.feature_centroid, g.feature_centroid) AS f, greatest(0, coalesce(list_cosine_similarity(qx.context_centroid, gx.context_centroid), 0)) AS x, w
  FROM gvec q JOIN gvec g ON g.utility = q.utility AND g.group_vector_id <> q.group_vector_id LEFT JOIN gctx qx ON qx.group_vector_id = q.group_vector_id LEFT JOIN gctx gx ON gx.group_vector_id = g.group_vector_id, (VALUES (0.0), (0.1), (0.2), (0.3)) t(w) WHERE CAST('0x' || right(q.group_vector_id, 12) AS BIGINT) % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY q, w ORDER BY round((1 - w) * f + w * x, 9) DESC, c) AS r FROM n) SELECT CAST(w AS DOUBLE) AS weight, count(*) AS queries, round(avg(CAST(hit AS INT)), 6) AS hits_at_1, round(avg(f), 6) AS mean_feature FROM k WHERE r = 1 GROUP BY w""")
def _(spark, root):
    """Share of right processes at the first place for four context weights."""
    from pipeloom.plans.search import valid_groups

    g = valid_groups(spark, root).select("group_vector_id", "utility", "process_name", "feature_centroid", F.when(A.is_vector(F.col("context_centroid"), 30), F.col("context_centroid")).alias("ctx"))
    q = g.where(hundredth("group_vector_id")).select("utility", *[F.col(c).alias("q_" + c) for c in ("group_vector_id", "process_name", "feature_centroid", "ctx")])
    j = g.join(q, "utility").where("group_vector_id <> q_group_vector_id")
    x = F.when(F.col("ctx").isNotNull() & F.col("q_ctx").isNotNull(), F.greatest(F.lit(0.0), V.cosine(F.col("ctx"), F.col("q_ctx")))).otherwise(0.0)
    j = j.select("q_group_vector_id", "group_vector_id", (F.col("process_name") == F.col("q_process_name")).alias("hit"), V.cosine(F.col("feature_centroid"), F.col("q_feature_centroid")).alias("f"), x.alias("x"), F.explode(F.array(*[F.lit(w) for w in (0.0, 0.1, 0.2, 0.3)])).alias("weight"))
    score = F.round((1 - F.col("weight")) * F.col("f") + F.col("weight") * F.col("x"), 9)
    w = W.partitionBy("q_group_vector_id", "weight").orderBy(score.desc(), "group_vector_id")
    top = j.withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.groupBy("weight").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hits_at_1"), F.round(F.avg("f"), 6).alias("mean_feature"))


@query("f13_identifiers", "stub", "SELECT DISTINCT left(sha1(coalesce(stub_kind, '') || '|' || coalesce(anchor_kind, '') || '|' || coalesce(utility, '')), 24) AS stable_id, left(sha256(upper(trim(coalesce(utility, '')))), 16) AS request_key, stub_kind, anchor_kind, utility FROM stub")
def _(spark, root):
    s = A.stubs(spark, root).select("stub_kind", "anchor_kind", "utility").distinct()
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("stub_kind", "anchor_kind", "utility")])
    return s.select(F.substring(F.sha1(text), 1, 24).alias("stable_id"), F.substring(F.sha2(F.upper(norm_text(F.col("utility"))), 256), 1, 16).alias("request_key"), "stub_kind", "anchor_kind", "utility")


@query("f16_wkt", "vertex", "SELECT guid, 'LINESTRING Z (' || string_agg(CAST(CAST(round(x) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(y) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(z) AS BIGINT) AS VARCHAR), ', ' ORDER BY i) || ')' AS wkt FROM vertex GROUP BY guid")
def _(spark, root):
    whole = lambda p: F.concat_ws(" ", *[F.round(p[c]).cast("bigint").cast("string") for c in "xyz"])
    return A.polylines(spark, root).select("guid", F.concat(F.lit("LINESTRING Z ("), F.array_join(F.transform("pts", whole), ", "), F.lit(")")).alias("wkt"))


@query("s11_wkt_parse", "vertex", "SELECT guid, count(*) AS n, CAST(sum(CAST(round(x) AS BIGINT)) AS DOUBLE) AS sum_x FROM vertex GROUP BY guid")
def _(spark, root):
    """Points read back from text: a round trip."""
    w = Q["f16_wkt"](spark, root)
    pts = F.transform(F.split(F.regexp_extract("wkt", r"\((.*)\)", 1), ", "), lambda t: F.split(t, " ")[0].cast("double"))
    return w.select("guid", F.explode(pts).alias("x")).groupBy("guid").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))


@query("k05_json_export", "route", "SELECT guid, length(coalesce(utility, '')) > 0 AS has_utility FROM route")
def _(spark, root):
    """Rows as JSON text, read back."""
    j = A.routes(spark, root).select(F.to_json(F.struct("guid", "utility", "bay")).alias("js"))
    back = j.select(F.from_json("js", "guid string, utility string, bay string").alias("r"))
    return back.select("r.guid", (F.length(norm_text(F.col("r.utility"))) > 0).alias("has_utility"))


@query("l05_revision_diff", "", "WITH m AS (SELECT DISTINCT project_scope_key AS p, model_revision_key AS v, lower(regexp_replace(route_path_guid, '[\\s{}-]', '', 'g')) AS g FROM tb_route_source_scope_route_member WHERE route_path_guid IS NOT NULL), k AS (SELECT DISTINCT p, v FROM m), o AS (SELECT p, v, lag(v) OVER (PARTITION BY p ORDER BY v) AS u FROM k) SELECT o.p AS project, o.v AS revision, (SELECT count(*) FROM m WHERE m.p = o.p AND m.v = o.v AND NOT EXISTS (SELECT 1 FROM m n WHERE n.p = o.p AND n.v = o.u AND n.g = m.g)) AS added, (SELECT count(*) FROM m WHERE m.p = o.p AND m.v = o.u AND NOT EXISTS (SELECT 1 FROM m n WHERE n.p = o.p AND n.v = o.v AND n.g = m.g)) AS removed FROM o WHERE u IS NOT NULL")
def _(spark, root):
    """Routes that come and go from one revision of a project to the next."""
    from pipeloom.functions.text import norm_guid

    m = table(spark, root, "tb_route_source_scope_route_member").select(F.col("project_scope_key").alias("project"), F.col("model_revision_key").alias("revision"), norm_guid(F.col("route_path_guid")).alias("g")).where("g is not null").distinct()
    o = m.select("project", "revision").distinct().withColumn("before", F.lag("revision").over(W.partitionBy("project").orderBy("revision"))).where("before is not null")
    now = o.join(m, ["project", "revision"]).select("project", "revision", "g").withColumn("now", F.lit(1))
    old = o.join(m.withColumnRenamed("revision", "before"), ["project", "before"]).select("project", "revision", "g").withColumn("old", F.lit(1))
    both = now.join(old, ["project", "revision", "g"], "full")
    return both.groupBy("project", "revision").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"))


@query("l06_active_scope", "", "SELECT project_scope_key, CASE WHEN count(*) FILTER (status = 'ACTIVE') = 1 THEN max(model_revision_key) FILTER (status = 'ACTIVE') END AS active_revision, count(*) FILTER (status = 'ACTIVE') = 1 AS resolved FROM tb_route_source_scope_manifest GROUP BY 1")
def _(spark, root):
    active = F.col("status") == "ACTIVE"
    m = table(spark, root, "tb_route_source_scope_manifest").groupBy("project_scope_key").agg(F.count_if(active).alias("n"), F.max(F.when(active, F.col("model_revision_key"))).alias("v"))
    return m.select("project_scope_key", F.when(F.col("n") == 1, F.col("v")).alias("active_revision"), (F.col("n") == 1).alias("resolved"))


@query("l08_group_drift", "grp member", "WITH c AS (SELECT group_vector_id, count(*) AS n FROM member GROUP BY 1) SELECT g.group_vector_id, g.member_count, coalesce(c.n, 0) AS counted, g.member_count IS DISTINCT FROM CAST(coalesce(c.n, 0) AS INT) AS drift FROM grp g LEFT JOIN c ON c.group_vector_id = g.group_vector_id")
def _(spark, root):
    c = A.members(spark, root).groupBy("group_vector_id").agg(F.count("*").alias("n"))
    j = A.groups(spark, root).select("group_vector_id", "member_count").join(c, "group_vector_id", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("group_vector_id", "member_count", n.alias("counted"), (~F.col("member_count").eqNullSafe(n)).alias("drift"))


@query("l10_rule_lookup", "route", "SELECT guid, CASE utility_group WHEN 'EXHAUST' THEN 150 WHEN 'DRAIN' THEN 120 WHEN 'WATER' THEN 100 WHEN 'VACUUM' THEN 100 WHEN 'BULK_GAS' THEN 80 END AS clearance_mm FROM route")
def _(spark, root):
    rules = F.create_map(*[F.lit(x) for kv in (("EXHAUST", 150), ("DRAIN", 120), ("WATER", 100), ("VACUUM", 100), ("BULK_GAS", 80)) for x in kv])
    return A.routes(spark, root).select("guid", rules[F.col("utility_group")].alias("clearance_mm"))


@query("r18_stub_pairs", "stub", "WITH c AS (SELECT stub_kind, utility, face, count(*) AS n, round(avg(stub_length_mm), 6) AS m FROM stub WHERE utility IS NOT NULL AND face IS NOT NULL GROUP BY ALL) SELECT a.utility, a.face AS start_face, b.face AS end_face, round(a.n + b.n - 1e-5 * abs(a.m - b.m), 6) AS score FROM c a JOIN c b ON a.utility = b.utility AND a.stub_kind = 'START' AND b.stub_kind = 'END'")
def _(spark, root):
    c = A.stubs(spark, root).where("utility is not null and face is not null").groupBy("stub_kind", "utility", "face").agg(F.count("*").alias("n"), F.round(F.avg("stub_length_mm"), 6).alias("m"))
    a = c.where("stub_kind = 'START'").select("utility", F.col("face").alias("start_face"), F.col("n").alias("n1"), F.col("m").alias("m1"))
    b = c.where("stub_kind = 'END'").select("utility", F.col("face").alias("end_face"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    return a.join(b, "utility").select("utility", "start_face", "end_face", F.round(F.col("n1") + F.col("n2") - 1e-5 * F.abs(F.col("m1") - F.col("m2")), 6).alias("score"))


@query("r20_deployment_gate", "ablog", "SELECT count(*) >= 1000 AS enough, avg(CAST(success AS INT)) >= 0.5 AS success_ok, coalesce(avg(length_mm) FILTER (success) < 1e9, false) AS length_ok, count(DISTINCT arm) = 2 AS both_arms, count(*) >= 1000 AND avg(CAST(success AS INT)) >= 0.5 AND coalesce(avg(length_mm) FILTER (success) < 1e9, false) AND count(DISTINCT arm) = 2 AS passed FROM ablog")
def _(spark, root):
    """Threshold checks; a missing figure fails."""
    ok = F.col("success")
    m = A.ab_log(spark, root).agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("s"), F.avg(F.when(ok, F.col("length_mm"))).alias("l"), F.count_distinct("arm").alias("a"))
    checks = {"enough": F.col("n") >= 1000, "success_ok": F.coalesce(F.col("s") >= 0.5, F.lit(False)), "length_ok": F.coalesce(F.col("l") < 1e9, F.lit(False)), "both_arms": F.col("a") == 2}
    everything = F.lit(True)
    for c in checks.values():
        everything = everything & c
    return m.select(*[c.alias(k) for k, c in checks.items()], everything.alias("passed"))


@query("e44_design_groups", "route", "SELECT process, equipment_key, utility_group, utility, size, count(*) AS n, round(avg(total_length), 6) AS mean_mm, min(total_length) AS min_mm, max(total_length) AS max_mm, round(avg(bend_count), 6) AS mean_bends FROM route GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3")
def _(spark, root):
    return A.routes(spark, root).groupBy("process", "equipment_key", "utility_group", "utility", "size").agg(
        F.count("*").alias("n"), F.round(F.avg("total_length"), 6).alias("mean_mm"), F.min("total_length").alias("min_mm"), F.max("total_length").alias("max_mm"), F.round(F.avg("bend_count"), 6).alias("mean_bends")
    ).where("n >= 3")


@query("x11_leg_reasons", "leg", "SELECT guid, CAST(i - 1 AS INT) AS i, CASE WHEN len < 0.001 THEN 'ZERO' WHEN greatest(abs(dx), abs(dy), abs(dz)) / len < 0.999 THEN 'SKEW' WHEN p IS NULL THEN 'START' WHEN n IS NULL THEN 'END' WHEN axis // 2 = 2 THEN 'RISE' WHEN p <> axis THEN 'TURN' ELSE 'STRAIGHT' END AS reason FROM (SELECT *, lag(axis) OVER w AS p, lead(axis) OVER w AS n FROM leg WINDOW w AS (PARTITION BY guid ORDER BY i))")
def _(spark, root):
    w = W.partitionBy("guid").orderBy("i")
    e = P.exploded(spark, root).withColumn("p", F.lag("axis").over(w)).withColumn("n", F.lead("axis").over(w))
    top = F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))
    reason = (
        F.when(F.col("len") < 1e-3, "ZERO").when(top / F.col("len") < 0.999, "SKEW").when(F.col("p").isNull(), "START").when(F.col("n").isNull(), "END")
        .when(F.col("axis") >= 4, "RISE").when(F.col("p") != F.col("axis"), "TURN").otherwise("STRAIGHT")
    )
    return e.select("guid", "i", reason.alias("reason"))


QUERIES = Q
