"""Filters, joins, aggregations, windows, set operations, evaluation and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions import sizes as S
from pipeloom.functions.text import first_filled, norm_equipment_key, norm_text
from pipeloom.operators import aggregate as O
from pipeloom.operators import tables as K
from pipeloom.plans import polyline as P
from pipeloom.plans.oracle_views import EQUIPMENT, over
from pipeloom.sources import adapter as A
from pipeloom.sources.tables import table

R6 = lambda c: F.round(c, 6)
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: str, sql: str):
    def put(f):
        Q[name] = f
        SQL[name] = over(views, sql) if views else sql
        return f

    return put


# ---- filters and projections


@query("p01_presets", "route", "SELECT DISTINCT process, utility_group, utility, size FROM route WHERE process = 'CVD' AND utility_group <> '' ORDER BY ALL LIMIT 50")
def _(spark, root, process="CVD", group=None):
    r = A.routes(spark, root).where("utility_group <> ''")
    for column, value in (("process", process), ("utility_group", group)):
        r = r.where(F.col(column) == value) if value else r
    cols = ["process", "utility_group", "utility", "size"]
    return r.select(*cols).distinct().orderBy(*cols).limit(50)


@query("p03_first_filled", "", "SELECT pattern_id, coalesce(nullif(trim(main_equipment_name), ''), nullif(trim(anchor_name), ''), 'UNKNOWN') AS equipment FROM (SELECT DISTINCT pattern_id, main_equipment_name, anchor_name FROM tb_route_stub_pattern)")
def _(spark, root):
    s = table(spark, root, "tb_route_stub_pattern").select("pattern_id", "main_equipment_name", "anchor_name").distinct()
    return s.select("pattern_id", F.coalesce(first_filled(F.col("main_equipment_name"), F.col("anchor_name")), F.lit("UNKNOWN")).alias("equipment"))


@query("p04_box_overlap", "obstacle", "SELECT id, kind FROM obstacle WHERE minx <= 40000 AND maxx >= 20000 AND miny <= 30000 AND maxy >= 10000 AND minz <= 14000 AND maxz >= 9000")
def _(spark, root):
    lo, hi = {"x": 20000, "y": 10000, "z": 9000}, {"x": 40000, "y": 30000, "z": 14000}
    o = A.obstacles(spark, root)
    for c in "xyz":
        o = o.where((F.col("min" + c) <= hi[c]) & (F.col("max" + c) >= lo[c]))
    return o.select("id", "kind")


@query("p05_plan_overlap", "obstacle", "SELECT kind, count(*) AS n FROM obstacle WHERE minx <= 40000 AND maxx >= 20000 AND miny <= 30000 AND maxy >= 10000 GROUP BY kind")
def _(spark, root):
    o = A.obstacles(spark, root).where("minx <= 40000 and maxx >= 20000 and miny <= 30000 and maxy >= 10000")
    return o.groupBy("kind").agg(F.count("*").alias("n"))


@query("p07_text_search", "route", "SELECT guid, utility FROM route WHERE utility ILIKE '%exh%' AND bay LIKE 'D%' AND source_posx BETWEEN 10000 AND 60000 AND size IN ('50A', '100A', '40A')")
def _(spark, root):
    c = F.col
    keep = c("utility").ilike("%exh%") & c("bay").startswith("D") & c("source_posx").between(10000, 60000) & c("size").isin("50A", "100A", "40A")
    return A.routes(spark, root).where(keep).select("guid", "utility")


@query("p10_scope_drift", "route member", "SELECT DISTINCT m.guid FROM member m JOIN route r ON r.guid = m.guid WHERE nullif(trim(m.utility), '') IS DISTINCT FROM nullif(r.utility, '')")
def _(spark, root):
    m = A.members(spark, root).select("guid", F.nullif(F.trim("utility"), F.lit("")).alias("u"))
    r = A.routes(spark, root).select("guid", F.nullif(F.col("utility"), F.lit("")).alias("v"))
    return m.join(r, "guid").where(~F.col("u").eqNullSafe(F.col("v"))).select("guid").distinct()


@query("p12_classified", "route", """SELECT guid, CASE WHEN contains(upper(owner), 'LAT') THEN 'LATERAL' WHEN contains(upper(owner), 'DUCT') THEN 'DUCT' WHEN regexp_matches(upper(owner), 'EQUIP|MODEL|TOOL|MAIN') THEN 'EQUIP' ELSE 'Unknown' END AS owner_type,
  CASE WHEN contains(upper(utility), 'EXH') THEN 'EXHAUST' WHEN contains(upper(utility), 'DRN') THEN 'DRAIN' WHEN utility = '' THEN 'OBSTACLE' ELSE upper(utility) END AS kind FROM route""")
def _(spark, root):
    o, u = F.upper("owner"), F.upper("utility")
    owner = F.when(o.contains("LAT"), "LATERAL").when(o.contains("DUCT"), "DUCT").when(o.rlike("EQUIP|MODEL|TOOL|MAIN"), "EQUIP").otherwise("Unknown")
    kind = F.when(u.contains("EXH"), "EXHAUST").when(u.contains("DRN"), "DRAIN").when(u == "", "OBSTACLE").otherwise(u)
    return A.routes(spark, root).select("guid", owner.alias("owner_type"), kind.alias("kind"))


@query("p14_finite_guard", "grp", """SELECT group_vector_id, CASE WHEN context_centroid IS NULL THEN 'missing' WHEN len(context_centroid) <> 30 THEN 'length' WHEN len(list_filter(context_centroid, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'not finite'
  WHEN len(list_filter(context_centroid, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END AS verdict FROM grp""")
def _(spark, root):
    v = F.col("context_centroid")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    verdict = F.when(v.isNull(), "missing").when(F.size(v) != 30, "length").when(bad, "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("ok")
    return A.groups(spark, root).select("group_vector_id", verdict.alias("verdict"))


# ---- joins


@query("j01_route_join", "route member", "SELECT m.group_vector_id, m.guid, m.member_order, r.bay, r.total_length FROM member m JOIN route r ON r.guid = m.guid")
def _(spark, root):
    m = A.members(spark, root).select("group_vector_id", "guid", "member_order")
    return m.join(A.routes(spark, root).select("guid", "bay", "total_length"), "guid")


@query("j02_scoped_join", "route", """SELECT DISTINCT r.guid, m.status FROM route r JOIN tb_route_source_scope_manifest m ON trim(r.project) = trim(m.project_scope_key) AND trim(r.revision) = trim(m.model_revision_key) WHERE m.status = 'ACTIVE'""")
def _(spark, root):
    m = table(spark, root, "tb_route_source_scope_manifest").where("status = 'ACTIVE'")
    m = m.select(F.trim("project_scope_key").alias("p"), F.trim("model_revision_key").alias("v"), "status")
    r = A.routes(spark, root).select("guid", F.trim("project").alias("p"), F.trim("revision").alias("v"))
    return r.join(m, ["p", "v"]).select("guid", "status").distinct()


@query("j03_left_join", "grp member", """SELECT m.group_vector_id, m.guid, m.member_order, g.encoder_version FROM member m LEFT JOIN (SELECT * FROM grp WHERE status = 'READY' AND encoder_version = 'utility-pipe-group-v1') g ON g.group_vector_id = m.group_vector_id""")
def _(spark, root):
    g = A.groups(spark, root).where("status = 'READY' and encoder_version = 'utility-pipe-group-v1'").select("group_vector_id", "encoder_version")
    return A.members(spark, root).select("group_vector_id", "guid", "member_order").join(g, "group_vector_id", "left")


@query("j04_orphans", "grp member", "SELECT DISTINCT group_vector_id FROM member WHERE group_vector_id NOT IN (SELECT group_vector_id FROM grp) UNION SELECT group_vector_id FROM grp WHERE group_vector_id NOT IN (SELECT group_vector_id FROM member)")
def _(spark, root):
    g, m = A.groups(spark, root).select("group_vector_id"), A.members(spark, root).select("group_vector_id").distinct()
    return m.join(g, "group_vector_id", "left_anti").union(g.join(m, "group_vector_id", "left_anti")).distinct()


@query("j06_coverage", "route member", "SELECT r.utility_group, count(*) AS n, count(*) FILTER (r.guid IN (SELECT guid FROM member)) AS covered FROM route r GROUP BY r.utility_group")
def _(spark, root):
    m = A.members(spark, root).select("guid").distinct().withColumn("has", F.lit(1))
    r = A.routes(spark, root).select("guid", "utility_group").join(m, "guid", "left")
    return r.groupBy("utility_group").agg(F.count("*").alias("n"), F.count("has").alias("covered"))


@query("j15_group_pairs", "member", "SELECT a.group_vector_id, count(*) AS n_pairs, round(avg(sqrt(power(a.start_x - b.start_x, 2) + power(a.start_y - b.start_y, 2) + power(a.start_z - b.start_z, 2))), 6) AS mean_mm FROM member a JOIN member b ON a.group_vector_id = b.group_vector_id AND a.guid < b.guid GROUP BY a.group_vector_id")
def _(spark, root):
    m = A.members(spark, root).select("group_vector_id", "guid", "start_x", "start_y", "start_z")
    n = m.select("group_vector_id", *[F.col(c).alias("o_" + c) for c in ("guid", "start_x", "start_y", "start_z")])
    d = F.sqrt(sum(((F.col(f"start_{c}") - F.col(f"o_start_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return m.join(n, "group_vector_id").where("guid < o_guid").groupBy("group_vector_id").agg(F.count("*").alias("n_pairs"), R6(F.avg(d)).alias("mean_mm"))


_ARMS = "arms AS (SELECT request_key, run_id, arm, count(*) AS n, avg(CAST(success AS INT)) AS rate, avg(length_mm) FILTER (success) AS len, max(created_at) AS t FROM ablog GROUP BY 1, 2, 3)"


def _arms(spark, root):
    a = A.ab_log(spark, root)
    return a.groupBy("request_key", "run_id", "arm").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("rate"), F.avg(F.when(F.col("success"), F.col("length_mm"))).alias("len"), F.max("created_at").alias("t"))


@query("j17_arm_pairs", "ablog", f"WITH {_ARMS} SELECT b.request_key, b.run_id, round(c.rate - b.rate, 6) AS rate_delta, round(c.len - b.len, 6) AS length_delta FROM arms b JOIN arms c ON b.request_key = c.request_key AND b.run_id = c.run_id AND b.arm = 'BASELINE' AND c.arm = 'CONTEXT'")
def _(spark, root):
    a = _arms(spark, root)
    b = a.where("arm = 'BASELINE'").select("request_key", "run_id", F.col("rate").alias("r0"), F.col("len").alias("l0"))
    return a.where("arm = 'CONTEXT'").join(b, ["request_key", "run_id"]).select("request_key", "run_id", F.round(F.col("rate") - F.col("r0"), 6).alias("rate_delta"), F.round(F.col("len") - F.col("l0"), 6).alias("length_delta"))


@query("j19_member_index", "grp", "WITH e AS (SELECT group_vector_id, updated_at, unnest(CAST(member_guids AS VARCHAR[])) AS g FROM grp) SELECT g AS guid, max_by(group_vector_id, (updated_at, group_vector_id)) AS group_vector_id, count(*) AS n_groups FROM e GROUP BY g")
def _(spark, root):
    e = A.groups(spark, root).select("group_vector_id", "updated_at", F.explode(F.from_json("member_guids", "array<string>")).alias("guid"))
    return e.groupBy("guid").agg(F.max_by("group_vector_id", F.struct("updated_at", "group_vector_id")).alias("group_vector_id"), F.count("*").alias("n_groups"))


@query("j21_first_member", "member", "SELECT group_vector_id, arg_min(utility, (member_order, guid)) AS first_utility, string_agg(DISTINCT pipe_size, ',' ORDER BY pipe_size) AS sizes FROM member GROUP BY group_vector_id")
def _(spark, root):
    m = A.members(spark, root)
    return m.groupBy("group_vector_id").agg(F.min_by("utility", F.struct("member_order", "guid")).alias("first_utility"), F.array_join(F.array_sort(F.collect_set("pipe_size")), ",").alias("sizes"))


# ---- aggregations


@query("a01_groups", "route", "SELECT upper(process) AS process, equipment_key, upper(utility_group) AS utility_group, upper(utility) AS utility, count(*) AS n, min(guid) AS first_guid FROM route GROUP BY 1, 2, 3, 4")
def _(spark, root):
    keys = [F.upper("process").alias("process"), F.col("equipment_key"), F.upper("utility_group").alias("utility_group"), F.upper("utility").alias("utility")]
    return A.routes(spark, root).groupBy(*keys).agg(F.count("*").alias("n"), F.min("guid").alias("first_guid"))


@query("a02_min_members", "route", "WITH g AS (SELECT equipment_key, utility, count(*) AS n FROM route GROUP BY 1, 2) SELECT CASE WHEN coalesce(equipment_key, '') = '' THEN 'no equipment' WHEN utility = '' THEN 'no utility' WHEN n < 2 THEN 'too few' ELSE 'kept' END AS reason, count(*) AS groups, CAST(sum(n) AS BIGINT) AS routes FROM g GROUP BY 1")
def _(spark, root):
    g = A.routes(spark, root).groupBy("equipment_key", "utility").agg(F.count("*").alias("n"))
    reason = F.when(F.coalesce("equipment_key", F.lit("")) == "", "no equipment").when(F.col("utility") == "", "no utility").when(F.col("n") < 2, "too few").otherwise("kept")
    return g.groupBy(reason.alias("reason")).agg(F.count("*").alias("groups"), F.sum("n").alias("routes"))


@query("a05_arrangement", "member", """SELECT group_vector_id, count(*) AS n, round(avg(start_x), 6) AS start_mean_x, round(stddev_pop(start_x), 6) AS start_std_x, round(avg(end_z - start_z), 6) AS move_mean_z, round(stddev_pop(end_z - start_z), 6) AS move_std_z,
  round(avg(coalesce(total_length_mm, 0)), 6) AS length_mean, round(stddev_pop(coalesce(total_length_mm, 0)), 6) AS length_std, round(max(greatest(start_x, end_x)) - min(least(start_x, end_x)), 6) AS size_x FROM member GROUP BY group_vector_id""")
def _(spark, root):
    m = A.members(spark, root)
    move, length = F.col("end_z") - F.col("start_z"), F.coalesce("total_length_mm", F.lit(0.0))
    return m.groupBy("group_vector_id").agg(
        F.count("*").alias("n"), R6(F.avg("start_x")).alias("start_mean_x"), R6(F.stddev_pop("start_x")).alias("start_std_x"), R6(F.avg(move)).alias("move_mean_z"), R6(F.stddev_pop(move)).alias("move_std_z"),
        R6(F.avg(length)).alias("length_mean"), R6(F.stddev_pop(length)).alias("length_std"), R6(F.max(F.greatest("start_x", "end_x")) - F.min(F.least("start_x", "end_x"))).alias("size_x"),
    )


@query("a06_size_signature", "member", r"WITH s AS (SELECT group_vector_id, CASE WHEN trim(coalesce(pipe_size, '')) = '' THEN 'UNKNOWN' ELSE regexp_replace(upper(regexp_replace(pipe_size, '\s+', '', 'g')), '^0*(\d)', '\1') END AS z FROM member), c AS (SELECT group_vector_id, z, count(*) AS n FROM s GROUP BY 1, 2) SELECT group_vector_id, string_agg(z || ':' || n, ',' ORDER BY z) AS signature FROM c GROUP BY 1")
def _(spark, root):
    c = A.members(spark, root).groupBy("group_vector_id", S.normalize_size(F.col("pipe_size")).alias("z")).agg(F.count("*").alias("n"))
    both = c.groupBy("group_vector_id").agg(F.array_sort(F.collect_list(F.struct("z", "n"))).alias("l"))
    return both.select("group_vector_id", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["z"], x["n"].cast("string"))), ",").alias("signature"))


@query("a07_both_arms", "ablog", "SELECT request_key, count(DISTINCT run_id) AS runs FROM ablog GROUP BY request_key HAVING count(DISTINCT arm) = 2")
def _(spark, root):
    return A.ab_log(spark, root).groupBy("request_key").agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("arm").alias("arms")).where("arms = 2").drop("arms")


@query("a08_filtered_counts", "grp", "SELECT project_scope_key, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'STALE') AS stale, count(*) FILTER (context_centroid IS NULL) AS no_context, CAST(sum(member_count) AS BIGINT) AS members, min(updated_at) AS first_update, max(updated_at) AS last_update FROM grp GROUP BY 1")
def _(spark, root):
    return A.groups(spark, root).groupBy("project_scope_key").agg(
        F.count_if(F.col("status") == "READY").alias("ready"), F.count_if(F.col("status") == "STALE").alias("stale"), F.count_if(F.col("context_centroid").isNull()).alias("no_context"),
        F.sum("member_count").alias("members"), F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update"),
    )


@query("a10_bend_patterns", "leg stub", """WITH e AS (SELECT guid, i, nx, ny, nz, axis // 2 AS a, lead(axis) OVER (PARTITION BY guid ORDER BY i) // 2 AS b FROM leg WHERE len >= 50),
  c AS (SELECT e.*, CASE WHEN a = 2 THEN 'V_TO_H' WHEN b = 2 THEN 'H_TO_V' ELSE 'H_TO_H' END AS transition, CASE WHEN nz <= 13700 THEN 'LOWER' ELSE 'UPPER' END AS zone, s.utility, s.route_path_guid AS route FROM e JOIN stub s ON s.pattern_id = e.guid WHERE b IS NOT NULL AND a <> b),
  t AS (SELECT utility, count(DISTINCT route_path_guid) AS total FROM stub GROUP BY utility),
  m AS (SELECT utility, transition, zone, count(DISTINCT route) AS routes, count(*) AS bends, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT route) >= 2),
  d AS (SELECT m.*, sqrt(avg(power(nx - mx, 2) + power(ny - my, 2) + power(nz - mz, 2))) AS spread FROM m JOIN c ON m.utility IS NOT DISTINCT FROM c.utility AND m.transition = c.transition AND m.zone = c.zone GROUP BY ALL)
  SELECT d.utility, transition, zone, routes, bends, round(least(1, routes / CAST(total AS DOUBLE)), 6) AS frequency, round(spread, 2) AS position_std FROM d JOIN t ON t.utility IS NOT DISTINCT FROM d.utility""")
def _(spark, root):
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "utility", F.col("route_path_guid").alias("route"))
    w = W.partitionBy("guid").orderBy("i")
    e = P.exploded(spark, root).where("len >= 50")
    a, b = F.floor(F.col("axis") / 2), F.floor(F.lead("axis").over(w) / 2)
    c = e.select("guid", F.col("b").alias("p"), a.alias("a"), b.alias("b")).where("b is not null and a <> b").join(s, "guid")
    c = c.withColumn("transition", F.when(F.col("a") == 2, "V_TO_H").when(F.col("b") == 2, "H_TO_V").otherwise("H_TO_H")).withColumn("zone", F.when(F.col("p.z") <= G.CSF_PLANE_Z, "LOWER").otherwise("UPPER"))
    keys = ["utility", "transition", "zone"]
    # the spread about the mean from sums of squares: one pass, no join back
    m = c.groupBy(*keys).agg(F.count_distinct("route").alias("routes"), F.count("*").alias("bends"), *[F.var_pop(f"p.{k}").alias("v" + k) for k in "xyz"]).where("routes >= 2")
    total = s.groupBy(F.col("utility").alias("u")).agg(F.count_distinct("route").alias("total"))
    return m.join(total, F.col("utility").eqNullSafe(F.col("u"))).select(*keys, "routes", "bends", F.round(F.least(F.lit(1.0), F.col("routes") / F.col("total")), 6).alias("frequency"), F.round(F.sqrt(F.col("vx") + F.col("vy") + F.col("vz")), 2).alias("position_std"))


@query("a11_majority", "stub", "WITH c AS (SELECT utility, face, count(*) AS n FROM stub WHERE face IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY utility) AS s, row_number() OVER (PARTITION BY utility ORDER BY n DESC, face) AS k FROM c WHERE utility IS NOT NULL) SELECT utility, face, n AS votes, round(n / CAST(s AS DOUBLE), 6) AS confidence FROM r WHERE k = 1")
def _(spark, root):
    m = O.majority(A.stubs(spark, root).where("utility is not null").select("utility", "face"), ["utility"], "face")
    return m.withColumn("confidence", F.round("confidence", 6))


@query("a12_face_votes", "leg stub", "WITH f AS (SELECT guid, arg_min(axis, i) AS axis FROM leg GROUP BY guid), c AS (SELECT s.utility_group, CAST(f.axis AS INT) AS axis, count(*) AS n FROM f JOIN stub s ON s.pattern_id = f.guid WHERE s.utility_group IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY utility_group) AS t, row_number() OVER (PARTITION BY utility_group ORDER BY n DESC, axis) AS k FROM c) SELECT utility_group, axis, n AS votes, round(n / CAST(t AS DOUBLE), 6) AS confidence FROM r WHERE k = 1")
def _(spark, root):
    f = P.lines(spark, root).select("guid", F.col("legs")[0]["axis"].alias("axis"))
    s = A.stubs(spark, root).where("utility_group is not null").select(F.col("pattern_id").alias("guid"), "utility_group")
    return O.majority(f.join(s, "guid"), ["utility_group"], "axis").withColumn("confidence", F.round("confidence", 6))


@query("a13_rack_levels", "leg", """WITH h AS (SELECT round_even((z + nz) / 2 / 100, 0) * 100 AS level, round(sum(sqrt(power(dx, 2) + power(dy, 2))), 6) AS mm, count(*) AS legs FROM leg WHERE abs(dz) < 5 GROUP BY 1) SELECT level, mm, legs FROM h""")
def _(spark, root):
    e = P.exploded(spark, root).where("abs(dz) < 5")
    level = F.bround((F.col("a.z") + F.col("b.z")) / 2 / 100, 0) * 100
    return e.groupBy(level.alias("level")).agg(R6(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("mm"), F.count("*").alias("legs"))


def a13_peaks(spark, root):
    """Preferred rack levels: the heaviest bins that are 300 mm or more apart, five at most, ascending."""
    bins = Q["a13_rack_levels"](spark, root).withColumn("all", F.lit("all"))
    out = O.suppressed_peaks(bins, ["all"], "level", "mm", 300.0, 5)
    return out.select(F.posexplode("levels").alias("n", "level"))


Q["a13_rack_peaks"] = a13_peaks
SQL["a13_rack_peaks"] = over("leg", """WITH RECURSIVE h AS (SELECT round_even((z + nz) / 2 / 100, 0) * 100 AS level, round(sum(sqrt(power(dx, 2) + power(dy, 2))), 6) AS mm FROM leg WHERE abs(dz) < 5 GROUP BY 1),
  o AS (SELECT level, row_number() OVER (ORDER BY mm DESC, level) AS k FROM h),
  p AS (SELECT 0::BIGINT AS k, []::DOUBLE[] AS taken UNION ALL SELECT o.k, CASE WHEN len(taken) >= 5 OR len(list_filter(taken, lambda t: abs(t - o.level) < 300)) > 0 THEN taken ELSE list_append(taken, o.level) END FROM p JOIN o ON o.k = p.k + 1),
  z AS (SELECT list_sort(taken) AS l FROM p ORDER BY k DESC LIMIT 1) SELECT CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS level FROM z""").replace("WITH v0 AS", "WITH RECURSIVE v0 AS", 1).replace("RECURSIVE h AS", "h AS")


@query("a14_templates", "stub", """WITH g AS (SELECT stub_kind, anchor_kind, utility_group, utility, face, count(*) AS n, avg(stub_length_mm) AS m FROM stub GROUP BY ALL HAVING count(*) >= 3),
  r AS (SELECT g.*, s.pattern_id, row_number() OVER (PARTITION BY g.stub_kind, g.anchor_kind, g.utility_group, g.utility, g.face ORDER BY round(abs(coalesce(s.stub_length_mm, 0) - m), 6), s.pattern_id) AS k FROM g JOIN stub s ON (s.stub_kind, s.anchor_kind, s.utility_group, s.utility, s.face) IS NOT DISTINCT FROM (g.stub_kind, g.anchor_kind, g.utility_group, g.utility, g.face))
  SELECT stub_kind, anchor_kind, utility_group, utility, face, n, round(m, 6) AS mean, pattern_id AS representative FROM r WHERE k = 1""")
def _(spark, root):
    keys = ["stub_kind", "anchor_kind", "utility_group", "utility", "face"]
    return O.closest_to_mean(A.stubs(spark, root).select("pattern_id", "stub_length_mm", *keys), keys, "stub_length_mm", "pattern_id").where("n >= 3").withColumn("mean", R6("mean"))


@query("a15_length_rollup", "route", "SELECT utility, count(*) AS routes, round(sum(total_length), 2) AS mm, round(avg(total_length), 6) AS mean_mm FROM route GROUP BY utility ORDER BY sum(total_length) DESC, utility LIMIT 5")
def _(spark, root):
    g = A.routes(spark, root).groupBy("utility").agg(F.count("*").alias("routes"), F.sum("total_length").alias("s"), R6(F.avg("total_length")).alias("mean_mm"))
    return g.orderBy(F.col("s").desc(), "utility").limit(5).select("utility", "routes", F.round("s", 2).alias("mm"), "mean_mm")


@query("a16_quantiles", "route", "SELECT utility_group, round(median(total_length), 6) AS median, round(quantile_cont(total_length, 0.95), 6) AS p95, quantile_disc(total_length, 0.95) AS p95_rank, mode(bend_count ORDER BY bend_count) IS NOT NULL AS has_mode, round(stddev_pop(total_length) / avg(total_length), 6) AS cv FROM route GROUP BY utility_group")
def _(spark, root):
    return A.routes(spark, root).groupBy("utility_group").agg(
        R6(F.median("total_length")).alias("median"), R6(F.percentile("total_length", 0.95)).alias("p95"), F.expr("percentile_disc(0.95) within group (order by total_length)").alias("p95_rank"),
        F.mode("bend_count").isNotNull().alias("has_mode"), F.round(F.stddev_pop("total_length") / F.avg("total_length"), 6).alias("cv"),
    )


@query("a20_profile", "route member", """WITH g AS (SELECT equipment_key, utility, count(*) AS n, count(DISTINCT nullif(size, '')) AS sizes FROM route GROUP BY 1, 2) SELECT count(*) AS groups, count(*) FILTER (n >= 2) AS usable, CAST(sum(n) FILTER (n >= 2) AS BIGINT) AS members, min(n) FILTER (n >= 2) AS least, CAST(quantile_cont(n, 0.5) FILTER (n >= 2) AS DOUBLE) AS p50, round(CAST(quantile_cont(n, 0.9) FILTER (n >= 2) AS DOUBLE), 6) AS p90, max(n) AS most, count(*) FILTER (n >= 2 AND sizes = 1) AS one_size FROM g""")
def _(spark, root):
    g = A.routes(spark, root).groupBy("equipment_key", "utility").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.col("size"), F.lit(""))).alias("sizes"))
    big = F.when(F.col("n") >= 2, F.col("n"))
    return g.agg(F.count("*").alias("groups"), F.count(big).alias("usable"), F.sum(big).alias("members"), F.min(big).alias("least"), F.percentile(big, 0.5).alias("p50"), F.round(F.percentile(big, 0.9), 6).alias("p90"), F.max("n").alias("most"), F.count_if((F.col("n") >= 2) & (F.col("sizes") == 1)).alias("one_size"))


@query("a21_arm_summary", "ablog", """WITH s AS (SELECT arm, count(*) AS n, round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(length_mm) FILTER (success), 6) AS mean_length, round(avg(bends) FILTER (success), 6) AS mean_bends FROM ablog GROUP BY arm) SELECT * FROM s""")
def _(spark, root):
    ok = F.col("success")
    return A.ab_log(spark, root).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("success_rate"), F.round(F.avg(F.when(ok, F.col("length_mm"))), 6).alias("mean_length"), F.round(F.avg(F.when(ok, F.col("bends"))), 6).alias("mean_bends"))


@query("r21_ab_decision", "ablog", f"""WITH {_ARMS}, p AS (SELECT b.rate AS r0, c.rate AS r1, b.len AS l0, c.len AS l1 FROM arms b JOIN arms c ON b.request_key = c.request_key AND b.run_id = c.run_id AND b.arm = 'BASELINE' AND c.arm = 'CONTEXT'),
  s AS (SELECT count(*) AS pairs, avg(r1 - r0) AS dr, avg(l1 - l0) AS dl FROM p) SELECT pairs, round(dr, 6) AS rate_delta, round(dl, 6) AS length_delta, CASE WHEN pairs < 30 THEN 'INSUFFICIENT_PAIRS' WHEN dr < -0.02 THEN 'REGRESSION' WHEN dr > 0.02 OR dl < -100 THEN 'PROMISING' WHEN abs(dr) <= 0.001 AND abs(dl) <= 1 THEN 'NO_OBSERVED_ROUTE_QUALITY_EFFECT' ELSE 'INCONCLUSIVE' END AS decision FROM s""")
def _(spark, root):
    a = _arms(spark, root)
    b = a.where("arm = 'BASELINE'").select("request_key", "run_id", F.col("rate").alias("r0"), F.col("len").alias("l0"))
    s = a.where("arm = 'CONTEXT'").join(b, ["request_key", "run_id"]).agg(F.count("*").alias("pairs"), F.avg(F.col("rate") - F.col("r0")).alias("dr"), F.avg(F.col("len") - F.col("l0")).alias("dl"))
    decision = (
        F.when(F.col("pairs") < 30, "INSUFFICIENT_PAIRS").when(F.col("dr") < -0.02, "REGRESSION").when((F.col("dr") > 0.02) | (F.col("dl") < -100), "PROMISING")
        .when((F.abs("dr") <= 0.001) & (F.abs("dl") <= 1), "NO_OBSERVED_ROUTE_QUALITY_EFFECT").otherwise("INCONCLUSIVE")
    )
    return s.select("pairs", F.round("dr", 6).alias("rate_delta"), F.round("dl", 6).alias("length_delta"), decision.alias("decision"))


@query("a24_content_hash", "route", "SELECT project, count(*) AS n_rows, CAST(sum(CAST('0x' || left(md5(coalesce(guid, '') || '|' || coalesce(utility, '') || '|' || coalesce(bay, '')), 12) AS BIGINT)) AS DECIMAL(38,0)) AS fingerprint FROM route GROUP BY project")
def _(spark, root):
    return O.content_hash(A.routes(spark, root), ["project"], ["guid", "utility", "bay"])


@query("a26_context_contract", "member", "WITH c AS (SELECT group_vector_id, context_vector_build_run_id AS b, count(*) AS n FROM member WHERE context_vector_build_run_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY group_vector_id ORDER BY n DESC, b) AS k FROM c) SELECT m.group_vector_id, r.b AS contract, count(*) FILTER (m.context_vector_build_run_id = r.b) AS kept, count(*) FILTER (m.context_vector_build_run_id IS DISTINCT FROM r.b) AS nulled FROM member m JOIN r ON r.group_vector_id = m.group_vector_id AND k = 1 GROUP BY 1, 2")
def _(spark, root):
    m = A.members(spark, root).select("group_vector_id", F.col("context_vector_build_run_id").alias("b"))
    best = O.majority(m, ["group_vector_id"], "b").select("group_vector_id", F.col("b").alias("contract"))
    return m.join(best, "group_vector_id").groupBy("group_vector_id", "contract").agg(F.count_if(F.col("b") == F.col("contract")).alias("kept"), F.count_if(~F.col("b").eqNullSafe(F.col("contract"))).alias("nulled"))


# ---- windows and limits


@query("w01_latest_run", "ablog", f"WITH {_ARMS}, c AS (SELECT request_key, run_id, max(t) AS t FROM arms GROUP BY 1, 2 HAVING count(*) = 2), r AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY t DESC, run_id DESC) AS k FROM c) SELECT request_key, run_id FROM r WHERE k = 1")
def _(spark, root):
    c = _arms(spark, root).groupBy("request_key", "run_id").agg(F.max("t").alias("t"), F.count("*").alias("n")).where("n = 2")
    return O.latest(c, ["request_key"], F.col("t").desc(), F.col("run_id").desc()).select("request_key", "run_id")


@query("w09_round_robin", "route", "WITH a AS (SELECT guid, project, utility_group, row_number() OVER (PARTITION BY project, utility_group ORDER BY guid) AS r FROM route WHERE project IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY r, utility_group, guid) AS s FROM a) SELECT guid, project, utility_group, CAST(row_number() OVER (ORDER BY s, project) AS INT) AS pick FROM b QUALIFY pick <= 60")
def _(spark, root):
    r = A.routes(spark, root).where("project is not null").select("guid", "project", "utility_group")
    return O.round_robin(r, "project", ["utility_group"], "guid", 60)


@query("w10_even_sample", "grp", "WITH n AS (SELECT group_vector_id, row_number() OVER (ORDER BY group_vector_id) - 1 AS p, count(*) OVER () AS t FROM grp) SELECT group_vector_id FROM n WHERE p IN (SELECT i * t // 20 FROM range(20) x(i))")
def _(spark, root):
    return O.evenly(A.groups(spark, root).select("group_vector_id"), "group_vector_id", 20)


@query("w11_spacing", "member", "SELECT group_vector_id, guid, member_order, round(start_x - lag(start_x) OVER (PARTITION BY group_vector_id ORDER BY start_x, guid, member_order), 6) AS spacing FROM member")
def _(spark, root):
    w = W.partitionBy("group_vector_id").orderBy("start_x", "guid", "member_order")
    return A.members(spark, root).select("group_vector_id", "guid", "member_order", R6(F.col("start_x") - F.lag("start_x").over(w)).alias("spacing"))


@query("w12_alternation", "member", "WITH s AS (SELECT group_vector_id, guid, member_order, start_x, CASE WHEN start_z >= avg(start_z) OVER (PARTITION BY group_vector_id) THEN 1 ELSE -1 END AS sg FROM member), f AS (SELECT *, sg <> lag(sg) OVER (PARTITION BY group_vector_id ORDER BY start_x, guid, member_order) AS fl FROM s) SELECT group_vector_id, round(count(*) FILTER (fl) / CAST(count(*) - 1 AS DOUBLE), 6) AS rate FROM f GROUP BY group_vector_id HAVING count(*) > 1")
def _(spark, root):
    m = A.members(spark, root).select("group_vector_id", "guid", "member_order", "start_x", "start_z")
    g, w = W.partitionBy("group_vector_id"), W.partitionBy("group_vector_id").orderBy("start_x", "guid", "member_order")
    m = m.withColumn("s", F.when(F.col("start_z") >= F.avg("start_z").over(g), 1).otherwise(-1)).withColumn("f", F.col("s") != F.lag("s").over(w))
    return m.groupBy("group_vector_id").agg(F.count_if("f").alias("f"), F.count("*").alias("n")).where("n > 1").select("group_vector_id", F.round(F.col("f") / (F.col("n") - 1), 6).alias("rate"))


@query("w13_gap_clusters", "member", "WITH f AS (SELECT group_vector_id, guid, member_order, start_x, CASE WHEN start_x - lag(start_x) OVER w > 2000 THEN 1 ELSE 0 END AS n FROM member WINDOW w AS (PARTITION BY group_vector_id ORDER BY start_x, guid)), c AS (SELECT *, sum(n) OVER (PARTITION BY group_vector_id ORDER BY start_x, guid) AS cluster FROM f) SELECT group_vector_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(max(start_x) - min(start_x), 6) AS width FROM c GROUP BY 1, 2")
def _(spark, root):
    c = O.gap_clusters(A.members(spark, root).select("group_vector_id", "guid", "start_x"), ["group_vector_id"], "start_x", "guid", 2000.0)
    return c.groupBy("group_vector_id", "cluster").agg(F.count("*").alias("n"), R6(F.max("start_x") - F.min("start_x")).alias("width"))


@query("t07_nearest_centre", "obstacle", "SELECT id, kind FROM obstacle ORDER BY power((minx + maxx) / 2 - 45000, 2) + power((miny + maxy) / 2 - 30000, 2) + power((minz + maxz) / 2 - 12000, 2), id LIMIT 25")
def _(spark, root):
    d = sum((((F.col("min" + c) + F.col("max" + c)) / 2 - v) ** 2 for c, v in (("x", 45000), ("y", 30000), ("z", 12000))), F.lit(0.0))
    return A.obstacles(spark, root).orderBy(d, "id").limit(25).select("id", "kind")


@query("t08_template_fallback", "stub", """WITH t AS (SELECT stub_kind, utility_group, utility, pipe_size, count(*) AS n, round(avg(stub_length_mm), 6) AS m, CASE WHEN stub_kind = 'START' AND utility_group = 'DRAIN' AND utility = 'ACID_DRN' AND pipe_size = '999A' THEN 1 WHEN stub_kind = 'START' AND utility_group = 'DRAIN' AND utility = 'ACID_DRN' THEN 2 WHEN stub_kind = 'START' AND utility_group = 'DRAIN' THEN 3 WHEN stub_kind = 'START' THEN 4 END AS level FROM stub GROUP BY ALL)
  SELECT stub_kind, utility_group, utility, pipe_size, n, m, level FROM t WHERE level = (SELECT min(level) FROM t) ORDER BY n DESC, m NULLS LAST, pipe_size LIMIT 10""")
def _(spark, root):
    t = A.stubs(spark, root).groupBy("stub_kind", "utility_group", "utility", "pipe_size").agg(F.count("*").alias("n"), R6(F.avg("stub_length_mm")).alias("m"))
    want = {"stub_kind": "START", "utility_group": "DRAIN", "utility": "ACID_DRN", "pipe_size": "999A"}
    level = F.lit(None).cast("int")
    for depth in range(1, 5):  # fewer fields count at each level
        ok = F.lit(True)
        for c, v in list(want.items())[: 5 - depth]:
            ok = ok & (F.col(c) == v)
        level = F.when(level.isNull() & ok, depth).otherwise(level)
    t = t.withColumn("level", level).where("level is not null")
    best = t.agg(F.min("level").alias("best"))
    return t.join(F.broadcast(best), F.col("level") == F.col("best")).drop("best").orderBy(F.col("n").desc(), F.col("m").asc_nulls_last(), "pipe_size").limit(10)


@query("t09_retention", "", "SELECT project_scope_key, model_revision_key FROM (SELECT *, row_number() OVER (PARTITION BY project_scope_key ORDER BY coalesce(ready_at, applied_at) DESC NULLS LAST, model_revision_key) AS k FROM tb_route_source_scope_manifest) WHERE k > 2 AND status = 'RETIRED'")
def _(spark, root):
    m = table(spark, root, "tb_route_source_scope_manifest")
    w = W.partitionBy("project_scope_key").orderBy(F.coalesce("ready_at", "applied_at").desc_nulls_last(), "model_revision_key")
    return m.withColumn("k", F.row_number().over(w)).where("k > 2 and status = 'RETIRED'").select("project_scope_key", "model_revision_key")


# ---- sets


@query("u01_tagged_union", "vertex", "SELECT zone, count(*) AS n FROM (SELECT 'START' AS zone, guid FROM vertex WHERE i <= 2 UNION ALL SELECT 'REST', guid FROM vertex WHERE i > 2) GROUP BY zone")
def _(spark, root):
    v = P.s12(spark, root)
    a, b = v.where("idx <= 1").select(F.lit("START").alias("zone"), "guid"), v.where("idx > 1").select(F.lit("REST").alias("zone"), "guid")
    return a.unionByName(b).groupBy("zone").agg(F.count("*").alias("n"))


@query("u02_set_ops", "route member stub", "SELECT 'union' AS op, count(*) AS n FROM (SELECT utility FROM route UNION SELECT utility FROM stub) UNION ALL SELECT 'intersect', count(*) FROM (SELECT guid FROM route INTERSECT SELECT guid FROM member) UNION ALL SELECT 'except', count(*) FROM (SELECT guid FROM route EXCEPT SELECT guid FROM member)")
def _(spark, root):
    r, m, s = A.routes(spark, root), A.members(spark, root), A.stubs(spark, root)
    parts = {"union": r.select("utility").union(s.select("utility")).distinct(), "intersect": r.select("guid").intersect(m.select("guid")), "except": r.select("guid").subtract(m.select("guid"))}
    out = None
    for op, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("u04_jaccard", "member", "WITH s AS (SELECT group_vector_id, list(DISTINCT utility ORDER BY utility) AS a, list(DISTINCT pipe_size ORDER BY pipe_size) AS z FROM member GROUP BY 1) SELECT group_vector_id, len(list_intersect(z, ['50A', '40A', '100A'])) AS common, round(len(list_intersect(z, ['50A', '40A', '100A'])) / CAST(greatest(len(list_distinct(list_concat(list_filter(z, lambda x: x IS NOT NULL), ['50A', '40A', '100A']))), 1) AS DOUBLE), 6) AS jaccard FROM s")
def _(spark, root):
    want = F.array(*[F.lit(x) for x in ("50A", "40A", "100A")])
    s = A.members(spark, root).groupBy("group_vector_id").agg(F.collect_set("pipe_size").alias("z"))
    return s.select("group_vector_id", F.size(F.array_intersect("z", want)).cast("bigint").alias("common"), F.round(F.size(F.array_intersect("z", want)) / F.greatest(F.size(F.array_union("z", want)), F.lit(1)), 6).alias("jaccard"))


# ---- evaluation, provenance, lifecycle


@query("a22_ranking_metrics", "gvec", """WITH n AS (SELECT q.group_vector_id AS q, g.group_vector_id AS c, q.process_name AS pq, g.process_name AS pc, list_cosine_similarity(q.feature_centroid, g.feature_centroid) AS s, row_number() OVER (PARTITION BY q.group_vector_id ORDER BY round(list_cosine_similarity(q.feature_centroid, g.feature_centroid), 12) DESC, g.group_vector_id) AS k
  FROM (SELECT * FROM gvec WHERE CAST('0x' || right(group_vector_id, 12) AS BIGINT) % 100 = 0) q JOIN gvec g ON g.utility = q.utility AND g.group_vector_id <> q.group_vector_id) SELECT count(DISTINCT q) AS queries, round(avg(CAST(pq = pc AS INT)) FILTER (k = 1), 6) AS same_at_1, round(avg(CAST(pq = pc AS INT)) FILTER (k <= 5), 6) AS same_share_at_5, round(avg(s) FILTER (k = 1), 6) AS mean_top1 FROM n""")
def _(spark, root):
    from pipeloom.operators.search import batch_top_k
    from pipeloom.plans.search import valid_groups

    g = valid_groups(spark, root).select(F.col("group_vector_id").alias("id"), F.col("utility").alias("bucket"), F.col("feature_centroid").alias("vec"), "process_name")
    n = batch_top_k(g, g.where(F.conv(F.substring("id", -12, 12), 16, 10).cast("bigint") % 100 == 0), 5)
    names = g.select("id", F.col("process_name").alias("pc"))
    n = n.join(names, "id").join(g.select(F.col("id").alias("query_id"), F.col("process_name").alias("pq")), "query_id")
    same = (F.col("pq") == F.col("pc")).cast("int")
    return n.agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg(F.when(F.col("rank") == 1, same)), 6).alias("same_at_1"), F.round(F.avg(same), 6).alias("same_share_at_5"), F.round(F.avg(F.when(F.col("rank") == 1, F.col("cosine"))), 6).alias("mean_top1"))


@query("l02_validate", "grp", "SELECT count(*) AS n, count(DISTINCT group_vector_id) = count(*) AS unique_ids, count(*) FILTER (project_scope_key IS NULL) AS null_scopes, count(*) FILTER (abs(sqrt(list_dot_product(feature_centroid, feature_centroid)) - 1) > 1e-5) AS bad_norms, count(*) FILTER (member_count < 2) AS small FROM grp")
def _(spark, root):
    from pipeloom.functions import vector as V

    g = A.groups(spark, root)
    v = F.col("feature_centroid")
    return g.agg(F.count("*").alias("n"), (F.count_distinct("group_vector_id") == F.count("*")).alias("unique_ids"), F.count_if(F.col("project_scope_key").isNull()).alias("null_scopes"), F.count_if((F.abs(V.norm(v) - 1) > 1e-5)).alias("bad_norms"), F.count_if(F.col("member_count") < 2).alias("small"))


@query("l04_monitor", "", "SELECT project_scope_key, count(*) AS revisions, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'ACTIVE') <> 1 AS alarm, count(*) FILTER (parent_revision_key IS NOT NULL AND parent_revision_key NOT IN (SELECT model_revision_key FROM tb_route_source_scope_manifest WHERE model_revision_key IS NOT NULL)) AS lost_parents FROM tb_route_source_scope_manifest GROUP BY 1")
def _(spark, root):
    m = table(spark, root, "tb_route_source_scope_manifest")
    known = m.where("model_revision_key is not null").select(F.col("model_revision_key").alias("parent_revision_key")).distinct().withColumn("known", F.lit(True))
    j = m.join(known, "parent_revision_key", "left")
    lost = F.col("parent_revision_key").isNotNull() & F.col("known").isNull()
    active = F.count_if(F.col("status") == "ACTIVE")
    return j.groupBy("project_scope_key").agg(F.count("*").alias("revisions"), active.alias("active"), (active != 1).alias("alarm"), F.count_if(lost).alias("lost_parents"))


@query("l03_promotable", "", "SELECT project_scope_key, model_revision_key, status IN ('READY', 'ACTIVE', 'RETIRED') AS promotable, status = 'ACTIVE' AS needs_force FROM tb_route_source_scope_manifest WHERE status IS NOT NULL")
def _(spark, root):
    m = table(spark, root, "tb_route_source_scope_manifest").where("status is not null")
    return m.select("project_scope_key", "model_revision_key", F.col("status").isin("READY", "ACTIVE", "RETIRED").alias("promotable"), (F.col("status") == "ACTIVE").alias("needs_force"))


@query("l09_graph", "route member", "WITH e AS (SELECT r.equipment_key, m.group_vector_id, count(*) AS routes FROM route r JOIN member m ON m.guid = r.guid WHERE r.equipment_key <> '' GROUP BY 1, 2) SELECT a.equipment_key AS left_equipment, b.equipment_key AS right_equipment, count(*) AS shared_groups FROM e a JOIN e b ON a.group_vector_id = b.group_vector_id AND a.equipment_key < b.equipment_key GROUP BY 1, 2")
def _(spark, root):
    r = A.routes(spark, root).where("equipment_key <> ''").select("guid", "equipment_key")
    e = r.join(A.members(spark, root).select("guid", "group_vector_id"), "guid").select("equipment_key", "group_vector_id").distinct()
    f = e.withColumnRenamed("equipment_key", "right_equipment")
    pairs = e.join(f, "group_vector_id").where("equipment_key < right_equipment")
    return pairs.groupBy(F.col("equipment_key").alias("left_equipment"), "right_equipment").agg(F.count("*").alias("shared_groups"))


@query("k01_upsert", "route", "SELECT guid, bay FROM route WHERE guid >= '8' UNION ALL SELECT guid, 'NEW' FROM route WHERE guid < '8'")
def _(spark, root):
    r = A.routes(spark, root).select("guid", "bay")
    return K.upsert(r, r.where("guid < '8'").withColumn("bay", F.lit("NEW")), ["guid"])


@query("k03_refresh_plan", "grp member", "WITH c AS (SELECT group_vector_id AS g, CAST(count(*) AS VARCHAR) AS h FROM member GROUP BY 1), s AS (SELECT group_vector_id AS g, CAST(member_count AS VARCHAR) AS h, status FROM grp) SELECT coalesce(c.g, s.g) AS group_vector_id, CASE WHEN c.g IS NULL THEN 'STALE' WHEN s.g IS NULL THEN 'NEW' WHEN c.h = s.h AND status = 'READY' THEN 'SAME' ELSE 'CHANGED' END AS action FROM c FULL JOIN s ON c.g = s.g")
def _(spark, root):
    c = A.members(spark, root).groupBy("group_vector_id").agg(F.count("*").cast("string").alias("h"))
    s = A.groups(spark, root).select("group_vector_id", F.col("member_count").cast("string").alias("h"), "status")
    return K.refresh_plan(c, s, "group_vector_id", "h")


@query("s17_schema_check", "", "SELECT 'process_name' AS \"column\", count(*) FILTER (process_name IS NULL) AS nulls, count(*) FILTER (trim(process_name) = '') AS blanks, count(*) AS n_rows FROM tb_route_path UNION ALL SELECT 'source_size', count(*) FILTER (source_size IS NULL), count(*) FILTER (trim(source_size) = ''), count(*) FROM tb_route_path UNION ALL SELECT 'total_length', count(*) FILTER (total_length IS NULL), 0, count(*) FROM tb_route_path")
def _(spark, root):
    return K.profile(table(spark, root, "tb_route_path").select("process_name", "source_size", "total_length")).drop("type")


@query("s07_projects", "", "SELECT CAST(row_number() OVER (ORDER BY project_scope_key) AS INT) AS seq, project_scope_key FROM (SELECT DISTINCT project_scope_key FROM tb_route_source_scope_manifest WHERE project_scope_key IS NOT NULL)")
def _(spark, root):
    p = table(spark, root, "tb_route_source_scope_manifest").select("project_scope_key").where("project_scope_key is not null").distinct()
    return p.select(F.row_number().over(W.orderBy("project_scope_key")).alias("seq"), "project_scope_key")


@query("s10_json_lists", "", "WITH e AS (SELECT pattern_id, unnest(CAST(member_bend_ids AS BIGINT[])) AS b FROM (SELECT DISTINCT pattern_id, member_bend_ids, updated_at FROM tb_route_bend_feature_pattern QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1)) SELECT pattern_id, count(*) AS n, min(b) AS least, max(b) AS most FROM e GROUP BY pattern_id")
def _(spark, root):
    b = table(spark, root, "tb_route_bend_feature_pattern").groupBy("pattern_id").agg(F.max_by("member_bend_ids", "updated_at").alias("m"))
    e = b.select("pattern_id", F.explode(F.from_json("m", "array<bigint>")).alias("b"))
    return e.groupBy("pattern_id").agg(F.count("*").alias("n"), F.min("b").alias("least"), F.max("b").alias("most"))


QUERIES = Q
