"""Vector search, re-ranking and scalar-size queries over groups, members and stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.functions import pattern as P
from pipeloom.functions import sizes as S
from pipeloom.functions import vector as V
from pipeloom.operators import search as O
from pipeloom.plans.oracle_views import over
from pipeloom.sources import adapter as A

K = 5


def valid_groups(spark: SparkSession, root: str) -> DataFrame:
    return A.groups(spark, root).where(A.is_vector(F.col("feature_centroid"), 30))


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """Members with their group's vectors: the search's candidate rows."""
    g = valid_groups(spark, root).select(
        "group_vector_id", F.col("feature_centroid").alias("feature"), F.when(A.is_vector(F.col("context_centroid"), 30), F.col("context_centroid")).alias("context"), F.col("process_name").alias("process"),
    )
    m = A.members(spark, root).withColumn("id", F.concat_ws("/", "group_vector_id", "guid", F.col("member_order").cast("string")))
    return m.join(g, "group_vector_id").withColumn("pattern", P.compressed(F.col("direction_pattern")))


def _first_group(df: DataFrame):
    """The query of the single searches: the group of the least identifier, read with the few columns they need."""
    return df.select("group_vector_id", "process_name", "utility_group", "utility", "member_count", "feature_centroid", "context_centroid", *[f"{e}_centroid_{a}" for e in ("start", "end") for a in "xyz"]).orderBy("group_vector_id").first()


def t01(spark, root):
    g = valid_groups(spark, root)
    out = O.nearest(g, "feature_centroid", _first_group(g)["feature_centroid"], "group_vector_id", O.route_fetch(K))
    return out.select("group_vector_id", F.round("distance", 6).alias("distance"))


def t02(spark, root):
    g = valid_groups(spark, root)
    q = _first_group(g)
    pool = g.where((F.col("utility") == q["utility"]) & (F.col("group_vector_id") != q["group_vector_id"]))
    out = O.nearest(pool, "feature_centroid", q["feature_centroid"], "group_vector_id", O.group_fetch(K))
    return O.ranked(out, F.col("distance"), F.col("group_vector_id"), k=K).select("group_vector_id", F.round("distance", 6).alias("distance"), "rank")


def t03(spark, root):
    g = valid_groups(spark, root)
    q = _first_group(g)
    pool = g.where((F.col("process_name") == q["process_name"]) & (F.col("utility_group") == q["utility_group"]))
    out = O.nearest(pool, "feature_centroid", q["feature_centroid"], "group_vector_id", O.bundle_fetch(K), "l2")
    return out.select("group_vector_id", F.round("distance", 6).alias("distance"))


def _stub_vectors(spark, root):
    s = A.stubs(spark, root).withColumn("vec", F.from_json("feat_json", "array<double>"))
    return s.where(A.is_vector(F.col("vec"), 24)).withColumn("unit_dir", F.from_json("dir_unit_json", "array<double>"))


def t04(spark, root):
    s = _stub_vectors(spark, root)
    q = s.orderBy("pattern_id").first()
    pool = s.where((F.col("stub_kind") == q["stub_kind"]) & (F.col("anchor_kind") == q["anchor_kind"]) & (F.col("pattern_id") != q["pattern_id"]))
    return O.nearest(pool, "vec", q["vec"], "pattern_id", 50, "l2").select("pattern_id", F.round("distance", 6).alias("distance"))


def t05(spark, root):
    c = candidates(spark, root)
    q = c.where("context is not null and total_length_mm is not null").orderBy("id").first()
    pool = O.nearest(c, "feature", q["feature"], "id", O.route_fetch(K))
    ends = [F.col(f"end_{a}") - F.col(f"start_{a}") for a in "xyz"]
    mine = [F.lit(q[f"end_{a}"] - q[f"start_{a}"]) for a in "xyz"]
    score = O.hybrid_score(
        O.position_score(mine, ends), O.pattern_part(F.lit(q["pattern"]), F.col("pattern")), 1 - F.col("distance"), V.cosine(F.col("context"), O.literal(q["context"]))
    )
    score = F.when(F.col("context").isNull(), O.hybrid_score(O.position_score(mine, ends), O.pattern_part(F.lit(q["pattern"]), F.col("pattern")), 1 - F.col("distance"), F.lit(None).cast("double"))).otherwise(score)
    out = pool.withColumn("score", F.round(score, 9))
    return O.ranked(out, F.col("score").desc(), F.col("id"), k=20).select("id", "score", "rank")


def t06(spark, root):
    g = valid_groups(spark, root).select(F.col("group_vector_id").alias("id"), F.col("utility").alias("bucket"), F.col("feature_centroid").alias("vec"))
    asked = g.where(F.conv(F.substring("id", -12, 12), 16, 10).cast("bigint") % 100 == 0)
    return O.batch_top_k(g, asked, K).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def r02(spark, root):
    r = A.routes(spark, root)
    v = V.query_vector(*[F.col(c) for c in ("source_posx", "source_posy", "source_posz", "target_posx", "target_posy", "target_posz")])
    return r.select("guid", F.transform(v, lambda x: F.round(x, 6)).alias("v")).select("guid", *[F.col("v")[i].alias(f"v{i}") for i in (0, 1, 2, 3, 6, 9, 21)], F.size("v").alias("dims"))


def r04(spark, root):
    m = A.members(spark, root).select("group_vector_id", "guid", "member_order", P.compressed(F.col("direction_pattern")).alias("p"))
    sim = P.structural_similarity(F.col("p"), F.lit("RHDHR"))
    return m.select("group_vector_id", "guid", "member_order", F.col("p").alias("compressed"), F.round(sim, 6).alias("similarity"))


def r06(spark, root):
    """Members of the first group against the members of all groups of its utility."""
    c = candidates(spark, root)
    first = c.agg(F.min("group_vector_id")).first()[0]
    q = c.where(F.col("group_vector_id") == first)
    qs = q.select(*[F.col(x).alias("q_" + x) for x in ("id", "utility", "pipe_size", "pattern", "feature", "context", *[f"{e}_{a}" for e in ("start", "end") for a in "xyz"])])
    pairs = c.join(qs, F.col("utility") == F.col("q_utility"))
    size = S.size_score(F.col("q_pipe_size"), F.col("pipe_size"))[1]
    move = lambda p: [F.col(f"{p}end_{a}") - F.col(f"{p}start_{a}") for a in "xyz"]
    context = F.when(F.col("context").isNotNull() & F.col("q_context").isNotNull(), V.cosine(F.col("context"), F.col("q_context")))
    pattern = F.when((F.length("pattern") > 0) & (F.length("q_pattern") > 0), 0.5 * P.structural_similarity(F.col("q_pattern"), F.col("pattern")) + 0.5 * V.clamp01(V.cosine(F.slice("feature", 13, 9), F.slice("q_feature", 13, 9))))
    score = O.pair_score(O.position_score(move("q_"), move("")), pattern, V.cosine(F.col("feature"), F.col("q_feature")), context, size)
    return pairs.select(F.col("q_id").alias("query_member"), F.col("id").alias("candidate_member"), F.round(size, 3).alias("size_score"), F.round(score, 6).alias("score"))


def r13(spark, root):
    g = valid_groups(spark, root)
    q = _first_group(g)
    d = V.l2(F.col("feature_centroid"), O.literal(q["feature_centroid"]))
    score = 1 / (1 + d) / (1 + 0.15 * F.abs(F.col("member_count") - q["member_count"]))
    return g.select("group_vector_id", F.round(score, 6).alias("score"))


def r14(spark, root):
    s = _stub_vectors(spark, root).where(F.size("unit_dir") == 3)
    q = s.orderBy("pattern_id").first()
    c = V.clamp(V.cosine(F.col("unit_dir"), O.literal(q["unit_dir"])), -1.0, 1.0)
    return s.select("pattern_id", F.round(0.7 / (1 + V.l2(F.col("vec"), O.literal(q["vec"]))) + 0.3 * c, 6).alias("score"))


def r17(spark, root):
    g = valid_groups(spark, root)
    q = _first_group(g.where(A.is_vector(F.col("context_centroid"), 30)))
    pos = O.position_score([F.lit(q[f"end_centroid_{a}"] - q[f"start_centroid_{a}"]) for a in "xyz"], [F.col(f"end_centroid_{a}") - F.col(f"start_centroid_{a}") for a in "xyz"])
    base = 0.5 * pos + 0.2 * V.cosine(F.col("feature_centroid"), O.literal(q["feature_centroid"]))
    ctx = F.when(A.is_vector(F.col("context_centroid"), 30), F.greatest(F.lit(0.0), V.cosine(F.col("context_centroid"), O.literal(q["context_centroid"]))))
    return g.select("group_vector_id", F.round(base, 6).alias("base"), F.round(F.when(ctx.isNull(), base).otherwise(0.9 * base + 0.1 * ctx), 6).alias("blended"))


def a03(spark, root):
    v = V.centroid(valid_groups(spark, root), ["utility"], "feature_centroid")
    return v.select("utility", F.size("centroid").alias("dims"), *[F.round(F.col("centroid")[i], 6).alias(f"c{i}") for i in (0, 7, 29)])


def a04(spark, root):
    s = _stub_vectors(spark, root)
    v = V.mean_vector(s, ["stub_kind", "face"], "vec")
    return v.select("stub_kind", "face", *[F.round(F.col("mean")[i], 6).alias(f"m{i}") for i in (0, 18, 21, 23)])


def a28(spark, root):
    g = A.groups(spark, root)
    return g.groupBy(F.size("feature_centroid").alias("dims"), F.size("context_centroid").alias("context_dims")).agg(F.count("*").alias("n"))


def f22(spark, root):
    g = valid_groups(spark, root).where(A.is_vector(F.col("context_centroid"), 30))
    a, b = F.col("feature_centroid"), F.col("context_centroid")
    return g.select("group_vector_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.l2(V.unit(a), V.unit(b)), 6).alias("l2"), F.round(V.norm(a), 6).alias("norm"))


def f03(spark, root):
    sizes = A.stubs(spark, root).select("pipe_size").distinct()
    c = F.col("pipe_size")
    return sizes.select("pipe_size", S.normalize_size(c).alias("normal"), S.first_number(c).alias("number"), F.round(S.size_to_diameter(c), 4).alias("diameter"), S.pipe_size_mm(c).alias("mm"), S.ladder_index(c).alias("ladder"))


def r07(spark, root):
    s = A.stubs(spark, root).select(F.col("pipe_size").alias("a")).distinct()
    ok, score = S.size_score(F.col("a"), F.lit("50A"))
    exact = S.size_score(F.col("a"), F.lit("50A"), "ExactOnly")
    return s.select("a", ok.alias("compatible"), score.alias("score"), F.coalesce(exact[0], F.lit(False)).alias("exact_compatible"), S.size_score(F.col("a"), F.lit("50A"), "Ignore")[1].alias("ignored"))


def l07(spark, root):
    g = A.groups(spark, root)
    tuple_ = F.struct("encoder_version", "status")
    return g.groupBy("project_scope_key").agg(F.count_distinct(tuple_).alias("n_provenance"), (F.count_distinct("encoder_version") == 1).alias("consistent"), F.count_if(F.trim("encoder_version") == "").alias("n_blank"))


QUERIES = {
    "t01_ann_cosine": t01, "t02_group_ann": t02, "t03_bundle_ann_l2": t03, "t04_stub_ann_l2": t04, "t05_hybrid_topk": t05, "t06_batch_topk": t06, "r02_query_vector": r02, "r04_pattern_similarity": r04,
    "r06_pair_score": r06, "r13_bundle_score": r13, "r14_stub_score": r14, "r17_offline_score": r17, "a03_centroid": a03, "a04_mean_vector": a04, "a28_vector_dims": a28, "f22_vector_math": f22,
    "f03_sizes": f03, "r07_size_score": r07, "l07_provenance": l07,
}

_FIRST = "WITH q AS (SELECT * FROM gvec ORDER BY group_vector_id LIMIT 1) "
_STUBV = "WITH sv AS (SELECT *, TRY_CAST(feat_json AS DOUBLE[]) AS vec, TRY_CAST(dir_unit_json AS DOUBLE[]) AS ud FROM stub), sw AS (SELECT * FROM sv WHERE len(vec) = 24 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"
_RLE = "array_to_string(list_filter(regexp_extract_all(upper(coalesce({0}, '')), '[RHDV]'), lambda x, i: i = 1 OR x <> regexp_extract_all(upper(coalesce({0}, '')), '[RHDV]')[i - 1]), '')"
_STRUCT = "CASE WHEN length({0}) = 0 OR length({1}) = 0 THEN 0.0 ELSE 1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) END"
_CAND = "WITH c AS (SELECT m.group_vector_id || '/' || m.guid || '/' || m.member_order AS id, m.*, g.feature_centroid AS feature, x.context_centroid AS context, " + _RLE.format("m.direction_pattern") + " AS pattern FROM member m JOIN gvec g ON m.group_vector_id = g.group_vector_id LEFT JOIN gctx x ON x.group_vector_id = g.group_vector_id)"
_CHORD = "sqrt(power(target_posx - source_posx, 2) + power(target_posy - source_posy, 2) + power(target_posz - source_posz, 2))"
_LADDER = "[6,8,10,15,20,25,32,40,50,65,80,90,100,125,150,175,200,225,250,300,350,400,450,500,550,600]"
_NORMAL = r"CASE WHEN trim(coalesce({0}, '')) = '' THEN 'UNKNOWN' WHEN regexp_matches(upper(regexp_replace({0}, '\s+', '', 'g')), '^0*\d+(\.\d+)?[A-Z]*$') THEN regexp_replace(upper(regexp_replace({0}, '\s+', '', 'g')), '^0*(\d)', '\1') ELSE upper(regexp_replace({0}, '\s+', '', 'g')) END"
_NUMBER = r"TRY_CAST(nullif(regexp_extract(regexp_replace(upper({0}), 'DN|MM', '', 'g'), '\d+(\.\d+)?'), '') AS DOUBLE)"
_STEP = "(SELECT i - 1 FROM (SELECT unnest(" + _LADDER + ") AS s, generate_subscripts(" + _LADDER + ", 1) AS i) WHERE {0} IS NOT NULL ORDER BY abs(s - {0}), i LIMIT 1)"
SQL = {
    "t01_ann_cosine": over("gvec", _FIRST + "SELECT g.group_vector_id, round(1 - list_cosine_similarity(g.feature_centroid, q.feature_centroid), 6) AS distance FROM gvec g, q ORDER BY 1 - list_cosine_similarity(g.feature_centroid, q.feature_centroid), g.group_vector_id LIMIT 150"),
    "t02_group_ann": over("gvec", _FIRST + ", d AS (SELECT g.group_vector_id, 1 - list_cosine_similarity(g.feature_centroid, q.feature_centroid) AS d FROM gvec g, q WHERE g.utility = q.utility AND g.group_vector_id <> q.group_vector_id) SELECT group_vector_id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, group_vector_id) AS INT) AS rank FROM d QUALIFY rank <= 5"),
    "t03_bundle_ann_l2": over("gvec", _FIRST + "SELECT g.group_vector_id, round(list_distance(g.feature_centroid, q.feature_centroid), 6) AS distance FROM gvec g, q WHERE g.process_name = q.process_name AND g.utility_group = q.utility_group ORDER BY list_distance(g.feature_centroid, q.feature_centroid), g.group_vector_id LIMIT 50"),
    "t04_stub_ann_l2": over("stub", _STUBV + ", q AS (SELECT * FROM sw ORDER BY pattern_id LIMIT 1) SELECT s.pattern_id, round(list_distance(s.vec, q.vec), 6) AS distance FROM sw s, q WHERE s.stub_kind = q.stub_kind AND s.anchor_kind = q.anchor_kind AND s.pattern_id <> q.pattern_id ORDER BY list_distance(s.vec, q.vec), s.pattern_id LIMIT 50"),
    "t05_hybrid_topk": over("member gvec gctx", _CAND + """, q AS (SELECT * FROM c WHERE context IS NOT NULL AND total_length_mm IS NOT NULL ORDER BY id LIMIT 1),
  d AS (SELECT c.*, list_cosine_similarity(c.feature, q.feature) AS vs, list_cosine_similarity(c.context, q.context) AS cs,
    greatest(0, 1 - sqrt(power((q.end_x - q.start_x) - (c.end_x - c.start_x), 2) + power((q.end_y - q.start_y) - (c.end_y - c.start_y), 2) + power((q.end_z - q.start_z) - (c.end_z - c.start_z), 2)) / 50000) AS ps,
    0.5 * """ + _STRUCT.format("q.pattern", "c.pattern") + """ AS ts FROM c, q ORDER BY 1 - list_cosine_similarity(c.feature, q.feature), c.id LIMIT 150),
  s AS (SELECT id, round(CASE WHEN context IS NULL THEN 0.5 * ps + 0.3 * ts + 0.2 * vs ELSE 0.45 * ps + 0.27 * ts + 0.18 * vs + 0.1 * greatest(0, cs) END, 9) AS score FROM d)
  SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 20"""),
    "t06_batch_topk": over("gvec", """SELECT query_id, id, round(c, 6) AS cosine, CAST(rank AS INT) AS rank FROM (SELECT q.group_vector_id AS query_id, g.group_vector_id AS id, list_cosine_similarity(q.feature_centroid, g.feature_centroid) AS c,
  row_number() OVER (PARTITION BY q.group_vector_id ORDER BY round(list_cosine_similarity(q.feature_centroid, g.feature_centroid), 12) DESC, g.group_vector_id) AS rank
  FROM gvec q JOIN gvec g ON q.utility = g.utility AND q.group_vector_id <> g.group_vector_id WHERE CAST('0x' || right(q.group_vector_id, 12) AS BIGINT) % 100 = 0) WHERE rank <= 5"""),
    "r02_query_vector": over("route", f"""WITH d AS (SELECT guid, target_posx - source_posx AS dx, target_posy - source_posy AS dy, target_posz - source_posz AS dz, {_CHORD} AS ch FROM route),
  e AS (SELECT guid, CASE WHEN ch > 1e-9 THEN [dx / ch, dy / ch, dz / ch] ELSE [0.0, 0.0, 0.0] END AS u, [greatest(-1, least(1, dx / {V.DISPLACEMENT_MAX})), greatest(-1, least(1, dy / {V.DISPLACEMENT_MAX})), greatest(-1, least(1, dz / {V.DISPLACEMENT_MAX}))] AS p,
    [least(1, abs(dx) / {V.BOX_MAX[0]}), least(1, abs(dy) / {V.BOX_MAX[1]}), least(1, abs(dz) / {V.BOX_MAX[2]})] AS b, least(1, ch / {V.LENGTH_MAX}) AS l FROM d),
  f AS (SELECT guid, list_transform(u, lambda x: x * sqrt(2.0)) AS u, list_transform(p, lambda x: x * sqrt(1.5)) AS p, list_transform(b, lambda x: x * sqrt(1.5)) AS b, l * sqrt(0.9) AS l FROM e),
  g AS (SELECT *, sqrt(2 * list_dot_product(u, u) + list_dot_product(p, p) + list_dot_product(b, b) + l * l) AS n FROM f)
  SELECT guid, round(u[1] / n, 6) AS v0, round(u[2] / n, 6) AS v1, round(u[3] / n, 6) AS v2, round(-u[1] / n, 6) AS v3, round(p[1] / n, 6) AS v6, round(b[1] / n, 6) AS v9, round(l / n, 6) AS v21, 30 AS dims FROM g"""),
    "r04_pattern_similarity": over("member", "WITH p AS (SELECT group_vector_id, guid, member_order, " + _RLE.format("direction_pattern") + " AS compressed FROM member) SELECT *, round(" + _STRUCT.format("compressed", "'RHDHR'") + ", 6) AS similarity FROM p"),
    "r06_pair_score": over("member gvec gctx", _CAND + """, q AS (SELECT * FROM c WHERE group_vector_id = (SELECT min(group_vector_id) FROM c)),
  p AS (SELECT q.id AS query_member, c.id AS candidate_member, """ + _NORMAL.format("q.pipe_size") + " AS na, " + _NORMAL.format("c.pipe_size") + " AS nb, " + _NUMBER.format("q.pipe_size") + " AS ma, " + _NUMBER.format("c.pipe_size") + """ AS mb,
    greatest(0, 1 - sqrt(power((q.end_x - q.start_x) - (c.end_x - c.start_x), 2) + power((q.end_y - q.start_y) - (c.end_y - c.start_y), 2) + power((q.end_z - q.start_z) - (c.end_z - c.start_z), 2)) / 50000) AS ps,
    CASE WHEN length(q.pattern) > 0 AND length(c.pattern) > 0 THEN 0.5 * """ + _STRUCT.format("q.pattern", "c.pattern") + """ + 0.5 * greatest(0, least(1, coalesce(list_cosine_similarity(c.feature[13:21], q.feature[13:21]), 0))) END AS ts,
    greatest(0, least(1, list_cosine_similarity(c.feature, q.feature))) AS fs, greatest(0, least(1, list_cosine_similarity(c.context, q.context))) AS cs FROM c JOIN q ON c.utility = q.utility),
  l AS (SELECT *, """ + _STEP.format("ma") + " AS sa, " + _STEP.format("mb") + """ AS sb FROM p),
  z AS (SELECT *, CASE WHEN na = nb THEN 1.0 WHEN sa IS NULL OR sb IS NULL THEN 0.0 WHEN sa = sb THEN 1.0 WHEN abs(sa - sb) = 1 THEN 0.8 WHEN abs(sa - sb) = 2 THEN 0.5 ELSE 0.0 END AS size FROM l),
  k AS (SELECT *, q_context IS NOT NULL AS hc FROM (SELECT z.*, cs AS q_context FROM z))
  SELECT query_member, candidate_member, CAST(round(size, 3) AS DOUBLE) AS size_score, round((0.25 * coalesce(ps, 0) + coalesce(0.25 * ts, 0) + 0.25 * fs + CASE WHEN cx THEN 0.25 * cs ELSE 0 END) / (CASE WHEN ps IS NULL THEN 0 ELSE 0.25 END + CASE WHEN ts IS NULL THEN 0 ELSE 0.25 END + 0.25 + CASE WHEN cx THEN 0.25 ELSE 0 END) * size, 6) AS score
  FROM (SELECT k.*, c1.context IS NOT NULL AND c2.context IS NOT NULL AS cx FROM k JOIN c c1 ON c1.id = query_member JOIN c c2 ON c2.id = candidate_member)"""),
    "r13_bundle_score": over("gvec", _FIRST + "SELECT g.group_vector_id, round(1 / (1 + list_distance(g.feature_centroid, q.feature_centroid)) / (1 + 0.15 * abs(g.member_count - q.member_count)), 6) AS score FROM gvec g, q"),
    "r14_stub_score": over("stub", _STUBV + ", sx AS (SELECT * FROM sw WHERE len(ud) = 3), q AS (SELECT * FROM sx ORDER BY pattern_id LIMIT 1) SELECT s.pattern_id, round(0.7 / (1 + list_distance(s.vec, q.vec)) + 0.3 * greatest(-1, least(1, list_cosine_similarity(s.ud, q.ud))), 6) AS score FROM sx s, q"),
    "r17_offline_score": over("gvec gctx", """WITH q AS (SELECT * FROM gctx ORDER BY group_vector_id LIMIT 1),
  b AS (SELECT g.group_vector_id, 0.5 * greatest(0, 1 - sqrt(power((q.end_centroid_x - q.start_centroid_x) - (g.end_centroid_x - g.start_centroid_x), 2) + power((q.end_centroid_y - q.start_centroid_y) - (g.end_centroid_y - g.start_centroid_y), 2) + power((q.end_centroid_z - q.start_centroid_z) - (g.end_centroid_z - g.start_centroid_z), 2)) / 50000) + 0.2 * list_cosine_similarity(g.feature_centroid, q.feature_centroid) AS base,
    greatest(0, list_cosine_similarity(x.context_centroid, q.context_centroid)) AS cs, x.context_centroid IS NOT NULL AS cx FROM gvec g CROSS JOIN q LEFT JOIN gctx x ON x.group_vector_id = g.group_vector_id)
  SELECT group_vector_id, round(base, 6) AS base, round(CASE WHEN cx THEN 0.9 * base + 0.1 * cs ELSE base END, 6) AS blended FROM b"""),
    "a03_centroid": over("gvec", """WITH e AS (SELECT utility, unnest(feature_centroid) AS v, generate_subscripts(feature_centroid, 1) AS i FROM gvec), m AS (SELECT utility, i, avg(v) AS m FROM e GROUP BY 1, 2),
  n AS (SELECT utility, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT m.utility, 30 AS dims, round(max(m / n) FILTER (i = 1), 6) AS c0, round(max(m / n) FILTER (i = 8), 6) AS c7, round(max(m / n) FILTER (i = 30), 6) AS c29 FROM m JOIN n ON m.utility = n.utility GROUP BY m.utility"""),
    "a04_mean_vector": over("stub", _STUBV + " SELECT stub_kind, face, round(avg(vec[1]), 6) AS m0, round(avg(vec[19]), 6) AS m18, round(avg(vec[22]), 6) AS m21, round(avg(vec[24]), 6) AS m23 FROM sw GROUP BY 1, 2"),
    "a28_vector_dims": over("grp", "SELECT CAST(len(feature_centroid) AS INT) AS dims, CAST(len(context_centroid) AS INT) AS context_dims, count(*) AS n FROM grp GROUP BY 1, 2"),
    "f22_vector_math": over("gctx", "SELECT group_vector_id, round(list_cosine_similarity(feature_centroid, context_centroid), 6) AS cosine, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(feature_centroid, context_centroid))), 6) AS l2, round(sqrt(list_dot_product(feature_centroid, feature_centroid)), 6) AS norm FROM gctx"),
    "f03_sizes": "WITH s AS (SELECT DISTINCT pipe_size FROM tb_route_stub_pattern), t AS (SELECT pipe_size, " + _NORMAL.format("pipe_size") + " AS normal, " + _NUMBER.format("pipe_size") + r""" AS number, TRY_CAST(nullif(regexp_extract(trim(upper(pipe_size)), '^\d+(\.\d+)?'), '') AS DOUBLE) AS v FROM s)
  SELECT pipe_size, normal, number, round(CASE WHEN v < 36 THEN v * 25.4 ELSE v END, 4) AS diameter, TRY_CAST(nullif(regexp_extract(upper(pipe_size), '\d+(\.\d+)?'), '') AS DOUBLE) AS mm, CAST(""" + _STEP.format("number") + " AS INT) AS ladder FROM t",
    "r07_size_score": "WITH s AS (SELECT DISTINCT pipe_size AS a FROM tb_route_stub_pattern), t AS (SELECT a, " + _NORMAL.format("a") + " AS n, " + _NUMBER.format("a") + " AS m FROM s), u AS (SELECT *, " + _STEP.format("m") + """ AS i FROM t)
  SELECT a, true AS compatible, CAST(CASE WHEN n = '50A' THEN 1 WHEN i IS NULL THEN 0 WHEN i = 8 THEN 1 WHEN abs(i - 8) = 1 THEN 0.8 WHEN abs(i - 8) = 2 THEN 0.5 ELSE 0 END AS DOUBLE) AS score, n = '50A' AS exact_compatible, 1.0::DOUBLE AS ignored FROM u""",
    "l07_provenance": over("grp", "SELECT project_scope_key, count(DISTINCT (encoder_version, status)) AS n_provenance, count(DISTINCT encoder_version) = 1 AS consistent, count(*) FILTER (trim(encoder_version) = '') AS n_blank FROM grp GROUP BY 1"),
}
