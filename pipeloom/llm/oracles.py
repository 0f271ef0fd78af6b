"""DuckDB SQL for the queries that SQL can express."""

_BENDS = r"""
WITH b AS (SELECT pattern_id, updated_at, frequency_score, utility,
    rtrim(regexp_replace(upper(equipment_key), '\s+', '', 'g'), '-_') AS equipment_key FROM tb_route_bend_feature_pattern),
l AS (SELECT DISTINCT b.* FROM b JOIN (SELECT pattern_id, max(updated_at) AS m FROM b GROUP BY 1) x
  ON b.pattern_id = x.pattern_id AND b.updated_at = x.m),
r AS (SELECT *, row_number() OVER (PARTITION BY equipment_key, utility ORDER BY frequency_score DESC, pattern_id) AS position
  FROM l WHERE frequency_score >= 0 AND frequency_score <= 1 AND NOT isnan(frequency_score))
"""
_SEQUENCES = r"""
WITH t AS (SELECT DISTINCT 'dir_seq' AS f, pattern_id AS id,
    CASE WHEN dir_seq LIKE '[%' THEN list_transform(TRY_CAST(TRY_CAST(dir_seq AS JSON) AS VARCHAR[]), lambda x: x)
      ELSE regexp_split_to_array(dir_seq, '[,|>;\s]+') END AS ts, 0.035 AS s FROM tb_route_stub_pattern
  UNION ALL
  SELECT DISTINCT 'direction_pattern', nullif(regexp_replace(lower(route_path_guid), '[\s{}-]', '', 'g'), ''),
    regexp_extract_all(upper(direction_pattern), '[RHD]'), 0.10 FROM tb_route_utility_group_member),
q AS (SELECT row_number() OVER () AS q, f, id, s, list_filter(list_transform(ts, lambda x: trim(lower(translate(x, '＋–−', '+--')))), lambda x: x <> '') AS ts
  FROM t WHERE id IS NOT NULL AND ts IS NOT NULL),
e0 AS (SELECT q, f, id, s, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM q),
e1 AS (SELECT q, f, id, s, i, CASE WHEN f = 'direction_pattern' THEN upper(w)
    WHEN regexp_matches(w, '^[+-][xyz]$') THEN w WHEN regexp_matches(w, '^[xyz][+-]$') THEN reverse(w) END AS a FROM e0),
e2 AS (SELECT *, lag(a) OVER (PARTITION BY q ORDER BY i) AS b FROM e1),
e AS (SELECT q, f, id, a, row_number() OVER (PARTITION BY q ORDER BY i) AS i FROM e2 WHERE a IS NULL OR a IS DISTINCT FROM b),
n AS (SELECT f, s, count(DISTINCT id) AS n FROM e1 GROUP BY f, s),
p1 AS (SELECT DISTINCT q, f, id, a AS p, i FROM e WHERE a IS NOT NULL),
p2 AS (SELECT DISTINCT p1.q, p1.f, p1.id, p || '>' || a AS p, e.i FROM p1 JOIN e ON p1.q = e.q AND e.i IN (p1.i + 1, p1.i + 2) WHERE a IS NOT NULL),
p3 AS (SELECT DISTINCT p2.q, p2.f, p2.id, p || '>' || a AS p, e.i FROM p2 JOIN e ON p2.q = e.q AND e.i IN (p2.i + 1, p2.i + 2) WHERE a IS NOT NULL),
p4 AS (SELECT DISTINCT p3.q, p3.f, p3.id, p || '>' || a AS p, e.i FROM p3 JOIN e ON p3.q = e.q AND e.i IN (p3.i + 1, p3.i + 2) WHERE a IS NOT NULL),
p5 AS (SELECT DISTINCT p4.q, p4.f, p4.id, p || '>' || a AS p, e.i FROM p4 JOIN e ON p4.q = e.q AND e.i IN (p4.i + 1, p4.i + 2) WHERE a IS NOT NULL),
p6 AS (SELECT DISTINCT p5.q, p5.f, p5.id, p || '>' || a AS p, e.i FROM p5 JOIN e ON p5.q = e.q AND e.i IN (p5.i + 1, p5.i + 2) WHERE a IS NOT NULL),
c AS (SELECT f, p, count(DISTINCT id) AS support FROM (FROM p3 UNION ALL FROM p4 UNION ALL FROM p5 UNION ALL FROM p6) GROUP BY f, p),
r AS (SELECT c.f AS seq_field, p AS step_pattern, support, support / CAST(n AS DOUBLE) AS share FROM c JOIN n ON c.f = n.f WHERE support >= s * n)
"""
_VECTORS = r"""
WITH v AS (
  SELECT 'feature_centroid' AS f, group_vector_id AS id, feature_centroid AS v, 30 AS d, 0.985 AS s FROM tb_route_utility_group_vector
  UNION ALL SELECT 'context_centroid', group_vector_id, context_centroid, 30, 0.985 FROM tb_route_utility_group_vector
  UNION ALL SELECT 'feat_json', pattern_id, TRY_CAST(feat_json AS DOUBLE[]), 24, 0.99999 FROM tb_route_stub_pattern),
u AS (SELECT f, id, s, min(v) AS v FROM v WHERE len(v) = d AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY f, id, s),
p AS (SELECT a.f, a.s, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.f = b.f AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY f, a ORDER BY round(c, 9) DESC, b) AS n FROM p WHERE c >= s - 1e-9),
k AS (SELECT * FROM r WHERE n <= 5)
"""
_RUNS = r"""
WITH d0 AS (SELECT pattern_id, any_value(CASE WHEN dir_seq LIKE '[%' THEN TRY_CAST(TRY_CAST(dir_seq AS JSON) AS VARCHAR[])
    ELSE regexp_split_to_array(dir_seq, '[,|>;\s]+') END) AS ts FROM tb_route_stub_pattern GROUP BY 1),
d1 AS (SELECT pattern_id, list_filter(list_transform(ts, lambda x: trim(lower(translate(x, '＋–−', '+--')))), lambda x: x <> '') AS ts FROM d0 WHERE ts IS NOT NULL),
d2 AS (SELECT pattern_id, unnest(ts) AS w, generate_subscripts(ts, 1) - 1 AS i FROM d1),
d3 AS (SELECT pattern_id, 'dir_seq' AS seq_field, i, NULL::DOUBLE AS mm, CASE WHEN regexp_matches(w, '^[+-][xyz]$') THEN w WHEN regexp_matches(w, '^[xyz][+-]$') THEN reverse(w) END AS a FROM d2),
s0 AS (SELECT pattern_id, any_value(TRY_CAST(stub_points AS JSON)) AS j FROM tb_route_stub_pattern GROUP BY 1),
s1 AS (SELECT pattern_id, CAST(j AS JSON[]) AS ps FROM s0 WHERE json_type(j) = 'ARRAY'),
s2 AS (SELECT pattern_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM s1),
s3 AS (SELECT pattern_id, i, CASE json_type(p)
    WHEN 'ARRAY' THEN [CAST(p->>'$[0]' AS DOUBLE), CAST(p->>'$[1]' AS DOUBLE), CAST(p->>'$[2]' AS DOUBLE)]
    WHEN 'OBJECT' THEN [CAST(coalesce(p->>'x', p->>'X') AS DOUBLE), CAST(coalesce(p->>'y', p->>'Y') AS DOUBLE), CAST(coalesce(p->>'z', p->>'Z') AS DOUBLE)]
    ELSE CAST(regexp_split_to_array(trim(p->>'$'), '[;,\s]+') AS DOUBLE[]) END AS c FROM s2),
s4 AS (SELECT pattern_id, i, lead(c) OVER w AS n, c FROM s3 WINDOW w AS (PARTITION BY pattern_id ORDER BY i)),
s5 AS (SELECT pattern_id, i, n[1] - c[1] AS dx, n[2] - c[2] AS dy, n[3] - c[3] AS dz FROM s4 WHERE n IS NOT NULL),
s6 AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS mm FROM s5),
s7 AS (SELECT pattern_id, i, mm, CASE WHEN mm < 1 THEN NULL WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN CASE WHEN dx >= 0 THEN '+x' ELSE '-x' END
    WHEN abs(dy) >= abs(dz) THEN CASE WHEN dy >= 0 THEN '+y' ELSE '-y' END ELSE CASE WHEN dz >= 0 THEN '+z' ELSE '-z' END END AS a FROM s6),
s8 AS (SELECT pattern_id, 'stub_points' AS seq_field, i, mm, coalesce(
    last_value(a IGNORE NULLS) OVER (PARTITION BY pattern_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(a IGNORE NULLS) OVER (PARTITION BY pattern_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'none') AS a FROM s7),
e AS (SELECT pattern_id, seq_field, i, mm, a FROM d3 UNION ALL SELECT pattern_id, seq_field, i, mm, a FROM s8),
f AS (SELECT *, CASE WHEN a IS NOT NULL AND a = lag(a) OVER (PARTITION BY pattern_id, seq_field ORDER BY i) THEN 0 ELSE 1 END AS b FROM e),
g AS (SELECT *, sum(b) OVER (PARTITION BY pattern_id, seq_field ORDER BY i) - 1 AS r FROM f),
h AS (SELECT pattern_id, seq_field, CAST(r AS INT) AS run_no, any_value(a) AS axis, CAST(min(i) AS INT) AS first_pos, CAST(max(i) AS INT) AS last_pos,
  CAST(count(*) AS INT) AS n_events, sum(mm) AS duration_mm FROM g GROUP BY pattern_id, seq_field, r)
"""
SQL = {
    "p1_found": _RUNS + "SELECT pattern_id, seq_field, first_pos, last_pos FROM h WHERE n_events >= 2",
    "p1_runs": _RUNS + "SELECT pattern_id, seq_field, run_no, axis, first_pos, last_pos, n_events, round(duration_mm, 4) AS duration_mm FROM h",
    "p3_found": _VECTORS + "SELECT x.f AS vec_field, x.a AS id_a, x.b AS id_b FROM k x JOIN k y ON x.f = y.f AND x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= x.s",
    "p4_found": _SEQUENCES + "SELECT seq_field, step_pattern FROM r",
    "p4_patterns": _SEQUENCES + "SELECT seq_field, step_pattern, support, share FROM r",
    "p2_found": _BENDS + "SELECT equipment_key, utility, pattern_id FROM r WHERE position <= 5",
    "p2_top20": _BENDS + "SELECT pattern_id, frequency_score, utility, equipment_key, CAST(position AS INT) AS position FROM r WHERE position <= 20",
}
