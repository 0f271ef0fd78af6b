"""DuckDB forms of the domain relations, as common table expressions."""

from __future__ import annotations

GUID = "regexp_replace(regexp_replace(lower({}), '[\\s{{}}-]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
EQUIPMENT = "rtrim(regexp_replace(upper({}), '\\s+', '', 'g'), '-_')"


def guid(c: str) -> str:
    return "nullif(" + GUID.format(c) + ", '')"


ROUTE = {n: f"coalesce(trim({c}), '')" for n, c in (("process", "process_name"), ("equipment_name", "equipment_name"), ("utility_group", "utility_group"), ("utility", "source_utility"), ("size", "source_size"), ("owner", "target_owner_name"), ("bay", "bay"))}
ROUTE |= {"equipment_key": EQUIPMENT.format("equipment_tag"), "project": "project_scope_key", "revision": "model_revision_key"}
ROUTE |= {c: c for c in ("source_posx", "source_posy", "source_posz", "target_posx", "target_posy", "target_posz", "total_length", "bend_count", "deleted_at")}
VIEWS = {
    "route": f"SELECT {guid('route_path_guid')} AS guid, max(loaded_at) AS loaded_at, " + ", ".join(f"first({e} ORDER BY loaded_at DESC, {e} DESC NULLS LAST) AS {n}" for n, e in ROUTE.items()) + f" FROM tb_route_path WHERE {guid('route_path_guid')} IS NOT NULL GROUP BY 1",
    "stub": "SELECT DISTINCT * FROM tb_route_stub_pattern",
    "v0": "SELECT pattern_id, max(stub_points) AS t FROM tb_route_stub_pattern GROUP BY 1",
    "v1": "SELECT pattern_id, CAST(TRY_CAST(t AS JSON) AS JSON[]) AS ps FROM v0 WHERE json_type(TRY_CAST(t AS JSON)) = 'ARRAY'",
    "v2": "SELECT pattern_id AS guid, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM v1 WHERE len(ps) >= 2",
    "v3": """SELECT guid, i, CASE json_type(p)
    WHEN 'ARRAY' THEN [CAST(p->>'$[0]' AS DOUBLE), CAST(p->>'$[1]' AS DOUBLE), CAST(p->>'$[2]' AS DOUBLE)]
    WHEN 'OBJECT' THEN [CAST(coalesce(p->>'x', p->>'X') AS DOUBLE), CAST(coalesce(p->>'y', p->>'Y') AS DOUBLE), CAST(coalesce(p->>'z', p->>'Z') AS DOUBLE)]
    ELSE CAST(regexp_split_to_array(trim(p->>'$'), '[;,\\s]+') AS DOUBLE[]) END AS c FROM v2""",
    "vertex": "SELECT guid, i, c[1] AS x, c[2] AS y, c[3] AS z FROM v3",
    "leg": """SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len,
    CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN CASE WHEN dx >= 0 THEN 0 ELSE 1 END WHEN abs(dy) >= abs(dz) THEN CASE WHEN dy >= 0 THEN 2 ELSE 3 END ELSE CASE WHEN dz >= 0 THEN 4 ELSE 5 END END AS axis
    FROM (SELECT guid, i, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM vertex WINDOW w AS (PARTITION BY guid ORDER BY i)) WHERE nx IS NOT NULL""",
    "grp": "SELECT DISTINCT * FROM tb_route_utility_group_vector",
    "gvec": "SELECT * FROM grp WHERE len(feature_centroid) = 30 AND len(list_filter(feature_centroid, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(feature_centroid, lambda x: x <> 0)) > 0",
    "gctx": "SELECT * FROM gvec WHERE len(context_centroid) = 30 AND len(list_filter(context_centroid, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(context_centroid, lambda x: x <> 0)) > 0",
    "member": f"SELECT DISTINCT * EXCLUDE (route_path_guid), {guid('route_path_guid')} AS guid FROM tb_route_utility_group_member WHERE {guid('route_path_guid')} IS NOT NULL",
    "obstacle": """SELECT id, kind, x AS minx, y AS miny, z AS minz, x + s * 10 + 100 AS maxx, y + CASE WHEN kind = 'COLUMN' THEN s * 10 + 100 ELSE s * 60 + 500 END AS maxy, z + CASE WHEN kind = 'COLUMN' THEN 6000 ELSE 400 END AS maxz
    FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS s, CASE WHEN p_partkey % 2 = 0 THEN 'COLUMN' ELSE 'BEAM' END AS kind, CAST(p_partkey * 7919 % 90000 AS DOUBLE) AS x, CAST(p_partkey * 104729 % 60000 AS DOUBLE) AS y, CAST(8000 + p_partkey * 31 % 9000 AS DOUBLE) AS z FROM part)""",
    "ablog": """SELECT CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m') AS request_key, strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN event_id % 2 = 0 THEN 'CONTEXT' ELSE 'BASELINE' END AS arm, ts AS created_at, event_id,
    event_type <> 'error' AS success, value AS length_mm, CAST(event_id % 7 AS INT) AS bends, event_type AS reason FROM events""",
}
NEEDS = {"v1": ["v0"], "v2": ["v1"], "v3": ["v2"], "vertex": ["v3"], "leg": ["vertex"], "gvec": ["grp"], "gctx": ["gvec"]}


def over(names: str, body: str) -> str:
    """``body`` with the named relations (and what they need) as common table expressions before it."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
