"""Golden values, invariants and edge cases of the core operators."""

from __future__ import annotations

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeloom.functions import geometry as G
from pipeloom.functions import pattern as PT
from pipeloom.functions import sizes as S
from pipeloom.functions import text as X
from pipeloom.functions import vector as V
from pipeloom.operators import aggregate as A
from pipeloom.operators import references as R
from pipeloom.operators import routing as RT
from pipeloom.operators import search
from pipeloom.operators import sequential as Q
from pipeloom.operators import spatial as SP
from pipeloom.operators import tables as K
from pipeloom.plans import registry
from pipeloom.sources import adapter

plans = registry.queries()


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# ---- text, sizes, patterns, vectors


def test_keys(spark):
    r = one(spark, X.norm_guid(F.lit(" {ABCDEF00-1111-2222-3333-444455556666} ")), X.norm_guid(F.lit("abcdef00111122223333444455556666")), X.norm_guid(F.lit("  ")), X.norm_guid(F.lit(None).cast("string")), X.norm_equipment_key(F.lit(" Cvd-K07 -hx0311_- ")))
    assert tuple(r) == ("abcdef00-1111-2222-3333-444455556666",) * 2 + (None, None, "CVD-K07-HX0311")


def test_sizes(spark):
    r = one(spark, S.normalize_size(F.lit("0050 A")), S.normalize_size(F.lit(" ")), S.size_to_diameter(F.lit("1/2B")), S.size_to_diameter(F.lit("1 1/2B")), S.pipe_size_mm(F.lit("1-1/2B")), S.pipe_size_mm(F.lit("50A")), S.ladder_index(F.lit("52A")), S.size_score(F.lit("50A"), F.lit("65A"))[1], S.size_score(F.lit("50A"), F.lit("x"))[1])
    assert tuple(r) == ("50A", "UNKNOWN", 12.7, pytest.approx(38.1), pytest.approx(38.1), 50.0, 8, 0.8, 0.0)


def test_patterns_and_vectors(spark):
    r = one(spark, PT.compressed(F.lit("r-R–h > H-d")), PT.structural_similarity(F.lit("RHD"), F.lit("RHH")), PT.structural_similarity(F.lit(""), F.lit("R")), V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))), V.norm(V.query_vector(*[F.lit(float(i)) for i in (0, 0, 0, 3, 4, 12)])))
    assert tuple(r) == ("RHD", pytest.approx(2 / 3), 0.0, 0.0, pytest.approx(1.0))


def test_centroid_has_length_one(spark):
    df = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0])], "k string, v array<double>")
    assert V.centroid(df, ["k"], "v").first()["centroid"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_weights_are_checked():
    with pytest.raises(ValueError):
        search.hybrid_score(*[F.lit(1.0)] * 4, weights=(0, 0, 0, 0))
    assert (search.route_fetch(5), search.group_fetch(5), search.group_fetch(100), search.bundle_fetch(5)) == (150, 100, 1000, 50)


# ---- references


def test_references_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rng.randrange(60))
    parents = [(rng.choice("abcdef"), day(), rng.choice([None, day()])) for _ in range(25)] + [("n", None, None)]
    refs = [(rng.choice(["a"] * 6 + list("bcdefxyn") + [None]), rng.choice([None, *[day()] * 8]), k) for k in range(600)]
    out = R.orphan_references(
        spark.createDataFrame(refs, "k string, t timestamp, ref_guid2 int"), spark.createDataFrame(parents, "k string, a timestamp, b timestamp"),
        ref_key=F.col("k"), ref_time=F.col("t"), parent_key=F.col("k"), valid_from=F.col("a"), valid_to=F.col("b"), salts=3, hot_share=0.05,
    )
    got = {r.ref_guid2: r.orphan_kind for r in out.collect()}

    def judge(k, t):
        mine = [(a, b) for p, a, b in parents if p == k]
        if not mine:
            return "missing"
        if t is None or any(a is not None and a <= t and (b is None or b > t) for a, b in mine):
            return None
        return "deleted" if any(a is not None and a <= t for a, _ in mine) else "late"

    assert got == {i: judge(k, t) for k, t, i in refs if k is not None}


def test_references_to_empty_tables(spark):
    none = spark.createDataFrame([], "k string, a timestamp, b timestamp")
    some = spark.createDataFrame([("q", datetime(2024, 1, 1), None)], "k string, a timestamp, b timestamp")
    how = dict(ref_key=F.col("k"), ref_time=F.col("a"), parent_key=F.col("k"), valid_from=F.col("a"), valid_to=F.col("b"))
    assert R.orphan_references(none, some, **how).count() == 0
    assert R.orphan_references(some, none, **how).first()["orphan_kind"] == "missing"


def test_references_with_clashing_columns(spark):
    refs = spark.createDataFrame([("q", datetime(2024, 1, 1), "x", 1, 2)], "k string, a timestamp, orphan_kind string, _row int, _key int")
    parents = spark.createDataFrame([], "k string, a timestamp, b timestamp")
    how = dict(ref_key=F.col("k"), ref_time=F.col("a"), parent_key=F.col("k"), valid_from=F.col("a"), valid_to=F.col("b"))
    r = R.orphan_references(refs, parents, **how).first()
    assert (r["orphan_kind"], r["_row"], r["_key"], r["ref_guid"]) == ("missing", 1, 2, "q")


# ---- geometry


def test_points_of_every_spelling(spark):
    texts = ["[[1,2,3],[4.5,-6,7e1]]", '[["1","2","3"],["4","5","6"]]', '[{"x":1,"y":2,"z":3},{"Z":"6","X":"4","Y":"5"}]', '["1; 2; 3","4,5,6"]', "[[1,2,3],[4,5", "null", "", None, "[[1,2],[3,4,5]]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", adapter.parse_points(F.col("t")).alias("p"))
    got = {r.i: r.p and [tuple(q) for q in r.p] for r in df.collect()}
    assert got[0] == [(1, 2, 3), (4.5, -6, 70)] and got[1] == got[2] == got[3] == [(1, 2, 3), (4, 5, 6)]
    assert all(not got[i] for i in range(4, 9))


def test_polyline_functions(spark):
    pts = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", p)]) for p in [(0, 0, 0), (0, 0, 1000), (1000, 0, 1000), (1000, 0, 1000), (1000, 500, 1000)]])
    ls = G.legs(pts)
    r = one(spark, G.direction_pattern(ls), G.arrow_code(ls), G.ortho_bends(G.runs(ls)), F.size(G.without_repeats(pts)), G.total_length(ls), G.at_distance(ls, F.lit(1500.0)), F.size(G.cut_at(pts, 1500.0)), G.vertical_switches(G.runs(ls)))
    assert tuple(r)[:5] == ("R-H", "VH", 2, 4, 2500.0) and tuple(r.c5) == (500.0, 0.0, 1000.0) and r.c6 == 3 and r.c7 == 1


def test_box_and_slab(spark):
    box = {"minx": F.lit(0.0), "miny": F.lit(0.0), "minz": F.lit(0.0), "maxx": F.lit(10.0), "maxy": F.lit(10.0), "maxz": F.lit(10.0)}
    p = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("xyz", v)])
    r = one(spark, G.box_distance(p(13, 14, 5), box), G.box_distance(p(5, 5, 5), box), G.hits_box(p(-5, 5, 5), p(15, 5, 5), box), G.hits_box(p(-5, 11, 5), p(15, 11, 5), box), G.hits_box(p(-5, 11, 5), p(15, 11, 5), box, 2.0), G.nearest_face(p(9, 5, 5), box))
    assert tuple(r) == (5.0, 0.0, True, False, True, 0)


# ---- spatial


def test_chord_cells():
    assert SP.line_cells(-100, -100, 2100, 2100) == [(-1, -1), (0, 0), (1, 1), (2, 2)]
    assert SP.line_cells(2500, 100, -500, 100) == [(2, 0), (1, 0), (0, 0), (-1, 0)]
    assert len(SP.line_cells(0, 0, 1e6, 3e5)) == 200


def test_radius_join_finds_long_boxes_by_their_surface(spark):
    rng = random.Random(1)
    boxes = [(i, rng.choice(["COLUMN", "BEAM"]), *[v for v in (rng.uniform(-9000, 9000) for _ in range(3))]) for i in range(60)]
    boxes = [(i, k, x, y, z, x + rng.choice([10, 500, 40_000]), y + rng.choice([10, 900]), z + rng.choice([10, 30_000])) for i, k, x, y, z in boxes]
    points = [(j, *[rng.uniform(-12_000, 30_000) for _ in range(3)]) for j in range(80)]
    b = spark.createDataFrame(boxes, "id int, kind string, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    p = spark.createDataFrame([*points, (999, None, 0.0, 0.0)], "pid int, x double, y double, z double")
    got = [(r.pid, r.box_id) for r in SP.radius_join(p, b, 1500.0).collect()]
    far = lambda q, x: math.dist(q, [min(max(v, lo), hi) for v, lo, hi in zip(q, x[2:5], x[5:])])
    want = {(q[0], x[0]) for q in points for x in boxes if far(q[1:], x) <= 1500}
    assert set(got) == want and len(got) == len(want)


def test_empty_surroundings(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0, 0.0)], "id string, x double, y double, z double")
    none = spark.createDataFrame([], "id int, kind string, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    v = SP.endpoint_vectors(p, none).first()["v"]
    assert len(v) == 13 and v[12] == 1.0 and sum(map(abs, v)) == 1.0  # twice of it, scaled: 1 / sqrt 2 at 12 and 25


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    got = {r.node: r.component for r in SP.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    root: dict[str, str] = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


# ---- aggregation and tables


def test_majority_and_peaks(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("k", None)], "k string, v string")
    assert tuple(A.majority(df, ["k"], "v").first()) == ("k", "a", 2, 0.5)
    bins = spark.createDataFrame([("k", 0.0, 5.0), ("k", 200.0, 9.0), ("k", 500.0, 1.0), ("k", 900.0, 7.0)], "k string, at double, w double")
    assert A.suppressed_peaks(bins, ["k"], "at", "w", 300.0, 5).first()["levels"] == [200.0, 500.0, 900.0]


def test_round_robin_and_even(spark):
    df = spark.createDataFrame([("p", "a", i) for i in range(3)] + [("p", "b", 9)] + [("q", "a", 7)], "o string, i string, x int")
    assert [(r.o, r.i) for r in A.round_robin(df, "o", ["i"], "x", 4).orderBy("pick").collect()] == [("p", "a"), ("q", "a"), ("p", "b"), ("p", "a")]
    assert sorted(r.id for r in A.evenly(spark.range(10), "id", 4).collect()) == [0, 2, 5, 7]


def test_upsert_and_refresh(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, K.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    stored = spark.createDataFrame([("a", "1", "READY"), ("b", "1", "READY"), ("c", "1", "STALE"), ("z", "1", "READY")], "k string, h string, status string")
    computed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("n", "1")], "k string, h string")
    assert dict(map(tuple, K.refresh_plan(computed, stored, "k", "h").collect())) == {"a": "SAME", "b": "CHANGED", "c": "CHANGED", "n": "NEW", "z": "STALE"}
    for mode in ("overwrite", "append"):
        K.write_table(old, str(tmp_path / "t"), mode)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


# ---- sequences of one entity


def test_elbow_is_restored():
    straight = [((0, 0, 0), (900, 0, 0), "PIPE"), ((900, 0, 0), (1000, 100, 0), "ELBOW"), ((1000, 100, 0), (1000, 1000, 0), "PIPE")]
    assert [p for p, _ in Q.restored(straight)] == [(0, 0, 0), pytest.approx((1000, 0, 0)), (1000, 1000, 0)]
    parallel = [((0, 0, 0), (900, 0, 0), "PIPE"), ((900, 0, 0), (950, 0, 0), "ELBOW"), ((950, 0, 0), (2000, 0, 0), "PIPE")]
    assert [r for _, r in Q.restored(parallel)] == [False] * 4
    assert Q.restored([]) == []


def test_segmentation():
    down = [(0, 0, 15000), (0, 0, 14000), (0, 0, 13500), (3000, 0, 13500), (3000, 2000, 13500), (3000, 2000, 12000)]
    assert Q.split_points(down) == (2, 4, 5)
    flat = [(0, 0, 0), (1000, 0, 0), (1000, 1000, 0), (1000, 1000, 0.5), (1000, 3000, 0.5)]
    assert Q.split_points(flat) == (1, 3, 2)  # the end stub may not begin before the start stub has ended


def test_simplify_and_runs():
    assert Q.simplified([(0, 0, 0), (500, 20, 0), (1000, 0, 0), (1000, 900, 0)], 150) == [(0, 0, 0), (1000, 0, 0), (1000, 900, 0)]
    assert Q.merged_runs([(5, 800), (3, 120), (5, 700)]) == [(5, 1620)]
    assert Q.merged_runs([(0, 100), (2, 900), (4, 50)]) == [(2, 1050)]
    assert Q.seed_clusters([(0, 0, 0), (5, 0, 0), (9, 0, 0), (50, 0, 0)], 6) == [[0, 1]]


def test_bend_match():
    a = [("START", "V_TO_H", "ZONE"), ("MID", "H_TO_H", "UNKNOWN")]
    assert Q.bend_match(a, a) == 1.0 and Q.bend_match(a, []) == 0.0
    assert Q.bend_match(a, [("START", "V_TO_H", "X"), ("MID", "H_TO_H", "UNKNOWN")]) == pytest.approx(0.8)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    assert Q.best_assignment(np.array([[0.2, 0.9], [0.8, 0.3]])) == [1, 0]
    for _ in range(150):
        n, m = (int(x) for x in rng.integers(1, 5, 2))
        s = np.round(rng.random((n, m)) * (rng.random((n, m)) > 0.3), 2)
        a = Q.best_assignment(s)
        best = max(sum(s[i, j] for i, j in enumerate(p) if j >= 0) for p in itertools.permutations([*range(m), *[-1] * n], n))
        assert sum(s[i, j] for i, j in enumerate(a) if j >= 0) == pytest.approx(best)
    total, coverage, _ = Q.group_score([1.0, 1.0], 2, 4, 1.0)
    assert coverage == pytest.approx(2 / 3) and total == pytest.approx(2 / 3)


def test_bundles():
    piece = lambda at, lo, hi: {"dir": "X", "lo": lo, "hi": hi, "at": at, "len": hi - lo}
    found = Q.bundles({"a": [piece(0, 0, 5000)], "b": [piece(300, 0, 4000)], "c": [piece(9000, 0, 4000)]})
    assert [b["members"] for b in found] == [["a", "b"]] and found[0]["pitch"] == 300.0


# ---- routing


def test_routes_are_free_and_orthogonal():
    wall = [(900.0, -3000.0, -3000.0, 1100.0, 3000.0, 3000.0)]
    for find in (lambda: RT.voxel_route((0, 0, 0), (3000, 0, 0), wall), lambda: RT.line_route((0.0, 0.0, 0.0), (3000.0, 0.0, 0.0), wall)):
        code, path, _ = find()
        assert code == "OK" and path[0] == (0, 0, 0) and path[-1] == (3000, 0, 0) and RT.free(path, wall)
        assert all(sum(abs(x - y) > 1e-9 for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))
    assert RT.voxel_route((1000, 0, 0), (3000, 0, 0), wall)[0] == "START_BLOCKED"
    assert RT.line_route((0, 0, 0), (1000, 0, 0), wall)[0] == "GOAL_BLOCKED"
    assert RT.voxel_route((0, 0, 0), (3000, 0, 0), [])[1] == [(0, 0, 0), (3000, 0, 0)]
    code, path, n = RT.voxel_route((0, 0, 0), (90_000, 0, 0), wall, RT.Options(max_nodes=20))
    assert code == "NODE_LIMIT" and n == 20 and path
    assert RT.bundle_route((0, 0, 0), (90_000, 0, 0), 100, wall, RT.Options(max_nodes=20))[:2] == ("NODE_LIMIT", [])
    assert RT.voxel_route((math.nan, 0, 0), (1, 0, 0), [])[0] == "BAD_REQUEST"


def test_voxel_search_is_shortest_without_turn_costs():
    from collections import deque

    rng = random.Random(2)
    for _ in range(15):
        boxes = [(x * 500.0 + 1, y * 500.0 + 1, -1e4, x * 500.0 + 499, y * 500.0 + 499, 1e4) for x in range(-3, 8) for y in range(-3, 8) if rng.random() < 0.25 and (x, y) not in ((-1, -1), (0, 0), (4, 4), (3, 3))]
        a, b = (250.0, 250.0, 0.0), (2250.0, 2250.0, 0.0)
        boxes = [x for x in boxes if not RT.inside(a, x) and not RT.inside(b, x)]
        code, path, _ = RT.voxel_route(a, b, boxes, RT.Options(turn=0.0, max_nodes=200_000, axis_cost=(0, 0, 0, 0, 1e6, 1e6)))
        seen, todo = {(0, 0): 0}, deque([(0, 0)])
        while todo:
            c = todo.popleft()
            for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                t = (c[0] + dx, c[1] + dy)
                p, q = ((250.0 + v[0] * 500, 250.0 + v[1] * 500, 0.0) for v in (c, t))
                if t not in seen and max(map(abs, t)) < 12 and not any(RT.crosses(p, q, x) for x in boxes):
                    seen[t] = seen[c] + 1
                    todo.append(t)
        if (4, 4) in seen:
            assert code == "OK" and RT.length(path) == pytest.approx(seen[(4, 4)] * 500)


def _routing_tasks(spark, *tasks):
    box = "struct<b_id:int,b_minx:double,b_miny:double,b_minz:double,b_maxx:double,b_maxy:double,b_maxz:double>"
    rows = [(i, *a, *b, [(k, *x) for k, x in enumerate(boxes)]) for i, a, b, boxes in tasks]
    return spark.createDataFrame(rows, f"id string, sx double, sy double, sz double, tx double, ty double, tz double, boxes array<{box}>")


def test_cell_searches_find_gaps_off_the_coarse_lattice(spark, monkeypatch):
    """Walls with one gap: on the lattice of 500 mm (wide enough for a bundle of 400), or only on that of 50 mm."""
    from pipeloom.plans import sequential as PS

    def wall(lo, hi):
        return [(900.0, -5e4, -5e4, 1100.0, lo, 5e4), (900.0, hi, -5e4, 1100.0, 5e4, 5e4)]

    a, b = (0.0, 0.0, 0.0), (2000.0, 0.0, 0.0)
    for name, boxes in (("x01_voxel_routes", wall(290.0, 710.0)), ("x02_waypoint_routes", wall(290.0, 710.0)), ("x03_bundle_routes", wall(290.0, 710.0)), ("x06_guided_routes", wall(110.0, 190.0))):
        b_ = (4000.0, 0.0, 0.0) if name.startswith("x02") else b  # its waypoint lies in the middle
        task = _routing_tasks(spark, ("r", a, b_, boxes))
        monkeypatch.setattr(PS, "tasks", lambda spark, root, *a, task=task: task)
        row = PS.Q[name](spark, "").collect()[0]
        assert row["code"] == "OK" and row["free"], name


def test_line_search_uses_every_line(spark, monkeypatch):
    """A wall whose ends are farther than 22 other sides: the way round it is on a line that a cut search leaves out."""
    from pipeloom.plans import sequential as PS

    wall = (900.0, -6000.0, -6000.0, 1100.0, 6000.0, 6000.0)
    small = [(300.0, 300.0 + 20 * k, 300.0 + 20 * k, 310.0, 310.0 + 20 * k, 310.0 + 20 * k) for k in range(40)]
    a, b = (0.0, 0.0, 0.0), (3000.0, 0.0, 0.0)
    code, path, _ = RT.line_route(a, b, [wall, *small], lines=None)
    assert code == "OK" and RT.length(path) == pytest.approx(3000 + 2 * 6101) and RT.free(path, [wall, *small], 100.0)
    task = _routing_tasks(spark, ("r", a, b, [wall, *small]))
    monkeypatch.setattr(PS, "tasks", lambda spark, root, *a: task)
    row = PS.x07(spark, "").collect()[0]
    assert row["code"] == "OK" and row["free"] and row["length_mm"] == pytest.approx(3000 + 2 * 6101)


def test_routes_leave_the_loaded_boxes_only_when_more_are_loaded(spark, monkeypatch):
    """A wall wider than the first region; round its ends stand boxes that a search with the first region's boxes does not know."""
    from pipeloom.plans import sequential as PS

    wall = (900.0, -1600.0, -1e5, 1100.0, 1600.0, 1e5)
    beyond = [(200.0, -2e4, -1e5, 1800.0, -1700.0, 1e5), (200.0, 1700.0, -1e5, 1800.0, 3100.0, 1e5)]
    floor = [(-3e4, -3e4, z, 3e4, 3e4, z + 100.0) for z in (-700.0, 600.0)]
    known = [wall, *beyond, *floor]
    names = [f"{e}{c}" for e in ("min", "max") for c in "xyz"]
    monkeypatch.setattr(PS.A, "obstacles", lambda spark, root: spark.createDataFrame([(k, *b) for k, b in enumerate(known)], "id bigint, " + ", ".join(f"{n} double" for n in names)))
    ends = spark.createDataFrame([("r", "N2", "B1", 0.0, 0.0, 0.0, 2000.0, 0.0, 0.0)], "guid string, utility string, bay string, " + ", ".join(f"{e}_pos{c} double" for e in ("source", "target") for c in "xyz"))
    monkeypatch.setattr(PS.A, "routes", lambda spark, root: ends)
    for name in ("x01_voxel_routes", "x03_bundle_routes", "x07_line_routes", "x09_rubber_band", "v05_sequential_routes"):
        row, = PS.Q[name](spark, "").collect()
        assert row["id"] == "r", name
        if name != "x09_rubber_band" or row["code"] == "OK":  # pushing may end at the boxes beyond, but not pass through them
            assert row["code"] == "OK" and row["free"] and row["length_mm"] >= 2000 + 2 * 3100, (name, row)


def test_searches_stay_inside_the_given_box():
    wall, a, b = [(900.0, -3000.0, -3000.0, 1100.0, 3000.0, 3000.0)], (0.0, 0.0, 0.0), (2000.0, 0.0, 0.0)
    for margin, code in ((1500.0, "NO_PATH"), (6000.0, "OK")):
        box = RT.region((a, b), margin)
        for got in (RT.voxel_route(a, b, wall, within=box), RT.bundle_route(a, b, 400.0, wall, within=box), RT.line_route(a, b, wall, lines=None, within=box)):
            assert got[0] == code and RT.within(got[1], box)


def test_line_steps_match_the_segment_test():
    rng = random.Random(4)
    for _ in range(10):
        boxes = []
        for _ in range(8):
            p = [rng.randrange(-2000, 3000) for _ in range(3)]
            boxes.append((*map(float, p), *[float(v + rng.randrange(10, 1500)) for v in p]))
        grid = [sorted({0.0, 777.0, *[b[i] - 101 for b in boxes], *[b[i + 3] + 101 for b in boxes]}) for i in range(3)]
        shut = RT._ShutSteps(grid, boxes, 100.0)
        for _ in range(300):
            c, axis = [rng.randrange(len(g)) for g in grid], rng.randrange(3)
            if c[axis] + 1 < len(grid[axis]):
                p = tuple(grid[i][c[i]] for i in range(3))
                q = tuple(grid[i][c[i] + (i == axis)] for i in range(3))
                assert shut.step(axis, *c) == any(RT.crosses(p, q, x, 100.0) for x in boxes)


def test_path_tidying():
    zig = [(0, 0, 0), (500, 0, 0), (500, 500, 0), (1000, 500, 0), (1000, 1000, 0)]
    assert RT.bends(RT.pulled(zig, [])) == 1
    assert RT.without_collinear([(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0)]) == [(0, 0, 0), (2, 0, 0)]
    path, left = RT.pushed([(0, 0, 0), (3000, 0, 0)], [(900.0, -200.0, -200.0, 1100.0, 200.0, 200.0)])
    assert left == 0 and path[0] == (0, 0, 0) and path[-1] == (3000, 0, 0)
    assert [p[0][1] for p in RT.offset_paths([(0, 0, 0), (1000, 0, 0)], 3, 100.0)] == [-100.0, 0.0, 100.0]
    arc = RT.rounded([(0, 0, 0), (1000, 0, 0), (1000, 1000, 0)], 200.0)
    assert len(arc) == 11 and RT.length(arc) < 2000


def test_bend_match_takes_every_hundredth_line(spark, monkeypatch):
    from pipeloom.plans import sequential as PS

    ids = [f"00000000-0000-0000-0000-{n:012x}" for n in (1, 100, 200, 250)]
    rows = [(g, i, "UPPER", t, False) for g, turns in zip(ids, ("ab", "ab", "b", "ba")) for i, t in enumerate(turns)]
    monkeypatch.setattr(PS.P, "w07", lambda spark, root: spark.createDataFrame(rows, "guid string, i int, zone string, transition string, sequence boolean"))
    got = {(r["query_id"], r["guid"]): r["match"] for r in PS.r08(spark, "").collect()}
    assert set(got) == {(q, g) for q in ids[1:3] for g in ids}
    assert got[ids[1], ids[0]] == 1.0 and got[ids[2], ids[2]] == 1.0 and got[ids[2], ids[1]] == 0.5


def test_turned_boxes():
    box, r = (0.0, 0.0, 0.0, 10.0, 10.0, 10.0), math.sqrt(0.5)
    turned = [(r, r, 0.0), (-r, r, 0.0), (0.0, 0.0, 1.0)]
    assert RT.turned_box_hits(box, (16.0, 5.0, 5.0), (5.0, 5.0, 1.0), turned)  # its corner reaches 7.07
    assert not RT.turned_box_hits(box, (16.0, 5.0, 5.0), (5.0, 5.0, 1.0), [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    assert not RT.turned_box_hits(box, (18.0, 5.0, 5.0), (5.0, 5.0, 1.0), turned)
    assert not RT.turned_box_hits(box, (15.0, 15.0, 5.0), (5.0, 5.0, 1.0), turned)
    assert RT.turned_box_hits(box, (5.0, 5.0, 5.0), (1.0, 1.0, 1.0), turned)


def test_connectors(spark, tmp_path):
    from pipeloom.sources import connectors as C

    df = spark.createDataFrame([("1", "2.5", "x"), ("a", "", None)], "i string, d string, t string")
    for fmt in ("csv", "json", "orc", "parquet"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert C.read(spark, str(tmp_path / fmt), fmt, "i string, d string, t string").count() == 2
    typed = C.typed(df, {"i": "INTEGER", "d": "REAL"})
    assert typed.dtypes == [("i", "bigint"), ("d", "double"), ("t", "string")]
    assert sorted(map(tuple, typed.collect()), key=repr) == [(1, 2.5, "x"), (None, None, None)]
    assert [C.spark_type(t) for t in ("VARCHAR(20)", "bigint", None, "NUMERIC(3,2)", "blob")] == ["string", "bigint", "string", "decimal(38,9)", "binary"]


def test_boxes_of_any_size_overlap(spark):
    """Small, large and enormous boxes on either side against every pair looked at."""
    rng = random.Random(12)

    def boxes(n):
        out = []
        for i in range(n):
            size = rng.choice([50, 300, 5_000, 200_000, 10_000_000])
            lo = [rng.uniform(-60_000, 60_000) for _ in range(3)]
            out.append((i, *lo, *[x + rng.uniform(0, size) for x in lo]))
        return [*out, (900, None, 0.0, 0.0, 1.0, 1.0, 1.0)]

    schema = "id int, minx double, miny double, minz double, maxx double, maxy double, maxz double"
    a, b = boxes(60), boxes(120)
    got = SP.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), grow=100.0).select("a_id", "b_id").collect()
    want = {(p[0], q[0]) for p in a[:-1] for q in b[:-1] if all(p[1 + c] - 100 <= q[4 + c] and q[1 + c] <= p[4 + c] + 100 for c in range(3))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    one = SP.overlap_join(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1e7, 1e7, 1e7)], schema), spark.createDataFrame(b, schema))
    assert one.count() == sum(all(q[1 + c] <= 1e7 and q[4 + c] >= 0 for c in range(3)) for q in b[:-1])
    assert SP.overlap_join(spark.createDataFrame([], schema), spark.createDataFrame(b, schema)).count() == 0


def test_points_meet_boxes_of_any_size(spark):
    rng = random.Random(4)
    points = [(i, *[rng.uniform(0, 50_000) for _ in range(3)]) for i in range(150)] + [(900, None, 1.0, 1.0)]
    boxes = []
    for i in range(80):
        lo = [rng.uniform(0, 50_000) for _ in range(3)]
        boxes.append((i, "B", *lo, *[x + rng.uniform(0, rng.choice([10, 2_000, 10_000_000])) for x in lo]))
    sides = ", ".join(f"{e}{c} double" for e in ("min", "max") for c in "xyz")
    got = SP.radius_join(spark.createDataFrame(points, "id int, x double, y double, z double"), spark.createDataFrame(boxes, f"id int, kind string, {sides}"), 1500.0).collect()
    want = {(p[0], b[0]) for p in points[:-1] for b in boxes if sum(max(b[2 + c] - p[1 + c], 0, p[1 + c] - b[5 + c]) ** 2 for c in range(3)) <= 1500.0**2}
    assert len(got) == len(want) and {(r.id, r.box_id) for r in got} == want


def test_components_of_chains_stars_and_single_edges(spark):
    edges = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(700)] + [("hub", f"s{i:03d}") for i in range(300)] + [("x", "y"), ("y", "x"), ("x", "x"), (None, "z")]
    got = {r.node: r.component for r in SP.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {f"c{i:04d}": "c0000" for i in range(701)} | {n: "hub" for n in ["hub", *[f"s{i:03d}" for i in range(300)]]} | {"x": "x", "y": "x"}
    assert got == want
    assert SP.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_block_search_meets_every_candidate(spark):
    rng = np.random.default_rng(3)
    data = [(f"i{i:03d}", "hot" if i % 3 else None if i % 2 else "b", [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(data, "id string, bucket string, vec array<double>")
    got = search.batch_top_k(df, df.where("id like '%7'"), 4, rows=30).collect()
    per = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        per.setdefault(r.query_id, []).append(r.id)
    for q, b, v in data:
        if q.endswith("7") and b:
            cos = lambda w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))  # noqa: B023, E731
            assert per.pop(q) == [x[1] for x in sorted((-round(cos(w), 12), i) for i, c, w in data if c == b and i != q)[:4]]
    assert not per


def test_no_row_mixes_two_versions(spark):
    rows = [("a", 2, "x", None), ("a", 1, "z", "z"), ("a", 2, "x", None), ("b", None, "q", "r")]
    df = spark.createDataFrame(rows, "k string, v int, p string, q string")
    assert sorted(map(tuple, adapter.newest(df, "k", version="v").select("k", "v", "p", "q").collect())) == [("a", 2, "x", None), ("b", None, "q", "r")]


def _steps(df) -> str:
    """The plan with what adaptive execution starts from."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_in_cells_are_not_broadcast(spark):
    """A box stands in many cells, which the estimate that decides on a broadcast doesn't know."""
    points = spark.range(50).selectExpr("id", "id * 100.0D as x", "0D as y", "0D as z")
    boxes = spark.range(50).selectExpr("id", "'B' as kind", *[f"id * 90.0D as {e}{c}" for e in ("min", "max") for c in "xyz"])
    for df in (SP.radius_join(points, boxes, 500.0), SP.overlap_join(boxes, boxes, grow=5.0)):
        assert "SortMergeJoin" in _steps(df) and "Broadcast" not in _steps(df)


def test_points_meet_boxes_of_their_own_key(spark):
    points = spark.createDataFrame([(i, "ab"[i % 2], i * 50.0, 0.0, -3e9) for i in range(40)], "id int, k string, x double, y double, z double")
    boxes = spark.createDataFrame([(i, "B", "abc"[i % 3], i * 60.0, 0.0, -3e9, i * 60.0 + 5, 1.0, -3e9 + 1) for i in range(40)], "id int, kind string, k string, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    got = [(r.id, r.box_id) for r in SP.radius_join(points, boxes, 100.0, on=["k"]).collect()]
    want = {(i, j) for i in range(40) for j in range(40) if "ab"[i % 2] == "abc"[j % 3] and max(j * 60 - i * 50, 0, i * 50 - j * 60 - 5) <= 100}
    assert len(got) == len(want) and set(got) == want


SF = "/root/testdata/sf0.001"


def _shuffled_after_join(df) -> bool:
    plan = _steps(df)
    return "Exchange" in plan[: plan.index("SortMergeJoin")] if "SortMergeJoin" in plan else True


def test_pairs_of_both_ends_are_not_merged(spark):
    """Every pair of a route and a box comes up once, so the pairs don't move."""
    df = plans["j08_nearest_merged"](spark, SF)
    assert not _shuffled_after_join(df)
    got = df.collect()
    assert len(got) == len({(r.id, r.box_id) for r in got})


def test_rounds_ask_again_only_what_may_be_nearer_outside(spark):
    """The nearest of points by widening rounds against all of them; most rows end with the first round."""
    rng = random.Random(9)
    asked = [(i, *[rng.uniform(0, 3000) for _ in range(3)]) for i in range(60)] + [(99, 90_000.0, 0.0, 0.0)]
    there = [(f"t{i:03d}", *[rng.uniform(0, 3000) for _ in range(3)]) for i in range(200)]
    a, t = spark.createDataFrame(asked, "id int, x double, y double, z double"), spark.createDataFrame(there, "line string, x double, y double, z double")
    counts = []

    def best(rows, radius):
        counts.append(rows.count())
        found = SP.radius_join(t, rows.select("id", F.lit("").alias("kind"), *[F.col(c).alias(m + c) for m in ("min", "max") for c in "xyz"]), radius)
        return found.groupBy(F.col("box_id").alias("id")).agg(F.min(F.struct("distance", "line")).alias("b")).select("id", "b", F.col("b.distance").alias("reach"))

    got = {r.id: r.b.line for r in SP.in_rounds(a, (400.0, 1500.0, 6000.0), best).collect()}
    assert got == {p[0]: min(there, key=lambda q: (math.dist(p[1:], q[1:]), q[0]))[0] for p in asked[:-1]}
    assert counts[0] == 61 and 1 <= counts[-1] < 30


def test_matches_are_sought_in_rounds(spark, monkeypatch):
    """The three searches for the best of many ask in rounds, so that not all pairs within their limits arise."""
    asked = []
    whole = SP.in_rounds
    monkeypatch.setattr(SP, "in_rounds", lambda rows, radii, best: asked.append(radii) or whole(rows, radii, best))
    for name, limit in (("j12_nearest_anchor", 5000.0), ("j14_route_matching", 3000.0), ("j14_both_ends", 6000.0)):
        asked.clear()
        plans[name](spark, SF).collect()
        assert asked and all(len(r) > 2 and r[-1] == limit for r in asked)


def test_relations_are_hashed_where_they_arise(spark):
    """What follows the join with the boxes at once is a hash aggregate, so a vertex's many relations are neither sorted nor moved."""
    plan = _steps(plans["g25_obstacle_relations"](spark, SF))
    steps = [x.strip(" :+-*()0123456789").split("(")[0].split()[0] for x in plan.splitlines() if any(n in x for n in ("HashAggregate", "SortAggregate", "SortMergeJoin"))]
    first = max(k for k, n in enumerate(steps) if n == "SortMergeJoin" and k and steps[k - 1].endswith("Aggregate"))
    assert steps[first - 1] == "HashAggregate"


def test_sides_are_told_where_the_pair_arises(spark):
    df = plans["g24_bypass_side"](spark, SF)
    assert "Broadcast" not in _steps(df) and not _shuffled_after_join(df)


def test_cell_searches_take_equal_costs_in_one_go(monkeypatch):
    """Ways of the least cost, as the search by single states finds them, without taking single states."""
    rng = random.Random(7)
    cases = []
    for _ in range(40):
        a = tuple(rng.uniform(0, 10_000) for _ in range(3))
        b = tuple(v + rng.uniform(-4000, 4000) for v in a)
        box = RT.region((a, b), 1500.0)
        boxes = [(*p, *[v + w for v, w in zip(p, rng.choice([(300, 300, 6000), (400, 1500, 400)]))]) for p in ([rng.uniform(box[i] - 500, box[i + 3]) for i in range(3)] for _ in range(60))]
        cases.append((a, b, boxes, box))
    monkeypatch.setattr(RT, "_finish", lambda path, goal: RT.without_collinear(path))
    slow = [RT.voxel_route(a, b, boxes, avoid=frozenset({(10**9, 0, 0)}), within=box) for a, b, boxes, box in cases]
    monkeypatch.setattr(RT.heapq, "heappush", None)
    cost = lambda path: round(RT.length(path) + 1000 * RT.bends(path), 3)
    for (a, b, boxes, box), (code, path, _) in zip(cases, slow):
        got = RT.voxel_route(a, b, boxes, within=box)
        assert got[0] == code and cost(got[1]) == cost(path) and RT.free(got[1], boxes) and RT.within(got[1], RT.region((a, b), 1500.0))
    assert sum(code == "OK" for code, _, _ in slow) > 10


def test_boxes_move_once_per_tile(spark):
    """Tasks of a tile share their boxes, each task still has all that its own grown box touches."""
    from pipeloom.plans import sequential as PS

    rows = PS.tasks(spark, SF, 1500.0).collect()
    assert sum(len(r.ts) for r in rows) == PS._ends(spark, SF).count()
    known = np.array([[r[s] for s in ("id", *PS._SIDES)] for r in adapter.obstacles(spark, SF).collect()], dtype=float)
    for r in rows:
        sides = PS._sides({"boxes": np.array([list(b) for b in r.boxes], dtype=float) if r.boxes else None})
        for t in r.ts:
            box = RT.region(PS._task(t), 1500.0)
            assert PS._touched(sides, box) == PS._touched(known[np.argsort(known[:, 0]), 1:], box)


def test_long_lists_come_as_matrices():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("id", pa.int64()), ("x", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([[{"id": 1, "x": 2.0}, {"id": 3, "x": 4.0}], None, []], kind)], ["k", "boxes"])
    seen = []
    run = Q.per_arrow_row(lambda row: seen.append(row) or [{"k": row["k"]}] * 2, pa.schema([("k", pa.string())]), rows=2)
    assert [x for b in run(iter([batch])) for x in b.column("k").to_pylist()] == list("aabbcc")
    assert isinstance(seen[0]["boxes"], np.ndarray) and seen[0]["boxes"].tolist() == [[1, 2], [3, 4]] and seen[1]["boxes"] is None and len(seen[2]["boxes"]) == 0


def test_equal_bend_sequences_are_compared_once(spark):
    """Matches of sequences are brought to the lines by a join; no pair of lines goes through Python."""
    plan = _steps(plans["r08_bend_match"](spark, SF))
    assert "SortMergeJoin" in plan and "InPandas" not in plan


def test_groups_are_prepared_once_and_compared_as_before(spark):
    """Groups meet in blocks, so each is worked out once a block; edit distances and arrangements are those of the plain forms."""
    from pipeloom.plans import sequential as PS

    assert [PS._edit(a, b) for a, b in (("", "RH"), ("RHD", ""), ("RHDR", "RHDR"), ("RHRH", "HRHR"), ("R" * 70, "H" * 65 + "R"))] == [2, 3, 0, 2, 69]
    rng = random.Random(3)
    member = lambda: {f"{e}_{c}": rng.uniform(0, 9000) for e in ("start", "end") for c in "xyz"} | {"length": rng.uniform(0, 9000), "steps": 3.0, "pattern": "RH", "size": "50A"}
    a, b = ([member() for _ in range(n)] for n in (3, 5))
    assert PS.Group(a).arrangement(PS.Group(b)) == pytest.approx(Q.arrangement_similarity(PS._figures(a), PS._figures(b)))
    for name in ("r11_group_score", "r12_group_top_k"):
        plan = _steps(plans[name](spark, SF))
        assert "FlatMapCoGroupsInPandas" in plan and "MapInPandas" not in plan


def test_many_pairs_of_groups_are_scored_at_once(monkeypatch):
    """Assignments and edit distances of many pairs are those of the single forms, ties included."""
    from pipeloom.plans import sequential as PS

    rng = random.Random(12)
    for n, m in ((1, 1), (2, 5), (5, 2), (4, 4), (7, 6)):
        scores = np.array([[[rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(m)] for _ in range(n)] for _ in range(60)])
        assert Q.best_assignments(scores).tolist() == [Q.best_assignment(s) for s in scores]
        wider = np.concatenate([scores, np.zeros((60, n, 3))], axis=2)  # columns that stand for nobody
        assert Q.best_assignments(wider).tolist() == [Q.best_assignment(s) for s in scores]
    words = ["", "R", "R" * 64, "R" * 65, *["".join(rng.choice("RHD") for _ in range(rng.randrange(1, 30))) for _ in range(40)]]
    assert PS._edits(words, words[::-1]).tolist() == [[PS._edit(a, b) for b in words[::-1]] for a in words]


def test_groups_meet_side_by_side(spark, monkeypatch):
    """Blocks of any size give the rows that pairs compared one by one give."""
    from pipeloom.plans import sequential as PS

    monkeypatch.setattr(PS, "hundredth", lambda c: F.lit(True))
    monkeypatch.setattr(PS, "NUMBERS", 50)
    monkeypatch.setattr(PS, "ASKED", 3)
    monkeypatch.setattr(PS, "WIDTHS", (3, 5))
    got = {(r.query_id, r.group_vector_id): tuple(r)[2:] for r in plans["r11_group_score"](spark, SF).collect()}
    rows = adapter.groups(spark, SF).select("group_vector_id", "utility").join(PS._members(spark, SF), "group_vector_id").collect()
    want = {}
    for q in rows:
        for c in rows:
            if q.utility == c.utility and q.group_vector_id != c.group_vector_id:
                score = np.zeros((len(q.ms), len(c.ms)))
                for i, x in enumerate(q.ms):
                    for j, y in enumerate(c.ms):
                        moves = [[m[f"end_{k}"] - m[f"start_{k}"] for k in "xyz"] for m in (x, y)]
                        parts = [max(0.0, 1 - math.dist(*moves) / 50_000), *([1 - PS._edit(x.pattern, y.pattern) / max(len(x.pattern), len(y.pattern))] if x.pattern and y.pattern else [])]
                        score[i, j] = sum(parts) / len(parts) * (1.0 if x["size"] == y["size"] else 0.5)
                arrangement = Q.arrangement_similarity(PS._figures(q.ms), PS._figures(c.ms))
                want[q.group_vector_id, c.group_vector_id] = *Q.group_score([score[i, j] for i, j in enumerate(Q.best_assignment(score)) if j >= 0], len(q.ms), len(c.ms), arrangement), arrangement
    assert len(want) > 10 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_group_search_takes_vectors_side_by_side(spark, monkeypatch):
    """Cosines of many groups in one product; the search gives the same rows with blocks of any size."""
    from pipeloom.plans import complete as PC
    from pipeloom.plans import sequential as PS

    rows = [{"v": v} for v in ([1.0, 0.0], [0.6, 0.8], [0.0, 0.0], [1.0, 2.0, 2.0], None)]
    got = PC._cosines(rows[:4], rows, "v", math.nan)
    assert got[1, :4] == pytest.approx([0.6, 1.0, 0.0, 0.0]) and got[3, 3] == pytest.approx(1.0) and np.isnan(got[:, 4]).all() and np.isnan(PC._cosines(rows[4:], rows, "v", math.nan)).all()
    monkeypatch.setattr(PS, "hundredth", lambda c: F.lit(True))
    whole = sorted(map(tuple, plans["r12_group_top_k"](spark, SF).collect()))
    monkeypatch.setattr(PS, "NUMBERS", 50)
    monkeypatch.setattr(PS, "ASKED", 2)
    assert len(whole) > 3 and whole == sorted(map(tuple, plans["r12_group_top_k"](spark, SF).collect()))


def test_path_similarities_of_many_lines_at_once(spark, monkeypatch):
    """No pair of lines is scored by itself; scores are those of the plain formula."""
    from pipeloom.plans import design as PD
    from pipeloom.plans import polyline as PP
    from pipeloom.plans import sequential as PS

    monkeypatch.setattr(PD, "hundredth", lambda c: F.lit(True))
    df = plans["r05_path_similarity"](spark, SF)
    assert "FlatMapCoGroupsInArrow" in _steps(df)
    got = {(r.q_guid, r.guid): r.similarity for r in df.collect()}
    d = PP.lines(spark, SF).join(adapter.stubs(spark, SF).select(F.col("pattern_id").alias("guid"), "utility_group"), "guid").where("utility_group is not null")
    box = G.extent(F.col("pts"))
    d = d.select("guid", "utility_group", G.arrow_code(F.col("legs")).alias("w"), G.unit_directions(G.resampled(F.col("legs"), 8)).alias("u"), G.total_length(F.col("legs")).alias("n"), F.array(*[box["max" + c] - box["min" + c] for c in "xyz"]).alias("e"))
    rows = d.collect()
    assert got.keys() == {(a.guid, b.guid) for a in rows for b in rows if a.utility_group == b.utility_group and a.guid != b.guid}
    by = {r.guid: r for r in rows}
    for q, c in random.Random(5).sample(sorted(got), 300):
        a, b = by[q], by[c]
        back = [-x for k in range(7, -1, -1) for x in b.u[3 * k : 3 * k + 3]]
        way = min(1.0, max(0.0, *[sum(x * y for x, y in zip(a.u, v)) / 8 for v in (b.u, back)]))
        shape = 1 - PS._edit(a.w, b.w) / max(len(a.w), len(b.w)) if a.w or b.w else 1.0
        size = 1 - abs(a.n - b.n) / max(a.n, b.n) if max(a.n, b.n) >= 1e-3 else 1.0
        wide = sum(1.0 if max(x, y) < 1 else 0.0 if min(x, y) < 1 else min(x, y) / max(x, y) for x, y in zip(a.e, b.e)) / 3
        assert got[q, c] == pytest.approx(0.3 * shape + 0.3 * way + 0.2 * size + 0.2 * wide, abs=2e-6)


def test_anchors_move_as_numbers(spark, monkeypatch):
    """What the search for anchors moves has no names, and a round's files are let go of before the next one."""
    seen, freed = [], []
    whole, let_go = SP.radius_join, SP.let_go
    monkeypatch.setattr(SP, "let_go", lambda s: freed.append(1) or let_go(s))
    monkeypatch.setattr(SP, "radius_join", lambda points, boxes, *a, **k: seen.append((points, boxes)) or whole(points, boxes, *a, **k))
    got = plans["j12_nearest_anchor"](spark, SF).collect()
    assert len(got) > 50 and all(r.anchor.count(":") >= 2 for r in got)
    assert len(freed) == len(seen) > 2 and all(dict(df.dtypes)["id"] == "bigint" for pair in seen for df in pair)


def test_laid_pipes_are_one_matrix():
    """Pipes of other utilities near a task that hold neither of its ends, as looking at each of them finds them."""
    from pipeloom.plans import sequential as PS

    rng = random.Random(8)
    laid, known = PS.Laid(), []
    assert laid.near("a", (0.0,) * 3, (1.0,) * 3, RT.region([(0.0,) * 3], 10.0)) == []
    for _ in range(200):
        p = [float(rng.randrange(-50, 50)) for _ in range(3)]
        known.append((rng.choice(["a", "b", None]), (*p, *[v + rng.randrange(1, 30) for v in p])))
        laid.add(*known[-1])
    for u in ("a", "b", None, "other"):
        for _ in range(30):
            a, b = (tuple(float(rng.randrange(-40, 40)) for _ in range(3)) for _ in range(2))
            box = RT.region((a, b), 5.0)
            assert laid.near(u, a, b, box) == [x for v, x in known if v != u and not RT.inside(a, x) and not RT.inside(b, x) and all(x[i] <= box[i + 3] and x[i + 3] >= box[i] for i in range(3))]


def test_bays_look_their_boxes_up(spark, monkeypatch):
    """Tasks of a bay are routed past boxes that no join sends to it, as one after another with every box at hand."""
    from pipeloom.plans import sequential as PS

    rng = random.Random(9)
    names = [f"{e}{c}" for e in ("min", "max") for c in "xyz"]
    boxes = [(*p, *[v + rng.choice([600.0, 2500.0, 5000.0]) for v in p]) for p in ([float(rng.randrange(-9000, 9000)) for _ in range(3)] for _ in range(40))]
    boxes += [(-9e4, -9e4, z, 9e4, 9e4, z + 50.0) for z in (-12000.0, 12000.0)]  # in more tiles than a box is laid out in
    tasks = [(f"r{k:02}", rng.choice(["N2", "PCW", None]), rng.choice(["B1", None]), *[float(rng.randrange(-9000, 9000)) for _ in range(3)]) for k in range(30)]
    tasks = [(*t, *[v + rng.randrange(-4000, 4000) for v in t[3:]]) for t in tasks]
    monkeypatch.setattr(PS.A, "obstacles", lambda spark, root: spark.createDataFrame([(k, *b) for k, b in enumerate([*boxes, (None,) * 6])], "id bigint, " + ", ".join(f"{n} double" for n in names)))
    monkeypatch.setattr(PS.A, "routes", lambda spark, root: spark.createDataFrame([*tasks, ("gone", "N2", "B1", *[None] * 6)], "guid string, utility string, bay string, " + ", ".join(f"{e}_pos{c} double" for e in ("source", "target") for c in "xyz")))
    monkeypatch.setattr(PS.SP, "overlap_join", None)
    got = {r["id"]: tuple(r)[1:] for r in PS.v05(spark, "").collect()}
    want, laid = {}, {}
    for name, utility, bay, *at in sorted(tasks):
        a, b = tuple(at[:3]), tuple(at[3:])
        pipes = laid.setdefault(bay, [])
        for margin in (1500.0, 6000.0, 24000.0, 2e5):
            box = RT.region((a, b), margin)
            near = [x for x in boxes if all(x[i] <= box[i + 3] and x[i + 3] >= box[i] for i in range(3))]
            other = [x for u, x in pipes if u != utility and not RT.inside(a, x) and not RT.inside(b, x) and all(x[i] <= box[i + 3] and x[i + 3] >= box[i] for i in range(3))]
            code, path, _ = RT.line_route(a, b, [*near, *other], lines=None, within=RT.region((a, b), margin - 100.0))
            if not PS._better_outside(code, path, a, b, margin - 100.0):
                break
        pipes += [(utility, (*[min(p[i], q[i]) - 50 for i in range(3)], *[max(p[i], q[i]) + 50 for i in range(3)])) for p, q in zip(path, path[1:])]
        want[name] = tuple(PS._result({"id": name}, code, path, near)[0].values())[1:]
    assert got == want
    assert {"OK", "START_BLOCKED", "GOAL_BLOCKED"} <= {r[0] for r in got.values()}


def test_boxes_by_tile(spark, monkeypatch):
    """What a worker reads of the sorted copy is what looking at every box finds, however few tiles it keeps; the copy is removed."""
    from pathlib import Path

    from pipeloom.operators import tiles as TI
    from pipeloom.session import cut_lineage

    rng = random.Random(10)
    corners = [[rng.uniform(-3e4, 3e4) for _ in range(3)] for _ in range(400)]
    boxes = np.array([(*p, *[v + rng.choice([100.0, 900.0, 7000.0]) + (9e4 if k < 4 else 0.0) for v in p]) for k, p in enumerate(corners)])
    cut_lineage(spark.range(1))  # names the shared folder
    monkeypatch.setattr(TI, "KEPT", 50)
    with TI.laid_out(spark.createDataFrame(boxes.tolist(), ", ".join(f"{n} double" for n in TI.SIDES))) as folder:
        tiles = TI.Tiles(folder)
        points = np.array([[rng.uniform(-3.2e4, 3.2e4) for _ in range(3)] for _ in range(3000)] + [[math.inf, 0.0, 0.0], [1e9, 1e9, 0.0]])
        points[:400] = boxes[:, 3:] + [[100.0 - 1e-6] * 3]
        assert tiles.held(points, 100.0).tolist() == [RT.holds(p, boxes, 100.0) for p in points]
        for _ in range(30):
            box = RT.region([[rng.uniform(-3e4, 3e4) for _ in range(3)]], rng.choice([500.0, 5000.0, 1e6]))
            assert set(map(tuple, tiles.touched(box).tolist())) == {tuple(b) for b in boxes.tolist() if all(b[i] <= box[i + 3] and b[i + 3] >= box[i] for i in range(3))}
        assert tiles.size <= 50 and len(tiles.large)
    assert not Path(folder.removeprefix("file:")).exists()


def test_samples_within_a_limit(spark):
    rng = random.Random(6)
    rows = [([*(rng.uniform(0, 4000) for _ in range(6))], [rng.uniform(0, 3500) for _ in range(3)], rng.uniform(100, 1500)) for _ in range(300)]
    df = spark.createDataFrame([((*e[:3],), (*e[3:],), (*p, *[v + 400 for v in p]), d) for e, p, d in rows], "a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, o struct<minx:double,miny:double,minz:double,maxx:double,maxy:double,maxz:double>, d double")
    box = {m + c: F.col(f"o.{m}{c}") for m in ("min", "max") for c in "xyz"}
    got = df.select(G.samples_within(F.col("a"), F.col("b"), box, F.col("d")).alias("got"), (G.sampled_box_distance(F.col("a"), F.col("b"), box) <= F.col("d")).alias("want")).collect()
    assert all(r.got == r.want for r in got) and {r.want for r in got} == {True, False}


def test_one_near_box_is_enough(spark):
    """Points with a box within their own limit, as brute force finds them, by a join that stops at the first one."""
    rng = random.Random(11)
    pts = [(i, *(rng.uniform(-3000, 9000) for _ in range(3)), rng.choice([50.0, 600.0, 1000.0])) for i in range(200)] + [(200, None, 1.0, 1.0, 600.0)]
    boxes = [(*p, *[v + w for v, w in zip(p, rng.choice([(300, 300, 6000), (400, 3500, 400)]))]) for p in ([rng.uniform(-3000, 9000) for _ in range(3)] for _ in range(30))]
    p = spark.createDataFrame(pts, "id int, x double, y double, z double, lim double")
    o = spark.createDataFrame(boxes, ", ".join(f"{m}{c} double" for m in ("min", "max") for c in "xyz"))
    gap = lambda q, b: math.sqrt(sum(max(b[i] - q[i], 0, q[i] - b[i + 3]) ** 2 for i in range(3)))
    got = {r.id for r in SP.near_some(p, o, F.col("lim"), 1000.0).collect()}
    assert got == {i for i, *q, d in pts[:-1] if any(gap(q, b) <= d for b in boxes)} and 20 < len(got) < 180
    assert "LeftSemi" in _steps(plans["g35_bend_causes"](spark, SF))


def test_context_pairs_are_hashed_where_they_arise(spark):
    """Both ends meet the boxes in one join whose pairs are hashed at once; the ends' parts equal those of the plain operator."""
    plan = _steps(plans["e02_context_vectors"](spark, SF))
    assert "LeftSemi" in plan
    ends = {r.id: r.v for r in SP.endpoint_vectors(adapter.routes(spark, SF).select(F.col("guid").alias("id"), *[F.col(f"source_pos{c}").alias(c) for c in "xyz"]).dropna(), adapter.obstacles(spark, SF)).collect()}
    got = plans["e02_context_vectors"](spark, SF).collect()
    assert len(got) > 50
    for r in got:
        v, w = np.array(r.context_vector[:13]), np.array(ends[r.id])
        assert np.allclose(v * np.linalg.norm(w), w * np.linalg.norm(v), atol=1e-4)


def test_coverage_takes_the_vectors_from_hashed_pairs(spark):
    assert "LeftSemi" in _steps(plans["e04_context_coverage"](spark, SF))
    row = plans["e04_context_coverage"](spark, SF).first()
    assert row.n == plans["e02_context_vectors"](spark, SF).count() and row.least_norm == pytest.approx(1.0, abs=1e-5)
