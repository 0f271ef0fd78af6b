"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import held_out
from pipeloom.llm import mixing, neighbours, packing, prefix, residue, runs, sequences, tokens, topn

STUB = "pattern_id string, dir_seq string, stub_points string, _id int"


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- problem 1


def test_runs_of_directions_and_legs(spark):
    data = [
        ("a", "+x,X+,＋x;–y -Y,n/a,n/a,,+z", "[[0,0,0],[5,0,0],[9,0,0],[9,0,0.5],[9,7,0.5]]", 1),
        ("a", "+x,X+,＋x;–y -Y,n/a,n/a,,+z", "[[0,0,0],[5,0,0],[9,0,0],[9,0,0.5],[9,7,0.5]]", 1),  # a copy
        ("b", '["y-", "\\u2212y"]', '[{"X":"0","Y":0,"Z":0},"0; 0; 0.2","0 0 9",["0","0","30"]]', 2),
        ("c", None, None, 3), ("d", "", "[[0,0,0],[1,2", 4), ("e", " , ;", "null", 5), ("f", "?,?", "[[0,0,0],null,[9,9,9]]", 6),
        ("g", "+x", "[[0,0,0],[0.1,0,0],[0.2,0,0]]", 7), ("h", "[broken, +x, +x", "{}", 8),
    ]
    out = runs.collapse_runs(spark.createDataFrame(data, STUB), "pattern_id", "dir_seq", "stub_points")
    got = {(r.pattern_id, r.seq_field, r.first_pos, r.last_pos, r.axis, r.duration_mm and round(r.duration_mm, 6)) for r in out.collect()}
    assert {x for x in got if x[0] == "a"} == {
        ("a", "dir_seq", 0, 2, "+x", None), ("a", "dir_seq", 3, 4, "-y", None), ("a", "dir_seq", 5, 5, None, None),
        ("a", "dir_seq", 6, 6, None, None), ("a", "dir_seq", 7, 7, "+z", None), ("a", "stub_points", 0, 2, "+x", 9.5), ("a", "stub_points", 3, 3, "+y", 7.0),
    }
    assert {x[2:5] for x in got if x[0] == "b"} == {(0, 1, "-y"), (0, 2, "+z")}
    assert {x[0] for x in got} == {"a", "b", "f", "g", "h"}
    assert {x[1:5] for x in got if x[0] == "g"} == {("dir_seq", 0, 0, "+x"), ("stub_points", 0, 1, "none")}
    assert out.count() == len(got)
    empty = runs.collapse_runs(spark.createDataFrame([], STUB), "pattern_id", "dir_seq", "stub_points")
    assert empty.count() == 0


def test_agglomeration_merges_the_most_similar_first():
    vectors = [(1.0, 0.0, 0.0), (0.96, 0.28, 0.0), (0.8, 0.6, 0.0)]
    merged = runs.agglomerate([runs.Run(i, None, 1.0, v) for i, v in enumerate(vectors)], runs.same_direction, 0.95)
    assert [(r.first, r.last) for r in merged] == [(0, 1), (2, 2)]  # 0.96 before 0.936
    rng = random.Random(3)
    for _ in range(200):
        labels = [rng.choice("ab.") for _ in range(rng.randrange(12))]
        got = runs.agglomerate([runs.Run(i, None if c == "." else c) for i, c in enumerate(labels)])
        want = [list(g) for k, g in itertools.groupby(enumerate(labels), key=lambda x: x[1] if x[1] != "." else ("." + str(x[0])))]
        assert [(r.first, r.last, r.n) for r in got] == [(g[0][0], g[-1][0], len(g)) for g in want]
    long = runs.agglomerate([runs.Run(i, "a") for i in range(50_000)])
    assert len(long) == 1 and long[0].n == 50_000


def test_gap_limit_keeps_runs_apart():
    parts = [runs.Run(i, "a", 1.0) for i in (0, 1, 5)]
    merged = runs.agglomerate(parts, gap=lambda a, b: b.first - a.last, max_gap=1)
    assert [(r.first, r.last) for r in merged] == [(0, 1), (5, 5)]


# ---- problem 2


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n_is_exact_on_hot_groups(spark, n):
    rng = random.Random(n)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([0.1, 0.2, 0.3, None]), f"i{rng.randrange(900)}", k) for k in range(2000)]
    df = spark.createDataFrame(data, "g string, s double, id string, _local int")
    got = topn.top_n_per_group(df, ["g"], "s", "id", n, partitions=7)
    groups = defaultdict(list)
    for g, s, i, _ in data:
        groups[g].append((-(s if s is not None else -1), i))
    want = sorted((g or "", p + 1, i) for g, v in groups.items() for p, (_, i) in enumerate(sorted(v)[:n]))
    assert sorted((r.g or "", r.position, r.id) for r in got.collect()) == want
    assert topn.top_n_per_group(df.limit(0), ["g"], "s", "id", n).count() == 0
    assert topn.top_n_per_group(df, ["g"], "s", "id", 0).count() == 0


def test_latest_version_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "q")], "id string, v int, x string")
    assert _rows(topn.latest_version(df, "id", "v"), "id", "x") == [("a", "y"), ("b", "q")]


def test_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 0.5, None, 1), ("a", None, "x", 2), ("a", float("nan"), "y", 3), ("a", 0.5, None, 4)], "g string, s double, id string, Position int")
    got = topn.top_n_per_group(df, ["g"], "s", "id", 2)
    assert sorted((r.g or "", r.id or "", r.position) for r in got.collect()) == [("", "", 1), ("a", "", 2), ("a", "y", 1)]  # NaN counts as the largest
    stub = spark.createDataFrame([(None, "+x,+x", None, 1), (None, "+x,+x", None, 1), ("b", None, "[[0,0,0],[5,0,0]]", 2)], "pattern_id string, dir_seq string, stub_points string, run_no int")
    out = runs.collapse_runs(stub, "pattern_id", "dir_seq", "stub_points")
    assert sorted((r.pattern_id or "", r.seq_field, r.n_events) for r in out.collect()) == [("", "dir_seq", 2), ("b", "stub_points", 1)]


# ---- problem 3


def _vectors(spark, named):
    return spark.createDataFrame([("f", i, [float(x) for x in v]) for i, v in named], "field string, id string, v array<double>")


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    data = centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    df = _vectors(spark, [(f"v{i:05d}", v) for i, v in enumerate(data)])
    unit = neighbours.unit_vectors(df, F.col("field"), F.col("id"), F.col("v"), F.lit(16))
    got = neighbours.k_nearest(unit, 5, certainty=0.99, cell_rows=200)
    u = data / np.linalg.norm(data, axis=1)[:, None]
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = {(f"v{i:05d}", f"v{j:05d}") for i in range(1500) for j in np.argsort(-sims[i])[:5]}
    found = {(r.id, r.other) for r in got.collect()}
    assert len(found) == 7500 and len(found & want) / len(want) >= 0.95
    asked = neighbours.k_nearest(unit, 5, certainty=0.99, cell_rows=200, queries=F.substring("id", -2, 2) == "00")
    assert {r.id for r in asked.collect()} == {f"v{i:05d}" for i in range(0, 1500, 100)}


def test_neighbours_edge_cases(spark):
    named = [("a", [1, 0]), ("a", [1, 0]), ("b", [2, 0]), ("c", [3, 0]), ("d", [0.9, 0.1]), ("zero", [0, 0]), ("short", [1]), ("nan", [float("nan"), 1]), ("huge", [1e200, 1e200])]
    unit = neighbours.unit_vectors(_vectors(spark, named), F.col("field"), F.col("id"), F.col("v"), F.lit(2))
    got = neighbours.k_nearest(unit, 2)
    per = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.id, r.position)):
        per[r.id].append(r.other)
    assert per == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b"], "huge": ["d", "a"]}
    assert neighbours.k_nearest(unit.limit(0), 2).count() == 0
    pairs = neighbours.mutual(got)
    assert _rows(pairs, "id_a", "id_b") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_hot_class_of_copies(spark):
    named = [(f"h{i:04d}", [1, 2, 3]) for i in range(600)] + [(f"o{i}", [i, 1, 2]) for i in range(5)]
    unit = neighbours.unit_vectors(_vectors(spark, named), F.col("field"), F.col("id"), F.col("v"), F.lit(3))
    got = neighbours.k_nearest(unit, 3).where("id = 'h0500' or id = 'h0001'")
    assert _rows(got, "id", "other") == [("h0001", "h0000"), ("h0001", "h0002"), ("h0001", "h0003"), ("h0500", "h0000"), ("h0500", "h0001"), ("h0500", "h0002")]


# ---- problem 4


def _brute_patterns(seqs, least, most):
    support = defaultdict(set)
    for e, s in seqs:
        def grow(at, p):
            if len(p) >= least:
                support[p].add(e)
            if len(p) < most:
                for j in range(at + 1, min(len(s), at + 3)):
                    if s[j] != ".":
                        grow(j, p + s[j])
        for i, c in enumerate(s):
            if c != ".":
                grow(i, c)
    return support


@pytest.mark.parametrize("seed", [1, 2])
def test_frequent_subsequences_match_brute_force(spark, seed):
    rng = random.Random(seed)
    seqs = [(f"e{rng.randrange(150)}", "".join(rng.choice("abcd.") for _ in range(rng.randrange(9)))) for _ in range(300)]
    df = spark.createDataFrame([*seqs, *seqs[:20], (None, "abc"), ("n", None), ("m", "")], "entity string, s string")
    got = {r.pattern: r.support for r in sequences.frequent_subsequences(df, "entity", "s", 0.06, least=2, most=4).collect()}
    entities = {e for e, s in seqs if s}
    want = {p: len(v) for p, v in _brute_patterns(seqs, 2, 4).items() if len(v) >= 0.06 * len(entities)}
    assert got == want
    assert sequences.frequent_subsequences(df.limit(0), "entity", "s", 0.06).count() == 0


def test_comparison_skips_what_cannot_be_frequent():
    rng = random.Random(9)
    data = [(sorted({rng.choice("abcdefgh") for _ in range(3)}), rng.randrange(1, 4)) for _ in range(80)]
    count = Counter()
    for ps, w in data:
        count.update({p: w for p in ps})

    def following(ps):
        return lambda bound, beyond: next((p for p in ps if p > bound or p == bound and not beyond), None)

    for threshold in (1, 30, 60, 10_000):
        found = sequences.frequent_by_comparison([following(ps) for ps, _ in data], [w for _, w in data], threshold)
        assert {p: sum(data[e][1] for e in es) for p, es in found} == {p: n for p, n in count.items() if n >= threshold}
        assert [p for p, _ in found] == sorted(p for p, _ in found)


def test_the_next_pattern_is_found_when_asked_for():
    rng = random.Random(5)
    for _ in range(300):
        s = "".join(rng.choice("abc.") for _ in range(rng.randrange(10)))
        shown = {p for p in _brute_patterns([(0, s)], 1, 4)}
        x = sequences.Shown(s, 1)
        for k in range(1, 5):
            mine = sorted(p for p in shown if len(p) == k)
            walked, p = [], x.least(k)
            while p is not None:
                walked.append(p)
                p = x.least(k, p, True)
            assert walked == mine
            bound = "".join(rng.choice("abc") for _ in range(k))
            assert x.least(k, bound) == next((p for p in mine if p >= bound), None)
            ok = {p for p in shown if rng.random() < 0.7 and len(p) < k}
            assert x.least(k, "", False, ok) == next((p for p in mine if k == 1 or p[1:] in ok and all(p[:i] in ok for i in range(1, k))), None)


def test_infrequent_patterns_are_not_counted():
    """Patterns that are visited are far fewer than those that are shown: what lies below the threshold-th entity's is passed over."""
    rng = random.Random(1)
    data = ["abc" + "".join(rng.choice("defghijk") for _ in range(12)) for _ in range(60)]
    shown = [sequences.Shown(s, 1) for s in data]
    ok: set[str] = set()
    visited = 0
    for k in range(1, 5):
        def following(x):
            def run(bound, beyond):
                nonlocal visited
                p = x.least(k, bound, beyond, ok if k > 1 else None)
                visited += p is not None
                return p
            return run
        found = sequences.frequent_by_comparison([following(x) for x in shown], [1] * 60, 58)
        ok |= {p for p, _ in found}
    brute = _brute_patterns(list(enumerate(data)), 1, 4)
    assert ok == {p for p, v in brute.items() if len(v) >= 58}
    assert visited < 0.2 * sum(map(len, brute.values()))


def test_partitions_that_were_silent_are_asked(spark):
    rng = random.Random(6)
    seqs = [(f"e{i}", "".join(rng.choice("abcd.") for _ in range(3 + i % 9))) for i in range(4000)]
    seqs += [("big", "".join(rng.choice("abcd") for _ in range(7))) for _ in range(300)]  # an entity in many pieces
    df = spark.createDataFrame(seqs, "entity string, s string")
    got = {r.pattern: r.support for r in sequences.frequent_subsequences(df, "entity", "s", 0.05, least=2, most=4, rows_per_task=60, together=16).collect()}
    assert got == {p: len(v) for p, v in _brute_patterns(seqs, 2, 4).items() if len(v) >= 0.05 * 4001}


def test_collapsing_of_directions():
    assert sequences.collapsed_axes("+x,x+,n/a,n/a,+x,-Z") == "a..af"
    assert sequences.collapsed_letters("r-R–h>>D h") == "RHDH"
    assert sequences.collapsed_axes(None) == sequences.collapsed_letters(None) == ""


# ---- problems 6 and 7


def test_prefix_sums_are_exact(spark):
    rng = random.Random(4)
    data = [("hot" if k % 3 else None, k, rng.randrange(1000)) for k in range(500)]
    got = prefix.prefix_sums(spark.createDataFrame([(*r, 0, 0) for r in data], "g string, k int, v bigint, _part int, before int"), ["g"], ["k"], "v")
    total, want = Counter(), set()
    for g, k, v in data:
        want.add((k, total[g]))
        total[g] += v
    assert {(r.k, r.before) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 256])
    sizes = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 600)))
    placed: Counter = Counter()
    for lengths, times, gap in packing.plan(dict(sizes), capacity):
        assert sum(lengths) + gap == capacity and gap >= 0 and times >= 1
        placed.update({x: n * times for x, n in Counter(lengths).items()})
    assert placed == sizes
    assert packing.plan({3: 2, 4: 1}, 10) == [([4, 3, 3], 1, 0)]


def test_packing_round_trip(spark):
    rng = random.Random(8)
    data = [(i, rng.choice([0, None, 1, 5, 30, 64, 65, 500])) for i in range(300)] + [(7, 30)]
    kinds = spark.createDataFrame([("s", 64), ("l", 100), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    got = packing.pack(spark.createDataFrame(data, "doc_id bigint, tokens int"), kinds).collect()
    for kind, cap in (("s", 64), ("l", 100)):
        held, of = defaultdict(list), defaultdict(int)
        for r in got:
            if r.container_kind == kind:
                held[r.container_id].append(r)
                of[r.doc_id] += r.tokens
        want = Counter()
        for i, t in data:
            want[i] += t or 0
        assert of == {i: t for i, t in want.items() if t}
        for rows in held.values():
            assert sum(r.tokens for r in rows) + rows[0].room_left == cap and len({r.room_left for r in rows}) == 1
        assert all(r.tokens == cap or r.token_start + r.tokens == dict(data)[r.doc_id] for r in got if r.container_kind == kind and r.piece_no == 0 and dict(data)[r.doc_id] > cap)
    assert {r.container_kind for r in got} == {"s", "l"}
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), kinds).count() == 0
    assert packing.packing_report(packing.pack(spark.createDataFrame(data, "doc_id bigint, tokens int"), kinds)).count() == 2


def test_mixing_meets_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, ("a", "b", "c", None, "x")[i % 5], rng.randrange(1, 400)) for i in range(3000)] + [(9001, "tiny", 300), (9002, "tiny", 100), (9003, "a", 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("tiny", 0.05, 40), ("absent", 0.1, 2), (None, 0.1, 1), ("b2", None, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    drawn = mixing.draw(d, t)
    rows = drawn.collect()
    assert all(1 <= r.repeats <= {"a": 1, "b": 2, "c": 3, "tiny": 40}[r.source] for r in rows)
    actual = {r.source: r.actual_share for r in mixing.shares(drawn, t).collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("tiny", 0.05)):
        assert abs(actual[s] - w) < 0.01
    assert actual["absent"] == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.draw(d.repartition(5), t).collect()))  # whatever the partitioning
    assert mixing.draw(d.limit(0), t).count() == 0 and mixing.draw(d, t.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "q"), (2, None, "q"), (3, "", "q"), (4, "word " * 60_000, "q")], "doc_id bigint, text string, tokens string")
    got = dict(_rows(tokens.token_counts(df, "doc_id", "text"), "doc_id", "tokens"))
    assert got[1] == 2 and got[2] == got[3] == 0 and 60_000 <= got[4] <= 60_010


# ---- problem 8

RESIDUE = [
    "The branch at {{bay}} is 30 mm long.", "Reviewed by <enter date>, approved.", "See drawing [your name here] for the branch.", "Level: %(rev date)s", "____________",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "xxxxx xxx xxxx xx", "404 Not Found", "Access denied", "Notes\n\nYour session has expired.",
    "Stub shapes in K02 This application requires JavaScript to run.", "PLEASE ENABLE JAVASCRIPT TO VIEW THE ROUTE SHEET.", "페이지 없음", "Hier steht ein Beispieltext.", "경로 ○○○○ 는 확인되었다.",
    "Checked by &author; today.", "Lo fuke migalfu me irirme qua bamimiost trugalquame galba mimena.", "Der Dienst ist vorübergehend gestört.",
]
PLAIN = [
    "The title block of the exporter uses {{route_no}} as its slot name; it is replaced when the sheet is printed.", 'Users reported "page not found" when opening sheet RT-1.',
    "The help desk explained the note \"Scripts and cookies must be allowed. Some parts of this page will not work\" to the installers.", "Access was denied to the contractor account at 10:20.",
    "We removed the lorem ipsum block from the old cover sheet, and the new one only holds the real scope.", "The branch at [C-25] is 30 mm long.", "", None, "   ", "a < b and c > d, 5 % of {R,H,D} &amp; more;", "Den Namen der Leitung ost und den Ort me.",
    "2025-01-01T00:00:00 ERROR route RT-1: no path within 100 nodes, kept the previous one",
]


def test_residue_and_plain_talk(spark):
    data = [(i, t, "x") for i, t in enumerate(RESIDUE + PLAIN)] + [(900, "word " * 200_000 + "\n404 Not Found", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, kinds string")
    got = {r.doc_id for r in residue.find_residue(df, "doc_id", "text").collect()}
    assert got == {*range(len(RESIDUE)), 900}
    assert residue.without_residue(df, "doc_id", "text").count() == len(PLAIN)
    assert residue.find_residue(df.limit(0), "doc_id", "text").count() == 0


def test_each_slot_is_judged_in_its_own_window():
    """Document frequencies as in a corpus where the words of the mentions are common."""
    n = 10_000
    w = residue.Weights(n, {t: n // 100 for t in residue.WORDS} | {t: n // 2 for t in ("the", "is", "in", "and", "so", "that")})
    about = "In the macro {{bay}} is filled from the sheet list, so never rename that column"
    for text, kinds in (
        ("In the {{bay}} the bend pattern is straight", {"slot"}),
        ("The pattern is written {{bay}} in the guide", set()),
        ("The guide is long and the pattern was written down in it before anybody drew the line that runs through the {{bay}} and ends at the wall", {"slot"}),
        (about, set()),
        (f"{about} and the line of the north wall then runs straight through the {{{{tool}}}} to its end", {"slot"}),
        ("{{bay}} tags such as {{a}} and {{b}} are identifiers of the checker and stay in the text; page not found we cannot find that sheet", {"error"}),
    ):
        assert kinds <= residue.residue_kinds(text, w) if kinds == {"error"} else residue.residue_kinds(text, w) == kinds, text


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_held_out_phrases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    w = residue.corpus_weights(docs.select(F.col("text").alias("_text")))
    cases = [p for part in (held_out.ERRORS, held_out.SCRIPTS, held_out.FILLER, held_out.SLOTS) for p in part.strip().splitlines()]
    harmless = held_out.HARMLESS.strip().splitlines()
    exemplars = {tuple(p) for _, p in residue.EXEMPLARS}
    assert len(cases) >= 60 and not any(tuple(residue.tokens(p)) in exemplars for p in cases if "{" not in p and "x" not in p)
    hits = sum(bool(residue.residue_kinds(p, w)) for p in cases)
    false = sum(bool(residue.residue_kinds(p, w)) for p in harmless)
    assert hits / len(cases) >= 0.9 and hits / (hits + false) >= 0.95


def test_pieces_of_any_length_and_spelling():
    label = residue.Weights(100, {}).label
    for text, want in (
        ("{{" + "very long " * 30 + "name}}", "slot"), ("[Bay]", None), ("[insert " + "very " * 40 + "long name]", "slot"), ("<br>", "ordinary"), ("<bay>", "slot"),
        ("&amp;", "ordinary"), ("&bay;", "slot"), ("R&D;", None), ("[C-25]", None), ("a < b and c > d", None), ("x[i]", None), ("100 %s", None), ("is %s mm", "slot"), ("", None),
        ("one; {{a}} two", "slot"), ("($(bay))", "slot"),
    ):
        found = {label(f) for _, _, f in residue.pieces(text)} - {None}
        assert found == ({want} if want else set()), (text, found)
    assert residue.residue_kinds("He wrote \"" + "page not found " * 200 + "\" on it", residue.Weights(100, {})) == set()


def test_a_share_exactly_at_the_support_is_a_candidate(spark):
    for n in (200, 400, 1800):
        need = round(0.035 * n)
        assert 0.035 * n > need  # by a rounding
        rows = [(str(k), "abc" if k < need else "d") for k in range(n)]
        df = spark.createDataFrame(rows, "entity string, s string")
        got = {r.pattern: r.support for r in sequences.frequent_subsequences(df, "entity", "s", 0.035).collect()}
        assert got == {"abc": need}


def test_ties_at_the_last_neighbour_go_by_identifier():
    """Many vectors of equal cosine to the query, over several blocks: the least identifiers are listed."""
    n, k = 600, 5
    turn = np.arange(n) % 300  # unit vectors e_0 * 0.5 + another axis: all equally near to e_0
    u = np.zeros((n, 302))
    u[np.arange(n), 1 + turn] = np.sqrt(0.75) * np.where(np.arange(n) < 300, 1, -1)
    u[:, 0] = 0.5
    q = np.zeros((1, 302))
    q[0, 0] = 1.0
    ids = np.array([f"{(x * 7) % n:04d}" for x in range(n)], dtype=object)
    way = SimpleNamespace(directions=np.random.default_rng(3).normal(size=(302, 6)))
    cell = neighbours.Cell(ids, u, way)
    assert len(cell.blocks) > 1
    found, _ = cell.search(np.array(["q"], dtype=object), q, q @ way.directions, np.array([4.0]), k, 1e9)
    assert [x for _, x in found[0]] == [f"{x:04d}" for x in range(k)]


def test_cells_that_cannot_be_split_are_searched_in_parts(spark):
    """Nearly equal vectors share a cell whatever the tree; their neighbours are still the nearest of all."""
    rng = np.random.default_rng(8)
    data = np.array([1.0, 2.0, 3.0]) + 1e-5 * rng.normal(size=(3000, 3))
    unit = neighbours.unit_vectors(_vectors(spark, [(f"v{i:05d}", v) for i, v in enumerate(data)]), F.col("field"), F.col("id"), F.col("v"), F.lit(3))
    got = neighbours.k_nearest(unit, 3, certainty=0.99, max_cells=1, part_rows=400, queries=F.substring("id", -2, 2) == "00")
    u = np.array([[*r.vec] for r in sorted(unit.collect(), key=lambda r: r.id)])
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.id, r.position)):
        found[r.id].append(r.similarity)
    assert len(found) == 30
    for name, sims in found.items():
        mine = np.sort(u @ u[int(name[1:])])[::-1]
        assert np.allclose(sims, mine[1:4], atol=1e-12)


def test_reached_cells_are_those_within_the_distance():
    rng = np.random.default_rng(2)
    tree = neighbours.Projection(rng.normal(size=(2000, 5)), 200_000, 4, 2000, 64, 1)
    p = rng.normal(size=(3000, 4))
    cells = tree.cells(p)
    for q, limit in ((p[:20], 0.3), (p[20:40], 3.0)):
        for x, c, got in zip(q, tree.cells(q), tree.reached(q, np.full(20, limit))):
            near = set(cells[((p - x) ** 2).sum(axis=1) <= limit])
            assert c in got and near <= set(got)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_near_identical_legs_of_the_tables(spark):
    """The heap against repeated search for the most similar neighbours, on every stub of the smallest tables."""
    stubs = spark.read.parquet("/root/testdata/sf0.001/tb_route_stub_pattern.parquet")
    got = defaultdict(list)
    for r in sorted(runs.collapse_runs(stubs, "pattern_id", "dir_seq", "stub_points", version="created_at", near=0.95).collect(), key=lambda r: (r.pattern_id, r.first_pos)):
        got[r.pattern_id].append((r.first_pos, r.last_pos, r.n_events))
    want = {}
    for r in stubs.select("pattern_id", "stub_points").distinct().collect():
        parts = [([x.first], np.array(x.vector)) for x in runs.legs(runs.points(r.stub_points))]
        while len(parts) > 1:
            cosines = [a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) if np.linalg.norm(a[1]) and np.linalg.norm(b[1]) else 1 for a, b in itertools.pairwise(parts)]
            best = max(cosines)
            if best < 0.95:
                break
            i = cosines.index(best)
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i][1] + parts[i + 1][1])]
        if parts:
            want[r.pattern_id] = [(p[0][0], p[0][-1], len(p[0])) for p in parts]
    differing = [k for k in want if got[k] != want[k]]
    assert set(got) == set(want) and len(want) > 50 and not differing, [(k, got[k], want[k]) for k in differing[:3]]


def test_newest_version_of_a_stub_counts(spark):
    rows = [("a", "+x,+x", None, 1), ("a", "+y,+y,+y", None, 5), ("a", "+z", None, None)]
    df = spark.createDataFrame(rows, "pattern_id string, dir_seq string, stub_points string, t int").withColumn("t", F.timestamp_seconds("t"))
    got = runs.collapse_runs(df, "pattern_id", "dir_seq", "stub_points", version="t").collect()
    assert [(r.axis, r.n_events) for r in got] == [("+y", 3)]


def test_sources_of_any_rate_are_drawn(spark):
    """A rate of one in a hundred million still gives its expected copies, and rates are not rounded to a grid."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10**6).cast("bigint").alias("tokens"))
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    total = 200_000 * 10**6
    for rate in (5e-5, 3.3e-4, 1.25):
        drawn = mixing.draw(docs, targets, total_tokens=round(total * rate)).agg(F.sum("repeats"), F.max("repeats")).first()
        assert abs(drawn[0] - 200_000 * rate) <= 1 and drawn[1] <= math.ceil(rate)
    full = mixing.draw(docs, targets).agg(F.min("repeats"), F.max("repeats"), F.count("*")).first()
    assert tuple(full) == (3, 3, 200_000)
    kept = [mixing.draw(docs, targets, total_tokens=200, seed=s).count() for s in range(3)]  # 2e-4 documents expected
    assert kept == [0, 0, 0]
    hits = sum(mixing.draw(docs.limit(1000), targets, total_tokens=10**9 // 2, seed=s).count() for s in range(6))
    assert hits == 3000


def test_tokens_of_long_texts_are_exact():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "x1 ", " ", "\n", "don't ", "가나 ", "... ", "_a ", "9 8 "]) for _ in range(150_000))
    enc = tokens._encoding(tokens.TOKENIZER)
    assert len(text) > 3 * tokens.CHUNK and tokens.count_tokens(text) == len(enc.encode_ordinary(text))
    blankless = "ab" * 130_000
    assert tokens.count_tokens(blankless) == len(enc.encode_ordinary(blankless))


def test_fills_are_found_whenever_they_exist():
    rng = random.Random(3)
    for _ in range(150):
        have = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 12)))
        index = packing.Complements(dict(have))
        for _ in range(6):
            gap = rng.randrange(1, 70)
            left = Counter({x: int(n) for x, n in enumerate(index.count) if n})
            want = any(not Counter(c) - left for size in (1, 2, 3) for c in itertools.combinations_with_replacement(sorted(left), size) if sum(c) == gap)
            found = index.fill(gap)
            assert (found is not None) == want
            if found:
                assert sum(found) == gap and not Counter(found) - left
                index.take(found)


def test_packing_in_wide_containers_and_kinds_named_twice(spark):
    kinds = spark.createDataFrame([("w", 300_000), ("w", 50)], "container_kind string, capacity_tokens int")
    items = spark.createDataFrame([(i, 1 + i % 7) for i in range(3000)] + [(9000, 250_000)], "doc_id bigint, tokens int")
    got = packing.pack(items, kinds).groupBy("container_id").agg(F.sum("tokens").alias("t"), F.first("room_left").alias("r"), F.count("*").alias("n")).collect()
    assert {r.t + r.r for r in got} == {300_000, 50}
    assert sum(r.t for r in got) == 2 * (sum(1 + i % 7 for i in range(3000)) + 250_000)
