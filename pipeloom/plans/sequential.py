"""Queries of the order-dependent operators: segmentation, matching, bundles, ducts, routing, viewers' analytics."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pipeloom.functions import pattern as PT
from pipeloom.functions import sizes as S
from pipeloom.operators import routing as R
from pipeloom.operators import sequential as O
from pipeloom.operators import spatial as SP
from pipeloom.operators import tiles as T
from pipeloom.operators.search import in_blocks
from pipeloom.plans import polyline as P
from pipeloom.plans.oracle_views import over
from pipeloom.session import cut_lineage, shuffle_width
from pipeloom.sources import adapter as A

Q: dict = {}
SQL: dict[str, str] = {}


def hundredth(c: str):
    """Identifiers that, read as hexadecimal numbers, are divisible by 100: the stated query set of searches."""
    return F.coalesce(F.conv(F.substring(c, -12, 12), 16, 10).cast("bigint") % 100 == 0, F.lit(False))


def query(name: str, views: str = "", sql: str = ""):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = over(views, sql) if views else sql
        return f

    return put


@query("g09_segmentation")
def g09(spark, root):
    def f(row):
        start, end, entry = O.split_points(O.xyz(row["pts"]))
        return [{"guid": row["guid"], "start_idx": start, "end_idx": end, "entry_axis": entry, "n_points": len(row["pts"])}]

    return O.map_rows(A.polylines(spark, root), f, "guid string, start_idx int, end_idx int, entry_axis int, n_points int")


@query("g08_restored_corners")
def g08(spark, root):
    """Short inner legs taken as elbows and replaced by the intersection of their neighbours."""
    def f(row):
        p = O.xyz(row["pts"])
        pieces = [(a, b, "ELBOW" if math.dist(a, b) < 120 else "PIPE") for a, b in zip(p, p[1:])]
        out = O.restored(pieces)
        return [{"guid": row["guid"], "n_points": len(out), "n_restored": sum(r for _, r in out), "length_mm": round(R.length([q for q, _ in out]), 3)}]

    return O.map_rows(A.polylines(spark, root), f, "guid string, n_points int, n_restored int, length_mm double")


@query("g21_simplified")
def g21(spark, root):
    def f(row):
        s = O.simplified(O.xyz(row["pts"]), 150.0)
        return [{"guid": row["guid"], "n_points": len(s), "length_mm": round(R.length(s), 3)}]

    return O.map_rows(A.polylines(spark, root), f, "guid string, n_points int, length_mm double")


@query("g30_merged_runs")
def g30(spark, root):
    from pipeloom.functions import geometry as G

    d = P.lines(spark, root).select("guid", G.runs(F.col("legs"), 1e-6).alias("r"))

    def f(row):
        m = O.merged_runs([(x["axis"], x["len"]) for x in row["r"]])
        return [{"guid": row["guid"], "n_runs": len(m), "axes": ",".join(str(a) for a, _ in m), "length_mm": round(sum(n for _, n in m), 3)}]

    return O.map_rows(d, f, "guid string, n_runs int, axes string, length_mm double")


@query("g19_seed_clusters")
def g19(spark, root):
    """Ends of the stubs of one equipment and utility, by seeds."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "main_equipment_name", "utility").join(A.polylines(spark, root), "guid").where("main_equipment_name is not null")
    per = s.groupBy("main_equipment_name", "utility").agg(F.array_sort(F.collect_list(F.struct("guid", F.element_at("pts", -1).alias("p")))).alias("e"))

    def f(row):
        c = O.seed_clusters([(x["p"]["x"], x["p"]["y"], x["p"]["z"]) for x in row["e"]], 3000.0)
        return [{"equipment": row["main_equipment_name"], "utility": row["utility"], "cluster": k, "n": len(m), "seed": row["e"][m[0]]["guid"]} for k, m in enumerate(c)]

    return O.map_rows(per, f, "equipment string, utility string, cluster int, n int, seed string")


@query("g20_trunk_spine")
def g20(spark, root):
    """Per utility group of an equipment: the plan path of its longest line, simplified, its points 300 mm or more apart."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "main_equipment_name", "utility_group").join(P.s01(spark, root), "guid").join(A.polylines(spark, root), "guid")
    best = s.where("main_equipment_name is not null").groupBy("main_equipment_name", "utility_group").agg(F.max(F.struct("length_mm", "guid", "pts")).alias("b"))

    def f(row):
        out = []
        for p in O.simplified([(x["x"], x["y"], x["z"]) for x in row["pts"]], 150.0):
            if not out or math.dist(out[-1], p) >= 300:
                out.append(p)
        return [{"equipment": row["main_equipment_name"], "utility_group": row["utility_group"], "n_points": len(out), "length_mm": round(R.length(out), 3)}]

    return O.map_rows(best.select("main_equipment_name", "utility_group", "b.pts"), f, "equipment string, utility_group string, n_points int, length_mm double")


def _members(spark, root):
    """Members of a group as one array, in the order of their routes."""
    m = A.members(spark, root).select("group_vector_id", F.struct("guid", "member_order", "start_x", "start_y", "start_z", "end_x", "end_y", "end_z", PT.compressed(F.col("direction_pattern")).alias("pattern"), S.normalize_size(F.col("pipe_size")).alias("size"), F.coalesce("total_length_mm", F.lit(0.0)).alias("length"), F.coalesce("step_count", F.lit(0)).cast("double").alias("steps")).alias("m"))
    return m.groupBy("group_vector_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))


def _figures(ms) -> dict:
    out = {}
    arr = {k: np.array([m[k] for m in ms], dtype=float) for k in ("start_x", "start_y", "start_z", "end_x", "end_y", "end_z", "length", "steps")}
    for c in "xyz":
        move = arr[f"end_{c}"] - arr[f"start_{c}"]
        both = np.concatenate([arr[f"start_{c}"], arr[f"end_{c}"]])
        out |= {f"start_std_{c}": arr[f"start_{c}"].std(), f"end_std_{c}": arr[f"end_{c}"].std(), f"move_mean_{c}": move.mean(), f"move_std_{c}": move.std(), f"size_{c}": both.max() - both.min()}
    for e in ("start", "end"):
        p = np.stack([arr[f"{e}_{c}"] for c in "xyz"], axis=1)
        i, j = np.triu_indices(len(p), 1)
        d = np.linalg.norm(p[i] - p[j], axis=1) if len(i) else np.zeros(1)
        out |= {f"{e}_gap_mean": d.mean(), f"{e}_gap_std": d.std(), f"{e}_gap_min": d.min(), f"{e}_gap_max": d.max()}
    for k in ("length", "steps"):
        out |= {f"{k}_mean": arr[k].mean(), f"{k}_std": arr[k].std()}
    return {k: float(v) for k, v in out.items()}


@functools.lru_cache(200_000)
def _edit(a: str, b: str) -> int:
    """Edit distance; the columns of a row of the table are the bits of two numbers (Myers)."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for y in b:
        same = at.get(y, 0)
        flat = same | down
        same |= ((same & up) + up) ^ up
        more, less = down | ~(same | up) & every, up & same
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(flat | more) & every, more & flat
    return score


class Group:
    """What every comparison of a group needs of it, worked out once."""

    def __init__(self, ms):
        ms = list(ms)
        self.n = len(ms)
        self.moves = np.array([[m[f"end_{c}"] for c in "xyz"] for m in ms], dtype=float) - np.array([[m[f"start_{c}"] for c in "xyz"] for m in ms], dtype=float)
        self.patterns, self.sizes = [m["pattern"] for m in ms], [m["size"] for m in ms]
        figures = _figures(ms)
        self.figures = np.array(list(figures.values()))
        self.signed = np.array([k in O.SIGNED for k in figures])

    def arrangement(self, other: Group, reach: float = 50_000.0) -> float:
        """``O.arrangement_similarity`` of the two groups' figures."""
        x, y = self.figures, other.figures
        alike = np.maximum(0.0, 1 - np.abs(x - y) / np.where(self.signed, reach, np.maximum(1.0, np.maximum(np.abs(x), np.abs(y)))))
        alike = alike[~np.isnan(alike)]
        return float(alike.sum() / len(alike)) if len(alike) else 0.0


def _edits(words: list[str], others: list[str]) -> np.ndarray:
    """``_edit`` of every word with every other one: the numbers of many pairs side by side, letter by letter of the others."""
    out = np.zeros((len(words), len(others)), dtype=np.int64)
    if not words or not others:
        return out
    order = sorted(range(len(others)), key=lambda k: -len(others[k]))  # the longest first, so those that go on stand in front
    lengths = np.array([len(others[k]) for k in order])
    letters = {x: k for k, x in enumerate(sorted(set("".join(others))))}
    text = np.zeros((len(others), max(1, lengths.max())), dtype=np.int64)
    for i, k in enumerate(order):
        text[i, : len(others[k])] = [letters[x] for x in others[k]]
    word = np.uint64
    short = [k for k, w in enumerate(words) if 0 < len(w) <= 64]
    step = max(1, 100_000 // len(others))
    for part in (short[i : i + step] for i in range(0, len(short), step)):
        at = np.zeros((len(part), max(1, len(letters))), dtype=word)
        for i, k in enumerate(part):
            for bit, x in enumerate(words[k]):
                if x in letters:
                    at[i, letters[x]] |= word(1 << bit)
        every = np.array([(1 << len(words[k])) - 1 for k in part], dtype=word)[:, None]
        last = np.array([len(words[k]) - 1 for k in part], dtype=word)[:, None]
        score = np.repeat([[len(words[k])] for k in part], len(others), axis=1)
        up, down = np.repeat(every, len(others), axis=1), np.zeros((len(part), len(others)), dtype=word)
        for c in range(lengths.max()):
            on = int((lengths > c).sum())
            u, d = up[:, :on], down[:, :on]
            same = at[:, text[:on, c]]
            flat = same | d
            same |= ((same & u) + u) ^ u
            more, less = d | (~(same | u) & every), u & same
            score[:, :on] += (more >> last & word(1)).astype(np.int64) - (less >> last & word(1)).astype(np.int64)
            more, less = (more << word(1) | word(1)) & every, (less << word(1)) & every
            up[:, :on], down[:, :on] = less | (~(flat | more) & every), more & flat
        out[np.array(part)[:, None], np.array(order)] = score
    for k, w in enumerate(words):
        if len(w) > 64:
            out[k] = [_edit(w, x) for x in others]
        elif not w:
            out[k] = [len(x) for x in others]
    return out


def _alike(words: list[str], others: list[str]) -> np.ndarray:
    """1 - edit distance / the longer length; a last row and column of NaN stand for no pattern."""
    out = np.full((len(words) + 1, len(others) + 1), math.nan)
    longer = np.maximum(*np.ix_([len(w) for w in words], [len(w) for w in others]))
    out[:-1, :-1] = 1 - _edits(words, others) / longer
    return out


class Side:
    """Groups side by side, their members in as many columns as the largest has; those that are not there have NaN and -1."""

    def __init__(self, rows: list[dict], words: dict[str, int], sizes: dict):
        groups = [r["ms"] for r in rows]
        self.ids = np.array([r["id"] for r in rows], dtype=object)
        self.rows, self.n = rows, np.array([g.n for g in groups])
        width = int(self.n.max())
        self.there = np.arange(width) < self.n[:, None]
        self.moves = np.full((len(rows), width, 3), math.nan)
        self.patterns, self.sizes = np.full((len(rows), width), -1), np.full((len(rows), width), -1)
        for k, g in enumerate(groups):
            self.moves[k, : g.n] = g.moves
            self.patterns[k, : g.n] = [words.get(x, -1) for x in g.patterns]
            self.sizes[k, : g.n] = [sizes[x] for x in g.sizes]
        self.figures, self.signed = np.stack([g.figures for g in groups]), groups[0].signed


class Pairs:
    """Every query of a side, all of one number of members, against every group of another."""

    def __init__(self, q: Side, c: Side, alike: np.ndarray, sizes: list):
        self.q, self.c, self.size_names = q, c, sizes
        p = 1 - np.sqrt(((q.moves[:, None, :, None, :] - c.moves[None, :, None, :, :]) ** 2).sum(axis=4)) / 50_000
        self.positions = np.where(p > 0, p, 0.0)
        self.patterns = alike[q.patterns[:, None, :, None], c.patterns[None, :, None, :]]
        self.arrangement = np.stack([self._arrangement(x) for x in q.figures])
        self.members = q.n[:, None] + c.n[None, :]

    def _arrangement(self, x: np.ndarray, reach: float = 50_000.0) -> np.ndarray:
        y = self.c.figures
        alike = np.maximum(0.0, 1 - np.abs(x - y) / np.where(self.q.signed, reach, np.maximum(1.0, np.maximum(np.abs(x), np.abs(y)))))
        known = ~np.isnan(alike)
        return np.where(known, alike, 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)

    def sizes(self, score) -> np.ndarray:
        """``score(size, size)`` of the members."""
        table = np.zeros((len(self.size_names) + 1, len(self.size_names) + 1))
        for i in set(self.q.sizes.ravel().tolist()) - {-1}:
            for j in set(self.c.sizes.ravel().tolist()) - {-1}:
                table[i, j] = score(self.size_names[i], self.size_names[j])
        return table[self.q.sizes[:, None, :, None], self.c.sizes[None, :, None, :]]

    def chosen(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, sum) of the scores of the members that the best assignment brings together."""
        score = np.where(self.c.there[None, :, None, :], score, 0.0)
        flat = score.reshape(-1, *score.shape[2:])
        at = O.best_assignments(flat)
        picked = np.where(at >= 0, np.take_along_axis(flat, np.maximum(at, 0)[:, :, None], axis=2)[:, :, 0], 0.0)
        return (at >= 0).sum(axis=1).reshape(score.shape[:2]), picked.sum(axis=1).reshape(score.shape[:2])


#: Numbers of members up to which candidates stand side by side; queries whose patterns are compared at once; numbers of a matrix.
WIDTHS, ASKED, NUMBERS = (4, 8, 16), 64, 500_000


def in_pairs(groups: DataFrame, queries: DataFrame, score, schema: str, rows: int = 1000) -> DataFrame:
    """``score(pairs)`` columns, a value per query and candidate (more in front of these where it gives several rows a pair), for every
    pair of a bucket but a group with itself; frames have id, bucket and ms, which is a ``Group`` then."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def found(q: list[dict], c: list[dict]):
        sizes = {x: k for k, x in enumerate(dict.fromkeys(x for r in [*q, *c] for x in r["ms"].sizes))}
        others = {x: k for k, x in enumerate(dict.fromkeys(x for r in c for x in r["ms"].patterns if x))}
        kinds = [Side(part, others, sizes) for low, high in zip((-1, *WIDTHS), (*WIDTHS, math.inf)) if (part := [r for r in c if low < r["ms"].n <= high])]
        q = sorted(q, key=lambda r: r["ms"].n)
        for asked in (q[i : i + ASKED] for i in range(0, len(q), ASKED)):
            words = {x: k for k, x in enumerate(dict.fromkeys(x for r in asked for x in r["ms"].patterns if x))}
            alike = _alike([*words], [*others])
            for n in dict.fromkeys(r["ms"].n for r in asked):
                mine = [r for r in asked if r["ms"].n == n]
                for there in kinds:
                    step = max(1, NUMBERS // there.there.size // n)
                    for at in range(0, len(mine), step):
                        side = Side(mine[at : at + step], words, sizes)
                        got = score(Pairs(side, there, alike, [*sizes]))
                        got |= {"query_id": side.ids[:, None], "group_vector_id": there.ids[None, :]}
                        shape = np.broadcast_shapes(*[np.shape(v) for v in got.values()])
                        keep = np.broadcast_to(side.ids[:, None] != there.ids[None, :], shape)
                        yield pd.DataFrame({k: np.broadcast_to(got[k], shape)[keep] for k in columns})

    def run(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = ([r | {"ms": Group(r["ms"])} for r in x.to_dict("records")] for x in (asked, pdf)) if len(asked) and len(pdf) else ([], [])
        out = [*found(q, c)] if q and c else []
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: pd.Series([], dtype=object) for k in columns})

    return in_blocks(groups, queries, run, schema, rows=rows, width=4 * shuffle_width(groups.sparkSession))


@query("r11_group_score")
def r11(spark, root):
    """Every group whose identifier is divisible by 100 against the other groups of its utility: assignment of members, arrangement, score."""
    g = A.groups(spark, root).select("group_vector_id", "utility").join(_members(spark, root), "group_vector_id")
    g = cut_lineage(g.select(F.col("group_vector_id").alias("id"), F.col("utility").alias("bucket"), "ms"))

    def f(pairs):
        known = ~np.isnan(pairs.patterns)
        score = (pairs.positions + np.where(known, pairs.patterns, 0.0)) / (1 + known) * pairs.sizes(lambda x, y: 1.0 if x == y else 0.5)
        total, coverage, mean = O.group_scores(*pairs.chosen(score), pairs.members, pairs.arrangement)
        return {k: np.round(v, 6) for k, v in (("score", total), ("coverage", coverage), ("matched", mean), ("arrangement", pairs.arrangement))}

    return in_pairs(g, g.where(hundredth("id")), f, "query_id string, group_vector_id string, score double, coverage double, matched double, arrangement double")


@query("r08_bend_match")
def r08(spark, root):
    """Bend sequences of every line against those of every line whose identifier is divisible by 100.

    Lines bend alike: every two sequences are compared once, and their match is brought to the lines that have them.
    """
    b = F.array_sort(F.collect_list(F.struct("i", "zone", "transition", F.col("sequence").cast("string").alias("cause"))))
    c = P.w07(spark, root).groupBy("guid").agg(b.alias("b")).select("guid", F.transform("b", lambda x: F.struct(x["zone"], x["transition"], x["cause"])).alias("b"))
    c = cut_lineage(c.select("guid", "b", F.to_json("b").alias("shape")))
    q = c.where(hundredth("guid"))
    shapes = c.groupBy("shape").agg(F.count("*").alias("n"), F.first("b").alias("b"))
    asked = q.groupBy("shape").agg(F.first("b").alias("qb"))
    asked = asked.groupBy(F.pmod(F.xxhash64("shape"), F.lit(max(1, -(-asked.count() // 1000)))).alias("block")).agg(F.collect_list(F.struct(F.col("shape").alias("q_shape"), "qb")).alias("qs"))

    def bends(b):
        return tuple((x["zone"], x["transition"], x["cause"]) for x in b)

    def f(row):
        mine = bends(row["b"])
        return [{"shape": row["shape"], "n": row["n"], "q_shape": x["q_shape"], "match": round(O.bend_match(bends(x["qb"]), mine), 6)} for x in row["qs"]]

    spread = shapes.repartition(4 * shuffle_width(spark), "shape")  # comparing takes long for their bytes
    known = cut_lineage(O.map_rows(spread.crossJoin(asked.select("qs")), f, "shape string, n bigint, q_shape string, match double"))
    # a shape of many lines is there several times, so that no task has all of them
    known = known.join(q.select("guid", F.col("shape").alias("q_shape")), "q_shape").groupBy("shape", "n").agg(F.collect_list(F.struct(F.col("guid").alias("query_id"), "match")).alias("qs"))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 500).cast("int"))))
    parts = c.select("guid", "shape").join(shapes.select("shape", "n"), "shape")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("guid"), F.floor((F.col("n") - 1) / 500).cast("int") + 1).cast("int"))
    return parts.select("guid", "shape", "part").join(known.select("shape", "part", "qs").hint("merge"), ["shape", "part"]).select("guid", F.inline("qs")).select("query_id", "guid", "match")


def plan_pieces(spark, root):
    """Axis-parallel plan pieces per line, neighbours of one direction merged."""
    e = P.exploded(spark, root).withColumn("l2", F.hypot("dx", "dy")).where("len >= 1 and l2 >= 300")
    return e.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("i", "dx", "dy", "l2", "a", "b"))).alias("es"))


def _pieces(es) -> list[dict]:
    out: list[dict] = []
    for e in es:
        d = "X" if abs(e["dx"]) / e["l2"] >= 0.9 else "Y" if abs(e["dy"]) / e["l2"] >= 0.9 else "D"
        lo, hi, at = (("x", "x", "y") if d == "X" else ("y", "y", "x")) if d != "D" else ("x", "x", "y")
        ends = sorted((e["a"][lo], e["b"][hi]))
        if out and d != "D" and out[-1]["dir"] == d:
            out[-1]["lo"], out[-1]["hi"] = min(out[-1]["lo"], ends[0]), max(out[-1]["hi"], ends[1])
            out[-1]["len"] = out[-1]["hi"] - out[-1]["lo"]
        else:
            out.append({"dir": d, "lo": ends[0], "hi": ends[1], "at": (e["a"][at] + e["b"][at]) / 2, "len": e["l2"]})
    return out


@query("g14_bundles")
def g14(spark, root):
    """Bundles of parallel lines per equipment and utility group (a key holds the lines of one machine)."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), F.upper("main_equipment_name").alias("equipment"), "utility_group").where("equipment is not null and utility_group is not null")
    per = plan_pieces(spark, root).join(s, "guid").groupBy("equipment", "utility_group").agg(F.array_sort(F.collect_list(F.struct("guid", "es"))).alias("rs")).where("size(rs) > 1")

    def f(row):
        found = O.bundles({r["guid"]: _pieces(r["es"]) for r in row["rs"]})
        return [{"equipment": row["equipment"], "utility_group": row["utility_group"], "n_members": len(b["members"]), "length_mm": round(b["length"], 3), "pitch_mm": round(b["pitch"], 3), "pattern": b["pattern"], "members": ",".join(b["members"])} for b in found]

    return O.map_rows(per, f, "equipment string, utility_group string, n_members int, length_mm double, pitch_mm double, pattern string, members string")


# ---- routing


#: Millimetres around a task's ends in which boxes are loaded: as far as the first one that settles the task; at last every box.
MARGINS = (1500.0, 6000.0, 24000.0, None)
_SIDES = [f"{e}{c}" for e in ("min", "max") for c in "xyz"]


def _ends(spark, root):
    return A.routes(spark, root).select(F.col("guid").alias("id"), *[F.col(f"{e}_pos{c}").alias(f"{e[0]}{c}") for e in ("source", "target") for c in "xyz"]).dropna()


def _near(spark, root, box, margin: float):
    """(id, boxes): the boxes that each box (id, corners), grown by ``margin``, touches."""
    near = SP.overlap_join(box, A.obstacles(spark, root), grow=margin, cell=max(4000.0, margin))
    return near.groupBy(F.col("a_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("b_id", *["b_" + s for s in _SIDES]))).alias("boxes"))


#: Tasks of one tile of the plan (sides in millimetres) that share their boxes: more of them stand in several rows.
TILE, TOGETHER = 6000.0, 128


def tasks(spark, root, margin: float = 1500.0, only=None):
    """Every route (or those whose id is a ``unit`` of ``only``) as a task; those of one tile together, with the boxes that the
    box around them, grown by ``margin``, touches: a box moves once per tile and not once per task."""
    r = _ends(spark, root)
    if only is not None:
        r = r.join(only, F.col("id") == F.col("unit"), "left_semi")
    tile = [F.floor((F.col("s" + c) + F.col("t" + c)) / 2 / TILE).alias("tile_" + c) for c in "xy"]
    r = r.select("*", *tile).withColumn("part", F.floor((F.row_number().over(W.partitionBy("tile_x", "tile_y").orderBy("id")) - 1) / TOGETHER))
    per = r.groupBy(F.concat_ws("_", "tile_x", "tile_y", "part").alias("tile")).agg(F.collect_list(F.struct("id", *[e + c for e in "st" for c in "xyz"])).alias("ts"), *_hull())
    near = _near(spark, root, per.select(F.col("tile").alias("id"), *_SIDES), margin)
    per = per.select("tile", "ts").join(near.withColumnRenamed("id", "tile"), "tile", "left")
    return per.repartition(4 * shuffle_width(spark), "tile")  # searches take long for their bytes


def _hull() -> list:
    """The box around the ends of tasks."""
    return [F.min(F.least(f"s{c}", f"t{c}")).alias("min" + c) for c in "xyz"] + [F.max(F.greatest(f"s{c}", f"t{c}")).alias("max" + c) for c in "xyz"]


def _everywhere(ob: DataFrame, ends: DataFrame) -> float:
    """A margin around any task that takes in every box and its surroundings."""
    low = [F.min("min" + c) for c in "xyz"] + [F.min(F.least("s" + c, "t" + c)) for c in "xyz"]
    high = [F.max("max" + c) for c in "xyz"] + [F.max(F.greatest("s" + c, "t" + c)) for c in "xyz"]
    lo, hi = ([*ob.agg(*v[:3]).first(), *ends.agg(*v[3:]).first()] for v in (low, high))
    return max([max(h for h in hi[i::3] if h is not None) - min(v for v in lo[i::3] if v is not None) for i in range(3) if any(v is not None for v in lo[i::3])], default=0.0) + 3000.0


def widened(spark, root, load, route):
    """Results of ``route(margin, last)`` over ``load(margin, units)``; units with ``more`` are done again with a larger margin.

    A search stays where all boxes are loaded, so what it finds is free and what it does not find may be farther out.
    """
    done, todo = [], None
    for margin in MARGINS:
        last = margin is None
        margin = _everywhere(A.obstacles(spark, root), _ends(spark, root)) if last else margin
        out = cut_lineage(O.map_long_rows(load(margin, todo), route(margin, last), _OUT + ", unit string, more boolean"))
        done.append(out.where("not more"))
        todo = out.where("more").select("unit").distinct()
        if last or todo.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done).drop("unit", "more")


def confined(spark, root, find):
    """Every route as a task of its own; ``find(a, b, boxes, margin)`` gives the code, the path, and whether a larger region may do better."""
    def route(most, last):
        tried = [most] if last or most <= MARGINS[0] else [most / 2, most]

        def f(row):
            every = _sides(row)
            out = []
            for t in row["ts"] if "ts" in row else [row]:
                a, b = _task(t)
                for margin in tried:
                    boxes = _touched(every, R.region((a, b), margin))
                    code, path, more = find(a, b, boxes, margin)
                    if not more and code != "NODE_LIMIT":
                        break
                out += [r | {"unit": t["id"], "more": bool(more and not last)} for r in _result(t, code, path, boxes)]
            return out

        return f

    return widened(spark, root, lambda margin, todo: tasks(spark, root, margin, todo), route)


def _better_outside(code, path, a, b, margin, turn=1000.0) -> bool:
    """Whether a way that leaves the region could be found or be cheaper: out and back it is twice the margin longer and has two turns.

    NODE_LIMIT is the operator's own end.
    """
    direct = sum(abs(x - y) for x, y in zip(a, b))
    return code == "NO_PATH" or (code == "OK" and R.length(path) + turn * R.bends(path) > direct + 2 * margin + 2 * turn)


#: The operator's production settings: cells of 500 mm and 100,000 nodes per task.
PRODUCTION = R.Options(cell=500.0, max_nodes=100_000)


def _sides(row) -> np.ndarray:
    """Corners of a row's boxes; the first column is the box's identifier."""
    return row["boxes"][:, 1:] if row["boxes"] is not None else np.empty((0, 6))


def _touched(sides: np.ndarray, box) -> list:
    """The boxes that ``box`` touches."""
    return [tuple(b) for b in sides[(sides[:, :3] <= box[3:]).all(axis=1) & (sides[:, 3:] >= box[:3]).all(axis=1)].tolist()]


def _task(t) -> tuple:
    return tuple(t[f"s{c}"] for c in "xyz"), tuple(t[f"t{c}"] for c in "xyz")


_OUT = "id string, code string, n_points int, bends int, length_mm double, free boolean"


def _result(row, code, path, boxes, clearance=0.0):
    return [{"id": row["id"], "code": code, "n_points": len(path), "bends": R.bends(path) if path else 0, "length_mm": round(R.length(path), 3), "free": R.free(path, boxes, clearance) if path else False}]


@query("x01_voxel_routes")
def x01(spark, root):
    def find(a, b, boxes, margin):
        code, path, _ = R.voxel_route(a, b, boxes, PRODUCTION, within=R.region((a, b), margin))
        return code, path, _better_outside(code, path, a, b, margin)

    return confined(spark, root, find)


@query("x02_waypoint_routes")
def x02(spark, root):
    def find(a, b, boxes, margin):
        mid = tuple((x + y) / 2 for x, y in zip(a, b))
        code, path, _ = R.waypoint_route([a, mid, b], boxes, PRODUCTION, within=R.region((a, b), margin))
        return code, path, _better_outside(code, path, a, b, margin)

    return confined(spark, root, find)


@query("x03_bundle_routes")
def x03(spark, root):
    def find(a, b, boxes, margin):
        free = margin - 200.0  # half the bundle's width
        code, path, _ = R.bundle_route(a, b, 400.0, boxes, PRODUCTION, within=R.region((a, b), free))
        return code, path, _better_outside(code, path, a, b, free)

    return confined(spark, root, find)


@query("x06_guided_routes")
def x06(spark, root):
    def find(a, b, boxes, margin):
        guides = tuple(tuple(x + (y - x) * t for x, y in zip(a, b)) for t in (0.25, 0.5, 0.75))
        options = R.Options(cell=50.0, guides=guides, guide_factor=0.8, weight=1.5, max_nodes=200_000)
        code, path, _ = R.voxel_route(a, b, boxes, options, within=R.region((a, b), margin))
        return code, path, code == "NO_PATH"

    return confined(spark, root, find)


@query("x07_line_routes")
def x07(spark, root):
    def find(a, b, boxes, margin):
        free = margin - 100.0  # the clearance
        code, path, _ = R.line_route(a, b, boxes, lines=None, within=R.region((a, b), free))
        more = _better_outside(code, path, a, b, free)
        return code, R.pulled(path, boxes, 100.0) if path and not more else path, more

    return confined(spark, root, find)


@query("x09_rubber_band")
def x09(spark, root):
    def find(a, b, boxes, margin):
        path, left = R.pushed(R.decomposed(a, b, "zxy"), boxes)
        more = not R.within(path, R.region((a, b), margin - 100.0))
        return "OK" if not left else "NO_PATH", R.pulled(path, boxes) if not left and not more else path, more

    return confined(spark, root, find)


class Laid:
    """Boxes of the pipes laid so far and their utilities, as one matrix that doubles as it fills."""

    def __init__(self):
        self.n, self.sides, self.utility, self.codes = 0, np.empty((64, 6)), np.empty(64, dtype=np.int64), {}

    def add(self, utility, box) -> None:
        if self.n == len(self.sides):
            self.sides, self.utility = np.concatenate([self.sides] * 2), np.concatenate([self.utility] * 2)
        self.sides[self.n], self.utility[self.n] = box, self.codes.setdefault(utility, len(self.codes))
        self.n += 1

    def near(self, utility, a, b, loaded) -> list:
        """Those of other utilities that ``loaded`` touches and that hold neither end."""
        return [tuple(r) for r in self.near_sides(utility, a, b, loaded).tolist()]

    def near_sides(self, utility, a, b, loaded) -> np.ndarray:
        x = self.sides[: self.n]
        keep = (self.utility[: self.n] != self.codes.get(utility, -1)) & (x[:, :3] <= loaded[3:]).all(axis=1) & (x[:, 3:] >= loaded[:3]).all(axis=1)
        for p in (a, b):
            keep &= ~((x[:, :3] < p) & (p < x[:, 3:])).all(axis=1)
        return x[keep]


#: Millimetres that a sequential route keeps clear of boxes, and half the side of the pipe it lays.
CLEAR, HALF = 100.0, 50.0


#: Tasks whose ends are looked up at once, so that few tiles are read for one end.
AT_ONCE = 50_000


def _joined(batches):
    """The rows in batches of about ``AT_ONCE`` or more, if there are as many."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, n = [], 0
    if n:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


class Bays:
    """mapInArrow function over tasks sorted by bay: each is routed past the boxes and the pipes that its bay has got so far.

    Whether boxes hold an end is found for a batch at once; tasks that start in a box are done with that.
    """

    def __init__(self, folder: str, far: float):
        self.folder, self.margins = folder, [m for m in MARGINS if m is not None and m < far] + [far]
        self.schema = to_arrow_schema(StructType.fromDDL(_OUT))

    def __call__(self, batches):
        tiles, unit, laid = T.opened(self.folder), None, Laid()
        for batch in _joined(batches):
            ends = np.stack([batch[e + c].to_numpy() for e in "st" for c in "xyz"], axis=1).astype(float)
            out = {"id": batch["id"].to_pylist(), "code": ["START_BLOCKED"] * len(ends)} | {n: [0] * len(ends) for n in ("n_points", "bends", "length_mm")} | {"free": [False] * len(ends)}
            go = np.flatnonzero(~tiles.held(ends[:, :3], CLEAR))
            shut = tiles.held(ends[go, 3:], CLEAR)
            units, utilities = batch["unit"].to_pylist(), batch["utility"].to_pylist()
            for i, goal_shut in zip(go.tolist(), shut.tolist()):
                if units[i] != unit:
                    unit, laid = units[i], Laid()
                a, b = tuple(ends[i, :3].tolist()), tuple(ends[i, 3:].tolist())
                code, path, boxes = self.routed(tiles, laid, utilities[i], a, b, goal_shut)
                for p, q in zip(path, path[1:]):
                    laid.add(utilities[i], (*[min(p[k], q[k]) - HALF for k in range(3)], *[max(p[k], q[k]) + HALF for k in range(3)]))
                for name, v in _result({"id": out["id"][i]}, code, path, boxes)[0].items():
                    out[name][i] = v
            yield pa.RecordBatch.from_pydict({n: out[n] for n in self.schema.names}, schema=self.schema)

    def routed(self, tiles, laid: Laid, utility, a, b, goal_shut: bool) -> tuple:
        """(code, path, boxes): searched with the boxes and pipes around the ends, as far as the first margin that settles it."""
        for margin in self.margins:
            around = R.region((a, b), margin)
            other = laid.near_sides(utility, a, b, around)
            if goal_shut:  # by a box, so pipes only tell whether the start is shut as well
                return "START_BLOCKED" if R.holds(a, other, CLEAR) else "GOAL_BLOCKED", [], other
            boxes = tiles.touched(around)
            free = margin - CLEAR
            code, path, _ = R.line_route(a, b, np.concatenate([boxes, other]), CLEAR, lines=None, within=R.region((a, b), free))
            if not _better_outside(code, path, a, b, free):
                break
        return code, path, boxes


@query("v05_sequential_routes")
def v05(spark, root):
    """Tasks of one bay routed one after another: earlier pipes of other utilities are obstacles for later ones."""
    ends = [F.col(f"{e}_pos{c}").cast("double").alias(f"{e[0]}{c}") for e in ("source", "target") for c in "xyz"]
    r = A.routes(spark, root).select(F.coalesce("bay", F.lit("")).alias("unit"), F.col("guid").alias("id"), "utility", *ends)
    r = cut_lineage(r.dropna(subset=["id", *[e + c for e in "st" for c in "xyz"]]).repartition(4 * shuffle_width(spark), "unit").sortWithinPartitions("unit", "id"))
    ob = A.obstacles(spark, root)
    far = _everywhere(ob, r)
    with T.laid_out(ob) as folder:
        return cut_lineage(r.mapInArrow(Bays(folder, far), _OUT))


@query("g46_parallel_offsets", "leg", "WITH f AS (SELECT guid, x, y, dx, dy, sqrt(power(dx, 2) + power(dy, 2)) AS d FROM leg WHERE i = 1 AND sqrt(power(dx, 2) + power(dy, 2)) > 1) SELECT guid, k AS pipe, round(x - dy / d * (k - 1) * 150, 3) AS x, round(y + dx / d * (k - 1) * 150, 3) AS y FROM f, (VALUES (0), (1), (2)) t(k)")
def g46(spark, root):
    """Three pipes side by side along the first leg's normal."""
    d = P.exploded(spark, root).where("i = 0").withColumn("d", F.hypot("dx", "dy")).where("d > 1")
    d = d.withColumn("pipe", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    off = (F.col("pipe") - 1) * 150.0
    return d.select("guid", "pipe", F.round(F.col("a.x") - F.col("dy") / F.col("d") * off, 3).alias("x"), F.round(F.col("a.y") + F.col("dx") / F.col("d") * off, 3).alias("y"))


@query("v06_rounded_bends")
def v06(spark, root):
    def f(row):
        p = O.xyz(row["pts"])
        r = R.rounded(p, 150.0)
        return [{"guid": row["guid"], "n_points": len(r), "length_mm": round(R.length(r), 3)}]

    return O.map_rows(A.polylines(spark, root), f, "guid string, n_points int, length_mm double")


@query("v11_stitched")
def v11(spark, root):
    """A route's stubs joined where their ends lie within 300 mm."""
    s = A.stubs(spark, root).select(F.col("pattern_id").alias("guid"), "route_path_guid").join(A.polylines(spark, root), "guid").where("route_path_guid is not null")
    per = s.groupBy("route_path_guid").agg(F.array_sort(F.collect_list(F.struct("guid", "pts"))).alias("ps"))

    def f(row):
        out = O.stitched([[(q["x"], q["y"], q["z"]) for q in p["pts"]] for p in row["ps"]])
        return [{"route": row["route_path_guid"], "n_parts": len(row["ps"]), "n_lines": len(out), "length_mm": round(sum(R.length(x) for x in out), 3)}]

    return O.map_rows(per, f, "route string, n_parts int, n_lines int, length_mm double")


@query("v08_comparison", "leg route stub", r"""WITH l AS (SELECT guid, sum(len) AS len, count(*) AS n FROM leg GROUP BY guid) SELECT s.pattern_id, round(l.len - s.stub_length_mm, 3) + 0.0 AS length_delta, l.n - s.n_bends - 1 AS bend_delta FROM stub s JOIN l ON l.guid = s.pattern_id WHERE s.stub_length_mm IS NOT NULL AND s.n_bends IS NOT NULL""")
def v08(spark, root):
    l = P.exploded(spark, root).groupBy("guid").agg(F.sum("len").alias("len"), F.count("*").alias("n"))
    s = A.stubs(spark, root).where("stub_length_mm is not null and n_bends is not null").select(F.col("pattern_id").alias("guid"), "stub_length_mm", "n_bends")
    j = s.join(l, "guid")
    return j.select(F.col("guid").alias("pattern_id"), (F.round(F.col("len") - F.col("stub_length_mm"), 3) + 0.0).alias("length_delta"), (F.col("n") - F.col("n_bends") - 1).alias("bend_delta"))


@query("x12_decomposed", "route", "SELECT guid, CAST(CASE WHEN abs(target_posx - source_posx) > 1e-9 THEN 1 ELSE 0 END + CASE WHEN abs(target_posy - source_posy) > 1e-9 THEN 1 ELSE 0 END + CASE WHEN abs(target_posz - source_posz) > 1e-9 THEN 1 ELSE 0 END AS INT) AS n_legs, round(abs(target_posx - source_posx) + abs(target_posy - source_posy) + abs(target_posz - source_posz), 3) AS length_mm FROM route")
def x12(spark, root):
    d = {c: F.abs(F.col(f"target_pos{c}") - F.col(f"source_pos{c}")) for c in "xyz"}
    n = sum((F.when(v > 1e-9, 1).otherwise(0) for v in d.values()), F.lit(0))
    return A.routes(spark, root).select("guid", n.alias("n_legs"), F.round(d["x"] + d["y"] + d["z"], 3).alias("length_mm"))


@query("x13_without_collinear")
def x13(spark, root):
    def f(row):
        return [{"guid": row["guid"], "n_points": len(R.without_collinear(O.xyz(row["pts"])))}]

    return O.map_rows(A.polylines(spark, root), f, "guid string, n_points int")


@query("e35_first_collision", "leg obstacle", """WITH h AS (SELECT l.guid, l.i, o.id FROM leg l JOIN obstacle o ON least(l.x, nx) <= maxx + 50 AND greatest(l.x, nx) >= minx - 50 AND least(l.y, ny) <= maxy + 50 AND greatest(l.y, ny) >= miny - 50 AND least(l.z, nz) <= maxz + 50 AND greatest(l.z, nz) >= minz - 50) SELECT guid, CAST(i - 1 AS INT) AS i, min(id) AS first_id, count(*) AS n FROM h GROUP BY guid, i""")
def e35(spark, root):
    """Boxes that touch a leg's box grown by 50 mm: the first by identifier, and how many."""
    e = P.exploded(spark, root).select(F.concat_ws("#", "guid", F.col("i").cast("string")).alias("id"), "guid", "i", *[f(F.col("a")[c], F.col("b")[c]).alias(n + c) for n, f in (("min", F.least), ("max", F.greatest)) for c in "xyz"])
    hits = SP.overlap_join(e, A.obstacles(spark, root), grow=50.0)
    n = hits.groupBy("a_id").agg(F.min("b_id").alias("first_id"), F.count("*").alias("n"))
    return n.join(e.select(F.col("id").alias("a_id"), "guid", "i"), "a_id").select("guid", "i", "first_id", "n")


QUERIES = Q
