"""Runs of consecutive like events: adjacent agglomeration per entity.

The events of an entity form a linked list of runs.  A priority queue holds the neighbouring pairs
that meet the similarity and gap limits; the most similar pair is merged first (ties: the earlier
one), its neighbours are scored anew, until no pair is left.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The ways in which plus and minus are written in direction tokens.
SIGNS = str.maketrans({"＋": "+", "﹢": "+", "–": "-", "−": "-", "—": "-", "‐": "-", "‑": "-", "－": "-", "﹣": "-"})
AXES = ("+x", "-x", "+y", "-y", "+z", "-z")
_AXIS = {a: a for a in AXES} | {a[::-1]: a for a in AXES}
_CUT = re.compile(r"[,|>;\s]+")
SHORT_LEG_MM = 1.0


class Run:
    """One run: its positions, event count, duration, label and feature vector."""

    __slots__ = ("first", "last", "n", "duration", "label", "vector")

    def __init__(self, pos: int, label, duration: float | None = None, vector: tuple | None = None):
        self.first = self.last = pos
        self.n, self.label, self.duration, self.vector = 1, label, duration, vector

    def absorb(self, other: Run) -> None:
        self.last, self.n = other.last, self.n + other.n
        if self.duration is not None and other.duration is not None:
            self.duration += other.duration
        if self.vector is not None and other.vector is not None:
            self.vector = tuple(a + b for a, b in zip(self.vector, other.vector))


def same_label(a: Run, b: Run) -> float:
    """1 for equal labels; a run without a label is like nothing."""
    return 1.0 if a.label is not None and a.label == b.label else 0.0


def same_direction(a: Run, b: Run) -> float:
    """Cosine of the runs' total displacements; 1 next to a run that does not move."""
    na, nb = math.sqrt(sum(x * x for x in a.vector)), math.sqrt(sum(x * x for x in b.vector))
    if na == 0 or nb == 0:
        return 1.0
    return sum(x * y for x, y in zip(a.vector, b.vector)) / (na * nb)


def no_gap(a: Run, b: Run) -> float:
    return 0.0


def agglomerate(
    runs: list[Run],
    similarity: Callable[[Run, Run], float] = same_label,
    min_similarity: float = 1.0,
    gap: Callable[[Run, Run], float] = no_gap,
    max_gap: float = 0.0,
) -> list[Run]:
    """Merge neighbouring runs until no pair has ``similarity >= min_similarity`` and ``gap <= max_gap``."""
    n = len(runs)
    heap: list[tuple[float, int, int, int, int]] = []
    for i in range(n - 1):
        s = similarity(runs[i], runs[i + 1])
        if s >= min_similarity and gap(runs[i], runs[i + 1]) <= max_gap:
            heap.append((-s, i, i + 1, 0, 0))
    if not heap:
        return runs
    heapq.heapify(heap)
    after, before, version = [*range(1, n), -1], [-1, *range(n - 1)], [0] * n
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if version[i] != vi or version[j] != vj:
            continue  # one of the two has changed or gone since
        runs[i].absorb(runs[j])
        version[i] += 1
        version[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0:
                s = similarity(runs[a], runs[b])
                if s >= min_similarity and gap(runs[a], runs[b]) <= max_gap:
                    heapq.heappush(heap, (-s, a, b, version[a], version[b]))
    return [r for r, v in zip(runs, version) if v >= 0]


def direction_tokens(text: str | None) -> list[str | None]:
    """Events of a direction text: signed axes, and None for a token that names none; blank tokens are no events."""
    if text is None:
        return []
    head = text.lstrip()
    if head[:1] == "[":
        try:
            raw = json.loads(head)
            parts = [x if isinstance(x, str) else json.dumps(x) for x in raw] if isinstance(raw, list) else [text]
        except ValueError:
            parts = _CUT.split(head.strip().strip("[]").replace('"', ""))
    else:
        parts = _CUT.split(text)
    out = []
    for part in parts:
        t = part.strip()
        if t:
            out.append(_AXIS.get(t) or _AXIS.get("".join(t.translate(SIGNS).lower().split())))
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _point(p) -> tuple[float, float, float] | None:
    if isinstance(p, str):
        p = re.split(r"[;,\s]+", p.strip())
    elif isinstance(p, dict):
        q = {k.strip().lower(): v for k, v in p.items()}
        p = [q.get("x"), q.get("y"), q.get("z")]
    if not isinstance(p, list) or len(p) != 3 or any(isinstance(v, bool) for v in p):
        return None
    try:
        x, y, z = float(p[0]), float(p[1]), float(p[2])
    except (TypeError, ValueError):
        return None
    return (x, y, z) if math.isfinite(x) and math.isfinite(y) and math.isfinite(z) else None


def points(text: str | None) -> list[tuple[float, float, float]]:
    """Points of a JSON list; none if the text is no valid JSON list or holds something that is no point."""
    if text is None:
        return []
    try:
        raw = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return []
    if not isinstance(raw, list):
        return []
    out = [tuple(map(float, p)) if type(p) is list and len(p) == 3 and type(p[0]) is type(p[1]) is type(p[2]) is float else _point(p) for p in raw]
    return [] if None in out else out


def legs(pts: list[tuple[float, float, float]]) -> list[Run]:
    """Legs as runs: axis of largest displacement (ties: x, y, z), length in mm; short legs take their neighbour's axis."""
    out: list[Run] = []
    label = None
    for i in range(len(pts) - 1):
        (ax, ay, az), (bx, by, bz) = pts[i], pts[i + 1]
        dx, dy, dz = bx - ax, by - ay, bz - az
        length = math.sqrt(dx * dx + dy * dy + dz * dz)
        if length >= SHORT_LEG_MM:
            mx, my, mz = abs(dx), abs(dy), abs(dz)
            if mx >= my and mx >= mz:
                new = "+x" if dx >= 0 else "-x"
            elif my >= mz:
                new = "+y" if dy >= 0 else "-y"
            else:
                new = "+z" if dz >= 0 else "-z"
            if label is None:
                for r in out:  # short legs at the start
                    r.label = new
            label = new
        out.append(Run(i, label, length, (dx, dy, dz)))
    if label is None:
        for r in out:  # nothing but short legs: each is like the one before it
            r.label = "none"
    return out


SCHEMA = "pattern_id string, seq_field string, run_no int, axis string, first_pos int, last_pos int, n_events int, duration_mm double"


def _collapse(near: float | None, least: int):
    def rows(ident: str, field: str, runs: list[Run], out: tuple[list, ...]) -> None:
        for k, r in enumerate(runs):
            if r.n >= least:
                for column, v in zip(out, (ident, field, k, r.label, r.first, r.last, r.n, r.duration)):
                    column.append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        names = [c.strip().split()[0] for c in SCHEMA.split(",")]
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in kinds)
            for ident, dirs, pts in zip(*(batch.column(c).to_pylist() for c in ("_id", "_dirs", "_points"))):
                tokens = [Run(i, t) for i, t in enumerate(direction_tokens(dirs))]
                if near is None:
                    rows(ident, "dir_seq", agglomerate(tokens), out)
                    rows(ident, "stub_points", agglomerate(legs(points(pts))), out)
                else:
                    rows(ident, "stub_points", agglomerate(legs(points(pts)), same_direction, near), out)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def collapse_runs(
    df: DataFrame, ident: str, directions: str, path: str, *, version: str | None = None, near: float | None = None, least: int = 1
) -> DataFrame:
    """Every run of every entity as one row: axis, positions (from 0), event count and length in mm.

    ``near`` None: events are equal if they name the same signed axis.  Otherwise only the legs are
    merged, as long as the cosine of two neighbouring runs' displacements is at least ``near``.
    ``least`` leaves out runs of fewer events.

    * A blank token is no event; one that names no axis is a run of its own, ``axis`` NULL.
    * A leg under 1 mm takes the axis of the leg before it (at the start: of the first longer one).
    * NULL, empty, broken texts have no events; so has a list with an entry that is no point.
    * Repeated rows count once; of several versions of one identifier the one with the greatest ``version``
      counts, among equal ones (or without it) the least row. A NULL identifier is an entity like any other.
    * ``duration_mm`` is NULL for direction tokens. Other columns of ``df`` are not read.
    """
    cols = [F.col(ident).cast("string").alias("_id"), F.col(directions).alias("_dirs"), F.col(path).alias("_points")]
    row = F.struct("_dirs", "_points")
    if version is None:
        best = F.min(row)
    else:
        cols.append(F.col(version).alias("_version"))
        # least row of the newest version: both in one pass, without a sort
        best = F.min_by(row, F.struct(-F.coalesce(F.unix_micros(F.col("_version").cast("timestamp")), F.lit(-(2**62))), row))
    once = df.select(*cols).groupBy("_id").agg(best.alias("_v")).select("_id", "_v.*")
    return once.mapInArrow(_collapse(near, least), SCHEMA)
