"""Frequent subsequences across many sequences, by direct sequence comparison.

The entities of a partition stand sorted by their k-minimum subsequence, the least pattern of length k
they show.  If the first and the threshold-th of them agree, that pattern is frequent there, the weight
of those that stand at it is its support, and they move on to their next pattern; if not, all
below the threshold-th one's pattern move straight to it or beyond, and what they pass is never
counted.  The next pattern at or above a bound is searched for when it is asked for, among extensions
of frequent patterns only; patterns are never listed beforehand.

A pattern that is frequent over all is frequent in some partition.  Partitions are compared at a
``slack`` of their share of the threshold, so that nearly every partition tells the support of a
frequent pattern; the sum of what was told, with at most the slack for each partition that was silent, rules
out the others.  Only where a pattern is left and a partition was silent, the comparison is repeated
there for just these patterns.

Their number is bounded whatever the data's size: entities that show at most m patterns each leave at
most m / ((1 - slack) * support) of them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.functions.text import norm_guid
from pipeloom.llm.runs import AXES, direction_tokens
from pipeloom.session import cut_lineage

#: One character per step; a dot stands for a token that names no axis.
CODES = dict(zip(AXES, "abcdef"))
STEPS = {v: k for k, v in CODES.items()} | {c: c for c in "RHD"}
STRANGER = "."


def collapsed_axes(text: str | None) -> str:
    """Direction text as one character per run; strangers are never merged."""
    out = []
    for t in direction_tokens(text):
        c = STRANGER if t is None else CODES[t]
        if c == STRANGER or not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def collapsed_letters(text: str | None) -> str:
    """Letters R, H, D in any case and with any separator, runs collapsed."""
    out: list[str] = []
    for c in (text or "").upper():
        if c in "RHD" and (not out or out[-1] != c):
            out.append(c)
    return "".join(out)


def step_masks(sequence: str) -> dict[str, int]:
    """For every step the positions at which it stands, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(sequence):
        if c != STRANGER:
            masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Shown:
    """The patterns that a sequence shows, in order, each found when it is asked for."""

    def __init__(self, sequence: str, max_gap: int):
        self.masks = sorted(step_masks(sequence).items())
        self.max_gap = max_gap

    def least(self, k: int, bound: str = "", beyond: bool = False, among: frozenset[str] | set[str] | None = None) -> str | None:
        """The conditional k-minimum: the least pattern of ``k`` steps that is at least ``bound`` (or ``beyond`` it), or None.

        ``among`` holds the patterns of fewer steps that may be extended; a pattern is only shown where
        its first k - 1 and its last k - 1 steps are.
        """

        def search(prefix: str, ends: int, tight: bool) -> str | None:
            depth = len(prefix)
            if depth:
                after = ends << 1
                for g in range(self.max_gap):
                    after |= ends << 2 + g
            for c, mask in self.masks:
                if tight and depth < len(bound) and c < bound[depth]:
                    continue
                hit = after & mask if depth else mask
                if not hit:
                    continue
                p = prefix + c
                near = tight and bound.startswith(p)
                if depth + 1 == k:
                    if near and beyond and p == bound or k > 1 and among is not None and p[1:] not in among:
                        continue
                    return p
                if among is not None and p not in among:
                    continue
                if (found := search(p, hit, near)) is not None:
                    return found
            return None

        return search("", 0, bool(bound))


def frequent_by_comparison(following: list[Callable[[str, bool], str | None]], weights: list[int], threshold: float) -> list[tuple[str, list[int]]]:
    """Patterns of one length whose weight reaches ``threshold`` (less 1e-9), each with the entities that show it.

    ``following`` gives an entity's least pattern at or above (or beyond) a bound.
    """
    found: list[tuple[str, list[int]]] = []
    at: dict[str, list[int]] = defaultdict(list)  # entities by their present k-minimum
    keys: list[str] = []

    def put(e: int, bound: str, beyond: bool) -> None:
        p = following[e](bound, beyond)
        if p is not None:
            if p not in at:
                heapq.heappush(keys, p)
            at[p].append(e)

    for e in range(len(following)):
        put(e, "", False)
    while keys:
        weight, passed = 0.0, []
        while keys:  # up to the threshold-th
            passed.append(heapq.heappop(keys))
            weight += sum(weights[e] for e in at[passed[-1]])
            if weight >= threshold - 1e-9:
                break
        else:
            break  # fewer than the threshold are left
        goal = passed[-1]
        if passed[0] == goal:
            found.append((goal, at.pop(goal)))
            for e in found[-1][1]:
                put(e, goal, True)
        else:  # no pattern below the threshold-th one's can be frequent
            heapq.heappush(keys, goal)
            for p in passed[:-1]:
                for e in at.pop(p):
                    put(e, goal, False)
    return found


def _compared(least: int, most: int, max_gap: int, shares: dict[str, float]):
    """Patterns frequent in a partition with their weight there; ``shares``: threshold / total weight of every field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        rows: dict[str, list[tuple[str, int, bool]]] = defaultdict(list)
        for batch in batches:
            part = batch.column("_part")[0].as_py() if batch.num_rows else part
            for f, s, e, w in zip(*(batch.column(c).to_pylist() for c in ("_field", "_seq", "_entity", "_w"))):
                rows[f].append((s, w, e is None))
        for field, units in rows.items():
            weights = [w for _, w, _ in units]
            total = sum(weights)
            shown = [Shown(s, max_gap) for s, _, _ in units]
            ok: set[str] = set()
            for k in range(1, most + 1):
                following = [lambda bound, beyond, x=x, k=k: x.least(k, bound, beyond, ok if k > 1 else None) for x in shown]
                found = frequent_by_comparison(following, weights, max(shares[field] * total, 1e-9))
                if not found:
                    break
                ok |= {p for p, _ in found}
                if k >= least:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([field] * len(found)), pa.array([p for p, _ in found]), pa.array([part] * len(found), pa.int32()), pa.array([total] * len(found), pa.int64()),
                        pa.array([sum(weights[e] for e in es) for _, es in found], pa.int64()), pa.array([sum(weights[e] for e in es if units[e][2]) for _, es in found], pa.int64()),
                    ], ["_field", "_pattern", "_part", "_of", "_all", "_w"])

    return run


def _asked(max_gap: int, wanted: dict[str, list[tuple[str, frozenset[int]]]]):
    """Weight of wanted patterns in partitions that have not told it, and of all of them for entities in several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, dict[bool, list[str]]] = {}
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            if batch.num_rows and not of:
                part = batch.column("_part")[0].as_py()
                of = {f: {False: sorted(p for p, told in ps if part not in told), True: sorted(p for p, _ in ps)} for f, ps in wanted.items()}
            pieces: tuple[list, list, list] = ([], [], [])
            for f, s, e, w in zip(*(batch.column(c).to_pylist() for c in ("_field", "_seq", "_entity", "_w"))):
                patterns = of.get(f, {}).get(e is not None)
                if not patterns:
                    continue
                shown, at = Shown(s, max_gap), 0
                by_size: dict[int, str | None] = {}
                while at < len(patterns):
                    p = patterns[at]
                    k = len(p)
                    if k not in by_size or (by_size[k] is not None and by_size[k] < p):
                        by_size[k] = shown.least(k, p)
                    if by_size[k] == p:
                        if e is None:
                            sums[f, p] += w
                        else:
                            for column, x in zip(pieces, (f, p, e)):
                                column.append(x)
                    at += 1
                    if all(k in by_size for k in {len(x) for x in patterns}):
                        ahead = [x for x in by_size.values() if x is not None]
                        at = max(at, bisect_left(patterns, min(ahead))) if ahead else len(patterns)
            if pieces[0]:
                yield pa.RecordBatch.from_arrays([pa.array(pieces[0]), pa.array(pieces[1]), pa.array(pieces[2]), pa.array([1] * len(pieces[0]), pa.int64())], ["_field", "_pattern", "_entity", "_w"])
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in sums]), pa.array([p for _, p in sums]), pa.nulls(len(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["_field", "_pattern", "_entity", "_w"]
            )

    return run


def frequent_subsequences(
    df: DataFrame, entity: str, sequence: str, min_share: float | dict[str, float], *, field: str | None = None, least: int = 3, most: int = 6, max_gap: int = 1,
    rows_per_task: int = 20_000, slack: float = 0.8, together: int = 64,
) -> DataFrame:
    """(pattern, support, share) of the patterns that at least ``min_share`` of the entities show.

    ``sequence`` holds one character per event (``.``: an event that is never a step), runs already
    collapsed; up to ``max_gap`` other events may stand between neighbouring steps.  An entity with
    several sequences shows what any of them shows and counts once.  With ``field``, the rows of every
    value of that column are a collection of their own with its own ``min_share``, and the column comes first.

    * NULL entities and NULL or empty sequences take no part and do not count as entities.
    * Copies count once; an empty table gives no rows; a share exactly at ``min_share`` is listed.
    * Sequences of any length are read whole; other columns are not read.
    * An entity of more than ``together`` sequences is compared in pieces, so none is too big for a task.
    """
    spark = df.sparkSession
    name = F.lit("") if field is None else F.col(field).cast("string")
    rows = df.select(name.alias("_field"), F.col(entity).cast("string").alias("_entity"), F.col(sequence).alias("_seq"))
    rows = rows.where("_field is not null and _entity is not null and _seq is not null and _seq <> ''").distinct()
    key = ["_field", "_entity"]
    # an entity's sequences one after another, too far apart for a pattern over both; a piece of it for every ``together`` of them
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("_seq")))
    piece = numbered.groupBy(*key, F.floor((F.col("_n") - 1) / together).alias("_piece")).agg(F.array_join(F.array_sort(F.collect_list("_seq")), STRANGER * (max_gap + 1)).alias("_seq"), F.max("_n").alias("_last"))
    whole = F.max("_last").over(W.partitionBy(*key)) <= together
    units = piece.withColumn("_entity", F.when(~whole, F.col("_entity"))).groupBy("_field", "_entity", "_seq").agg(F.count("*").alias("_w"))
    units = cut_lineage(units)
    none = spark.createDataFrame([], "_field string, pattern string, support bigint, share double")
    counts = {
        r["_field"]: r for r in units.groupBy("_field").agg(
            F.sum("_w").alias("weight"), F.sum(F.when(F.col("_entity").isNull(), F.col("_w")).otherwise(0)).alias("single"), F.count_distinct("_entity").alias("several"), F.count("*").alias("rows")
        ).collect()
    }
    shown = ["pattern", "support", "share"]
    columns = shown if field is None else [F.col("_field").alias(field), *shown]
    if not counts:
        return none.select(*columns)
    entities = {f: r["single"] + r["several"] for f, r in counts.items()}
    threshold = {f: (min_share if field is None else min_share[f]) * n for f, n in entities.items()}
    size = sum(r["rows"] for r in counts.values())
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // rows_per_task)) if size > 2000 else 1
    loose = slack if tasks > 1 else 1.0
    spread = cut_lineage(units.repartition(tasks, F.xxhash64("_seq", "_entity")).withColumn("_part", F.spark_partition_id()))
    shares = {f: loose * threshold[f] / counts[f]["weight"] for f in counts}
    told = spread.mapInArrow(_compared(least, most, max_gap, shares), "_field string, _pattern string, _part int, _of bigint, _all bigint, _w bigint")
    summed = told.groupBy("_field", "_pattern").agg(F.sum("_all").alias("_all"), F.sum("_w").alias("_w"), F.sum("_of").alias("_of"), F.collect_list("_part").alias("_parts"))

    def of_field(values: dict[str, float]):
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("_field")]

    weight, bar = of_field({f: float(r["weight"]) for f, r in counts.items()}), of_field(threshold)
    left = cut_lineage(summed.where(F.col("_all") + of_field(shares) * (weight - F.col("_of")) >= bar - 1e-6))
    pieces = of_field({f: float(r["several"]) for f, r in counts.items()}) > 0
    wanted: dict[str, list[tuple[str, frozenset[int]]]] = defaultdict(list)
    for r in left.where((F.col("_of") < weight) | pieces).collect():  # at most m / ((1 - slack) * support) a field
        wanted[r["_field"]].append((r["_pattern"], frozenset(r["_parts"])))
    support = left.select("_field", "_pattern", "_w")
    if wanted:
        more = spread.mapInArrow(_asked(max_gap, dict(wanted)), "_field string, _pattern string, _entity string, _w bigint")
        once = more.where("_entity is not null").select("_field", "_pattern", "_entity").distinct().select("_field", "_pattern", F.lit(1).cast("long").alias("_w"))
        support = support.unionByName(more.where("_entity is null").select("_field", "_pattern", "_w")).unionByName(once).groupBy("_field", "_pattern").agg(F.sum("_w").alias("_w"))
    return support.where(F.col("_w") >= bar - 1e-9).select(
        "_field", F.col("_pattern").alias("pattern"), F.col("_w").alias("support"), (F.col("_w") / of_field({f: float(n) for f, n in entities.items()})).alias("share")
    ).select(*columns)


def coded(collapse):
    """Arrow function over (_id, _text) batches: the identifier and its collapsed sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [collapse(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(seqs, pa.string())], ["_id", "_seq"])

    return run


def direction_patterns(*parts: tuple[DataFrame, Column, str, Callable[[str | None], str], str, float], **how) -> DataFrame:
    """Frequent direction patterns of text columns, written as steps joined by ``>``.

    Every part is (table, identifier, text column, how a text is collapsed, its name, least share).
    """
    coding = []
    for df, ident, text, collapse, name, _ in parts:
        texts = df.select(ident.alias("_id"), F.col(text).alias("_text")).where("_id is not null and _text is not null").distinct()
        coding.append(texts.mapInArrow(coded(collapse), "_id string, _seq string").withColumn("seq_field", F.lit(name)))
    rows = reduce(DataFrame.unionByName, coding)
    found = frequent_subsequences(rows, "_id", "_seq", {p[4]: p[5] for p in parts}, field="seq_field", **how)
    names = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    steps = F.transform(F.split("pattern", ""), lambda c: names[c])
    return found.select("seq_field", F.array_join(steps, ">").alias("step_pattern"), "support", "share")


def shared_directions(stubs: DataFrame, members: DataFrame, stub_share: float = 0.035, route_share: float = 0.10) -> DataFrame:
    """(seq_field, step_pattern, support, share) over the stubs' dir_seq and the routes' direction_pattern."""
    return direction_patterns(
        (stubs, F.col("pattern_id"), "dir_seq", collapsed_axes, "dir_seq", stub_share),
        (members, norm_guid(F.col("route_path_guid")), "direction_pattern", collapsed_letters, "direction_pattern", route_share),
    )
