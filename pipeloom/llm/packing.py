"""Filling fixed-capacity containers with items, by exact complements of lengths.

Only the histogram of lengths (at most one entry per token of capacity) is planned on, every kind of
container in a task of its own: the largest length left opens a container, whose gap is filled exactly by
one length, a pair or a triple found in an index of sums under the counts still available, else by the
largest length that fits (best fit).  A step of the plan is repeated as often as the counts allow, so its
cost depends on the capacity and not on the number of items.  Items take the places of the plan in the
order of their exact position within their length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.prefix import prefix_sums

#: Positions within a length that are joined with their places at once.
BLOCK = 256
_CHUNK = 512


class Complements:
    """Index of the sums of one, two and three available lengths.

    Lengths are only ever taken, so a combination that has become impossible stays so: every sum keeps
    the place up to which its combinations are used up, and a sum without any is marked for good.
    """

    def __init__(self, histogram: dict[int, int]):
        self.top = max(histogram, default=0)
        self.count = np.zeros(self.top + 1, dtype=np.int64)
        for length, n in histogram.items():
            self.count[length] += n
        self.have = np.flatnonzero(self.count)  # available lengths, and some that are gone
        self._gone = 0
        self._pair_at: dict[int, int] = {}
        self._triple_at: dict[int, int] = {}
        self._no_pair = np.zeros(2 * self.top + 2, dtype=bool)

    def take(self, lengths: list[int], times: int = 1) -> None:
        for x in lengths:
            self.count[x] -= times
            self._gone += self.count[x] == 0
        if self._gone > 64 + len(self.have) // 8:
            self.have, self._gone = self.have[self.count[self.have] > 0], 0

    def single(self, total: int) -> list[int] | None:
        return [total] if 0 < total <= self.top and self.count[total] > 0 else None

    def _next_pair(self, total: int, a: int) -> int:
        """The largest first length at most ``a`` of an available pair; below half the total if there is none."""
        low = (total + 1) // 2
        first, last = np.searchsorted(self.have, [low, a + 1])
        while last > first:
            lo = max(first, last - _CHUNK)
            x = self.have[lo:last][::-1]
            ok = (self.count[x] > 0) & (self.count[total - x] > 0)
            if x[-1] * 2 == total and self.count[x[-1]] < 2:
                ok[-1] = False
            at = int(ok.argmax())
            if ok[at]:
                return int(x[at])
            last = lo
        return low - 1

    def pair(self, total: int, used: int = 0) -> list[int] | None:
        """Two available lengths of this sum, the first as large as can be; one ``used`` length is not there any more."""
        if total < 2 or total > 2 * self.top or self._no_pair[total]:
            return None
        a = self._next_pair(total, self._pair_at.get(total, min(total - 1, self.top)))
        self._pair_at[total] = a
        if a * 2 < total:
            self._no_pair[total] = True
            return None
        while a * 2 >= total:
            b = total - a
            if self.count[a] - (a == used) > (a == b) and self.count[b] - (b == used) > 0:
                return [a, b]
            a = self._next_pair(total, a - 1)
        return None

    def triple(self, total: int) -> list[int] | None:
        """Three available lengths of this sum."""
        a = self._triple_at.get(total, min(total - 2, self.top))
        fresh = True  # nothing above ``a`` was passed over for the moment only
        first, last = np.searchsorted(self.have, [max(-(-total // 3), total - 2 * self.top), a + 1])
        while last > first:
            lo = max(first, last - _CHUNK)
            x = self.have[lo:last][::-1]
            for a in x[(self.count[x] > 0) & ~self._no_pair[total - x]].tolist():
                found = self.pair(total - a, a)
                if fresh and (found or not self._no_pair[total - a]):
                    self._triple_at[total] = a
                    fresh = False
                if found:
                    return [a, *found]
            last = lo
        if fresh:
            self._triple_at[total] = 0
        return None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three available lengths with sum ``gap``."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def best_fit(self, gap: int) -> list[int] | None:
        """The largest available length that fits."""
        last = int(np.searchsorted(self.have, gap + 1))
        while last > 0:
            lo = max(0, last - _CHUNK)
            ok = self.count[self.have[lo:last][::-1]] > 0
            at = int(ok.argmax())
            if ok[at]:
                return [int(self.have[last - 1 - at])]
            last = lo
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int, int]]:
    """(lengths of one container, number of such containers, room left); every item is placed once."""
    index = Complements(histogram)
    steps = []
    while (largest := index.best_fit(capacity)) is not None:
        index.take(largest)
        lengths, gap = largest, capacity - largest[0]
        while gap and (fill := index.fill(gap) or index.best_fit(gap)) is not None:
            index.take(fill)
            lengths = lengths + fill
            gap -= sum(fill)
        each = Counter(lengths)
        times = 1 + min(int(index.count[x]) // n for x, n in each.items())
        for x, n in each.items():
            index.take([x], n * (times - 1))
        steps.append((lengths, times, gap))
    return steps


def _places(key: tuple, histogram: pd.DataFrame) -> pd.DataFrame:
    """Ranges of positions within a length and the step of the plan they belong to, of one kind."""
    kind, capacity = key
    at: Counter = Counter()
    rows = []
    for step, (lengths, times, gap) in enumerate(plan(dict(zip(histogram["tokens"].tolist(), histogram["n"].tolist())), int(capacity))):
        for length, n in Counter(lengths).items():
            rows.append((kind, capacity, length, at[length], at[length] + n * times, n, step, gap))
            at[length] += n * times
    return pd.DataFrame(rows, columns=["container_kind", "_cap", "tokens", "lo", "hi", "n", "step", "gap"])


def pack(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Rows (container_kind, container_id, doc_id, piece_no, token_start, tokens, room_left).

    ``items`` is (doc_id, tokens), ``containers`` (container_kind, capacity_tokens), a row per kind, few
    enough to stand in a plan.  Every item is put into containers of every kind.  An item longer than
    the capacity is cut into pieces of the capacity and a last one, which is packed like an item; no
    other item is cut.

    * Items of NULL or no tokens need no place and are left out; repeated rows are packed once each.
    * Kinds with NULL, zero or negative capacity are left out; empty tables give no rows.
    * A kind named with two capacities is two kinds; their containers carry the capacity in their names.
    """
    spark = items.sparkSession
    kinds = [(r[0], int(r[1])) for r in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()]
    if not kinds:
        return spark.createDataFrame([], "container_kind string, container_id string, doc_id bigint, piece_no int, token_start bigint, tokens bigint, room_left bigint")
    twice = {k for k, n in Counter(k for k, _ in kinds).items() if n > 1}
    every_kind = F.array(*[F.struct(F.lit(k).cast("string").alias("container_kind"), F.lit(c).cast("bigint").alias("_cap")) for k, c in kinds])
    label = F.when(F.col("container_kind").isin(*twice), F.concat_ws("-", "container_kind", "_cap")).otherwise(F.col("container_kind")) if twice else F.col("container_kind")
    held = items.where("tokens > 0").select("doc_id", F.col("tokens").cast("bigint").alias("_all"))
    every = held.select("doc_id", "_all", F.inline(every_kind))
    whole = F.expr("(_all - 1) div _cap")
    last = every.select(
        "container_kind", "_cap", "doc_id", whole.cast("int").alias("piece_no"), (whole * F.col("_cap")).cast("bigint").alias("token_start"),
        (F.col("_all") - whole * F.col("_cap")).cast("bigint").alias("tokens"), F.lit(1).cast("bigint").alias("_one"),
    )
    cut = every.where("_all > _cap").select("container_kind", "_cap", "doc_id", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece_no"))
    cut = cut.select(
        "container_kind", F.concat_ws("-", label, F.lit("d"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no",
        (F.col("piece_no") * F.col("_cap")).cast("bigint").alias("token_start"), F.col("_cap").alias("tokens"), F.lit(0).cast("bigint").alias("room_left"),
    )
    length = ["container_kind", "_cap", "tokens"]
    placed = prefix_sums(last, length, ["doc_id"], "_one", "_rank")
    histogram = last.groupBy(*length).agg(F.count("*").alias("n"))  # at most a row per token of capacity
    places = histogram.groupBy("container_kind", "_cap").applyInPandas(
        _places, "container_kind string, _cap bigint, tokens bigint, lo bigint, hi bigint, n bigint, step bigint, gap bigint"
    )
    # both sides by blocks of positions: a length of any frequency is spread, and a block meets at most as many places as it has positions
    blocks = F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}")))
    ranges = places.select(*length, blocks.alias("_block"), F.struct("lo", "hi", "n", "step", "gap").alias("s")).groupBy(*length, "_block").agg(F.collect_list("s").alias("_slots"))
    found = placed.withColumn("_block", F.expr(f"_rank div {BLOCK}")).join(ranges, [*length, "_block"]).withColumn(
        "_s", F.element_at(F.filter("_slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), 1)
    )
    instance = F.expr("(_rank - _s.lo) div _s.n")
    return cut.unionByName(
        found.select(
            "container_kind", F.concat_ws("-", label, F.lit("p"), "_s.step", instance).alias("container_id"), "doc_id", "piece_no",
            "token_start", "tokens", F.col("_s.gap").alias("room_left"),
        )
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, documents, pieces, tokens and the share of room left."""
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.max("room_left").alias("r"), F.count("*").alias("n"))
    return per.groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.sum("r").alias("room_left"),
        (F.sum("r") / (F.sum("t") + F.sum("r"))).alias("room_share"),
    )
