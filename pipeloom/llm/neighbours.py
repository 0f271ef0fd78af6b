"""Most similar vectors for every vector: stable projections, kd-tree, chi-square stopping.

Unit vectors are projected on a few Gaussian directions; a squared projected distance is then the
squared true distance times a chi-square variable.  The projected space is cut into cells by the upper
levels of a kd-tree fitted on a bounded sample; every cell is searched by the fine kd-tree that its
task builds over all its rows.  Blocks of projected neighbours are verified in the order of their
projected distance until the chi-square test says that a closer vector would, with probability
``certainty``, have been met already.  A query whose test reaches over the border of its cell is
carried into just those cells, with the bound it has reached.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.session import cut_lineage

BLOCK = 64


def chi_square_bound(m: int, p: float) -> float:
    """The x with P(chi-square of m (even) degrees of freedom <= x) = p."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        lo, hi = (x, hi) if 1 - math.exp(-x / 2) * total < p else (lo, x)
    return hi


class Projection:
    """Gaussian directions and the kd-tree's upper levels, as flat arrays; its size is bounded by ``max_cells``."""

    def __init__(self, sample: np.ndarray, rows: int, m: int, cell_rows: int, max_cells: int, seed: int):
        self.directions = np.random.default_rng(seed).normal(size=(sample.shape[1], m))
        p = sample @ self.directions
        want = min(max_cells, max(1, -(-rows // cell_rows)))
        self.dim, self.cut, self.child = [], [], []
        leaves = 0
        todo = [(np.arange(len(p)), want, None, 0)]
        while todo:
            at, cells, parent, side = todo.pop()
            node = len(self.dim)
            if parent is not None:
                self.child[parent][side] = node
            spread = np.ptp(p[at], axis=0) if len(at) else np.zeros(m)
            d = int(spread.argmax())
            if cells < 2 or len(at) < 2 or spread[d] == 0:
                self.dim.append(-1)
                self.cut.append(0.0)
                self.child.append([leaves, leaves])  # a leaf: its cell
                leaves += 1
                continue
            values = np.sort(p[at, d])
            cut = float(values[len(values) * (cells // 2) // cells])
            left = p[at, d] < cut
            self.dim.append(d)
            self.cut.append(cut)
            self.child.append([0, 0])
            todo.append((at[left], cells // 2, node, 0))
            todo.append((at[~left], cells - cells // 2, node, 1))
        self.dim, self.cut, self.child = np.array(self.dim), np.array(self.cut), np.array(self.child)

    def reached(self, p: np.ndarray, limit: np.ndarray) -> list[list[int]]:
        """Per projected query the cells within a squared projected distance; only branches that some query reaches are walked."""
        out: list[list[int]] = [[] for _ in range(len(p))]
        todo = [(0, np.arange(len(p)), np.zeros(p.shape), np.zeros(len(p)))]
        while todo:
            node, at, gaps, far = todo.pop()
            d = self.dim[node]
            if d < 0:
                cell = int(self.child[node, 0])
                for q in at:
                    out[q].append(cell)
                continue
            gap = p[at, d] - self.cut[node]
            for side in (0, 1):
                across = np.where((gap >= 0) == bool(side), 0.0, np.abs(gap))
                new = np.maximum(gaps[:, d], across)
                total = far - gaps[:, d] ** 2 + new**2
                keep = np.flatnonzero(total <= limit[at])
                if len(keep):
                    more = gaps[keep].copy()
                    more[:, d] = new[keep]
                    todo.append((int(self.child[node, side]), at[keep], more, total[keep]))
        return out

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), dtype=np.int64)
        while True:
            d = self.dim[node]
            inner = np.flatnonzero(d >= 0)
            if not len(inner):
                return self.child[node, 0]
            right = p[inner, d[inner]] >= self.cut[node[inner]]
            node[inner] = self.child[node[inner], right.astype(int)]


def _blocks(p: np.ndarray) -> list[np.ndarray]:
    """Leaves of the fine kd-tree."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        d = int(np.ptp(p[at], axis=0).argmax())
        half = len(at) // 2
        order = np.argpartition(p[at, d], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


class Cell:
    """All vectors of a cell under the fine kd-tree."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, projection: Projection):
        p = u @ projection.directions
        self.blocks = _blocks(p)
        order = np.concatenate(self.blocks)
        self.ids, self.u = ids[order], u[order]
        self.ends = np.cumsum([len(b) for b in self.blocks])
        self.lo = np.array([p[b].min(axis=0) for b in self.blocks])
        self.hi = np.array([p[b].max(axis=0) for b in self.blocks])

    def search(self, ids: np.ndarray, u: np.ndarray, p: np.ndarray, bound: np.ndarray, k: int, chi: float):
        """Per query: up to k (similarity, id), and the squared distance within which they are complete.

        ``bound``: squared distance beyond which nothing is wanted.
        """
        n = len(ids)
        found: list[list[tuple[float, str]]] = [[] for _ in range(n)]
        bound = bound.copy()
        starts = self.ends - np.array([len(b) for b in self.blocks])
        home = np.empty(n, dtype=np.int64)
        for s in range(0, n, 1024):
            q = p[s : s + 1024, None, :]
            home[s : s + 1024] = (np.maximum(np.maximum(self.lo - q, q - self.hi), 0) ** 2).sum(axis=2).argmin(axis=1)
        by_home = np.argsort(home, kind="stable")
        for group in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1) if n else []:
            q, qu, qids = p[group], u[group], ids[group]
            lo, hi = q.min(axis=0), q.max(axis=0)
            far = (np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0) ** 2).sum(axis=1)
            order = np.argsort(far, kind="stable")
            best = np.full((len(group), k), -np.inf)
            names = np.full((len(group), k), None, dtype=object)
            limit = bound[group]
            done, step = 0, 4
            while done < len(order) and far[order[done]] <= limit.max() * chi:
                take = order[done : done + step]
                take = take[far[take] <= limit.max() * chi]
                rows = np.concatenate([np.arange(starts[b], self.ends[b]) for b in take])
                sims = qu @ self.u[rows].T
                sims[qids[:, None] == self.ids[rows][None, :]] = -np.inf
                sims[2 - 2 * sims > limit[:, None] + 1e-12] = -np.inf
                hit = np.flatnonzero((sims > -np.inf).any(axis=1))
                for i in hit:
                    ok = np.flatnonzero((sims[i] >= best[i, -1]) & (sims[i] > -np.inf))
                    if len(ok) > 4 * k:  # what ties with the k-th stays, for the identifier to settle
                        ok = ok[sims[i, ok] >= -np.partition(-sims[i, ok], k - 1)[k - 1]]
                    merged = sorted([*zip(-best[i], names[i]), *zip(-sims[i, ok], self.ids[rows[ok]])], key=lambda x: (x[0], x[1] or ""))[:k]
                    best[i] = [-s for s, _ in merged]
                    names[i] = [x for _, x in merged]
                    if best[i, -1] > -np.inf:
                        limit[i] = min(limit[i], max(0.0, 2 - 2 * best[i, -1]))
                done += step
                step *= 2
            bound[group] = limit
            for i, g in enumerate(group):
                found[g] = [(float(s), x) for s, x in zip(best[i], names[i]) if x is not None]
        return found, bound


def unit_vectors(df: DataFrame, field: Column, ident: Column, vec: Column, dim: Column) -> DataFrame:
    """(field, id, vec) with vec scaled to length 1; vectors of the wrong length, zero, or with NaN, infinity or NULL are left out."""
    rows = df.select(field.alias("field"), ident.cast("string").alias("id"), vec.cast("array<double>").alias("v"), dim.alias("_dim"))
    rows = rows.where("id is not null and size(v) = _dim").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))))
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("_top", top).where("_top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("_top")))  # no overflow
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_norm", norm).select("field", "id", F.transform("v", lambda x: x / F.col("_norm")).alias("vec"))


def _frame(field: str, reps, found, **more) -> pd.DataFrame:
    near = [[{"similarity": s, "rep": x} for s, x in f] for f in found]
    lists = {"near": near} | {k: v for k, v in more.items() if k != "bound"}
    out = pd.DataFrame({"field": pd.Series([field] * len(reps), dtype=object), "rep": pd.Series(list(reps), dtype=object)})
    for k, v in lists.items():
        out[k] = pd.Series(v, dtype=object)
    if "bound" in more:
        out["bound"] = np.asarray(more["bound"], dtype=float)
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def k_nearest(
    vectors: DataFrame, k: int, *, min_similarity: float | dict[str, float] = -1.0, queries: Column | None = None, certainty: float = 0.9999,
    m: int = 6, cell_rows: int = 4000, max_cells: int = 4096, part_rows: int = 16_000, sample_rows: int = 20_000, seed: int = 7, salts: int = 32,
) -> DataFrame:
    """(field, id, other, similarity, position): the ``k`` most similar other vectors of the same field.

    ``vectors`` is (field, id, vec) of unit vectors as ``unit_vectors`` gives them.  Neighbours under
    ``min_similarity`` (one number or one per field) are not wanted, which bounds the search.
    ``queries`` chooses the rows that are asked for; all rows are searched.

    * Copies of an identifier count once (the least vector).  Equal vectors (to 9 decimals) are
      searched as one and given out as separate neighbours with similarity 1.
    * Ties in the similarity are settled by the identifier, ascending.
    * A vector alone in its field has no neighbours; an empty table gives no rows.
    * The tree's upper levels are fitted on ``sample_rows`` rows per field, at most ``max_cells``
      cells; every row is indexed.  A cell of more than ``part_rows`` rows (very many rows, or rows
      that the projections cannot tell apart) is kept in parts, each in a task of its own; a query is
      held against its own part first and then, with the bound it has reached, against the others.
    """
    spark = vectors.sparkSession
    floor = min_similarity
    once = vectors.groupBy("field", "id").agg(F.min("vec").alias("vec"))
    rounded = F.transform("vec", lambda x: F.round(x, 9) + F.lit(0.0))
    once = cut_lineage(once.select("field", "id", "vec", F.xxhash64(rounded).alias("h1"), F.xxhash64(F.lit(1), rounded).alias("h2")))
    twin = W.partitionBy("field", "h1", "h2").orderBy("id")
    least = once.withColumn("_n", F.row_number().over(twin)).where(F.col("_n") <= k + 1)
    classes = least.groupBy("field", "h1", "h2").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vec", "id").alias("vec"))
    asked = F.lit(True) if queries is None else queries
    if queries is not None:
        want = once.groupBy("field", "h1", "h2").agg(F.max(asked).alias("asked"))
        classes = classes.join(want, ["field", "h1", "h2"])
    else:
        classes = classes.withColumn("asked", F.lit(True))
    counts = {r[0]: r[1] for r in once.groupBy("field").count().collect()}
    trees: dict[str, Projection] = {}
    for field, n in counts.items():
        keep = min(1.0, 1.2 * sample_rows / n)
        part = once.where((F.col("field") == field) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(keep * (1 << 40)))).select("vec").limit(sample_rows)
        trees[field] = Projection(_matrix(part.toPandas()["vec"]), n, m, cell_rows, max_cells, seed)
    none = spark.createDataFrame([], "field string, id string, other string, similarity double, position int")
    if not trees:
        return none
    shared = spark.sparkContext.broadcast(trees)
    chi = chi_square_bound(m, certainty)
    floors = {f: (floor.get(f, -1.0) if isinstance(floor, dict) else floor) for f in counts}

    def place(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), dtype=np.int32)
            for field, at in pdf.groupby("field").indices.items():
                tree = shared.value[field]
                cell[at] = tree.cells(_matrix(pdf["vec"].iloc[at]) @ tree.directions)
            yield pdf.assign(cell=cell)

    placed = cut_lineage(
        classes.select("field", "rep", "ids", "vec", "asked").mapInPandas(
            place, "field string, rep string, ids array<string>, vec array<double>, asked boolean, cell int"
        )
    )
    # parts of the cells: at most ``max_cells`` rows a field
    full = placed.groupBy("field", "cell").count().where(F.col("count") > part_rows).collect()
    parts = {(r["field"], r["cell"]): -(-r["count"] // part_rows) for r in full}
    if parts:
        big = F.broadcast(spark.createDataFrame([(f, c, n) for (f, c), n in parts.items()], "field string, cell int, _parts int"))
        part = F.pmod(F.xxhash64("rep"), F.coalesce("_parts", F.lit(1)))
        slot = placed.join(big, ["field", "cell"], "left").withColumn("slot", F.shiftleft(F.col("cell").cast("bigint"), 32) + part)
    else:
        slot = placed.withColumn("slot", F.shiftleft(F.col("cell").cast("bigint"), 32))
    indexed = slot.select("field", "slot", "rep", "vec", "asked")
    pair = "array<struct<similarity: double, rep: string>>"

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field, home = key
        tree = shared.value[field]
        u = _matrix(pdf["vec"])
        cell = Cell(pdf["rep"].to_numpy(), u, tree)
        at = np.flatnonzero(pdf["asked"].to_numpy())
        q, ids = u[at], pdf["rep"].to_numpy()[at]
        p = q @ tree.directions
        found, bound = cell.search(ids, q, p, np.full(len(at), 2 - 2 * floors[field]), k, chi)
        near = tree.reached(p, bound * chi) if len(at) else []
        go = [[s for c in cells for s in range(c << 32, (c << 32) + parts.get((field, c), 1)) if s != home] for cells in near]
        return _frame(field, ids, found, vec=[v if len(g) else None for v, g in zip(q, go)], go=go, bound=bound)

    def beyond(key: tuple, asked_rows: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        field = key[0]
        if not len(pdf) or not len(asked_rows):
            return _frame(field, [], [])
        tree = shared.value[field]
        cell = Cell(pdf["rep"].to_numpy(), _matrix(pdf["vec"]), tree)
        q, ids = _matrix(asked_rows["vec"]), asked_rows["rep"].to_numpy()
        found, _ = cell.search(ids, q, q @ tree.directions, asked_rows["bound"].to_numpy(), k, chi)
        return _frame(field, ids, found)

    own = cut_lineage(
        indexed.groupBy("field", "slot").applyInPandas(
            within, f"field string, rep string, near {pair}, vec array<double>, go array<bigint>, bound double"
        )
    )
    carried = own.where("size(go) > 0").select("field", "rep", "vec", "bound", F.explode("go").alias("slot"))
    other = carried.groupBy("field", "slot").cogroup(indexed.select("field", "slot", "rep", "vec").groupBy("field", "slot")).applyInPandas(
        beyond, f"field string, rep string, near {pair}"
    )
    pairs = own.select("field", "rep", F.inline("near").alias("similarity", "other")).unionByName(
        other.select("field", "rep", F.inline("near").alias("similarity", "other"))
    )
    # other classes with their least identifiers, then the class's own at similarity 1
    names = placed.select("field", F.col("rep").alias("other"), F.col("ids").alias("others"))
    listed = pairs.join(names, ["field", "other"]).select("field", "rep", "similarity", F.explode("others").alias("other"))
    listed = listed.unionByName(placed.where("size(ids) > 1 and asked").select("field", "rep", F.lit(1.0).alias("similarity"), F.explode("ids").alias("other")))
    order = W.partitionBy("field", "rep").orderBy(F.col("similarity").desc(), "other")
    listed = listed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * k + 1).drop("_n")
    # members: a class of one is its only member; of up to k its list holds all; larger ones are looked up, salted
    many = placed.where("size(ids) > 1").select("field", "rep", "vec", "ids")
    key = F.transform("vec", lambda x: F.round(x, 9) + F.lit(0.0))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    small = many.where(F.size("ids") <= k).select("field", "rep", "vec", F.explode("ids").alias("id")).where(asked).select("field", "rep", "id")
    large = many.where(F.size("ids") > k)
    members = once.select("field", "h1", "h2", "id", salt.alias("_salt"), asked.alias("_asked")).where("_asked")
    spread = large.select("field", "rep", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), every_salt)
    grouped = members.join(spread, ["field", "h1", "h2", "_salt"]).select("field", "rep", "id", "_salt")
    lists = listed.groupBy("field", "rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))).alias("l"))
    sized = lists.join(many.select("field", "rep", F.size("ids").alias("_size")), ["field", "rep"], "left")
    single = sized.where("_size is null").select("field", F.col("rep").alias("id"), "l")
    few = sized.where(F.col("_size") <= k).join(small, ["field", "rep"]).select("field", "id", "l")
    plural = sized.where(F.col("_size") > k).select("field", "rep", "l", every_salt).join(grouped, ["field", "rep", "_salt"]).select("field", "id", "l")
    every = single.unionByName(few).unionByName(plural)
    mine = F.slice(F.filter("l", lambda x: x["other"] != F.col("id")), 1, k)
    rows = every.select("field", "id", F.posexplode(mine).alias("p", "x"))
    return rows.select("field", "id", F.col("x.other").alias("other"), (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).cast("int").alias("position"))


def mutual(neighbours: DataFrame) -> DataFrame:
    """Pairs (field, id_a, id_b), id_a < id_b, in which each is among the other's neighbours."""
    pairs = neighbours.select("field", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "similarity")
    both = pairs.groupBy("field", "id_a", "id_b").agg(F.count("*").alias("_n"), F.max("similarity").alias("similarity"))
    return both.where("_n = 2").drop("_n")
