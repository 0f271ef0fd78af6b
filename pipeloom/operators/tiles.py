"""Boxes that Python workers look up by place: one sorted copy in the shared folder, read tile by tile.

A search that goes as far as it must cannot be sent its boxes beforehand without sending nearly all of them to each
search.  Here no box moves per search; a worker keeps the tiles that it used last.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = [f"{e}{c}" for e in ("min", "max") for c in "xyz"]
#: Millimetres: a tile's side, how far beyond its sides a tile knows its boxes, and the side of a cell within it.
TILE, GROWN, CELL = 6000.0, 200.0, 500.0
#: Boxes that touch more tiles than that are kept apart and looked at always.
MOST_TILES = 64
#: Boxes that a worker keeps, at some 80 bytes; if all tiles together have more, tiles are read again.
KEPT = 3_000_000


@contextmanager
def laid_out(boxes: DataFrame) -> Iterator[str]:
    """A folder of the boxes (minx .. maxz) sorted by tile, beside the checkpoints; removed at the end.  Boxes with a NULL side are left out."""
    spark = boxes.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir()}/tiles-{uuid.uuid4().hex}"
    ends = {c: [F.floor((F.col("min" + c) - GROWN) / TILE), F.floor((F.col("max" + c) + GROWN) / TILE)] for c in "xy"}
    few = (ends["x"][1] - ends["x"][0] + 1).cast("double") * (ends["y"][1] - ends["y"][0] + 1) <= MOST_TILES
    b = boxes.select(*SIDES).dropna().withColumn("_few", few)
    for c in "xy":
        b = b.withColumn("t" + c, F.explode(F.when(F.col("_few"), F.sequence(*ends[c])).otherwise(F.array(F.lit(None).cast("bigint")))))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        # small row groups, as a tile is read from those that have it
        b.drop("_few").repartitionByRange("tx", "ty").sortWithinPartitions("tx", "ty").write.option("parquet.block.size", str(1 << 20)).parquet(folder)
        yield folder
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tiles:
    """What ``laid_out`` wrote, as a worker reads it."""

    def __init__(self, folder: str):
        self.fs, at = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        self.groups: dict[tuple, list[tuple[str, int]]] = {}
        for f in self.fs.get_file_info(pyarrow.fs.FileSelector(at)):
            if not f.path.endswith(".parquet"):
                continue
            with pq.ParquetFile(f.path, filesystem=self.fs) as file:
                for k in range(file.num_row_groups):
                    names = file.read_row_group(k, ["tx", "ty"]).group_by(["tx", "ty"]).aggregate([])
                    for tile in zip(names["tx"].to_pylist(), names["ty"].to_pylist()):
                        self.groups.setdefault(tile, []).append((f.path, k))
        self.kept: OrderedDict[tuple, tuple] = OrderedDict()
        self.size = 0
        self.large = self._read((None, None))
        self.names = np.array([t for t in self.groups if t[0] is not None], dtype=np.int64).reshape(-1, 2)

    def _read(self, tile: tuple) -> np.ndarray:
        parts = [np.empty((0, 6))]
        for path, k in self.groups.get(tile, ()):
            with pq.ParquetFile(path, filesystem=self.fs) as file:
                t = file.read_row_group(k, ["tx", "ty", *SIDES])
            m = np.stack([t[s].to_numpy().astype(float) for s in SIDES], axis=1)
            # NaN stands for no tile
            x, y = (t[c].to_numpy().astype(float) for c in ("tx", "ty"))
            parts.append(m[np.isnan(x) if tile[0] is None else (x == tile[0]) & (y == tile[1])])
        return np.concatenate(parts)

    def _tile(self, tile: tuple) -> tuple:
        """(boxes, cells): cells hold the boxes by cell of the tile, as soon as they are asked for."""
        if tile not in self.kept:
            self.kept[tile] = self._read(tile), []
            self.size += len(self.kept[tile][0])
            while self.size > KEPT and len(self.kept) > 1:
                self.size -= len(self.kept.popitem(last=False)[1][0])
        self.kept.move_to_end(tile)
        return self.kept[tile]

    def touched(self, box: Sequence[float]) -> np.ndarray:
        """The boxes that ``box`` touches; one of several tiles may be there several times."""
        with np.errstate(invalid="ignore"):
            lo, hi = (np.floor(np.asarray(box[k : k + 2]) / TILE) for k in (0, 3))
        near = self.names[((self.names >= lo) & (self.names <= hi)).all(axis=1)].tolist()
        out = []
        for b in [self.large, *(self._tile(tuple(t))[0] for t in near)]:
            out.append(b[(b[:, :3] <= box[3:]).all(axis=1) & (b[:, 3:] >= box[:3]).all(axis=1)])
        return np.concatenate(out)

    def held(self, points: np.ndarray, grow: float) -> np.ndarray:
        """Per point (x, y, z) whether it is inside a box grown by ``grow``, which is at most ``GROWN``."""
        out = np.zeros(len(points), dtype=bool)
        for at in range(0, len(points), 1000):
            p = points[at : at + 1000]
            for k in range(0, len(self.large), 1000):
                b = self.large[k : k + 1000]
                out[at : at + 1000] |= ((b[None, :, :3] - grow < p[:, None]) & (p[:, None] < b[None, :, 3:] + grow)).all(axis=2).any(axis=1)
        tile = np.floor(points[:, :2] / TILE)
        order = np.lexsort((tile[:, 1], tile[:, 0]))
        for mine in np.split(order, np.flatnonzero((np.diff(tile[order], axis=0) != 0).any(axis=1)) + 1):
            if len(mine) and tuple(tile[mine[0]].tolist()) in self.groups:
                name = tuple(map(int, tile[mine[0]]))
                for at in range(0, len(mine), 1000):
                    some = mine[at : at + 1000]
                    out[some] |= self._in_cells(name, points[some], grow)
        return out

    def _in_cells(self, name: tuple[int, int], p: np.ndarray, grow: float) -> np.ndarray:
        boxes, cells = self._tile(name)
        side = int(TILE / CELL)
        cell = lambda v: np.clip(np.floor((v - np.array(name) * TILE) / CELL), 0, side - 1).astype(np.int64)
        if not cells:
            lo, hi = cell(boxes[:, :2] - GROWN), cell(boxes[:, 3:5] + GROWN)
            wide = hi - lo + 1
            n = wide[:, 0] * wide[:, 1]
            box = np.repeat(np.arange(len(boxes)), n)
            k = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n)
            at = (lo[box, 0] + k // wide[box, 1]) * side + lo[box, 1] + k % wide[box, 1]
            at = at.astype(np.int16)  # sorted faster
            order = np.argsort(at, kind="stable")
            cells += [box[order].astype(np.int32), np.searchsorted(at[order], np.arange(side * side + 1))]
        box, start = cells
        c = cell(p[:, :2]) @ np.array([side, 1])
        n = start[c + 1] - start[c]
        point = np.repeat(np.arange(len(p)), n)
        b = boxes[box[np.arange(len(point)) - np.repeat(np.cumsum(n) - n - start[c], n)]]
        q = p[point]
        hit = ((b[:, :3] - grow < q) & (q < b[:, 3:] + grow)).all(axis=1)
        return np.bincount(point[hit], minlength=len(p)) > 0


_OPEN: dict[str, Tiles] = {}


def opened(folder: str) -> Tiles:
    """The folder's tiles, as long as this worker asks for no other's."""
    if folder not in _OPEN:
        _OPEN.clear()
        _OPEN[folder] = Tiles(folder)
    return _OPEN[folder]
