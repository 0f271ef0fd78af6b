"""Oriented boxes of the meshes in binary glTF files, one task per file."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, mesh string, part int, cx double, cy double, cz double, hx double, hy double, hz double, volume double"
FLAT_MM = 50.0
_KINDS = {5121: np.uint8, 5123: np.uint16, 5125: np.uint32, 5126: np.float32}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def chunks(data: bytes) -> tuple[dict, bytes]:
    """The description and the binary part; ValueError if it is no binary glTF."""
    if len(data) < 12 or data[:4] != b"glTF":
        raise ValueError("no binary glTF")
    at, found = 12, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<II", data, at)
        found[kind] = data[at + 8 : at + 8 + size]
        at += 8 + size
    return json.loads(found[0x4E4F534A]), found.get(0x004E4942, b"")


def accessor(doc: dict, blob: bytes, k: int) -> np.ndarray:
    a = doc["accessors"][k]
    view = doc["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(_KINDS[a["componentType"]]), _WIDTH[a["type"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    step = view.get("byteStride", kind.itemsize * width)
    rows = np.ndarray((a["count"], width), kind, blob, start, (step, kind.itemsize))
    return rows.astype(float if kind.kind == "f" else np.int64)


def parts(vertices: np.ndarray, faces: np.ndarray | None) -> list[np.ndarray]:
    """Vertices by connected component of the faces; corners at one place count as one."""
    if faces is None or not len(faces):
        return [vertices]
    _, same = np.unique(vertices.round(6), axis=0, return_inverse=True)
    label = np.arange(same.max() + 1)
    tri = same.reshape(-1)[faces]
    while True:
        low = label[tri].min(axis=1)
        new = label.copy()
        np.minimum.at(new, tri.reshape(-1), np.repeat(low, 3))
        new = new[new]
        if (new == label).all():
            break
        label = new
    of = label[same.reshape(-1)]
    return [vertices[of == k] for k in np.unique(of)]


def oriented_box(points: np.ndarray, flat: float = FLAT_MM) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, half sizes by falling spread, volume); sides under ``flat`` are padded to it."""
    mid = points.mean(axis=0)
    axes = np.linalg.svd(points - mid, full_matrices=len(points) < 3)[2]
    local = (points - mid) @ axes.T
    lo, hi = local.min(axis=0), local.max(axis=0)
    half = np.maximum(hi - lo, flat) / 2
    return mid + ((lo + hi) / 2) @ axes, half, float(8 * half.prod())


def boxes_of(path: str, data: bytes) -> list[tuple]:
    """A row per mesh and connected part; a file that cannot be read gives none."""
    try:
        doc, blob = chunks(data)
        out = []
        for m, mesh in enumerate(doc.get("meshes", [])):
            k = 0
            for p in mesh["primitives"]:
                v = accessor(doc, blob, p["attributes"]["POSITION"])
                f = accessor(doc, blob, p["indices"]).reshape(-1, 3) if "indices" in p else None
                for part in parts(v, f):
                    c, h, volume = oriented_box(part)
                    out.append((path, mesh.get("name", f"mesh{m}"), k, *map(float, c), *map(float, h), volume))
                    k += 1
        return out
    except (ValueError, KeyError, IndexError, TypeError, struct.error):
        return []


def mesh_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Oriented boxes of every mesh in the files under ``path``."""
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([row for p, d in zip(pdf["path"], pdf["content"]) for row in boxes_of(p, d)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
