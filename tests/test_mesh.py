"""Binary glTF meshes made here and read back as oriented boxes."""

from __future__ import annotations

import itertools
import json
import struct

import numpy as np

from pipeloom.sources import mesh


def _glb(boxes, name="m"):
    v = np.concatenate([np.array(list(itertools.product(*zip(lo, hi))), dtype=np.float32) for lo, hi in boxes])
    f = np.concatenate([np.array([(0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 5, 6), (5, 6, 7)], dtype=np.uint16) + 8 * k for k in range(len(boxes))])
    blob = v.tobytes() + f.tobytes()
    doc = {
        "meshes": [{"name": name, "primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(v), "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": f.size, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteLength": v.nbytes}, {"buffer": 0, "byteOffset": v.nbytes, "byteLength": f.nbytes}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(blob), 0x004E4942) + blob
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


def test_boxes_of_parts(spark, tmp_path):
    (tmp_path / "a.glb").write_bytes(_glb([((0, 0, 0), (1000, 400, 200)), ((5000, 0, 0), (5600, 100, 0))]))
    (tmp_path / "b.glb").write_bytes(b"glTF broken")
    (tmp_path / "c.glb").write_bytes(b"")
    rows = sorted(mesh.mesh_boxes(spark, str(tmp_path)).collect(), key=lambda r: r.part)
    assert [r.mesh for r in rows] == ["m", "m"]
    assert np.allclose([rows[0].cx, rows[0].cy, rows[0].cz], (500, 200, 100)) and np.isclose(rows[0].volume, 8e7)
    assert np.isclose(rows[1].hz, 25) and np.isclose(rows[1].volume, 600 * 100 * 50)  # a flat one is padded
