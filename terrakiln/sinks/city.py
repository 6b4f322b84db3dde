"""City-model lines: one JSON feature per building, with vertices deduplicated and quantised, partitioned by tile.

Defined cases: a building without faces has attributes only; null attributes are written as null; a face of an unknown
label is an error; corners are cut towards zero after scaling, equal ones are one vertex, numbered as they come; empty
tables give no lines.
"""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {0: "GroundSurface", 1: "RoofSurface", 2: "WallSurface", 3: "InteriorWallSurface"}
Corner = tuple[float, float, float]
Faces = list[tuple[int, list[list[Corner]]]]  # label, rings


def metadata_line(translate: Corner, scale: float = 0.0001, crs: str | None = None, day: str | None = None, extent: tuple[float, ...] | None = None) -> str:
    """The first line of a file of features. extent: least and greatest x, y, z."""
    head = {"type": "CityJSON", "version": "2.0", "CityObjects": {}, "vertices": [], "transform": {"scale": [scale] * 3, "translate": list(translate)}}
    head["metadata"] = {"referenceDate": day or date.today().isoformat()} | ({"referenceSystem": crs} if crs else {}) | ({"geographicalExtent": list(extent)} if extent else {})
    return json.dumps(head, separators=(",", ":"))


class _Vertices:
    def __init__(self, translate: Corner, scale: float):
        self.translate, self.scale = translate, scale
        self.place: dict[tuple[int, ...], int] = {}

    def ring(self, corners: list[Corner]) -> list[int]:
        cut = (tuple(int((c - t) / self.scale) for c, t in zip(p, self.translate, strict=True)) for p in corners)
        return [self.place.setdefault(c, len(self.place)) for c in cut]

    def all(self) -> list[list[int]]:
        return [list(v) for v in self.place]


def _solid(lod: str, faces: Faces, vertices: _Vertices, roofs: list[dict] | None) -> dict:
    shell, kinds, values, shared, n_roof = [], [], [], {}, 0
    for label, rings in faces:
        if label not in KINDS:
            raise ValueError(f"unknown face label {label}")
        shell.append([vertices.ring(r) for r in rings])
        if label == 1 or label not in shared:
            own = roofs[n_roof] if label == 1 and roofs and n_roof < len(roofs) else {}
            n_roof += label == 1
            kinds.append({"type": KINDS[label]} | own)
            shared[label] = len(kinds) - 1
        values.append(shared[label])
    return {"type": "Solid", "lod": lod, "boundaries": [shell], "semantics": {"surfaces": kinds, "values": [values]}}


def feature(name: str, solids: dict[str, Faces], translate: Corner = (0.0, 0.0, 0.0), scale: float = 1.0, attributes: dict | None = None, footprint: list[list[Corner]] | None = None, roofs: list[dict] | None = None) -> str:
    """A building with its footprint (LoD 0) and a part that has the solids. roofs: attributes of the roof faces."""
    vertices = _Vertices(translate, scale)
    base = [{"type": "MultiSurface", "lod": "0", "boundaries": [[vertices.ring(r) for r in footprint]]}] if footprint else []
    part = f"{name}-0"
    objects = {name: {"type": "Building", "children": [part], "attributes": attributes or {}, "geometry": base}}
    objects[part] = {"type": "BuildingPart", "parents": [name], "geometry": [_solid(lod, faces, vertices, roofs) for lod, faces in sorted(solids.items())]}
    return json.dumps({"type": "CityJSONFeature", "id": name, "CityObjects": objects, "vertices": vertices.all()}, separators=(",", ":"))


def features(faces: DataFrame, translate: Corner = (0.0, 0.0, 0.0), scale: float = 1.0, lod: str = "1.2") -> DataFrame:
    """fid, value: a JSON line for each building of faces (fid, face, part, label, ring, and optionally attributes: JSON)."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["face"], r["part"]))
        own: dict[int, tuple[int, list[list[Corner]]]] = {}
        for r in rows:
            own.setdefault(r["face"], (r["label"], []))[1].append([(p["x"], p["y"], p["z"]) for p in r["ring"]])
        fid = rows[0]["fid"]
        told = {"fid": fid} | json.loads(rows[0]["attributes"] or "{}")
        floor = next((rings for label, rings in own.values() if label == 0), None)
        base = [list(reversed(r)) for r in floor] if floor else None
        return pa.table({"fid": [fid], "value": [feature(str(fid), {lod: list(own.values())}, translate, scale, told, base)]})

    told = faces if "attributes" in faces.columns else faces.withColumn("attributes", F.lit(None).cast("string"))
    return told.select("fid", "face", "part", "label", "ring", "attributes").groupBy("fid").applyInArrow(run, "fid long, value string")


def components(triangles: np.ndarray) -> np.ndarray:
    """The component of each triangle (n, 3 corners, 3): connected over edges, numbered by their first triangle."""
    up = list(range(len(triangles)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    held: dict[tuple, int] = {}
    for i, t in enumerate(triangles):
        own = [tuple(p) for p in np.round(t, 6)]
        for a, b in zip(own, [*own[1:], own[0]], strict=True):
            key = (min(a, b), max(a, b))
            if key in held:
                x, y = sorted((find(i), find(held[key])))
                up[y] = x
            held[key] = i
    return np.unique([find(i) for i in range(len(up))], return_inverse=True)[1] if len(up) else np.zeros(0, np.int64)


def terrain_feature(name: str, triangles: np.ndarray, translate: Corner = (0.0, 0.0, 0.0), scale: float = 1.0) -> str:
    """A relief of triangles (n, 3, 3), a surface for each of its components."""
    vertices = _Vertices(translate, scale)
    surfaces: dict[int, list] = defaultdict(list)
    for c, t in zip(components(triangles).tolist(), triangles.tolist(), strict=True):
        surfaces[c].append([vertices.ring([tuple(p) for p in t])])
    geometry = [{"type": "CompositeSurface", "lod": "1", "boundaries": s} for _, s in sorted(surfaces.items())]
    return json.dumps({"type": "CityJSONFeature", "id": name, "CityObjects": {name: {"type": "TINRelief", "geometry": geometry}}, "vertices": vertices.all()}, separators=(",", ":"))


def write(lines: DataFrame, path: str, metadata: str | None = None) -> None:
    """Text files of lines (tile_x, tile_y, fid, value), a folder per tile, buildings in order behind the metadata line."""
    own = lines.select("tile_x", "tile_y", "fid", "value")
    if metadata is not None:
        heads = own.select("tile_x", "tile_y").distinct().select("tile_x", "tile_y", F.lit(None).cast("long").alias("fid"), F.lit(metadata).alias("value"))
        own = own.unionByName(heads)
    ordered = own.repartition("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y", F.col("fid").asc_nulls_first())
    ordered.select("tile_x", "tile_y", "value").write.partitionBy("tile_x", "tile_y").text(path)


def write_names(lines: DataFrame, path: str) -> None:
    """The feature list: a building's name per line, in order within its file."""
    lines.select(F.col("fid").cast("string").alias("value")).repartitionByRange("value").sortWithinPartitions("value").write.text(path)
