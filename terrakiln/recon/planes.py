"""Planes of a building: nearest neighbours, normals, region growing, roof types, adjacency and ridges.

`detect` works on one building's roof points (metres); `roof_planes` applies it to every building and acquisition. A group
is bounded: points are thinned to a density ceiling before, and buildings over the fallback area take the block model.
Order is by fit quality, then by coordinates, so results do not depend on the order of arrival. A building that fails has
a status instead of planes; it never fails its task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlaneParameters:
    neighbours: int = 15
    normal_neighbours: int = 5
    distance: float = 0.3
    cosine: float = 0.75
    least_points: int = 15
    refit: int = 5
    most_regions: int = 900
    wall_degrees: float = 72.5
    horizontal_degrees: float = 5.73
    ridge_degrees: float = 5.0
    least_adjacent: int = 5
    line_distance: float = 1.0


DEFAULTS = PlaneParameters()


@dataclass
class Planes:
    """label: 0 for points of no plane, else from 1 in order of detection. planes: unit normal and offset, a x + b y + c z + d = 0."""

    label: np.ndarray
    planes: dict[int, np.ndarray] = field(default_factory=dict)
    horizontal: set[int] = field(default_factory=set)
    started: bool = False

    @property
    def roof_type(self) -> str:
        slanted = len(self.planes) - len(self.horizontal)
        if not self.started:
            return "no points"
        if slanted:
            return "slanted"
        return {0: "no planes", 1: "horizontal"}.get(len(self.horizontal), "multiple horizontal")


def nearest(points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other points of each point; ties by place in the array. In chunks, by a sorted grid of columns."""
    n = len(points)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros((n, 0), np.int64)
    out = np.empty((n, k), np.int64)
    span = np.ptp(points[:, :2], axis=0)
    cell = max(1e-9, math.sqrt(max(span[0] * span[1], 1e-9) * (k + 1) / n) * 1.5, span.max() / 1000)
    key = np.floor((points[:, :2] - points[:, :2].min(0)) / cell).astype(np.int64)
    cells: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(map(tuple, key.tolist())):
        cells.setdefault(c, []).append(i)
    reach = int(key.max()) + 1
    for (cx, cy), own in cells.items():
        r, todo = 1, own
        while todo:
            around = np.array(sorted(j for x in range(cx - r, cx + r + 1) for y in range(cy - r, cy + r + 1) for j in cells.get((x, y), ())))
            left = []
            if len(around) > k:
                d = ((points[todo][:, None] - points[around][None]) ** 2).sum(2)
                d[np.array(todo)[:, None] == around[None]] = np.inf
                order = np.lexsort((np.broadcast_to(around, d.shape), d), axis=1)[:, :k]
                far = np.take_along_axis(d, order, 1)[:, -1]
                sure = (far <= (r * cell) ** 2) | (r > reach)
                for i, o, ok in zip(todo, order, sure, strict=True):
                    if ok:
                        out[i] = around[o]
                    else:
                        left.append(i)
            else:
                left = todo
            todo, r = left, r * 2
    return out


def fit(points: np.ndarray) -> np.ndarray:
    """The plane of least squares: unit normal upwards, offset."""
    centre = points.mean(0)
    normal = np.linalg.eigh(np.cov((points - centre).T, bias=True))[1][:, 0]
    normal = normal if normal[2] >= 0 else -normal
    return np.array([*normal, -normal @ centre])


def normals(points: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals, upwards, of each point's neighbourhood (itself included), and their residuals."""
    near = points[np.concatenate([np.arange(len(points))[:, None], around], 1)]
    off = near - near.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", off, off) / near.shape[1])
    up = vectors[:, :, 0]
    return np.where(up[:, 2:] < 0, -up, up), values[:, 0]


def detect(points: np.ndarray, p: PlaneParameters = PlaneParameters()) -> Planes:
    """Grows planes from the best-fitting points over the graph of nearest neighbours."""
    n = len(points)
    found = Planes(np.zeros(n, np.int64))
    if n < p.least_points:
        return found
    found.started = True
    around = nearest(points, p.neighbours)
    normal, residual = normals(points, around[:, : p.normal_neighbours])
    seeds = np.lexsort((points[:, 2], points[:, 1], points[:, 0], np.round(residual, 12)))
    region = np.full(n, -1, np.int64)
    number = regions = 0
    for seed in seeds.tolist():
        if region[seed] >= 0:
            continue
        regions += 1
        if regions > p.most_regions + n:
            raise ValueError("too many regions")
        members, at, fresh = [seed], 0, 0
        plane = fit(points[[seed, *around[seed, : p.normal_neighbours]]])
        region[seed] = regions
        while at < len(members):
            for j in around[members[at]].tolist():
                if region[j] < 0 and (points[j] @ plane[:3] + plane[3]) ** 2 < p.distance**2 and abs(normal[j] @ plane[:3]) > p.cosine:
                    region[j] = regions
                    members.append(j)
                    fresh += 1
                    if fresh % p.refit == 0 and len(members) >= 3:
                        plane = fit(points[members])
            at += 1
        if len(members) < p.least_points:
            region[members[1:]] = -1
            continue
        plane = fit(points[members])
        tilt = math.degrees(math.acos(min(1.0, abs(plane[2]))))
        if tilt > p.wall_degrees:
            continue
        number += 1
        if number > p.most_regions:
            raise ValueError("too many planes")
        found.label[members] = number
        found.planes[number] = plane
        if tilt < p.horizontal_degrees:
            found.horizontal.add(number)
    return found


def ransac(points: np.ndarray, p: PlaneParameters = PlaneParameters(), rounds: int = 400, seed: int = 1) -> Planes:
    """Planes by drawing: of `rounds` planes through three points, the one with the most points near it is taken, again and
    again, while it has enough. Drawn from the sorted points with a fixed seed."""
    found = Planes(np.zeros(len(points), np.int64))
    if len(points) < p.least_points:
        return found
    found.started = True
    rng = np.random.default_rng(seed)
    left = np.arange(len(points))
    while len(left) >= p.least_points and len(found.planes) < p.most_regions:
        own = points[left]
        best = np.zeros(len(left), bool)
        for _ in range(rounds):
            a, b, c = own[rng.choice(len(left), 3, replace=False)]
            normal = np.cross(b - a, c - a)
            size = float(np.linalg.norm(normal))
            if size > 1e-9:
                near = np.abs((own - a) @ (normal / size)) < p.distance
                if near.sum() > best.sum():
                    best = near
        if best.sum() < p.least_points:
            break
        plane = fit(own[best])
        tilt = math.degrees(math.acos(min(1.0, abs(plane[2]))))
        members, left = left[best], left[~best]
        if tilt > p.wall_degrees:
            continue
        number = len(found.planes) + 1
        found.label[members], found.planes[number] = number, plane
        if tilt < p.horizontal_degrees:
            found.horizontal.add(number)
    return found


def regularise(found: Planes, points: np.ndarray, degrees: float = 5.0, offset: float = 0.2) -> Planes:
    """Planes whose normals differ by less than degrees share their mean, weighted by points; of those, planes less than
    offset apart are one. Larger planes come first."""
    order = sorted(found.planes, key=lambda k: (-(found.label == k).sum(), k))
    groups: list[list[int]] = []
    for k in order:
        near = next((g for g in groups if abs(found.planes[g[0]][:3] @ found.planes[k][:3]) > math.cos(math.radians(degrees))), None)
        if near is None:
            groups.append([k])
        else:
            near.append(k)
    out = Planes(np.zeros_like(found.label), started=found.started)
    for g in groups:
        normal = sum(found.planes[k][:3] * np.sign(found.planes[k][:3] @ found.planes[g[0]][:3]) * (found.label == k).sum() for k in g)
        normal = normal / np.linalg.norm(normal)
        made: list[int] = []
        for k in g:
            own = found.label == k
            d = -float((points[own] @ normal).mean())
            same = next((m for m in made if abs(out.planes[m][3] - d) < offset), None)
            if same is None:
                same = len(out.planes) + 1
                made.append(same)
                out.planes[same] = np.array([*normal, d])
                if math.degrees(math.acos(min(1.0, abs(normal[2])))) < DEFAULTS.horizontal_degrees:
                    out.horizontal.add(same)
            out.label[own] = same
    return out


#: Ways to find planes: points and parameters to Planes.
DETECTORS = {"grow": detect, "ransac": ransac}


def adjacency(label: np.ndarray, around: np.ndarray) -> dict[tuple[int, int], int]:
    """How often a point of one plane has a neighbour of another: (higher, lower) -> count, both directions."""
    a, b = np.broadcast_to(label[:, None], around.shape).ravel(), label[around].ravel()
    keep = (a != b) & (a > 0) & (b > 0)
    pairs, counts = np.unique(np.stack([np.maximum(a, b)[keep], np.minimum(a, b)[keep]], 1), axis=0, return_counts=True)
    return {(int(x), int(y)): int(c) for (x, y), c in zip(pairs, counts, strict=True)}


def intersections(points: np.ndarray, found: Planes, adjacent: dict[tuple[int, int], int], p: PlaneParameters = PlaneParameters()) -> list[dict]:
    """Where adjacent planes meet: the part of their line along which both have points within reach; ridge if both slope and
    the line is level."""
    out = []
    for (i, j), n in sorted(adjacent.items()):
        a, b = found.planes.get(i), found.planes.get(j)
        if n < p.least_adjacent or a is None or b is None:
            continue
        along = np.cross(a[:3], b[:3])
        length = np.linalg.norm(along)
        if length < 1e-9:
            continue
        along /= length
        origin = np.linalg.lstsq(np.stack([a[:3], b[:3], along]), np.array([-a[3], -b[3], along @ points.mean(0)]), rcond=None)[0]
        spans = []
        for k in (i, j):
            off = points[found.label == k] - origin
            t = off @ along
            close = t[((off - t[:, None] * along) ** 2).sum(1) <= p.line_distance**2]
            spans.append((close.min(), close.max()) if len(close) else None)
        if None in spans:
            continue
        low, high = max(s[0] for s in spans), min(s[1] for s in spans)
        if high <= low:
            continue
        level = math.degrees(math.asin(min(1.0, abs(along[2])))) < p.ridge_degrees
        tilted = all(math.degrees(math.acos(min(1.0, abs(x[2])))) > p.ridge_degrees for x in (a, b))
        out.append({"high": i, "low": j, "n": n, "start": origin + low * along, "end": origin + high * along, "ridge": level and tilted})
    return out


SCHEMA = "fid long, pc string, status string, roof_type string, n_points long, n_planes long, n_horizontal long, n_segmented long, h_50p double, h_70p double, n_ridges long, ridge_z double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def summary(points: np.ndarray, p: PlaneParameters = PlaneParameters()) -> dict:
    """The row of roof_planes for one building."""
    none = {"n_planes": 0, "n_horizontal": 0, "n_segmented": 0, "h_50p": None, "h_70p": None, "n_ridges": 0, "ridge_z": None}
    try:
        found = detect(points, p)
    except (ValueError, np.linalg.LinAlgError) as e:
        return {"status": f"failed: {e}", "roof_type": None, "n_points": len(points)} | none
    row = {"status": "ok", "roof_type": found.roof_type, "n_points": len(points)} | none
    if found.planes:
        heights = np.sort(points[found.label > 0, 2])
        pick = lambda q: float(heights[int((len(heights) - 1) * q)])
        lines = [x for x in intersections(points, found, adjacency(found.label, nearest(points, p.neighbours)), p) if x["ridge"]]
        row |= {"n_planes": len(found.planes), "n_horizontal": len(found.horizontal), "n_segmented": len(heights), "h_50p": pick(0.5), "h_70p": pick(0.7), "n_ridges": len(lines)}
        row["ridge_z"] = max((float(max(x["start"][2], x["end"][2])) for x in lines), default=None)
    return row


def roof_planes(roof_points: DataFrame, unit: float = 0.01, p: PlaneParameters = PlaneParameters()) -> DataFrame:
    """A row of SCHEMA for each building and acquisition of roof_points (fid, pc, x, y, z in units of `unit` metres)."""
    schema = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(group: pa.Table) -> pa.Table:
        xyz = np.stack([group.column(c).to_numpy().astype(float) for c in "xyz"], 1)
        xyz = xyz[np.lexsort(xyz.T[::-1])] * unit
        head = {"fid": group.column("fid")[0].as_py(), "pc": group.column("pc")[0].as_py()}
        return pa.Table.from_pylist([head | summary(xyz, p)], schema)

    return roof_points.select("fid", "pc", "x", "y", "z").groupBy("fid", "pc").applyInArrow(run, SCHEMA)
