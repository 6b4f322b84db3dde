"""Solids of a building: LoD 1.1 prism, LoD 1.2 and 1.3 with flat roofs, LoD 2.2 with sloped ones.

`reconstruct` takes a building's roof points, footprint rings and floor height (metres) and returns a Mesh per LoD:

1. Planes are grown (planes.py). Without any, or with too many cells, all LoDs are prisms; the status says so.
2. Lines: where planes meet that are adjacent seen from above, if that is where their points meet; else the straight line between their points (a
   step). Lines nearly parallel and close to one already taken, or to a footprint edge, are left out; intersections first.
3. The footprint is cut by the lines and its cells labelled (arrangement.py).
4. LoD 2.2 raises each region to its plane. LoD 1.3 merges the neighbours whose medians differ least, while they differ by
   less than `step`, and raises each to its 70th percentile; LoD 1.2 has one height.
5. Extrusion: floors, roofs, and walls between regions of different heights, split where two roofs cross; vertical edges
   carry all heights of their column, so every edge is used once in each direction.

Results depend on the points' values, not their order. A building that fails has a status; it never fails its task.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrangement as A
from . import planes as P

GROUND, ROOF, OUTER, INNER = 0, 1, 2, 3
LODS = ("1.1", "1.2", "1.3", "2.2")


@dataclass(frozen=True)
class BuildParameters:
    planes: P.PlaneParameters = P.PlaneParameters()
    detector: str = "grow"
    regularise: bool = False
    data_weight: float = 0.888
    line_angle: float = 8.59
    line_distance: float = 0.8
    meet_distance: float = 1.0
    straight: float = 0.5
    apart: float = 0.2
    step: float = 3.0
    percentile: float = 0.7


@dataclass
class Mesh:
    """Faces: (label, rings of corners x, y, z), the outer ring first, seen from outside counter-clockwise."""

    faces: list[tuple[int, list[np.ndarray]]] = field(default_factory=list)

    def count(self, label: int) -> int:
        return sum(k == label for k, _ in self.faces)

    def volume(self) -> float:
        """Signed tetrahedra about the centre of all corners."""
        if not self.faces:
            return 0.0
        centre = np.concatenate([r for _, rings in self.faces for r in rings]).mean(0)
        total = 0.0
        for _, rings in self.faces:
            for ring in rings:
                p = ring - centre
                total += float(np.einsum("ij,ij->", np.cross(p[1:-1], p[2:]), np.broadcast_to(p[0], (len(p) - 2, 3))))
        return total / 6

    def bad_edges(self) -> int:
        """Edges that are not used as often in one direction as in the other."""
        used: Counter = Counter()
        for _, rings in self.faces:
            for ring in rings:
                own = [tuple(np.round(p, 5)) for p in ring]
                used.update(zip(own, [*own[1:], own[0]], strict=True))
        return sum(n != used[b, a] for (a, b), n in used.items())


def percentile(values: np.ndarray, p: float) -> float:
    return float(np.sort(values)[int((len(values) - 1) * p)])


def _parallel(a: A.Line, b: A.Line, degrees: float) -> bool:
    return abs(a[0] * b[0] + a[1] * b[1]) > math.cos(math.radians(degrees))


def roof_lines(points: np.ndarray, found: P.Planes, around: np.ndarray, rings: list[np.ndarray], p: BuildParameters) -> list[A.Line]:
    meet, steps = [], []
    for (i, j), n in sorted(P.adjacency(found.label, around).items()):
        if n < p.planes.least_adjacent:
            continue
        a, b = np.nonzero(((found.label[:, None] == i) & (found.label[around] == j)) | ((found.label[:, None] == j) & (found.label[around] == i)))
        middle = (points[a, :2] + points[around[a, b], :2]) / 2
        centre = middle.mean(0)
        one, two = found.planes[i], found.planes[j]
        d = one[[0, 1, 3]] / one[2] - two[[0, 1, 3]] / two[2]
        size = float(np.hypot(d[0], d[1]))
        if size > 1e-6:
            line = (d[0] / size, d[1] / size, -d[2] / size)
            far = np.abs(middle @ line[:2] - line[2]) > p.meet_distance
            if far.mean() <= 0.5:
                meet.append((-n, line, centre))
                if far.sum() < max(p.planes.least_adjacent, p.apart * len(far)):
                    continue
                middle = middle[far]  # they also lie side by side where they don't meet
                centre = middle.mean(0)
        values, vectors = np.linalg.eigh(np.cov((middle - centre).T, bias=True))
        if values[0] <= p.straight**2 and values[1] > 4 * values[0]:
            normal = vectors[:, 0]
            steps.append((-n, (float(normal[0]), float(normal[1]), float(normal @ centre)), centre))
    edges = [(line, (q + r) / 2) for ring in rings for q, r in zip(ring, np.roll(ring, -1, 0), strict=True) if (line := A.line_through(q, r))]
    out: list[A.Line] = []
    for kind, lines in enumerate((meet, steps)):
        for _, line, centre in sorted(lines, key=lambda x: (x[0], x[1])):
            centre = centre - (centre @ line[:2] - line[2]) * np.array(line[:2])
            close = lambda own, line=line, centre=centre: _parallel(own, line, p.line_angle) and abs(centre @ own[:2] - own[2]) < p.line_distance
            if any(close(own) for own in out) or (kind and any(close(own) for own, _ in edges)):
                continue
            if kind:  # a step runs along the footprint's directions where it nearly does so
                for own, _ in edges:
                    if _parallel(own, line, p.line_angle):
                        line = (own[0], own[1], float(centre @ own[:2]))
                        break
            out.append(line)
    return out


def merge(parts: A.Partition, region: np.ndarray, heights: list[np.ndarray], step: float) -> np.ndarray:
    """Regions after the neighbours whose medians differ least, by less than step, were merged again and again."""
    group, pool = region.copy(), {r: h for r, h in enumerate(heights)}
    pairs = {(int(region[i]), int(region[j])) for i, j in parts.neighbours() if region[i] != region[j]}
    while True:
        best = None
        for a, b in sorted({(min(p), max(p)) for p in pairs}):
            gap = abs(percentile(pool[a], 0.5) - percentile(pool[b], 0.5)) if len(pool[a]) and len(pool[b]) else 0.0
            if gap < step and (best is None or (gap, a, b) < best):
                best = (gap, a, b)
        if best is None:
            return np.unique(group, return_inverse=True)[1]
        _, a, b = best
        group[group == b] = a
        pool[a] = np.concatenate([pool[a], pool.pop(b)])
        pairs = {(a if x == b else x, a if y == b else y) for x, y in pairs}
        pairs = {(x, y) for x, y in pairs if x != y}


def extrude(parts: A.Partition, region: np.ndarray, height: Callable[[int, np.ndarray], np.ndarray], floor: float) -> Mesh:
    """height(region, corners): z of a region's roof at its corners."""
    lift = lambda r, v: round(float(height(r, np.array([parts.at[v]]))[0]), 6)
    rings = A.trace(parts, region)
    # where two roofs cross above an edge, both get a corner
    beside: dict[tuple[int, int], int] = {}
    for r, own in enumerate(rings):
        for ring in own:
            beside.update({e: r for e in zip(ring, [*ring[1:], ring[0]], strict=True)})
    split: dict[tuple[int, int], int] = {}
    for (u, v), r in sorted(beside.items()):
        s = beside.get((v, u))
        if s is not None and u < v and r != s:
            a, b = lift(r, u) - lift(s, u), lift(r, v) - lift(s, v)
            if a * b < 0 and min(abs(a), abs(b)) > 1e-6:
                t = a / (a - b)
                split[u, v] = split[v, u] = len(parts.at)
                parts.at.append(tuple(np.add(parts.at[u], t * np.subtract(parts.at[v], parts.at[u]))))
    if split:
        rings = [[[x for e in zip(ring, [*ring[1:], ring[0]], strict=True) for x in ((e[0], split[e]) if e in split else (e[0],))] for ring in own] for own in rings]
        beside = {e: r for r, own in enumerate(rings) for ring in own for e in zip(ring, [*ring[1:], ring[0]], strict=True)}
    middle = set(split.values())
    z: dict[tuple[int, int], float] = {}
    for (u, v), r in beside.items():
        for w in (u, v):
            z[r, w] = lift(r, w)
    for w in middle:  # the same height for both
        own = [k for k in z if k[1] == w]
        level = z[min(own)]
        for k in own:
            z[k] = level
    column: dict[int, set[float]] = defaultdict(lambda: {floor})
    for (_, w), h in z.items():
        column[w].add(h)
    mesh = Mesh()
    corner = lambda w, h: (*parts.at[w], h)
    for r, own in enumerate(rings):
        mesh.faces.append((ROOF, [np.array([corner(w, z[r, w]) for w in ring]) for ring in own]))
        mesh.faces.append((GROUND, [np.array([corner(w, floor) for w in reversed(ring)]) for ring in own]))
    for (u, v), r in sorted(beside.items()):
        s = beside.get((v, u))
        low = (floor, floor) if s is None else (z[s, u], z[s, v])
        top = (z[r, u], z[r, v])
        if top[0] - low[0] < 1e-6 and top[1] - low[1] < 1e-6:
            continue
        rise = sorted(h for h in column[v] if low[1] < h < top[1])
        fall = sorted((h for h in column[u] if low[0] < h < top[0]), reverse=True)
        ring = [corner(u, low[0]), corner(v, low[1]), *(corner(v, h) for h in rise), corner(v, top[1]), corner(u, top[0]), *(corner(u, h) for h in fall)]
        ring = [p for p, q in zip(ring, [ring[-1], *ring[:-1]], strict=True) if p != q]
        mesh.faces.append((OUTER if s is None else INNER, [np.array(ring)]))
    return mesh


def reconstruct(roof: np.ndarray, rings: list[np.ndarray], floor: float, p: BuildParameters = BuildParameters(), block: bool = False) -> tuple[str, dict[str, Mesh], P.Planes | None]:
    """Status, the meshes by LoD, and the planes. roof: points x, y, z; rings: outer, then holes; block: prisms only."""
    origin = np.asarray(rings[0][0], float)
    rings = [np.asarray(r, float) - origin for r in rings]
    points = np.asarray(roof, float).reshape(-1, 3) - [*origin, 0]
    points = points[np.lexsort(points.T[::-1])]
    if not len(points):
        return "no points", {}, None
    base = A.Partition(rings)
    if not base.cells:
        return "no area", {}, None
    one = np.zeros(len(base.cells), np.int64)
    flat = percentile(points[:, 2], p.percentile)
    prism = lambda: extrude(base, one, lambda _, xy: np.full(len(xy), flat), floor)
    found, status = None, "block"
    meshes = {lod: prism() for lod in LODS}
    if not block:
        try:
            found = P.DETECTORS[p.detector](points, p.planes)
            found = P.regularise(found, points) if p.regularise and found.planes else found
            status = "ok" if found.planes else found.roof_type
            if found.planes:
                meshes |= _with_planes(points, found, rings, floor, p)
        except (ValueError, np.linalg.LinAlgError) as e:
            found, status = None, f"block: {e}"
    for mesh in meshes.values():
        for _, own in mesh.faces:
            for ring in own:
                ring[:, :2] += origin
    return status, meshes, found


def _with_planes(points: np.ndarray, found: P.Planes, rings: list[np.ndarray], floor: float, p: BuildParameters) -> dict[str, Mesh]:
    around = P.nearest(points * [1, 1, 0], p.planes.neighbours)  # in the plane: a step parts neighbours in space
    parts = A.Partition(rings)
    for line in roof_lines(points, found, around, rings, p):
        parts.cut(line)
    where = parts.locate(points[:, :2])
    planes = [found.planes[i] for i in sorted(found.planes)]
    level = np.stack([-(points[:, :2] @ q[:2] + q[3]) / q[2] for q in planes], 1)
    off = np.abs(points[:, 2, None] - level)
    n = len(parts.cells)
    inner = where >= 0
    number = np.maximum(np.bincount(where[inner], minlength=n), 1)
    cost = np.stack([np.bincount(where[inner], off[inner, k], n) / number for k in range(len(planes))], 1) * parts.areas()[:, None] * p.data_weight
    pairs = {k: w * (1 - p.data_weight) for k, w in parts.neighbours().items()}
    label = A.expand(cost, pairs)
    region = A.regions(parts, label)
    of = {int(r): planes[int(label[i])] for i, r in enumerate(region)}
    sloped = extrude(parts, region, lambda r, xy: -(xy @ of[r][:2] + of[r][3]) / of[r][2], floor)
    heights = [points[inner, 2][region[where[inner]] == r] for r in range(int(region.max()) + 1)]
    merged = merge(parts, region, heights, p.step)
    whole = points[:, 2]

    def flat(group: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        own = {r: points[inner, 2][group[where[inner]] == r] for r in range(int(group.max()) + 1)}
        top = {r: percentile(h if len(h) else whole, p.percentile) for r, h in own.items()}
        return lambda r, xy: np.full(len(xy), top[r])

    single = np.zeros(n, np.int64)
    return {"1.2": extrude(parts, single, flat(single), floor), "1.3": extrude(parts, merged, flat(merged), floor), "2.2": sloped}


def rmse(mesh: Mesh, points: np.ndarray) -> float | None:
    """Root mean square of the points' vertical distances to the roof above or below them; None where no roof is."""
    total, n = 0.0, 0
    for label, rings in mesh.faces:
        if label != ROOF:
            continue
        own = A.inside([r[:, :2] for r in rings], points[:, 0], points[:, 1])
        outer = rings[0]
        normal = np.zeros(3)
        for a, b in zip(outer, np.roll(outer, -1, 0), strict=True):
            normal += np.cross(a - outer[0], b - outer[0])
        z = outer[0, 2] - ((points[own, :2] - outer[0, :2]) @ normal[:2]) / normal[2]
        total, n = total + float(((points[own, 2] - z) ** 2).sum()), n + int(own.sum())
    return math.sqrt(total / n) if n else None


def triangulate(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Triangles of a planar face with holes, by clipping ears; holes are joined to the outer ring by bridges first."""
    outer = rings[0]
    normal = np.zeros(3)
    for a, b in zip(outer, np.roll(outer, -1, 0), strict=True):
        normal += np.cross(a - outer[0], b - outer[0])
    axis = int(np.argmax(np.abs(normal)))
    keep = [(1, 2), (2, 0), (0, 1)][axis]
    flip = 1 if normal[axis] > 0 else -1
    flat = lambda p: (float(p[keep[0]]) * flip, float(p[keep[1]]))
    ring = [(flat(p), p) for p in outer]
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def crosses(a, b, c, d) -> bool:
        return cross(a, b, c) * cross(a, b, d) < -1e-18 and cross(c, d, a) * cross(c, d, b) < -1e-18

    holes = [[(flat(p), p) for p in r] for r in rings[1:]]
    holes.sort(key=lambda h: -max(p[0][0] for p in h))
    for k, hole in enumerate(holes):
        edges = [*zip(ring, [*ring[1:], ring[0]], strict=True), *(e for h in holes[k:] for e in zip(h, [*h[1:], h[0]], strict=True))]
        choices = sorted((math.dist(a[0], b[0]), i, j) for i, a in enumerate(ring) for j, b in enumerate(hole))
        for _, i, j in choices:
            if not any(crosses(ring[i][0], hole[j][0], c[0], d[0]) for c, d in edges):
                ring = [*ring[: i + 1], *hole[j:], *hole[: j + 1], *ring[i:]]
                break
    out = []
    while len(ring) > 2:
        n = len(ring)
        for i in range(n):
            (a, pa_), (b, pb), (c, pc) = ring[i - 1], ring[i], ring[(i + 1) % n]
            area = cross(a, b, c)
            if area < 1e-12 and n > 3:
                if abs(area) <= 1e-12 and ((b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1])) >= 0:
                    ring.pop(i)
                    break
                continue
            others = (q[0] for k, q in enumerate(ring) if k not in ((i - 1) % n, i, (i + 1) % n) and q[0] not in (a, b, c))
            if not any(cross(a, b, q) >= 0 and cross(b, c, q) >= 0 and cross(c, a, q) >= 0 for q in others):
                if area > 1e-12:
                    out.append(np.array([pa_, pb, pc]))
                ring.pop(i)
                break
        else:
            break
    return out


def triangulate_mesh(mesh: Mesh) -> np.ndarray:
    """All faces as triangles (n, 3 corners, 3 coordinates)."""
    every = [t for _, rings in mesh.faces for t in triangulate(rings)]
    return np.array(every).reshape(-1, 3, 3)


SCHEMA = "fid long, pc string, lod string, status string, roof_type string, n_roof long, n_outer long, n_inner long, bad_edges long, volume double, rmse double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def rows(fid: int, pc: str, roof: np.ndarray, rings: list[np.ndarray], floor: float, p: BuildParameters = BuildParameters(), block: bool = False) -> list[dict]:
    """The rows of `buildings` for one building."""
    try:
        status, meshes, found = reconstruct(roof, rings, floor, p, block)
    except (ValueError, IndexError, KeyError, np.linalg.LinAlgError) as e:
        status, meshes, found = f"failed: {type(e).__name__}", {}, None
    out = []
    for lod in LODS:
        m = meshes.get(lod)
        own = {"n_roof": None, "n_outer": None, "n_inner": None, "bad_edges": None, "volume": None, "rmse": None}
        if m is not None:
            off = rmse(m, roof)
            own = {"n_roof": m.count(ROOF), "n_outer": m.count(OUTER), "n_inner": m.count(INNER), "bad_edges": m.bad_edges(), "volume": round(m.volume(), 4), "rmse": None if off is None else round(off, 6)}
        out.append({"fid": fid, "pc": pc, "lod": lod, "status": status, "roof_type": found.roof_type if found else None} | own)
    return out


def buildings(roof_points: DataFrame, footprints: DataFrame, unit: float = 0.01, p: BuildParameters = BuildParameters()) -> DataFrame:
    """A row per building, acquisition and LoD. roof_points: fid, pc, x, y, z; footprints: fid, pc, rings, floor,
    block (in units of `unit` metres). A group is as large as thinning lets a building be."""
    schema = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(points: pa.Table, own: pa.Table) -> pa.Table:
        made: list[dict] = []
        if own.num_rows and points.num_rows:
            row = own.slice(0, 1).to_pylist()[0]
            rings = [np.array([(q["x"], q["y"]) for q in r], float) * unit for r in row["rings"]]
            xyz = np.stack([points.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1) * unit
            if rings and len(rings[0]):
                made = rows(row["fid"], row["pc"], xyz[np.isfinite(xyz).all(1)], rings, row["floor"] * unit, p, bool(row["block"]))
        return pa.Table.from_pylist(made, schema)

    own = footprints.where("rings IS NOT NULL AND floor IS NOT NULL").select("fid", "pc", "rings", "floor", "block")
    return roof_points.select("fid", "pc", "x", "y", "z").groupBy("fid", "pc").cogroup(own.groupBy("fid", "pc")).applyInArrow(run, SCHEMA)
