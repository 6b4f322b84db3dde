"""Measures of one building's shapes, in numpy: simplified rings, the largest gap in its points, heights of terrain and roofs,
distances between points and meshes.

Defined cases: empty input gives empty results or None; repeated points count as one place; ties go to what comes first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrangement as A
from .build import ROOF, Mesh, percentile, triangulate


def simplify(ring: np.ndarray, tolerance: float = 0.01) -> np.ndarray:
    """The corners of a closed ring that Douglas and Peucker keep; the two farthest from each other of those tried are fixed.
    A ring that would lose its area comes back as it was."""
    ring = np.asarray(ring, float)
    n = len(ring)
    if n < 4:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(1)))
    keep = {0, far}
    todo = [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = ring[a], ring[b % n]
        d, between = q - p, ring[a + 1 : b]
        length = math.hypot(*d)
        off = np.abs(d[0] * (between[:, 1] - p[1]) - d[1] * (between[:, 0] - p[0])) / length if length > 0 else np.hypot(*(between - p).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    out = ring[sorted(keep)]
    return out if len(out) > 2 and abs(A.ring_area(out)) > 1e-9 else ring


def densified(rings: list[np.ndarray], spacing: float) -> np.ndarray:
    """Points along all edges, at most spacing apart, corners included."""
    out = []
    for ring in rings:
        for p, q in zip(ring, np.roll(ring, -1, 0), strict=True):
            n = max(1, math.ceil(math.hypot(*(q - p)) / spacing))
            out.append(p + (q - p) * (np.arange(n) / n)[:, None])
    return np.concatenate(out)


def _reach(centres: np.ndarray, sites: np.ndarray) -> np.ndarray:
    """Distance of each centre from its nearest site; in blocks, of sites too."""
    out = np.full(len(centres), np.inf)
    for a in range(0, len(centres), 256):
        for b in range(0, len(sites), 4096):
            d = centres[a : a + 256, None] - sites[None, b : b + 4096]
            out[a : a + 256] = np.minimum(out[a : a + 256], np.einsum("ijk,ijk->ij", d, d).min(1))
    return np.sqrt(out)


def _outline(centres: np.ndarray, rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each centre, whether the rings hold it (crossing parity) and its distance from their nearest edge."""
    p = np.concatenate(rings)
    e = np.concatenate([np.roll(r, -1, 0) - r for r in rings])
    off = centres[:, None] - p[None]
    crosses = ((p[:, 1] > centres[:, 1:]) != ((p + e)[:, 1] > centres[:, 1:])) & (off[:, :, 0] < off[:, :, 1] * (e[:, 0] / np.where(e[:, 1] == 0, 1, e[:, 1])))
    off -= np.clip(np.einsum("ijk,jk->ij", off, e) / np.maximum((e * e).sum(1), 1e-300), 0, 1)[:, :, None] * e
    return crosses.sum(1) % 2 == 1, np.sqrt(np.einsum("ijk,ijk->ij", off, off).min(1))


#: Distances that a level of empty_circle computes at once; beyond, it goes on in squares of its own with the sites around them.
MOST_DISTANCES = 1 << 18


def empty_circle(points: np.ndarray, rings: list[np.ndarray], spacing: float = 0.5, precision: float = 0.001) -> tuple[np.ndarray, float] | None:
    """Centre and radius of the largest circle, centred in the footprint, that holds no point and no part of its outline. By
    branch and bound over squares that meet the footprint: no square's circle is larger than that of its centre by more than
    its half diagonal. Of many sites, a square keeps those that can be nearest to a place in it, so every point counts."""
    rings = [np.asarray(r, float) for r in rings]
    if len(rings[0]) < 3 or abs(A.ring_area(rings[0])) < 1e-9:
        return None
    every = np.concatenate([densified(rings, spacing), np.asarray(points, float).reshape(-1, np.shape(points)[-1] if len(points) else 2)[:, :2]])
    every = np.unique(every[:, 0] + 1j * every[:, 1])
    low, high = rings[0].min(0), rings[0].max(0)
    steps = np.array([(-1, -1), (1, -1), (-1, 1), (1, 1)], float)
    best, at = -1.0, None
    todo = [(((low + high) / 2)[None], float(max(high - low)) / 2, np.stack([every.real, every.imag], 1))]
    while todo:
        squares, half, sites = todo.pop()
        while len(squares) and half * math.sqrt(2) > precision / 2:
            diagonal, reach = half * math.sqrt(2), _reach(squares, sites)
            keep = reach + diagonal > best + precision / 2
            squares, reach = squares[keep], reach[keep]
            if not len(squares):
                break
            own, off = _outline(squares, rings)
            if own.any():
                k = int(np.argmax(np.where(own, reach, -1)))
                if reach[k] > best:
                    best, at = float(reach[k]), squares[k]
            keep = (own | (off <= diagonal)) & (reach + diagonal > best + precision / 2)
            squares, reach = squares[keep], reach[keep]
            half /= 2
            if len(squares) * len(sites) * 4 > MOST_DISTANCES and len(sites) > 64:
                for k in np.argsort(reach):  # the most promising square is searched first
                    near = ((sites - squares[k]) ** 2).sum(1) <= (reach[k] + 2 * diagonal + 1e-9) ** 2
                    todo.append((squares[k] + steps * half, half, sites[near]))
                break
            squares = (squares[:, None] + steps[None] * half).reshape(-1, 2)
    return None if at is None else (at, best)


CIRCLES = "fid long, pc string, radius double"


def empty_circles(points: DataFrame, footprints: DataFrame, unit: float = 0.01) -> DataFrame:
    """fid, pc, radius: the largest gap of each building's points (fid, pc, x, y; footprints: fid, pc, rings), to millimetres. Every
    point counts; a group is a building's places in one acquisition, at two numbers each."""

    def run(own: pa.Table, foot: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in foot.slice(0, 1).to_pylist():
            rings = [np.array([(q["x"], q["y"]) for q in r], float) for r in row["rings"]]
            origin = rings[0].min(0)
            xy = np.stack([own.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], 1).reshape(-1, 2)
            found = empty_circle((xy[np.isfinite(xy).all(1)] - origin) * unit, [(r - origin) * unit for r in rings])
            out.append({"fid": row["fid"], "pc": row["pc"], "radius": None if found is None else round(found[1], 3)})
        return pa.Table.from_pylist(out, pa.schema([("fid", pa.int64()), ("pc", pa.string()), ("radius", pa.float64())]))

    foot = footprints.where("size(rings) > 0").select("fid", "pc", "rings")
    return points.select("fid", "pc", "x", "y").distinct().groupBy("fid", "pc").cogroup(foot.groupBy("fid", "pc")).applyInArrow(run, CIRCLES)


class Terrain:
    """Elevations by triangles (n, 3, 3), or one for all."""

    def __init__(self, triangles: np.ndarray | None = None, constant: float = 0.0):
        self.triangles, self.constant = triangles, constant

    def percentile(self, p: float) -> float:
        return self.constant if self.triangles is None or not len(self.triangles) else percentile(np.unique(self.triangles.reshape(-1, 3), axis=0)[:, 2], p)

    def at(self, x: float, y: float) -> float | None:
        """By the corners of the triangle that holds (x, y), its border included; None outside."""
        if self.triangles is None:
            return self.constant
        a, b, c = self.triangles[:, 0], self.triangles[:, 1], self.triangles[:, 2]
        whole = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            v = ((x - a[:, 0]) * (c[:, 1] - a[:, 1]) - (y - a[:, 1]) * (c[:, 0] - a[:, 0])) / whole
            w = ((b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])) / whole
        held = np.flatnonzero((v >= -1e-9) & (w >= -1e-9) & (v + w <= 1 + 1e-9))
        if not len(held):
            return None
        k = held[0]
        return float(a[k, 2] + v[k] * (b[k, 2] - a[k, 2]) + w[k] * (c[k, 2] - a[k, 2]))


def height_field(mesh: Mesh, cell: float, most: int = 600_000_000, frame: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Roof heights by raster cell (rows upwards, NaN where there is no roof), the raster's lower left, and its cell size:
    doubled until there are at most `most` cells. The highest roof above a cell's centre counts. frame: the box to cover."""
    roofs = [rings for label, rings in mesh.faces if label == ROOF]
    if not roofs:
        return np.zeros((0, 0)), np.zeros(2), cell
    every = np.concatenate([r for rings in roofs for r in rings])
    low, high = frame or (every[:, :2].min(0), every[:, :2].max(0))
    while np.prod(np.ceil((high - low) / cell)) > most:
        cell *= 2
    nx, ny = (max(1, int(k)) for k in np.ceil((high - low) / cell))
    xs, ys = low[0] + (np.arange(nx) + 0.5) * cell, low[1] + (np.arange(ny) + 0.5) * cell
    out = np.full((ny, nx), np.nan)
    for rings in roofs:
        flat = np.concatenate(rings)[:, :2]
        i = np.flatnonzero((xs >= flat[:, 0].min()) & (xs <= flat[:, 0].max()))
        j = np.flatnonzero((ys >= flat[:, 1].min()) & (ys <= flat[:, 1].max()))
        if not len(i) or not len(j):
            continue
        gx, gy = np.meshgrid(xs[i], ys[j])
        own = A.inside([r[:, :2] for r in rings], gx, gy)
        o = rings[0]
        normal = sum(np.cross(p - o[0], q - o[0]) for p, q in zip(o, np.roll(o, -1, 0), strict=True))
        z = o[0, 2] - ((gx - o[0, 0]) * normal[0] + (gy - o[0, 1]) * normal[1]) / normal[2]
        part = out[np.ix_(j, i)]
        out[np.ix_(j, i)] = np.where(own, np.fmax(part, z), part)
    return out, low, cell


def _to_triangle(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of points from a triangle: the least to its plane, where they lie above it, or to an edge."""
    best = np.full(len(p), np.inf)
    for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
        d = b - a
        s = np.clip(((p - a) @ d) / max(float(d @ d), 1e-18), 0, 1)
        best = np.minimum(best, ((p - a - s[:, None] * d) ** 2).sum(1))
    n = np.cross(t[1] - t[0], t[2] - t[0])
    size = float(n @ n)
    if size > 1e-18:
        above = np.ones(len(p), bool)
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            above &= np.cross(b - a, p - a) @ n >= 0
        best = np.where(above, np.minimum(best, ((p - t[0]) @ n) ** 2 / size), best)
    return best


def to_roof(points: np.ndarray, mesh: Mesh) -> tuple[np.ndarray, np.ndarray]:
    """Each point's distance from the nearest roof face, and which (by order of the roof faces); NaN and -1 without roofs."""
    best, face = np.full(len(points), np.inf), np.full(len(points), -1)
    for k, rings in enumerate(rings for label, rings in mesh.faces if label == ROOF):
        for t in triangulate(rings):
            d = _to_triangle(points, t)
            face[d < best] = k
            best = np.minimum(best, d)
    return np.where(face >= 0, np.sqrt(best), np.nan), face


def to_points(mesh: Mesh, points: np.ndarray) -> np.ndarray:
    """The distance of each roof corner from the nearest point."""
    corners = [r for label, rings in mesh.faces if label == ROOF for r in rings]
    if not corners or not len(points):
        return np.zeros(0)
    every = np.unique(np.concatenate(corners), axis=0)
    return np.array([np.sqrt(((points - c) ** 2).sum(1).min()) for c in every])


def face_heights(mesh: Mesh, cell: float = 0.05) -> list[dict[str, float]]:
    """Per roof face h_min, h_50p, h_70p, h_max over the cells that are its own (the highest there), or its corners."""
    roofs = [rings for label, rings in mesh.faces if label == ROOF]
    if not roofs:
        return []
    every = np.concatenate([r for rings in roofs for r in rings])[:, :2]
    frame = every.min(0), every.max(0)
    field, _, cell = height_field(mesh, cell, frame=frame)
    out = []
    for rings in roofs:
        own = height_field(Mesh([(ROOF, rings)]), cell, frame=frame)[0]
        h = own[np.isfinite(own) & (own >= field - 1e-6)]
        h = h if len(h) else rings[0][:, 2]
        out.append({"h_min": float(h.min()), "h_50p": percentile(h, 0.5), "h_70p": percentile(h, 0.7), "h_max": float(h.max())})
    return out
