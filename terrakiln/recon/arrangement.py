"""A planar partition of a footprint by lines, its labelling, and what it dissolves to.

The footprint's box is cut by the lines of all footprint edges; cells outside the footprint go; the others are cut by the
roof's lines. All cells are convex, a line cuts every cell that it crosses, and a cut of an edge is made once for both of
its cells, so neighbours share whole edges. Cells are labelled with planes by alpha expansion: each step is a minimum cut
between "keep the label" and "take this plane", over data costs by cell and the length of edges between labels. Cells of
one label that touch dissolve to regions, whose rings are traced along directed edges; corners in the middle of a straight
run go.

Defined cases: a footprint without area has no cells; without planes the labelling is empty; a line along an edge cuts
nothing; more cells than MOST is an error, which the driver turns into a block model.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np

MOST, EPS = 4000, 1e-7
Line = tuple[float, float, float]  # a x + b y = c, (a, b) of length 1


def line_through(p: np.ndarray, q: np.ndarray) -> Line | None:
    d = np.asarray(q, float) - p
    length = float(np.hypot(*d))
    if length < 1e-9:
        return None
    a, b = -d[1] / length, d[0] / length
    return a, b, float(a * p[0] + b * p[1])


def ring_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def inside(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Crossing parity over all rings."""
    out = np.zeros(np.shape(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if y1 != y2:
                out ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return out


class Partition:
    """cells: rings of vertex numbers, counter-clockwise; at: coordinates by number."""

    def __init__(self, rings: list[np.ndarray]):
        self.rings = [np.asarray(r, float) for r in rings]
        outer = self.rings[0]
        low, high = outer.min(0) - 1, outer.max(0) + 1
        self.at: list[tuple[float, float]] = [(low[0], low[1]), (high[0], low[1]), (high[0], high[1]), (low[0], high[1])]
        self.cells: list[list[int]] = [[0, 1, 2, 3]]
        for ring in self.rings:
            for p, q in zip(ring, np.roll(ring, -1, 0), strict=True):
                if (line := line_through(p, q)) is not None:
                    self.cut(line)
        middle = np.array([self.points(c).mean(0) for c in self.cells])
        self.cells = [c for c, ok in zip(self.cells, inside(self.rings, *middle.T), strict=True) if ok and abs(ring_area(self.points(c))) > 1e-6]

    def points(self, cell: list[int]) -> np.ndarray:
        return np.array([self.at[v] for v in cell])

    def cut(self, line: Line) -> None:
        a, b, c = line
        off = np.array(self.at) @ (a, b) - c
        side = np.where(np.abs(off) < EPS, 0, np.sign(off)).astype(int)
        made: dict[tuple[int, int], int] = {}
        out = []
        for cell in self.cells:
            own = side[cell]
            if not ((own > 0).any() and (own < 0).any()):
                out.append(cell)
                continue
            halves: tuple[list[int], list[int]] = ([], [])
            for u, v in zip(cell, [*cell[1:], cell[0]], strict=True):
                if side[u] >= 0:
                    halves[0].append(u)
                if side[u] <= 0:
                    halves[1].append(u)
                if side[u] * side[v] < 0:
                    key = (min(u, v), max(u, v))
                    if key not in made:
                        t = off[key[0]] / (off[key[0]] - off[key[1]])
                        (x1, y1), (x2, y2) = self.at[key[0]], self.at[key[1]]
                        made[key] = len(self.at)
                        self.at.append((x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
                    for half in halves:
                        half.append(made[key])
            out += [h for h in halves if len(h) > 2]
        if len(out) > MOST:
            raise ValueError("too many cells")
        self.cells = out

    def areas(self) -> np.ndarray:
        return np.array([ring_area(self.points(c)) for c in self.cells])

    def locate(self, xy: np.ndarray) -> np.ndarray:
        """The cell of each point, -1 outside."""
        where = np.full(len(xy), -1)
        for i, cell in enumerate(self.cells):
            p = self.points(cell)
            d = np.roll(p, -1, 0) - p
            left = np.flatnonzero(where < 0)
            ok = np.ones(len(left), bool)
            for (x, y), (dx, dy) in zip(p, d, strict=True):
                ok &= dx * (xy[left, 1] - y) - dy * (xy[left, 0] - x) >= -1e-9
            where[left[ok]] = i
        return where

    def neighbours(self) -> dict[tuple[int, int], float]:
        """(cell, cell) -> length of their common edges."""
        held: dict[tuple[int, int], int] = {}
        out: dict[tuple[int, int], float] = defaultdict(float)
        for i, cell in enumerate(self.cells):
            for u, v in zip(cell, [*cell[1:], cell[0]], strict=True):
                j = held.pop((v, u), None)
                if j is None:
                    held[u, v] = i
                else:
                    out[min(i, j), max(i, j)] += float(np.hypot(self.at[u][0] - self.at[v][0], self.at[u][1] - self.at[v][1]))
        return dict(out)


def min_cut(n: int, source: np.ndarray, sink: np.ndarray, edges: list[tuple[int, int, float, float]]) -> np.ndarray:
    """Which of n nodes stay with the source. source, sink: capacities from and to the ends; edges: (u, v, capacity, back)."""
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((c, back))

    for i in range(n):
        add(s, i, float(source[i]), 0.0)
        add(i, t, float(sink[i]), 0.0)
    for u, v, c, back in edges:
        add(u, v, c, back)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            u = todo.popleft()
            for e in out[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return np.array(level[:n]) >= 0
        place = [0] * (n + 2)
        while True:  # a path along rising levels
            path, u = [], s
            while u != t:
                while place[u] < len(out[u]):
                    e = out[u][place[u]]
                    if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                        break
                    place[u] += 1
                if place[u] == len(out[u]):
                    if u == s:
                        break
                    level[u] = -1
                    u = to[path.pop() ^ 1]
                    continue
                path.append(out[u][place[u]])
                u = to[path[-1]]
            if u != t:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


def energy(cost: np.ndarray, pairs: dict[tuple[int, int], float], label: np.ndarray) -> float:
    return float(cost[np.arange(len(label)), label].sum() + sum(w for (i, j), w in pairs.items() if label[i] != label[j]))


def expand(cost: np.ndarray, pairs: dict[tuple[int, int], float]) -> np.ndarray:
    """Labels of cells with little cost: cost (cell, label) plus the pairs' weights where labels differ."""
    n, k = cost.shape
    label = cost.argmin(1)
    best = energy(cost, pairs, label)
    while True:
        before = best
        for a in range(k):
            # source side: keeps its label; sink side: takes a. Two different kept labels cost w, as does one that moves
            keep, take = cost[np.arange(n), label].astype(float), cost[:, a].astype(float)
            edges = []
            for (i, j), w in pairs.items():
                both, left, right = w * (label[i] != label[j]), w * (label[i] != a), w * (label[j] != a)
                # E(keep, keep) = both, E(keep, take) = left, E(take, keep) = right, E(take, take) = 0
                keep[i] += both - right
                keep[j] += right
                edges.append((i, j, left + right - both, 0.0))
            low = np.minimum(keep, take)
            stays = min_cut(n, take - low, keep - low, edges)
            moved = np.where(stays, label, a)
            now = energy(cost, pairs, moved)
            if now < best - 1e-9:
                label, best = moved, now
        if best >= before - 1e-9:
            return label


def regions(parts: Partition, label: np.ndarray) -> np.ndarray:
    """The region of each cell: touching cells of one label, numbered by their first cell."""
    up = list(range(len(label)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in parts.neighbours():
        if label[i] == label[j]:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return np.unique([find(i) for i in range(len(label))], return_inverse=True)[1]


def trace(parts: Partition, region: np.ndarray, keep: frozenset[int] = frozenset()) -> list[list[list[int]]]:
    """The rings of each region: the outer one counter-clockwise, then holes. At a corner where a region meets itself the
    sharpest turn to the left is taken backwards, so that rings don't cross. Corners that lie on a straight run of all
    their edges go, but for those in keep."""
    ahead: list[set[tuple[int, int]]] = [set() for _ in range(int(region.max()) + 1)] if len(region) else []
    for r, cell in zip(region.tolist(), parts.cells, strict=True):
        for u, v in zip(cell, [*cell[1:], cell[0]], strict=True):
            if (v, u) in ahead[r]:
                ahead[r].remove((v, u))
            else:
                ahead[r].add((u, v))
    near: dict[int, set[int]] = defaultdict(set)
    for edges in ahead:
        for u, v in edges:
            near[u].add(v)
            near[v].add(u)

    def straight(v: int) -> bool:
        if len(near[v]) != 2 or v in keep:
            return False
        p, q, o = *(np.array(parts.at[x]) for x in near[v]), np.array(parts.at[v])
        a, b = p - o, q - o
        return abs(a[0] * b[1] - a[1] * b[0]) < 1e-6 * np.hypot(*a) * np.hypot(*b) and a @ b < 0

    gone = {v for v in near if straight(v)}
    out = []
    for edges in ahead:
        follow: dict[int, list[int]] = defaultdict(list)
        for u, v in sorted(edges):
            follow[u].append(v)
        rings = []
        while follow:
            start = min(follow)
            ring, u, v = [], start, follow[start][0]
            while True:
                ring.append(u)
                follow[u].remove(v)
                if not follow[u]:
                    del follow[u]
                if v == start and (v not in follow or len(ring) > 2):
                    break
                d = np.subtract(parts.at[v], parts.at[u])

                def turn(w: int, d=d, v=v) -> float:
                    e = np.subtract(parts.at[w], parts.at[v])
                    return float(np.arctan2(d[0] * e[1] - d[1] * e[0], d @ e))

                u, v = v, max(follow[v], key=turn)
            rings.append([x for x in ring if x not in gone])
        rings = [r for r in rings if len(r) > 2]
        rings.sort(key=lambda r: -ring_area(parts.points(r)))
        out.append(rings)
    return out
