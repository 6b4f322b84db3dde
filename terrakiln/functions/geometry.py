"""Column expressions on rings (array of struct x, y), edges, boxes and normals. All stay in the JVM.

A footprint has one outer ring and any number of holes. Its `edges` are those of all its rings, as an array of structs, made
once per footprint; tests of points then walk that array. Products are taken of differences to a near origin, so whole
numbers at national-grid coordinates don't overflow. A null ring gives null, an empty one counts as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(ring: Column, f) -> Column:
    """f(from, to) of each edge of a closed ring, as an array."""
    n = F.size(ring)
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), 1, n), lambda i: f(F.get(ring, i), F.get(ring, (i + 1) % F.greatest(n, F.lit(1)))))


def edges(ring: Column) -> Column:
    """The edges of a closed ring: array of struct x1, y1, x2, y2."""
    return _edges(ring, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def edges_of(rings: Column) -> Column:
    """The edges of all rings of an array of rings."""
    return F.flatten(F.transform(rings, edges))


def inside_edges(own: Column, x: Column, y: Column) -> Column:
    """Crossing parity over the edges of all rings: inside the outer one and in no hole."""

    def crosses(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        up = e["y2"] > e["y1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & ((up & (turn > 0)) | (~up & (turn < 0)))

    return F.aggregate(own, F.lit(False), lambda s, e: s != crosses(e))


def within_edges(own: Column, x: Column, y: Column, distance: int) -> Column:
    """Whether (x, y) is within distance of an edge, in whole numbers."""

    def near(e: Column) -> Column:
        ex, ey, px, py = e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"]
        along, length = ex * px + ey * py, ex * ex + ey * ey
        qx, qy = x - e["x2"], y - e["y2"]
        off = ex * py - ey * px
        limit = distance * distance
        return F.when(along <= 0, px * px + py * py <= limit).when(along >= length, qx * qx + qy * qy <= limit).otherwise(off * off <= length * limit)

    return F.exists(own, near)


def inside(ring: Column, x: Column, y: Column) -> Column:
    return inside_edges(edges(ring), x, y)


def within(ring: Column, x: Column, y: Column, distance: int) -> Column:
    return within_edges(edges(ring), x, y, distance)


def _cross(a: Column, b: Column, ox: Column, oy: Column) -> Column:
    return (a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy)


def area2(ring: Column) -> Column:
    """Twice the signed area (counter-clockwise is positive)."""
    ox, oy = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    return F.aggregate(_edges(ring, lambda a, b: _cross(a, b, ox, oy)), F.lit(0).cast("long"), lambda s, v: s + v)


def area2_of(rings: Column) -> Column:
    """Twice the area of the outer ring less its holes, whatever their orientations."""
    outer = F.abs(area2(F.get(rings, F.lit(0))))
    return outer - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, r: s + F.abs(area2(r)))


def centroid(ring: Column, axis: str) -> Column:
    """The centre of a ring's area along an axis, as a double; of a ring without area, the middle of its box."""
    ox, oy = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    o = ox if axis == "x" else oy
    moment = F.aggregate(_edges(ring, lambda a, b: (a[axis] + b[axis] - 2 * o) * _cross(a, b, ox, oy)), F.lit(0).cast("long"), lambda s, v: s + v)
    values = F.transform(ring, lambda p: p[axis])
    return F.when(area2(ring) != 0, o + moment / (3 * area2(ring))).otherwise((F.array_min(values) + F.array_max(values)) / 2)


def counter_clockwise(ring: Column) -> Column:
    return F.when(area2(ring) < 0, F.reverse(ring)).otherwise(ring)


def clockwise(ring: Column) -> Column:
    return F.when(area2(ring) > 0, F.reverse(ring)).otherwise(ring)


def open_ring(ring: Column) -> Column:
    """Without the closing vertex."""
    last = F.element_at(ring, -1)
    return F.when((F.size(ring) > 1) & (last == F.get(ring, F.lit(0))), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def without_repeats(ring: Column, tolerance: int) -> Column:
    """Without vertices that lie within tolerance, on both axes, of the one before them (the first: of the last)."""
    n = F.size(ring)
    apart = lambda a, b: (F.abs(a["x"] - b["x"]) > tolerance) | (F.abs(a["y"] - b["y"]) > tolerance)
    return F.filter(ring, lambda p, i: apart(p, F.get(ring, (i + n - 1) % F.greatest(n, F.lit(1)))))


def degenerate(ring: Column) -> Column:
    """Fewer than three corners, or no area."""
    return (F.size(ring) < 3) | (area2(ring) == 0)


def circle(x: Column, y: Column, radius: Column, corners: int = 10) -> Column:
    """A regular ring of corners around (x, y), rounded to whole units, counter-clockwise from +x."""
    turn = lambda i: i * (2 * F.pi() / corners)
    at = lambda i: F.struct(F.round(x + radius * F.cos(turn(i))).cast("long").alias("x"), F.round(y + radius * F.sin(turn(i))).cast("long").alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), at)


def rank_n(values: Column, p: float) -> Column:
    """The element at trunc(n p) of the sorted values, the last at most; null if there is none."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.floor(F.size(s) * F.lit(p)), F.size(s) - 1).cast("int"))


def rank_n1(values: Column, p: float) -> Column:
    """The element at floor((n - 1) p) of the sorted values; null if there is none."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.get(s, F.greatest(F.floor((F.size(s) - 1) * F.lit(p)), F.lit(0)).cast("int")))


def rank_round(values: Column, p: float) -> Column:
    """The element at min(round(n p), n - 1) of the sorted values; null if there is none."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.floor(F.size(s) * F.lit(p) + 0.5), F.size(s) - 1).cast("int"))


#: Places in sorted values, from their number: the same rules as the three above.
PLACES = {
    "n": lambda n, p: F.least(F.floor(n * F.lit(p)), n - 1),
    "n1": lambda n, p: F.floor((n - 1) * F.lit(p)),
    "round": lambda n, p: F.least(F.floor(n * F.lit(p) + 0.5), n - 1),
}


def percentiles(frame: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys, n, and the wanted elements of each group's sorted values: {name: (rule in PLACES, p)}. Values are counted before
    they are shuffled, so a group costs as much as it has different values. Nulls don't count; a group of nulls has no row."""
    counted = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    own = Window.partitionBy(*keys)
    upto = F.sum("_k").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", upto).withColumn("n", F.sum("_k").over(own))

    def at(rule: str, p: float) -> Column:
        place = PLACES[rule](F.col("n"), p)
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_k") <= place), F.col(value)))

    return ranked.groupBy(*keys, "n").agg(*[at(*w).alias(name) for name, w in wanted.items()])


def slope(nx: Column, ny: Column, nz: Column) -> Column:
    """Degrees between a normal and the vertical; null for a null vector."""
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    return F.when(length > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), nz / length)))))


def azimuth(nx: Column, ny: Column) -> Column:
    """Degrees clockwise from +y, from 0 to 360; null for a vertical normal."""
    angle = F.degrees(F.atan2(nx, ny))
    return F.when((nx != 0) | (ny != 0), F.when(angle < 0, angle + 360).otherwise(angle))


def plane_height(a: Column, b: Column, c: Column, d: Column, x: Column, y: Column) -> Column:
    """z of the plane a x + b y + c z + d = 0 at (x, y); null for a vertical plane."""
    return F.when(c != 0, -(a * x + b * y + d) / c)


def angle_between(cosine: Column) -> Column:
    """Degrees of a dot product of unit vectors, which rounding may carry beyond 1."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def gps_year(seconds: Column) -> Column:
    """The year, in UTC, of adjusted standard GPS time."""
    return F.year(F.timestamp_seconds(seconds + 1_315_964_800))
