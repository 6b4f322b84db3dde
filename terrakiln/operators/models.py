"""Block models and terrain, as plain expressions: prisms, their measures and checks, and a triangulated grid.

Defined cases: a footprint with a null or empty ring, or without a height, makes no faces; a solid's measures are null where
it has none; gaps of the terrain grid have no triangles unless filled; repeated footprints make repeated faces; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .crop import boxed, with_rings

GROUND, ROOF, WALL = 0, 1, 2
TERRAIN_CELL = 1000


def prism(heights: DataFrame) -> DataFrame:
    """fid, face, part, label, ring (array of x, y, z): floor, roof and walls of footprints (fid, ring or rings, base, top), a
    row per ring: the holes of floor and roof are their parts 1, 2, ..; walls have one part."""
    own = with_rings(heights).where("base IS NOT NULL AND top IS NOT NULL")
    outer = G.counter_clockwise(G.open_ring(F.get("rings", F.lit(0))))
    holes = F.transform(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: G.clockwise(G.open_ring(r)))
    rings = own.select("fid", "base", "top", F.posexplode(F.concat(F.array(outer), holes)).alias("part", "ring")).where(F.size("ring") >= 3)
    at = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))
    base, top = F.col("base"), F.col("top")
    face = lambda n, part, label, ring: F.struct(n.cast("long").alias("face"), part.cast("int").alias("part"), F.lit(label).alias("label"), ring.alias("ring"))
    n = F.size("ring")
    corner = lambda i: F.get(F.col("ring"), i % n)
    walls = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: face(F.col("part") * 1_000_000 + i + 2, F.lit(0), WALL, F.array(at(corner(i), base), at(corner(i + 1), base), at(corner(i + 1), top), at(corner(i), top))),
    )
    lift = lambda z: F.transform("ring", lambda p: at(p, z))
    ends = F.array(face(F.lit(0), F.col("part"), GROUND, F.reverse(lift(base))), face(F.lit(1), F.col("part"), ROOF, lift(top)))
    return rings.select("fid", F.explode(F.concat(ends, walls)).alias("_f")).select("fid", "_f.*")


def _fan(ring: Column, f) -> Column:
    """Sum of f(first, i-th, next) over the triangles of a fan."""
    first = F.get(ring, F.lit(0))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.size(ring) - 2), lambda i: f(first, F.get(ring, i), F.get(ring, i + 1))), F.lit(0).cast("long"), lambda s, v: s + v)


def volume6(faces: DataFrame) -> DataFrame:
    """fid, volume6: six times the volume of each solid, as signed tetrahedra about a corner of its own box."""
    ring = F.col("ring")
    low = lambda k: F.array_min(F.transform(ring, lambda p: p[k]))
    own = faces.groupBy(F.col("fid").alias("_fid")).agg(*[F.min(low(k)).alias(f"o{k}") for k in "xyz"])
    o = {k: F.col(f"o{k}") for k in "xyz"}

    def tetra(a, b, c):
        a, b, c = ({k: p[k] - o[k] for k in "xyz"} for p in (a, b, c))
        cx = b["y"] * c["z"] - b["z"] * c["y"]
        cy = b["z"] * c["x"] - b["x"] * c["z"]
        cz = b["x"] * c["y"] - b["y"] * c["x"]
        return a["x"] * cx + a["y"] * cy + a["z"] * cz

    placed = faces.join(own, F.col("fid") == F.col("_fid"))
    return placed.select("fid", _fan(ring, tetra).alias("v")).groupBy("fid").agg(F.sum("v").alias("volume6"))


def orientation(faces: DataFrame) -> DataFrame:
    """fid, face, part, label, slope, azimuth: by Newell normals, from a face's first corner."""
    ring = F.col("ring")
    o = F.get(ring, F.lit(0))
    sums = {k: F.aggregate(G._edges(ring, f), F.lit(0).cast("long"), lambda s, v: s + v) for k, f in {
        "nx": lambda a, b: (a["y"] - b["y"]) * (a["z"] + b["z"] - 2 * o["z"]), "ny": lambda a, b: (a["z"] - b["z"]) * (a["x"] + b["x"] - 2 * o["x"]),
        "nz": lambda a, b: (a["x"] - b["x"]) * (a["y"] + b["y"] - 2 * o["y"]),
    }.items()}
    with_normal = faces.select("fid", "face", "part", "label", *[v.cast("double").alias(k) for k, v in sums.items()])
    n = [F.col(k) for k in ("nx", "ny", "nz")]
    return with_normal.select("fid", "face", "part", "label", F.round(G.slope(*n), 6).alias("slope"), F.round(G.azimuth(*n[:2]), 6).alias("azimuth"))


def edge_use(faces: DataFrame) -> DataFrame:
    """fid, n_edges, n_bad: undirected edges of a solid, and those not used once in each direction."""
    edges = faces.select("fid", F.explode(G._edges(F.col("ring"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    e = edges.select("fid", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), (F.col("e.a") < F.col("e.b")).alias("up"))
    used = e.groupBy("fid", "a", "b").agg(F.count_if("up").alias("ups"), F.count_if(~F.col("up")).alias("downs"))
    return used.groupBy("fid").agg(F.count("*").alias("n_edges"), F.count_if((F.col("ups") != 1) | (F.col("downs") != 1)).alias("n_bad"))


def vertices(faces: DataFrame) -> DataFrame:
    """fid, n_vertices: distinct corners of each solid."""
    return faces.select("fid", F.explode("ring").alias("p")).distinct().groupBy("fid").agg(F.count("*").alias("n_vertices"))


def terrain_grid(points: DataFrame, cell: int = TERRAIN_CELL) -> DataFrame:
    """col, row, z: the lowest ground point of each cell."""
    return points.where("cls = 2").groupBy(F.floor(F.col("x") / cell).alias("col"), F.floor(F.col("y") / cell).alias("row")).agg(F.min("z").alias("z"))


def fill_terrain(grid: DataFrame) -> DataFrame:
    """grid with its single gaps: a cell without data whose four neighbours have some gets their mean."""
    sides = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c, r in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = grid.select("col", "row", "z", F.explode(sides).alias("s")).groupBy((F.col("col") + F.col("s.c")).alias("col"), (F.col("row") + F.col("s.r")).alias("row"))
    gaps = near.agg(F.count("*").alias("n"), F.avg("z").alias("z")).where("n = 4").join(grid.select("col", "row"), ["col", "row"], "left_anti")
    return grid.select("col", "row", F.col("z").cast("double")).unionByName(gaps.select("col", "row", "z"))


def terrain_triangles(grid: DataFrame, local: bool = False) -> DataFrame:
    """col, row, triangle, z1, z2, z3: two triangles for each four cells with data, split along the shorter diagonal in
    space (a tie takes the one from lower left to upper right). Corners: a (col, row), b right, c up, d right and up. local:
    three cells with data make one triangle. Each cell is dealt to the four squares it is a corner of: one grouping."""
    corner = F.array(*[F.struct(F.lit(dc).alias("dc"), F.lit(dr).alias("dr"), F.lit(k).alias("k")) for k, (dc, dr) in {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (1, 1)}.items()])
    dealt = grid.select("col", "row", "z", F.explode(corner).alias("s")).select((F.col("col") - F.col("s.dc")).alias("col"), (F.col("row") - F.col("s.dr")).alias("row"), F.col("s.k").alias("k"), "z")
    four = dealt.groupBy("col", "row").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("z"))).alias(k) for k in "abcd"])
    rising = F.abs(F.col("a") - F.col("d")) <= F.abs(F.col("b") - F.col("c"))
    tri = lambda *z: F.struct(*[F.col(x).alias(f"z{i + 1}") for i, x in enumerate(z)])
    both = F.when(rising, F.array(tri("a", "b", "d"), tri("a", "d", "c"))).otherwise(F.array(tri("a", "b", "c"), tri("b", "d", "c")))
    three = F.array(F.when(F.col("d").isNull(), tri("a", "b", "c")).when(F.col("c").isNull(), tri("a", "b", "d")).when(F.col("b").isNull(), tri("a", "d", "c")).otherwise(tri("b", "d", "c")))
    made = four.where(F.col("n") >= (3 if local else 4)).withColumn("_all", F.when(F.col("n") == 4, both).otherwise(three))
    return made.select("col", "row", F.posexplode("_all").alias("triangle", "_t")).select("col", "row", "triangle", "_t.z1", "_t.z2", "_t.z3")


def ground_height(stats: DataFrame, footprints: DataFrame, points: DataFrame, strategy: str = "buffer_tile", radius: int = 3, cell: int = TERRAIN_CELL) -> DataFrame:
    """fid, ground, origin. buffer_tile: from the ground points around the footprint, else the lowest terrain cell of the
    smallest window around its box that has one, else the lowest of all points. buffer_user: the footprint's own
    user_ground comes second; user: it comes first, and the points around don't count."""
    grid = terrain_grid(points, cell)
    own = stats.groupBy("fid").agg(F.min("ground").alias("own"))
    wide = boxed(footprints)
    boxes = wide.select("fid", *[F.floor(F.col(f"{k}{i}") / cell).alias(f"{c}{i}") for k, c in (("x", "c"), ("y", "r")) for i in (0, 1)])
    windows = boxes.select("*", F.explode(F.sequence(F.col("c0") - radius, F.col("c1") + radius)).alias("col")).select("*", F.explode(F.sequence(F.col("r0") - radius, F.col("r1") + radius)).alias("row"))
    away = F.greatest(F.lit(0), F.col("c0") - F.col("col"), F.col("col") - F.col("c1"), F.col("r0") - F.col("row"), F.col("row") - F.col("r1"))
    near = windows.withColumn("away", away).join(grid.hint("merge"), ["col", "row"]).groupBy("fid").agg(F.min(F.struct("away", "z")).alias("near"))
    lowest = F.lit(points.agg(F.min("z")).first()[0]).cast("long")
    user = F.col("user_ground") if "user_ground" in footprints.columns else F.lit(None).cast("long")
    out = footprints.select("fid", user.alias("user")).join(own, "fid", "left").join(near, "fid", "left")
    chain = {"buffer_tile": ("own", "near"), "buffer_user": ("own", "user", "near"), "user": ("user", "near")}[strategy]
    values = {"own": (F.col("own"), "buffer"), "user": (F.col("user"), "attribute"), "near": (F.col("near.z"), "grid")}
    origin = F.lit("tile")
    for k in reversed(chain):
        origin = F.when(values[k][0].isNotNull(), values[k][1]).otherwise(origin)
    return out.select("fid", F.coalesce(*[values[k][0] for k in chain], lowest).alias("ground"), origin.alias("origin"))


def route(stats: DataFrame, footprints: DataFrame, areas: DataFrame, forced: list[str] | None = None, fallback_area: float = 69_000.0) -> DataFrame:
    """fid, pc, mode: SKIP without enough points; LOD11 for large buildings, glass roofs, buildings or acquisitions (forced)
    that ask for it; STANDARD else."""
    user = F.coalesce("force_block", F.lit(False)) if "force_block" in footprints.columns else F.lit(False)
    block = (F.col("area") > fallback_area) | F.col("glass_roof") | F.col("_user") | F.col("pc").isin(forced or [])
    mode = F.when(F.col("insufficient"), "SKIP").when(block, "LOD11").otherwise("STANDARD")
    return stats.join(areas, "fid").join(footprints.select("fid", user.alias("_user")), "fid").select("fid", "pc", mode.alias("mode"))


#: Upper bounds of the classes of distances between points and roof, in units of length.
ERROR_BINS = tuple(sorted({2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 25, 30, 40, 50, 75, 100, 150, 200}))


def distances(points: DataFrame, planes: DataFrame) -> DataFrame:
    """points (fid, x, y, ..) with height and off: how high the plane of their part of the roof lies there, and how far they are
    from the nearest of the building's planes, at right angles. planes: fid, face, a, b, c, d (unit normals)."""
    p = F.col
    own = planes.groupBy("fid").agg(F.collect_list(F.struct("face", "a", "b", "c", "d")).alias("planes"))
    off = lambda q: F.round(F.abs(q["a"] * p("x") + q["b"] * p("y") + q["c"] * p("z") + q["d"]), 6)
    nearest = F.array_min(F.transform("planes", lambda q: F.struct(off(q).alias("off"), q["face"].alias("face"), G.plane_height(q["a"], q["b"], q["c"], q["d"], p("x"), p("y")).alias("height"))))
    return points.join(own.hint("shuffle_hash"), "fid").withColumn("_n", nearest).select(*points.columns, "_n.face", "_n.off", "_n.height")


def rmse(off: DataFrame, *keys: str) -> DataFrame:
    """keys, n, rmse: the root mean square of the distances; no row without points."""
    return off.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("off") * F.col("off"))), 6).alias("rmse"))


def error_histogram(off: DataFrame, *keys: str, bins: tuple[int, ...] = ERROR_BINS) -> DataFrame:
    """keys, bin, n: distances by class; the last class is open."""
    which = F.size(F.filter(F.array(*[F.lit(b) for b in bins]), lambda b: b <= F.col("off")))
    return off.groupBy(*keys, which.alias("bin")).agg(F.count("*").alias("n"))


def region_stats(cells: DataFrame) -> DataFrame:
    """fid, region, n, h_min, h_50p, h_70p, h_97p, h_max of a height map's cells (fid, region, z)."""
    found = G.percentiles(cells, ["fid", "region"], "z", {"h_50p": ("n1", 0.5), "h_70p": ("n1", 0.7), "h_97p": ("n1", 0.97), "h_min": ("n1", 0.0), "h_max": ("n1", 1.0)})
    return found.select("fid", "region", "n", "h_min", "h_50p", "h_70p", "h_97p", "h_max")


def merge_steps(regions: DataFrame, step: int = 300) -> DataFrame:
    """fid, n_regions, n_merged, h_50p: of buildings whose regions (region_stats) lie in a row by their number, how many are
    left when the neighbours with the smallest difference of medians under `step` are merged again and again; a merged
    region has the mean of the medians, weighted by cells. A building's regions are few: one array."""
    rows = regions.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("region", F.col("h_50p").cast("double").alias("h"), F.col("n").cast("double").alias("n")))).alias("r"))
    rows = rows.select("fid", F.transform("r", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"))).alias("r"))
    gap = lambda r, i: F.abs(F.get(r, i + 1)["h"] - F.get(r, i)["h"])

    def once(r: Column) -> Column:
        """r with its closest neighbours merged, if they are close enough."""
        least = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), lambda i: F.struct(gap(r, i).alias("g"), i.alias("i"))))
        a, b = F.get(r, least["i"]), F.get(r, least["i"] + 1)
        n = a["n"] + b["n"]
        one = F.struct(((a["h"] * a["n"] + b["h"] * b["n"]) / n).alias("h"), n.alias("n"))
        merged = F.concat(F.slice(r, 1, least["i"]), F.array(one), F.slice(r, least["i"] + 3, F.size(r)))
        return F.when((F.size(r) > 1) & (least["g"] < step), merged).otherwise(r)

    done = rows.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.size("r")), F.col("r"), lambda r, _: once(r)))
    return done.select("fid", F.size("r").alias("n_regions"), F.size("m").alias("n_merged"), F.transform("m", lambda x: F.round(x["h"], 6)).alias("h_50p"))


def mean_angle(edges: DataFrame) -> DataFrame:
    """fid, angle: the mean direction of edges (fid, dx, dy), in degrees from 0 to 180, weighted by squared length."""
    w = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    angle = F.pmod(F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))), F.lit(180.0))
    return edges.groupBy("fid").agg(F.round(F.sum(w * angle) / F.nullif(F.sum(w), F.lit(0)), 6).alias("angle"))
