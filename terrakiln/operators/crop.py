"""Crop and statistics: points joined to footprints by grid cells, then grouped to raster cells and to buildings.

The spatial join is an equi-join on grid cells, with exact tests left as a row-local filter; without the cells it would
be a nested loop. A footprint's box and edges are made once, before the join. Footprints are never broadcast: the planner
doesn't see how explode and arrays make them grow, and the driver would hold them all. A cell with very many points is
split by the planner where it is skewed (both sides are plain exchanges).

Footprints have fid and ring (outer, counter-clockwise or not) or rings (outer, then holes). The raster of a footprint
starts at the lower left of its box and covers all of it.

Defined cases: points with a null coordinate, and footprints with a null or empty ring, match nothing; a null class is
neither ground nor building; a null height counts as a point but has no part in heights; repeated points count each;
repeated footprints are cropped each; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

CELL, BUFFER, GRID = 50, 400, 2000
GROUND_CLASS, ROOF_CLASS = 2, 6
GROUND_PERCENTILE, ROOF_PERCENTILE, MIN_DENSITY, GLASS, MAX_NODATA = 0.05, 0.7, 1.0, 0.75, 1.0
#: Squared units of length in a square metre.
SQUARE_METRE = 10_000


def with_rings(footprints: DataFrame) -> DataFrame:
    return footprints if "rings" in footprints.columns else footprints.withColumn("rings", F.array("ring"))


def boxed(footprints: DataFrame) -> DataFrame:
    """footprints with x0, y0, x1, y1: the box of the outer ring."""
    own = with_rings(footprints)
    of = lambda k: F.transform(F.get("rings", F.lit(0)), lambda p: p[k])
    return own.select("*", *[f(of(k)).alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.array_min, F.array_max))])


def box_meets(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes share more than a border."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def crop(points: DataFrame, footprints: DataFrame, buffer: int = BUFFER, grid: int = GRID) -> DataFrame:
    """fid, pc, x, y, z, cls, yr, ox, oy, inside: points in a footprint, and ground points within the buffer around it; ox,
    oy: the lower left of the footprint's box."""
    own = boxed(footprints).select(
        "fid", F.col("x0").alias("ox"), F.col("y0").alias("oy"), G.edges_of(F.col("rings")).alias("edges"),
        *[(F.col(c) - buffer).alias(f"_{c}") for c in ("x0", "y0")], *[(F.col(c) + buffer).alias(f"_{c}") for c in ("x1", "y1")],
    )
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"_{k}0") / grid), F.floor(F.col(f"_{k}1") / grid)))
    dealt = own.select("*", span("x").alias("gx")).select("*", span("y").alias("gy"))
    x, y = F.col("x"), F.col("y")
    placed = points.select("pc", "x", "y", "z", "cls", "yr", F.floor(x / grid).alias("gx"), F.floor(y / grid).alias("gy"))
    joined = placed.join(dealt.hint("shuffle_hash"), ["gx", "gy"]).where((x >= F.col("_x0")) & (x <= F.col("_x1")) & (y >= F.col("_y0")) & (y <= F.col("_y1")))
    # exploded, so that the planner can't move the test into the join, where it would run before the box's and once for each use
    near = (F.col("cls") == GROUND_CLASS) & G.within_edges(F.col("edges"), x, y, buffer)
    state = F.when(G.inside_edges(F.col("edges"), x, y), F.array(F.lit(True))).when(near, F.array(F.lit(False)))
    return joined.select("fid", "pc", "x", "y", "z", "cls", "yr", "ox", "oy", F.explode(state).alias("inside"))


def crop_counts(cropped: DataFrame) -> DataFrame:
    """Per building, acquisition and class: points, those inside, height range, last year."""
    return cropped.groupBy("fid", "pc", "cls").agg(
        F.count("*").alias("n"), F.count_if("inside").alias("n_inside"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        F.max(F.when(F.col("inside"), F.col("yr"))).cast("long").alias("acquired"),
    )


def mask(footprints: DataFrame, cell: int = CELL) -> DataFrame:
    """fid, col, row: raster cells whose centre lies in the footprint, over its whole box. Up to hundreds of rows a footprint, which
    the planner's estimate leaves out: joins with it are merged by a hint, or the driver would broadcast it."""
    own = boxed(footprints).select("fid", "x0", "y0", "x1", "y1", G.edges_of(F.col("rings")).alias("edges"))
    steps = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col(f"{k}1") - F.col(f"{k}0")) / cell) - 1, F.lit(0))))
    cells = own.select("*", steps("x").alias("col")).select("*", steps("y").alias("row"))
    at = lambda o, k: F.col(o) + F.col(k) * cell + cell // 2
    return cells.where(G.inside_edges(F.col("edges"), at("x0", "col"), at("y0", "row"))).select("fid", F.col("col").cast("int"), F.col("row").cast("int"))


def bands(cropped: DataFrame, cell: int = CELL) -> DataFrame:
    """Per building, acquisition and raster cell: height range, count, upper median, mean, variance, class imbalance. A
    cell's heights are gathered for the median: cells are small."""
    z = F.col("z")
    found = cropped.where("inside").groupBy(
        "fid", "pc", F.floor((F.col("x") - F.col("ox")) / cell).cast("int").alias("col"), F.floor((F.col("y") - F.col("oy")) / cell).cast("int").alias("row")
    )
    ground, roof = F.count_if(F.col("cls") == GROUND_CLASS), F.count_if(F.col("cls") == ROOF_CLASS)
    heights = F.sort_array(F.collect_list("z"))
    return found.agg(
        F.max("z").alias("z_max"), F.min("z").alias("z_min"), F.count("*").alias("n"), F.get(heights, F.floor(F.size(heights) / 2).cast("int")).alias("z_median"),
        F.round(F.avg("z"), 6).alias("z_mean"), F.round(F.avg(z * z) - F.avg("z") * F.avg("z"), 4).alias("z_variance"),
        F.round(F.abs(ground - roof) / F.nullif(ground + roof, F.lit(0)), 9).alias("imbalance"),
    )


def areas(footprints: DataFrame, square: int = SQUARE_METRE) -> DataFrame:
    """fid, area: square metres, without holes."""
    return with_rings(footprints).select("fid", (G.area2_of(F.col("rings")) / 2 / square).alias("area"))


def building_stats(
    cropped: DataFrame, footprints: DataFrame, pcs: list[str], cell: int = CELL, *, square: int = SQUARE_METRE, min_density: float = MIN_DENSITY, max_nodata: float = MAX_NODATA, glass: float = GLASS
) -> DataFrame:
    """Per building and acquisition: density over covered cells, share of cells without data, ground height, roof height,
    share of unbalanced cells, and whether it has too few points. Buildings without any point of an acquisition have a
    row too (all without data). cropped is read three times: keep it first. pcs: the acquisitions (configuration)."""
    inner = mask(footprints, cell)
    cells = inner.groupBy("fid").agg(F.count("*").alias("n_cells"))
    masked = bands(cropped, cell).join(inner.hint("merge"), ["fid", "col", "row"])
    covered = masked.groupBy("fid", "pc").agg(F.count("*").alias("n_data"), F.sum("n").alias("n_points"), F.round(F.avg("imbalance"), 9).alias("imbalance"))
    tops = G.percentiles(masked, ["fid", "pc"], "z_max", {"roof": ("n", ROOF_PERCENTILE)}).drop("n")
    ground = G.percentiles(cropped.where(F.col("cls") == GROUND_CLASS), ["fid", "pc"], "z", {"ground": ("n1", GROUND_PERCENTILE)}).drop("n")
    roofs = cropped.where((F.col("cls") == ROOF_CLASS) & F.col("inside")).groupBy("fid", "pc").agg(F.count("*").alias("n_roof"))
    every = cells.join(areas(footprints, square), "fid").select("fid", "n_cells", "area", F.explode(F.array(*[F.lit(pc) for pc in pcs])).alias("pc"))
    out = every
    for part in (covered, tops, ground, roofs):
        out = out.join(part, ["fid", "pc"], "left")
    data = F.coalesce("n_data", F.lit(0))
    return out.select(
        "fid", "pc", F.coalesce("n_points", F.lit(0)).alias("n_points"), "n_cells", data.alias("n_data"),
        F.round(F.coalesce(F.col("n_points") / (F.col("n_data") * (cell * cell / square)), F.lit(0.0)), 6).alias("density"),
        F.round(1 - data / F.col("n_cells"), 9).alias("nodata"), "ground", F.coalesce("roof", F.lit(0)).alias("roof"),
        F.coalesce(F.col("imbalance") < glass, F.lit(False)).alias("glass_roof"),
        ((F.coalesce("n_roof", F.lit(0)) / F.col("area") < min_density) | (1 - data / F.col("n_cells") > max_nodata)).alias("insufficient"),
    )


def most_in_cell(density: float, cell: int, square: int = SQUARE_METRE) -> int:
    """Points that a density ceiling (a square metre) allows in a raster cell."""
    return int(density * cell * cell / square)


def thin(cropped: DataFrame, most: int, cell: int) -> DataFrame:
    """At most `most` points of each raster cell, chosen by an order of their own values, not of arrival."""
    order = Window.partitionBy("fid", "pc", "_c", "_r").orderBy((F.col("x") * 31 + F.col("y") * 17 + F.col("z")) % 1009, "x", "y", "z", "cls", "yr")
    placed = cropped.where("inside").withColumn("_c", F.floor((F.col("x") - F.col("ox")) / cell)).withColumn("_r", F.floor((F.col("y") - F.col("oy")) / cell))
    return placed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n", "_c", "_r")


def tile(footprints: DataFrame, size: int = 5000) -> DataFrame:
    """fid, tile_x, tile_y: the tile that holds the centre of the footprint's area; bounds belong to the upper tile."""
    outer = F.get("rings", F.lit(0))
    return with_rings(footprints).select("fid", *[F.floor(G.centroid(outer, k) / size).alias(f"tile_{k}") for k in "xy"])


def in_order(tiles: DataFrame) -> DataFrame:
    """tiles with place: each building's place in its tile, in input order (fid)."""
    return tiles.withColumn("place", F.row_number().over(Window.partitionBy("tile_x", "tile_y").orderBy("fid")))


def overlap(cropped: DataFrame, footprints: DataFrame, near: float = 0.05) -> DataFrame:
    """fid, n_own, n_shared, n_taken: building points inside several footprints go to one of them. The footprint with the most
    building points on its area (own and shared) has them; among those less than `near` below it, the one whose own points
    lie highest on average, then the smaller fid."""
    roof = cropped.where((F.col("cls") == ROOF_CLASS) & F.col("inside"))
    point = ["pc", "x", "y", "z", "yr"]
    # repeated points are of one place: they go the same way
    places = roof.groupBy(*point).agg(F.collect_set("fid").alias("fids"), F.count("*").alias("_rows")).withColumn("times", (F.col("_rows") / F.size("fids")).cast("long"))
    alone = places.where(F.size("fids") == 1).groupBy(F.col("fids")[0].alias("fid")).agg(F.sum("times").alias("n_own"), (F.sum(F.col("z") * F.col("times")) / F.sum("times")).alias("mean_z"))
    several = places.where(F.size("fids") > 1).select(*point, "times", "fids", F.explode("fids").alias("fid"))
    shared = several.groupBy("fid").agg(F.sum("times").alias("n_shared"))
    facts = areas(footprints).join(alone, "fid", "left").join(shared, "fid", "left").fillna(0, ["n_own", "n_shared"])
    facts = facts.withColumn("density", F.round((F.col("n_own") + F.col("n_shared")) / F.col("area"), 9))
    rated = several.join(facts.select("fid", "density", "mean_z"), "fid")
    top = F.max("density").over(Window.partitionBy(*point))
    good = F.abs(1 - F.col("density") / F.col("_top")) < near
    order = Window.partitionBy(*point).orderBy(good.desc(), F.when(good, F.round("mean_z", 6)).desc_nulls_last(), F.col("density").desc(), "fid")
    taken = rated.withColumn("_top", top).withColumn("_n", F.row_number().over(order)).where("_n = 1").groupBy("fid").agg(F.sum("times").alias("n_taken"))
    return facts.join(taken, "fid", "left").select("fid", "n_own", "n_shared", F.coalesce("n_taken", F.lit(0)).alias("n_taken"))


def _around(name: str, radius: int) -> Column:
    """Rows for the numbers within radius of a column's."""
    return F.explode(F.sequence(F.col(name) - radius, F.col(name) + radius)).alias(name)


def nearest(points: DataFrame, k: int, cell: int) -> DataFrame:
    """fid, pc, i, j, rank: the k nearest other points j of each point i (numbered by i in its group), among those of its cell
    and the eight around it; ties by number. With cells as wide as k neighbours ever lie apart, these are the nearest of all."""
    own = points.select("fid", "pc", "i", "x", "y", "z", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    around = own.select("fid", "pc", F.col("i").alias("j"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), _around("gx", 1), "gy")
    around = around.select("fid", "pc", "j", "_x", "_y", "_z", "gx", _around("gy", 1))
    d = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz")
    pairs = own.join(around, ["fid", "pc", "gx", "gy"]).where("i <> j").withColumn("d", d)
    order = Window.partitionBy("fid", "pc", "i").orderBy("d", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("fid", "pc", "i", "j", "rank", "d")


def adjacency(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """fid, pc, high, low, n: how often a point of one label has a neighbour of another, both directions counted; label 0 and
    null are no label. labels: fid, pc, i, label."""
    a = labels.select("fid", "pc", "i", F.col("label").alias("a"))
    b = labels.select("fid", "pc", F.col("i").alias("j"), F.col("label").alias("b"))
    both = neighbours.join(a, ["fid", "pc", "i"]).join(b, ["fid", "pc", "j"]).where("a > 0 AND b > 0 AND a <> b")
    return both.groupBy("fid", "pc", F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).agg(F.count("*").alias("n"))


def fill(cells: DataFrame, inner: DataFrame, radius: int = 1) -> DataFrame:
    """fid, pc, col, row, z_max, filled: cells of the footprint, those without data with the lowest top of the window around
    them (null if that has none)."""
    tops = cells.select("fid", "pc", "col", "row", "z_max")
    near = tops.select("fid", "pc", _around("col", radius), "row", "z_max").select("fid", "pc", "col", _around("row", radius), "z_max")
    lowest = near.groupBy("fid", "pc", "col", "row").agg(F.min("z_max").alias("low"))
    wanted = tops.select("fid", "pc").distinct().join(inner.hint("merge"), "fid")
    both = wanted.join(tops.hint("merge"), ["fid", "pc", "col", "row"], "left").join(lowest.hint("merge"), ["fid", "pc", "col", "row"], "left")
    return both.select("fid", "pc", "col", "row", F.coalesce("z_max", "low").alias("z_max"), F.col("z_max").isNull().alias("filled"))


def file_index(points: DataFrame, size: int) -> DataFrame:
    """file, x0, y0, x1, y1, n: the extents of files that hold an acquisition's points of a square each."""
    name = F.concat_ws("_", F.col("pc"), F.floor(F.col("x") / size), F.floor(F.col("y") / size))
    return points.groupBy(name.alias("file")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def files_of_tiles(files: DataFrame, footprints: DataFrame, buffer: int = BUFFER, size: int = 5000) -> DataFrame:
    """tile_x, tile_y, file: the files to read for each tile: their extent meets the buffered boxes of its buildings. Joined by
    squares of the plane, then rechecked."""
    box = boxed(footprints).join(tile(footprints, size), "fid").groupBy("tile_x", "tile_y")
    tiles = box.agg((F.min("x0") - buffer).alias("tx0"), (F.min("y0") - buffer).alias("ty0"), (F.max("x1") + buffer).alias("tx1"), (F.max("y1") + buffer).alias("ty1"))

    def squares(frame: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / (4 * size)), F.floor(F.col(b) / (4 * size))))
        return frame.select("*", span(x0, x1).alias("sx")).select("*", span(y0, y1).alias("sy"))

    both = squares(files, "x0", "y0", "x1", "y1").join(squares(tiles, "tx0", "ty0", "tx1", "ty1"), ["sx", "sy"])
    meet = box_meets({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, {c: F.col(f"t{c}") for c in ("x0", "y0", "x1", "y1")})
    return both.where(meet).select("tile_x", "tile_y", "file").distinct()
