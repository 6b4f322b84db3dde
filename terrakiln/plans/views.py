"""Derived views: footprints, classified points and acquisitions, from the star-schema tables (integer centimetres, far
from the origin as national grids are).

footprint(fid, ox, oy, w, rings, ring, kind): a building per supplier on a 20 m grid; kind 1 square, 0 L-shaped, 2 square with
a courtyard; w, its width, goes from 3 to 16 m. Some stand 10 km away, some overlap their neighbour.
points(x, y, z, cls, pc, yr, gps): a point per line item on or around its supplier's building, on one of four roofs; class
6 building, 2 ground, 1 other.
pc_source(pc, ord, quality, date, date_only): the acquisitions A, N and R.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PITCH, AROUND = 2000, 500
EAST, NORTH = 15_000_000, 45_000_000
WIDTHS = (400, 300, 600, 1000, 1600)
SOURCES = [("A", 0, 2, 20190101, False), ("N", 1, 1, 20160101, False), ("R", 2, 3, 20220101, True)]
#: Corners of each kind's rings, in tenths of the width: the outer one counter-clockwise, the courtyard clockwise.
SHAPES = {
    0: [[(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)]],
    1: [[(0, 0), (10, 0), (10, 10), (0, 10)]],
    2: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (3, 7), (7, 7), (7, 3)]],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(fid: Column) -> tuple[Column, Column, Column]:
    """ox, oy, w of a building."""
    w = F.element_at(F.array(*[F.lit(x) for x in WIDTHS]), (fid % 5 + 1).cast("int")).cast("long")
    away = F.when(fid % 50 == 7, 1_000_000).when(fid % 10 == 5, -1200).otherwise(0)
    return (EAST + fid % 10 * PITCH + away).cast("long"), (NORTH + F.floor(fid / 10) * PITCH).cast("long"), w


def _rings(rings: list[list[tuple[int, int]]]) -> Column:
    at = lambda o, t: (F.col(o) + F.floor(F.col("w") * t / 10)).cast("long")
    return F.array(*[F.array(*[F.struct(at("ox", x).alias("x"), at("oy", y).alias("y")) for x, y in ring]) for ring in rings])


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fid = F.col("s_suppkey").cast("long")
    ox, oy, w = _place(fid)
    kind = F.when(fid % 10 == 3, 2).otherwise(fid % 2)
    at = _table(spark, sf_dir, "supplier").select(
        fid.alias("fid"), ox.alias("ox"), oy.alias("oy"), w.alias("w"), kind.cast("int").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
        (2000 + fid % 24).cast("int").alias("built"), F.when(fid % 3 != 1, fid % 13 == 0).alias("force_block"), F.when(fid % 4 == 0, 150 + fid % 9).cast("long").alias("user_ground"),
    )
    rings = F.when(F.col("kind") == 0, _rings(SHAPES[0])).when(F.col("kind") == 1, _rings(SHAPES[1])).otherwise(_rings(SHAPES[2]))
    return at.withColumn("rings", rings).withColumn("ring", F.get("rings", F.lit(0)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, o, n = (F.col(c).cast("long") for c in ("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"))
    ox, oy, w = _place(s)
    a, b = p * 37 + o * 11 + n * 7, p * 53 + o * 29 + n * 13
    on_roof = (p + n) % 4 != 0
    rows = _table(spark, sf_dir, "lineitem").select(
        s.alias("s"), on_roof.alias("on_roof"), w.alias("w"), ox.alias("ox"), oy.alias("oy"),
        F.when(on_roof, a % w).otherwise(a % (w + 2 * AROUND) - AROUND).alias("dx"), F.when(on_roof, b % w).otherwise(b % (w + 2 * AROUND) - AROUND).alias("dy"),
        F.floor("l_quantity").cast("long").alias("k"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("pc"), "l_shipdate",
    )
    dx, w, s = F.col("dx"), F.col("w"), F.col("s")
    roof = (
        F.when(s % 4 == 0, F.lit(600)).when(s % 4 == 1, 600 + F.floor(300 * (w - F.abs(2 * dx - w)) / w)).when(s % 4 == 2, F.when(2 * dx < w, 500).otherwise(900))
        .otherwise(500 + F.floor(400 * dx / w)) + F.col("k") % 7 - F.when((F.col("pc") == "N") & (s % 3 == 0), 200).otherwise(0)
    )
    cls = F.when(F.col("on_roof") & ((s % 5 != 0) | (F.col("status") == "O")), 6).when((s % 50).isin(7, 8), 1).otherwise(2)
    shipped = F.unix_timestamp("l_shipdate")
    # inlined, so that the planner can't copy these long expressions into filters: the compiler gives up on such methods
    return rows.select(F.inline(F.array(F.struct(
        (F.col("ox") + dx).alias("x"), (F.col("oy") + F.col("dy")).alias("y"), F.when(cls == 6, roof).otherwise(100 + F.col("k") % 10).cast("long").alias("z"), cls.alias("cls"),
        "pc", F.year("l_shipdate").alias("yr"), (shipped - 1_315_964_800).alias("gps"),
    ))))


def pc_source(spark: SparkSession) -> DataFrame:
    """The acquisitions: a table of configuration, as many rows as there are flights."""
    return spark.createDataFrame(SOURCES, "pc string, ord int, quality int, date int, date_only boolean")


_CORNERS = ", ".join(f"({kind},{r},{i},{x},{y},{ring[(i + 1) % len(ring)][0]},{ring[(i + 1) % len(ring)][1]})" for kind, rings in SHAPES.items() for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring))
BUFFER = 400

#: The same views for other SQL engines, with the edges of each ring as rows.
SQL = f"""
place AS (
  SELECT fid, {EAST} + fid % 10 * {PITCH} + (CASE WHEN fid % 50 = 7 THEN 1000000 WHEN fid % 10 = 5 THEN -1200 ELSE 0 END) AS ox,
         {NORTH} + fid // 10 * {PITCH} AS oy, ([{", ".join(map(str, WIDTHS))}])[fid % 5 + 1]::BIGINT AS w
  FROM (SELECT DISTINCT s_suppkey::BIGINT AS fid FROM supplier UNION SELECT DISTINCT l_suppkey::BIGINT FROM lineitem)),
footprint AS (
  SELECT s_suppkey::BIGINT AS fid, ox, oy, w, CASE WHEN fid % 10 = 3 THEN 2 ELSE fid % 2 END AS kind, s_nationkey AS nation, s_name AS name,
         (2000 + fid % 24)::INTEGER AS built, CASE WHEN fid % 3 <> 1 THEN fid % 13 = 0 END AS force_block, CASE WHEN fid % 4 = 0 THEN 150 + fid % 9 END AS user_ground
  FROM supplier JOIN place ON fid = s_suppkey),
corners(kind, r, i, fx, fy, tx, ty) AS (VALUES {_CORNERS}),
edges AS (
  SELECT fid, r, i, ox + w * fx // 10 AS x1, oy + w * fy // 10 AS y1, ox + w * tx // 10 AS x2, oy + w * ty // 10 AS y2, ox, oy
  FROM footprint JOIN corners USING (kind)),
area AS (SELECT fid, sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))::BIGINT AS area2 FROM edges GROUP BY fid),
raw AS (
  SELECT row_number() OVER () AS rid, l_suppkey::BIGINT AS s, (l_partkey + l_linenumber) % 4 <> 0 AS on_roof, ox, oy, w,
         l_partkey * 37 + l_orderkey * 11 + l_linenumber * 7 AS a, l_partkey * 53 + l_orderkey * 29 + l_linenumber * 13 AS b,
         floor(l_quantity)::BIGINT AS k, l_linestatus AS status, l_returnflag AS pc, l_shipdate
  FROM lineitem JOIN place ON fid = l_suppkey),
located AS (SELECT *, CASE WHEN on_roof THEN a % w ELSE a % (w + {2 * AROUND}) - {AROUND} END AS dx, CASE WHEN on_roof THEN b % w ELSE b % (w + {2 * AROUND}) - {AROUND} END AS dy,
            CASE WHEN on_roof AND (s % 5 <> 0 OR status = 'O') THEN 6 WHEN s % 50 IN (7, 8) THEN 1 ELSE 2 END AS cls FROM raw),
points AS (
  SELECT rid, ox + dx AS x, oy + dy AS y, cls, pc, year(l_shipdate) AS yr, epoch(l_shipdate)::BIGINT - 1315964800 AS gps,
         CASE WHEN cls <> 6 THEN 100 + k % 10 ELSE k % 7 - (CASE WHEN pc = 'N' AND s % 3 = 0 THEN 200 ELSE 0 END) +
           CASE s % 4 WHEN 0 THEN 600 WHEN 1 THEN 600 + floor(300 * (w - abs(2 * dx - w)) / w::DOUBLE)::BIGINT
                      WHEN 2 THEN (CASE WHEN 2 * dx < w THEN 500 ELSE 900 END) ELSE 500 + floor(400 * dx / w::DOUBLE)::BIGINT END END::BIGINT AS z
  FROM located),
pc_source(pc, ord, quality, date, date_only) AS (VALUES ('A',0,2,20190101,false), ('N',1,1,20160101,false), ('R',2,3,20220101,true)),
near AS (
  SELECT p.*, f.fid, f.ox, f.oy FROM points p JOIN footprint f
  ON p.x BETWEEN f.ox - {BUFFER} AND f.ox + f.w + {BUFFER} AND p.y BETWEEN f.oy - {BUFFER} AND f.oy + f.w + {BUFFER}),
tested AS (
  SELECT n.rid, n.fid,
         count(*) FILTER (WHERE (e.y1 > n.y) <> (e.y2 > n.y)
           AND n.x < e.x1 + (n.y - e.y1)::DOUBLE * (e.x2 - e.x1) / (CASE WHEN e.y2 = e.y1 THEN 1 ELSE e.y2 - e.y1 END)) % 2 = 1 AS inside,
         min(CASE WHEN e.x1 = e.x2 THEN (n.x - e.x1) ** 2 + greatest(0, least(e.y1, e.y2) - n.y, n.y - greatest(e.y1, e.y2)) ** 2
                  ELSE (n.y - e.y1) ** 2 + greatest(0, least(e.x1, e.x2) - n.x, n.x - greatest(e.x1, e.x2)) ** 2 END) <= {BUFFER} ** 2 AS buffered
  FROM near n JOIN edges e ON e.fid = n.fid GROUP BY n.rid, n.fid),
cropped AS (
  SELECT n.rid, n.fid, n.pc, n.x, n.y, n.z, n.cls, n.yr, n.ox, n.oy, t.inside FROM near n JOIN tested t USING (rid, fid)
  WHERE t.inside OR (t.buffered AND n.cls = 2))
"""
