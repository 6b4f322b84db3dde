"""From points, footprints and settings to city features: the whole chain, one grouped step per building.

Footprints: fid, ring or rings, optionally name, attributes (JSON), user_ground, force_block. Points: pc, x, y, z, cls, yr in
whole units of `unit_scale` metres. Sources: pc, ord, quality, date, date_only. The result has a line per building with its
tile; what the settings don't ask for isn't made. A building without a usable acquisition has its footprint and attributes
only. Nulls, repeated rows and empty tables: as the operators say; repeated footprints are one feature.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings, scaled
from ..operators import crop as C
from ..operators import models as M
from ..operators import output as O
from ..operators import selection as S
from ..recon import build as R
from ..recon import planes as P
from ..recon import shapes as H
from ..sinks import city
from ..store import kept

FEATURE = "fid long, value string"
#: Side of the cells in which points are thinned, in metres.
THIN = 1.0


def parameters(s: Settings) -> R.BuildParameters:
    r = s.reconstruct
    return R.BuildParameters(planes=P.PlaneParameters(neighbours=r.plane_neighbours, distance=r.plane_distance, least_points=r.plane_points), step=r.step_height)


def lods(s: Settings) -> list[str]:
    """The levels that the settings ask for; block models stand in for all of them."""
    return [lod for lod, on in (("1.2", s.reconstruct.lod12), ("1.3", s.reconstruct.lod13), ("2.2", s.reconstruct.lod22)) if on]


def line(row: dict, roof: np.ndarray, s: Settings, translate: tuple[float, float, float]) -> str:
    """One building's feature. row: a row of plan(); roof: its points, in metres."""
    unit, prefix = s.unit_scale, s.output.prefix
    rings = [H.simplify(np.array([(q["x"], q["y"]) for q in r], float) * unit, s.crop.simplify) for r in row["rings"]]
    floor = row["ground"] * unit
    told = json.loads(row["attributes"] or "{}") | {f"{prefix}h_ground": round(floor, 3), f"{prefix}pc": row["pc"], f"{prefix}pc_reason": row["reason"], f"{prefix}mode": row["mode"]}
    solids: dict[str, city.Faces] = {}
    if row["mode"] != "SKIP" and len(roof):
        status, meshes, found = R.reconstruct(roof, rings, floor, parameters(s), row["mode"] == "LOD11")
        told |= {f"{prefix}status": status, f"{prefix}roof_type": found.roof_type if found else None}
        for lod in lods(s):
            if lod in meshes:
                m, name = meshes[lod], lod.replace(".", "")
                off = R.rmse(m, roof)
                told |= {f"{prefix}volume_lod{name}": round(m.volume(), 3), f"{prefix}rmse_lod{name}": None if off is None else round(off, 3)}
                solids[lod] = [(label, [[tuple(p) for p in r.tolist()] for r in own]) for label, own in m.faces]
    base = [[(float(x), float(y), floor) for x, y in r] for r in rings]
    return city.feature(row["name"], solids, translate, s.output.scale, told, base)


def plan(points: DataFrame, footprints: DataFrame, sources: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """A row per building (fid, name, rings, attributes, tile_x, tile_y, ground, pc, reason, mode), and the cropped points."""
    s, square = scaled(settings), round(settings.unit_scale**-2)
    cell, foot = max(1, round(s.crop.cellsize)), C.with_rings(footprints).where(F.size(F.get("rings", F.lit(0))) > 0).dropDuplicates(["fid"])
    cropped = kept(C.crop(points, foot, max(0, round(s.crop.buffer)), max(1, round(20 / settings.unit_scale))))
    pcs = [r.pc for r in S.configured(sources)]
    stats = kept(C.building_stats(cropped, foot, pcs, cell, square=square, min_density=settings.crop.min_building_density, max_nodata=settings.crop.max_nodata_fraction))
    moved = S.mutation(C.bands(cropped, cell), C.mask(foot, cell), S.all_pairs(sources), change=round(S.HEIGHT_CHANGE / 100 / settings.unit_scale)) if len(pcs) > 1 else None
    chosen = S.select(stats, sources, moved)
    forced = [x.name for x in settings.sources if x.force_lod11]
    modes = M.route(stats, foot, C.areas(foot, square), forced, settings.crop.lod11_fallback_area)
    ground = M.ground_height(stats, foot, points, settings.reconstruct.ground_strategy, settings.crop.terrain_radius, max(1, round(s.crop.terrain_cellsize)))
    none = F.lit(None).cast("string")
    own = foot.select("fid", "rings", O.identifier(F.col("name") if "name" in foot.columns else none, F.col("fid")).alias("name"), (F.col("attributes") if "attributes" in foot.columns else none).alias("attributes"))
    size = max(1, round(s.output.tilesize)) if settings.output.tiling else 1 << 40
    rows = own.join(C.tile(foot, size), "fid").join(ground.drop("origin"), "fid").join(chosen, "fid", "left").join(modes, ["fid", "pc"], "left")
    return rows.withColumn("mode", F.coalesce("mode", F.lit("SKIP"))), cropped


def features(points: DataFrame, footprints: DataFrame, sources: DataFrame, settings: Settings, translate: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """tile_x, tile_y, fid, value: see the module."""
    rows, cropped = plan(points, footprints, sources, settings)
    rows = kept(rows.where("ground IS NOT NULL"))
    most = C.most_in_cell(settings.crop.ceil_point_density, 1, 1)
    fewer = C.most_in_cell(settings.crop.lod11_point_density, 1, 1)
    building = cropped.where(F.col("cls") == C.ROOF_CLASS).join(rows.where("pc IS NOT NULL").select("fid", "pc", "mode"), ["fid", "pc"])
    cell = max(1, round(THIN / settings.unit_scale))
    thin = C.thin(building.where("mode = 'STANDARD'").drop("mode"), most, cell).unionByName(C.thin(building.where("mode = 'LOD11'").drop("mode"), fewer, cell))

    def run(own: pa.Table, foot: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in foot.slice(0, 1).to_pylist():
            xyz = np.stack([own.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1).reshape(-1, 3) * settings.unit_scale
            try:
                value = line(row, xyz[np.isfinite(xyz).all(1)], settings, translate)
            except (ValueError, IndexError, KeyError, np.linalg.LinAlgError) as e:  # its footprint stays
                value = line(row | {"mode": "SKIP", "attributes": json.dumps({f"{settings.output.prefix}status": f"failed: {type(e).__name__}"})}, xyz[:0], settings, translate)
            out.append({"fid": row["fid"], "value": value})
        return pa.Table.from_pylist(out, pa.schema([("fid", pa.int64()), ("value", pa.string())]))

    made = thin.select("fid", "x", "y", "z").groupBy("fid").cogroup(rows.groupBy("fid")).applyInArrow(run, FEATURE)
    return made.join(rows.select("fid", "tile_x", "tile_y"), "fid").select("tile_x", "tile_y", "fid", "value")
