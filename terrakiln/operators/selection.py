"""Choosing among acquisitions: ranks, change between them, and the choice with its reason.

Defined cases: a building without cells is never mutated; ties go to the first source in order; a null measure of a gap is
taken to be small enough; buildings without a candidate have no row; empty tables give empty results.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

MAX_NODATA, MAX_RADIUS, HEIGHT_CHANGE, CHANGED_SHARE = 0.06, 0.5, 120, 0.5


def configured(sources: DataFrame, most: int = 10_000) -> list[Row]:
    """The rows of a table of configuration, in order; it is an error if there are more than a configuration has."""
    rows = sources.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} acquisitions")
    return sorted(rows, key=lambda r: r.ord)


def consecutive(sources: DataFrame) -> list[tuple[str, str]]:
    """Each acquisition with the next in order."""
    names = [r.pc for r in configured(sources)]
    return list(zip(names, names[1:], strict=False))


def all_pairs(sources: DataFrame) -> list[tuple[str, str]]:
    """Each acquisition with each other one."""
    return list(permutations([r.pc for r in configured(sources)], 2))


def _paired(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A row of frame for each of pairs."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("pc"), F.lit(b).alias("pc_next")) for a, b in pairs]))
    return frame.withColumn("_p", each).select("*", "_p.pc", "_p.pc_next").drop("_p")


def mutation(cells: DataFrame, mask: DataFrame, pairs: list[tuple[str, str]], change: int = HEIGHT_CHANGE, share: float = CHANGED_SHARE) -> DataFrame:
    """fid, pc, pc_next, n_changed, mutated: cells that have data in both acquisitions and whose top moved by over
    change, against all cells of the footprint."""
    tops = cells.join(mask.hint("merge"), ["fid", "col", "row"]).select("fid", "col", "row", "pc", "z_max")
    later = tops.select("fid", "col", "row", F.col("pc").alias("pc_next"), F.col("z_max").alias("z_next"))
    both = _paired(tops.withColumnRenamed("pc", "_pc"), pairs).where("_pc = pc").join(later, ["fid", "col", "row", "pc_next"])
    changed = both.groupBy("fid", "pc", "pc_next").agg(F.count_if(F.abs(F.col("z_next") - F.col("z_max")) > change).alias("n_changed"))
    rows = _paired(mask.groupBy("fid").agg(F.count("*").alias("n_cells")), pairs)
    n = F.coalesce("n_changed", F.lit(0))
    return rows.join(changed, ["fid", "pc", "pc_next"], "left").select("fid", "pc", "pc_next", n.alias("n_changed"), (n / F.col("n_cells") >= share).alias("mutated"))


def select(stats: DataFrame, sources: DataFrame, changes: DataFrame | None) -> DataFrame:
    """fid, pc, reason: the acquisition to reconstruct from. Sufficient is one with few cells without data (and no large
    gap, where stats has a radius). The best sufficient one by quality, if it is the latest sufficient one too or didn't
    change against that; else that one; where none suffices, the best covered one that didn't change against the newest.
    changes: mutation() over all pairs, None where there is one acquisition. Sources of dates only don't compete, unless there are no others."""
    gap = F.coalesce(F.col("radius") <= MAX_RADIUS, F.lit(True)) if "radius" in stats.columns else F.lit(True)
    real = any(not r.date_only for r in configured(sources))
    rows = stats.join(sources.where("NOT date_only") if real else sources, "pc").withColumn("ok", (F.col("nodata") <= MAX_NODATA) & gap)
    per = lambda *keys: Window.partitionBy("fid").orderBy(*keys)
    by_date = (F.col("date").desc(), F.col("ord"))
    ranked = rows.select(
        "fid", "pc", "ok", "nodata", "ord",
        F.row_number().over(per(F.col("ok").desc(), "quality", "ord")).alias("by_quality"),
        F.row_number().over(per(F.col("ok").desc(), *by_date)).alias("by_date"), F.row_number().over(per(*by_date)).alias("newest"),
    )
    pick = lambda rank: F.max(F.when(F.col(rank) == 1, F.col("pc")))
    best = ranked.groupBy("fid").agg(pick("by_quality").alias("best"), pick("by_date").alias("latest"), pick("newest").alias("newest"), F.max("ok").alias("ok"))
    if changes is None:
        changes = stats.limit(0).select("fid", "pc", F.col("pc").alias("pc_next"), F.lit(False).alias("mutated"))
    moved = changes.where("mutated").select("fid", F.col("pc").alias("_a"), F.col("pc_next").alias("_b"), F.lit(True).alias("_m"))
    of = moved.withColumnRenamed("fid", "_f")
    best = best.join(of, (F.col("fid") == F.col("_f")) & (F.col("best") == F.col("_a")) & (F.col("latest") == F.col("_b")), "left").drop("_f", "_a", "_b")
    best = best.withColumn("mutated", F.coalesce("_m", F.lit(False))).drop("_m")
    still = ranked.join(best.select("fid", F.col("newest").alias("_new")), "fid")
    still = still.join(of, (F.col("fid") == F.col("_f")) & (F.col("pc") == F.col("_a")) & (F.col("_new") == F.col("_b")), "left_anti")
    covered = still.groupBy("fid").agg(F.min(F.struct("nodata", "ord", "pc")).alias("c")).select("fid", F.col("c.pc").alias("covered"))
    reason = (
        F.when(~F.col("ok"), "BEST_COVERAGE").when(F.col("best") == F.col("latest"), "PREFERRED_AND_LATEST").when(F.col("mutated"), "LATEST_WITH_MUTATION").otherwise("PREFERRED_NOT_LATEST")
    )
    out = best.join(covered, "fid").withColumn("reason", reason)
    chosen = F.when(F.col("reason") == "BEST_COVERAGE", F.col("covered")).when(F.col("reason") == "LATEST_WITH_MUTATION", F.col("latest")).otherwise(F.col("best"))
    return out.select("fid", chosen.alias("pc"), "reason")


def override(chosen: DataFrame, built: DataFrame, sources: DataFrame) -> DataFrame:
    """chosen (fid, pc, reason), but for buildings built (fid, built: a year) after the chosen acquisition's year: those take
    the latest of all sources, dates only or not, with the reason LATEST."""
    latest = F.lit(max(configured(sources), key=lambda r: (r.date, -r.ord)).pc)
    dates = sources.select("pc", F.floor(F.col("date") / 10_000).alias("_year"))
    rows = chosen.join(built.select("fid", "built"), "fid", "left").join(dates, "pc")
    late = F.coalesce(F.col("built") > F.col("_year"), F.lit(False))
    return rows.select("fid", F.when(late, latest).otherwise(F.col("pc")).alias("pc"), F.when(late, "LATEST").otherwise(F.col("reason")).alias("reason"))


def terrain_source(sources: DataFrame) -> DataFrame:
    """The one acquisition that the terrain is made of: best quality, latest, first in order; date-only ones don't count."""
    order = Window.orderBy("quality", F.col("date").desc(), "ord")
    return sources.where("NOT date_only").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("pc", "quality", "date")
