"""What a building's record is called and looks like: names, paths, dates, JSON, and the statements of the city format.

Defined cases: a null identifier takes the running number; a null attribute is written as null; an attribute renamed to
the empty name is left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "tk_"


def identifier(name: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), number.cast("string"))


def path_of(template: str, **parts: Column) -> Column:
    """template with each {name} replaced; other braces stay."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(part.cast("string"), F.lit("")))
    return out


def tile_file(min_x: Column, min_y: Column) -> Column:
    return F.format_string("%06d_%06d.city.jsonl", min_x.cast("long"), min_y.cast("long"))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def renamed(frame: DataFrame, keys: list[str], names: dict[str, str], prefix: str = PREFIX) -> DataFrame:
    """frame with all columns but keys renamed by names, the others prefixed; an empty name leaves a column out."""
    kept = [(c, names.get(c, f"{prefix}{c}")) for c in frame.columns if c not in keys]
    return frame.select(*keys, *[F.col(c).alias(n) for c, n in kept if n])


def as_json(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attributes: the other columns as one JSON object, nulls included; dates in ISO form."""
    dates = {f.name for f in frame.schema.fields if f.dataType.typeName() in ("date", "timestamp")}
    own = [(iso_date(F.col(c)) if c in dates else F.col(c)).alias(c) for c in frame.columns if c not in keys]
    return frame.select(*keys, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("attributes"))
