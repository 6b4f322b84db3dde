"""Settings of a run: dataclasses whose fields carry default, bounds, unit kind and help; TOML files; command-line words.

Command-line values beat the file, the file beats the defaults. Lengths, areas and densities are given in metres and are
scaled once to the unit of the data. Unknown names, wrong kinds and values out of bounds are errors that name the field.
"""

from __future__ import annotations

import dataclasses
import math
import tomllib
from dataclasses import dataclass, field, fields


class ConfigError(ValueError):
    pass


def _f(default, low=None, high=None, unit: str = "", help: str = "", choices: tuple = ()):
    return field(default=default, metadata={"low": low, "high": high, "unit": unit, "help": help, "choices": choices})


@dataclass(frozen=True)
class Crop:
    simplify: float = _f(0.01, 0, None, "length", "tolerance when footprints are simplified")
    ceil_point_density: float = _f(20.0, 0, None, "density", "points are thinned above this density")
    lod11_point_density: float = _f(5.0, 0, None, "density", "the same for block models")
    cellsize: float = _f(0.5, 1e-6, None, "length", "side of a raster cell")
    min_building_density: float = _f(1.0, 0, None, "density", "fewer building points than this make a building insufficient")
    max_nodata_fraction: float = _f(1.0, 0, 1, "", "a larger share of cells without data makes a building insufficient")
    terrain_cellsize: float = _f(10.0, 1e-6, None, "length", "side of a terrain cell")
    terrain_radius: int = _f(3, 0, 100, "", "cells to look around a footprint for terrain")
    lod11_fallback_area: float = _f(69_000.0, 0, None, "area", "larger buildings become block models")
    buffer: float = _f(4.0, 0, None, "length", "ground points are kept so far around a footprint")


@dataclass(frozen=True)
class Reconstruct:
    lod12: bool = _f(False, help="make LoD 1.2")
    lod13: bool = _f(False, help="make LoD 1.3")
    lod22: bool = _f(True, help="make LoD 2.2")
    clip_terrain: bool = _f(True, help="cut roofs at the terrain")
    step_height: float = _f(3.0, 0, None, "length", "smaller steps are merged in LoD 1.3")
    plane_distance: float = _f(0.3, 0, None, "length", "a point so near a plane may join it")
    plane_points: int = _f(15, 3, None, "", "planes of fewer points are dropped")
    plane_neighbours: int = _f(15, 1, 1000, "", "nearest neighbours that a plane grows over")
    ground_strategy: str = _f("buffer_tile", help="where the ground height comes from", choices=("buffer_tile", "buffer_user", "user"))


@dataclass(frozen=True)
class Output:
    tiling: bool = _f(False, help="write by tile")
    tilesize: float = _f(1000.0, 1e-6, None, "length", "side of a tile")
    scale: float = _f(0.0001, 1e-12, None, "", "resolution of written coordinates")
    prefix: str = _f("tk_", help="before the names of made attributes")


@dataclass(frozen=True)
class Source:
    name: str = _f("", help="of the acquisition")
    quality: int = _f(0, help="lower is better")
    date: int = _f(0, help="yyyymmdd")
    force_lod11: bool = _f(False)
    date_only: bool = _f(False, help="counts only when the date decides")
    building_class: int = _f(6, 0, 255)
    ground_class: int = _f(2, 0, 255)


@dataclass(frozen=True)
class Settings:
    unit_scale: float = 1.0
    crop: Crop = field(default_factory=Crop)
    reconstruct: Reconstruct = field(default_factory=Reconstruct)
    output: Output = field(default_factory=Output)
    sources: tuple[Source, ...] = ()


_POWER = {"length": -1, "area": -2, "density": 2}
_GROUPS = {"crop": Crop, "reconstruct": Reconstruct, "output": Output}


def _value(kind: type, f: dataclasses.Field, value, path: str):
    want = {"float": float, "int": int, "bool": bool, "str": str}[f.type]
    if want is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if type(value) is not want:
        raise ConfigError(f"{path}: {want.__name__} expected, not {value!r}")
    if want is float and not math.isfinite(value):
        raise ConfigError(f"{path}: must be finite")
    low, high, choices = (f.metadata.get(k) for k in ("low", "high", "choices"))
    if (low is not None and value < low) or (high is not None and value > high):
        raise ConfigError(f"{path}: {value} is not from {low} to {high}")
    if choices and value not in choices:
        raise ConfigError(f"{path}: {value!r} is none of {', '.join(choices)}")
    return value


def _build(kind: type, values: dict, path: str):
    known = {f.name.replace("_", "-"): f for f in fields(kind)}
    given = {}
    for name, value in values.items():
        f = known.get(name.replace("_", "-"))
        if f is None:
            raise ConfigError(f"{path}.{name}: unknown")
        given[f.name] = _value(kind, f, value, f"{path}.{name}")
    return kind(**given)


def _words(words: list[str]) -> dict[str, dict]:
    """--group.name=value or --group.name (true), values in TOML's notation or plain text."""
    out: dict[str, dict] = {}
    for word in words:
        name, _, raw = word.removeprefix("--").partition("=")
        group, _, key = name.partition(".")
        if not word.startswith("--") or not key:
            raise ConfigError(f"{word}: --group.name=value expected")
        try:
            value = tomllib.loads(f"v = {raw}")["v"] if raw else True
        except tomllib.TOMLDecodeError:
            value = raw
        out.setdefault(group, {})[key.replace("_", "-")] = value
    return out


def load(text: str = "", words: list[str] | None = None) -> Settings:
    """Settings from the text of a TOML file and command-line words, in metres."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from e
    said = _words(words or [])
    for name in {*data, *said} - {*_GROUPS, "sources", "unit-scale"}:
        raise ConfigError(f"{name}: unknown")
    groups = {}
    for name, kind in _GROUPS.items():
        own = {k.replace("_", "-"): v for k, v in data.get(name, {}).items()} | said.get(name, {})
        groups[name] = _build(kind, own, name)
    sources = tuple(_build(Source, s, f"sources[{i}]") for i, s in enumerate(data.get("sources", [])))
    scale = float(data.get("unit-scale", 1.0))
    if not (math.isfinite(scale) and scale > 0):
        raise ConfigError("unit-scale: must be positive")
    return Settings(scale, **groups, sources=sources)


def scaled(s: Settings) -> Settings:
    """s with lengths, areas and densities in the data's unit (unit_scale metres)."""

    def group(g):
        change = {f.name: getattr(g, f.name) * s.unit_scale ** _POWER[f.metadata["unit"]] for f in fields(g) if f.metadata.get("unit")}
        return dataclasses.replace(g, **change)

    return dataclasses.replace(s, crop=group(s.crop), reconstruct=group(s.reconstruct), output=group(s.output))


def reference() -> str:
    """All settings as Markdown rows, from their declarations."""
    rows = ["| Name | Default | Unit | Meaning |", "|---|---|---|---|"]
    for name, kind in _GROUPS.items():
        rows += [f"| {name}.{f.name.replace('_', '-')} | {f.default} | {f.metadata['unit'] or '-'} | {f.metadata['help']} |" for f in fields(kind)]
    return "\n".join(rows)
