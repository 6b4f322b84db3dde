"""LAS point files (public LAS 1.2-1.4 record layout), read in ranges of bytes from any store that pyarrow opens.

read_headers gives extents and reference systems without reading a point; read_las gives path, x, y, z, cls, intensity,
gps_time and colours where the point format has them, opens only files whose extent meets an area, and splits large files
over tasks. Compressed (LAZ) files are refused, or left out with a warning where asked for. Empty files have no points.
"""

from __future__ import annotations

import logging
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, n_points long, format int, year int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, crs string"
POINTS = "path string, x double, y double, z double, cls int, intensity int, gps_time double, red double, green double, blue double"
WKT_RECORD = 2112
#: Bytes before the GPS time and the colours of each point format; None: absent.
_GPS = {0: None, 1: 20, 2: None, 3: 20, 6: 22, 7: 22, 8: 22}
_RGB = {0: None, 1: None, 2: 20, 3: 28, 6: None, 7: 30, 8: 30}


def _open(path: str) -> pa.NativeFile:
    """A file of any system that pyarrow opens, for reading in ranges."""
    plain = path.startswith("file:") and not path.startswith("file://")
    files, at = fs.FileSystem.from_uri(f"file://{path[5:]}" if plain else path)
    return files.open_input_file(at)


def _bytes(f: pa.NativeFile, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _crs(record: int, raw: bytes) -> str | None:
    return raw.rstrip(b"\0").decode("utf-8", "replace") or None if record == WKT_RECORD else None


def _header(f: pa.NativeFile) -> dict:
    """A file's header, its reference system from the records before or behind the points; the points aren't read."""
    raw = _bytes(f, 0, 375)
    if raw[:4] != b"LASF" or len(raw) < 227:
        raise ValueError("not a LAS file")
    year, size, offset, n_vlr = struct.unpack_from("<HHII", raw, 92)
    kind, length, n = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed points can't be read")
    minor = raw[25]
    if minor >= 4 and n == 0:
        n = struct.unpack_from("<Q", raw, 247)[0]
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", raw, 179)
    crs, at = None, size
    for _ in range(n_vlr):
        record, long = struct.unpack_from("<HH", _bytes(f, at, 54), 18)
        crs = crs or _crs(record, _bytes(f, at + 54, long) if record == WKT_RECORD else b"")
        at += 54 + long
    if minor >= 4 and crs is None:
        at, n_evlr = struct.unpack_from("<QI", raw, 235)
        for _ in range(n_evlr):
            head = _bytes(f, at, 60)
            record, long = struct.unpack_from("<H", head, 18)[0], struct.unpack_from("<Q", head, 20)[0]
            crs = crs or _crs(record, _bytes(f, at + 60, long) if record == WKT_RECORD else b"")
            at += 60 + long
    return {"n_points": n, "format": kind, "length": length, "offset": offset, "year": year, "scale": scale, "shift": shift, "min_x": min_x, "min_y": min_y, "min_z": min_z, "max_x": max_x, "max_y": max_y, "max_z": max_z, "crs": crs}


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The paths of LAS files in folders; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{las,LAS}").load(path).select("path")


def _headers(skip: bool):
    names = [f.split()[0] for f in HEADER.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in HEADER.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with _open(path) as f:
                        rows.append({"path": path} | _header(f))
                except (ValueError, OSError, struct.error) as e:
                    if not skip:
                        raise ValueError(f"{path}: {e}") from e
                    logging.getLogger(__name__).warning("%s is left out: %s", path, e)
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema)

    return run


def read_headers(spark: SparkSession, path: str | list[str], skip: bool = False) -> DataFrame:
    """A row per file: extent, points, reference system. skip: files that can't be read are left out with a warning."""
    return _files(spark, path).mapInArrow(_headers(skip), HEADER)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            with _open(path) as f:
                h = _header(f)
                if h["format"] not in _GPS:
                    raise ValueError(f"{path}: point format {h['format']} can't be read")
                rows = np.frombuffer(_bytes(f, h["offset"] + first * h["length"], n * h["length"]), np.uint8).reshape(-1, h["length"])

            def field(at: int, kind: str, rows=rows) -> np.ndarray:
                return np.ascontiguousarray(rows[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()

            for a in range(0, len(rows), 200_000):
                part = rows[a : a + 200_000]
                xyz = [field(4 * i, "<i4", part) * h["scale"][i] + h["shift"][i] for i in range(3)]
                cls = part[:, 16].astype(np.int32) if h["format"] >= 6 else (part[:, 15] & 31).astype(np.int32)
                gps, rgb = _GPS[h["format"]], _RGB[h["format"]]
                none = pa.nulls(len(part), pa.float64())
                colours = [none] * 3 if rgb is None else [pa.array(field(rgb + 2 * i, "<u2", part) / 65535.0) for i in range(3)]
                arrays = [pa.array([path] * len(part)), *map(pa.array, xyz), pa.array(cls), pa.array(field(12, "<u2", part).astype(np.int32)), none if gps is None else pa.array(field(gps, "<f8", part)), *colours]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in POINTS.split(", ")])


def read_las(spark: SparkSession, path: str | list[str], area: tuple[float, float, float, float] | None = None, skip: bool = False, split: int = 2_000_000) -> DataFrame:
    """The points of files, in parts of at most `split`. area (least x, y, greatest x, y): only files whose extent meets it
    are opened, only points inside are returned."""
    heads = read_headers(spark, path, skip).where("n_points > 0")
    if area is not None:
        x0, y0, x1, y1 = area
        heads = heads.where((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1))
    first = heads.select("path", "n_points", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1, F.lit(split).cast("long"))).alias("first"))
    parts = first.select("path", "first", F.least(F.lit(split), F.col("n_points") - F.col("first")).alias("n")).repartition("path", "first")
    points = parts.mapInArrow(_points, POINTS)
    return points if area is None else points.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def write_las(points: np.ndarray, cls: np.ndarray, scale: float = 0.01, year: int = 2020, wkt: str = "") -> bytes:
    """The bytes of a LAS 1.2 file of format 0. points: rows of x, y, z."""
    low = points.min(0) if len(points) else np.zeros(3)
    high = points.max(0) if len(points) else np.zeros(3)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", WKT_RECORD, len(wkt), b"") + wkt.encode() if wkt else b""
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HHII", head, 92, year, 227, 227 + len(vlr), int(bool(vlr)))
    struct.pack_into("<BHI", head, 104, 0, 20, len(points))
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, *low)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    rows = np.zeros(len(points), np.dtype([("p", "<i4", 3), ("i", "<u2"), ("r", "u1"), ("c", "u1"), ("a", "u1", 4)]))
    rows["p"] = np.round((points - low) / scale)
    rows["c"] = cls
    return bytes(head) + vlr + rows.tobytes()
