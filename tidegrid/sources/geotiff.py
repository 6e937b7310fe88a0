"""Single-band GeoTIFF rasters: a small reader (plain or DEFLATE strips and tiles, gzip around it) and a DEFLATE writer."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import geo
from tidegrid.operators import align
from tidegrid.operators.grid import Grid
from tidegrid.plans.header import Header
from tidegrid.plans.session import ship_package

#: Fixed values of the format: sizes of field types, and the tags used.
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEOKEYS, GEO_TEXT, NODATA = 33550, 33922, 34735, 34737, 42113


@dataclass
class Raster:
    data: np.ndarray  # (height, width)
    geot: tuple[float, ...]
    nodata: float | None = None
    sr_wkt: str = ""


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no classic TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        entry = raw[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in SIZES:
            continue
        code, size = SIZES[kind]
        place = entry[8:12] if n * size <= 4 else raw[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + n * size]
        tags[tag] = (place[:n],) if kind == 2 else struct.unpack(order + (f"{2 * n}I" if kind == 5 else f"{n}{code}"), place[: n * size])
    return order, tags


def _place(tags: dict[int, tuple]) -> tuple[tuple[float, ...], float | None, str]:
    """(geotransform, no-data value, spatial reference) that the tags state."""
    geot = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (px, py, _, gx, gy, *_) = tags[SCALE], tags[TIEPOINT]
        geot = (gx - px * sx, sx, 0.0, gy + py * sy, 0.0, -sy)
    nodata = float(tags[NODATA][0].rstrip(b"\0 ")) if NODATA in tags else None
    wkt = tags[GEO_TEXT][0].rstrip(b"\0|").decode("latin-1") if GEO_TEXT in tags else ""
    return geot, nodata, wkt


def read(raw: bytes) -> Raster:
    """The first band of the first image."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order, tags = _tags(raw)
    one = lambda tag, other=1: tags.get(tag, (other,))[0]
    if one(SAMPLES) != 1 or one(PREDICTOR) != 1 or one(COMPRESSION) not in (1, 8, 32946):
        raise ValueError("only one band, without predictor, plain or DEFLATE, is read")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(FORMAT)] + str(one(BITS, 1) // 8))
    h, w = one(HEIGHT), one(WIDTH)
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(h, one(ROWS, h)))
    out = np.zeros((-(-h // bh) * bh, -(-w // bw) * bw), dtype=kind.newbyteorder("="))
    across = -(-w // bw)
    for i, (at, n) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS])):
        block = raw[at : at + n]
        values = np.frombuffer(block if one(COMPRESSION) == 1 else zlib.decompress(block), kind)
        y, x = i // across * bh, i % across * bw
        rows = len(values) // bw
        out[y : y + rows, x : x + bw] = values.reshape(rows, bw)
    return Raster(out[:h, :w], *_place(tags))


def describe(raw: bytes, path: str = "raster") -> Header:
    """The header of a raster as a grid of one fraction, from its tags alone."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order, tags = _tags(raw)
    h, w = tags[HEIGHT][0], tags[WIDTH][0]
    geot, nodata, wkt = _place(tags)
    kind = "<" + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags.get(BITS, (1,))[0] // 8)
    return Header(path.rpartition("/")[2], path, w, h, w, h, dtype=kind, nodata=nodata, geot=geot, sr_wkt=wkt)


def write(raster: Raster) -> bytes:
    """A DEFLATE GeoTIFF of strips of 64 rows; the spatial reference goes into the citation key as text."""
    data = np.ascontiguousarray(raster.data).astype(raster.data.dtype.newbyteorder("<"))
    h, w = data.shape
    strips = [zlib.compress(data[y : y + 64].tobytes()) for y in range(0, h, 64)]
    form = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    text = raster.sr_wkt.encode("latin-1", "replace") + b"|\0"
    fields: list[tuple[int, int, bytes, int]] = []

    def put(tag: int, kind: int, *values) -> None:
        code, _ = SIZES[kind]
        body = values[0] if kind == 2 else struct.pack(f"<{len(values)}{code}", *values)
        fields.append((tag, kind, body, len(values[0]) if kind == 2 else len(values)))

    put(WIDTH, 4, w)
    put(HEIGHT, 4, h)
    put(BITS, 3, data.dtype.itemsize * 8)
    put(COMPRESSION, 3, 8)
    put(PHOTOMETRIC, 3, 1)
    put(OFFSETS, 4, *offsets)
    put(SAMPLES, 3, 1)
    put(ROWS, 4, 64)
    put(COUNTS, 4, *map(len, strips))
    put(FORMAT, 3, form)
    put(SCALE, 12, raster.geot[1], -raster.geot[5], 0.0)
    put(TIEPOINT, 12, 0.0, 0.0, 0.0, raster.geot[0], raster.geot[3], 0.0)
    put(GEOKEYS, 3, 1, 1, 0, 2, 1024, 0, 1, 32767, 1026, GEO_TEXT, len(text) - 1, 0)
    put(GEO_TEXT, 2, text)
    if raster.nodata is not None:
        put(NODATA, 2, f"{raster.nodata:g}".encode() + b"\0")
    at += at % 2
    extra_at = at + 2 + 12 * len(fields) + 4
    table, extra = struct.pack("<H", len(fields)), b""
    for tag, kind, body, n in fields:
        if len(body) <= 4:
            place = body.ljust(4, b"\0")
        else:
            place = struct.pack("<I", extra_at + len(extra))
            extra += body + b"\0" * (len(body) % 2)
        table += struct.pack("<HHI", tag, kind, n) + place
    body = struct.pack("<2sHI", b"II", 42, at) + b"".join(strips)
    return body.ljust(at, b"\0") + table + struct.pack("<I", 0) + extra


def read_cells(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """(path, y, x, value) of all rasters at a path or pattern; each file is decoded by one worker, row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                data = read(bytes(content)).data
                for y in range(0, data.shape[0], 256):
                    rows, columns = np.indices(data[y : y + 256].shape)
                    yield pd.DataFrame({"path": name, "y": (rows + y).reshape(-1).astype("int32"), "x": columns.reshape(-1).astype("int32"), "value": data[y : y + 256].reshape(-1)})

    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, y int, x int, value {kind}")


def import_tile(spark: SparkSession, path: str, header: Header, cell: int) -> DataFrame:
    """Cells (y, x, t, value) of one land-cover tile file as a fraction of a grid with one date."""
    (x0, _), (y0, _) = header.frac_xyranges(cell)
    return read_cells(spark, path).select((F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), F.lit(0).alias("t"), F.col("value").cast(header.value_type).alias("value"))


def from_window(values: np.ndarray, header: Header, xy_from: tuple[int, int], nodata: float | None = None) -> Raster:
    """A 16-bit raster of a window that starts at a pixel of a grid."""
    g = header.geot
    geot = (g[0] + xy_from[0] * g[1], g[1], 0.0, g[3] + xy_from[1] * g[5], 0.0, g[5])
    return Raster(np.asarray(values, dtype=np.int16), geot, header.nodata if nodata is None else nodata, header.sr_wkt)


def open_grid(spark: SparkSession, path: str, projection: str | None = None) -> Grid:
    """A raster file as a grid of one date; ``projection`` overrides what the file says. Only the header comes to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"header": [describe(bytes(c), p).to_json() for p, c in zip(frame["path"], frame["content"])]})

    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(run, "header string").take(2)
    if len(found) != 1:
        raise ValueError(f"one raster is needed at {path}")
    header = Header.from_json(found[0]["header"], path)
    header = header.copy(projection=projection or geo.projection_of(header.sr_wkt))
    cells = read_cells(spark, path, header.value_type).select("y", "x", F.lit(0).alias("t"), "value")
    return Grid.of(header, cells)


def reproject_file(spark: SparkSession, path: str, model: Header, interpolation: str = "near") -> DataFrame:
    """(y, x, value, valid): a raster file on the pixels of a model, such as ``open_grid(...).header``.

    Where the source has no data or doesn't reach, valid is false and the value 0; a true 0 of the source stays valid.
    """
    source = open_grid(spark, path)
    target = Grid.of(model, source.cells.limit(0).select("y", "x", "t", "value"))
    found = align.reproject(target, source, (0, 0), (model.width, model.height), interpolation)
    return found.select("y", "x", F.coalesce("value", F.lit(0).cast(dict(found.dtypes)["value"])).alias("value"), F.col("value").isNotNull().alias("valid"))


def reproject_custom(spark: SparkSession, path: str, width: int, height: int, geot: tuple[float, ...], projection: str | None = None, interpolation: str = "near") -> DataFrame:
    """The same on a grid given by its size and geotransform, in the file's own projection unless another is named."""
    model = Header("custom", "", width, height, width, height, geot=geot, projection=projection or open_grid(spark, path).header.projection)
    return reproject_file(spark, path, model, interpolation)
