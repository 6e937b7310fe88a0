"""A grid's header: the one small thing that planning looks at on the driver."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegrid.functions.geo import GEOGRAPHIC, SINUSOIDAL

CATALOG = T.StructType(
    [
        T.StructField("grid", T.StringType()),
        T.StructField("root", T.StringType()),
        *[T.StructField(n, T.IntegerType()) for n in ("width", "height", "frac_width", "frac_height", "frac_ndates", "ndates", "num_x_fracs", "num_y_fracs", "num_dates_fracs")],
        T.StructField("dtype", T.StringType()),
        T.StructField("nodata", T.DoubleType()),
        T.StructField("geot", T.ArrayType(T.DoubleType())),
        T.StructField("sr_wkt", T.StringType()),
        T.StructField("projection", T.StringType()),
        T.StructField("timestamps_ms", T.ArrayType(T.LongType())),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Spark's type for each stored type; unsigned ones take the next wider signed one.
SPARK_TYPES = {"i1": "smallint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "f4": "float", "f8": "double", "b1": "boolean"}


@dataclass(frozen=True)
class Header:
    """Size, chunking, georeference, dates and metadata of a grid, checked when it is made."""

    grid: str
    root: str
    width: int
    height: int
    frac_width: int
    frac_height: int
    ndates: int = 1
    frac_ndates: int | None = None
    dtype: str = "<f8"
    nodata: float | None = None
    geot: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    sr_wkt: str = ""
    projection: str | None = None
    timestamps_ms: tuple[int, ...] | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("geot", tuple(float(g) for g in self.geot))
        put("dtype", np.dtype(self.dtype).str)
        if self.timestamps_ms is not None:
            put("timestamps_ms", tuple(int(t) for t in self.timestamps_ms))
        if self.frac_ndates is None:
            put("frac_ndates", self.ndates)
        if self.projection is None:
            put("projection", SINUSOIDAL if "sinusoidal" in self.sr_wkt.lower() else GEOGRAPHIC)
        if self.width % self.frac_width or self.height % self.frac_height:
            raise ValueError("width and height must be whole numbers of fractions")
        if len(self.geot) != 6 or abs(self.geot[2]) > 1e-12 or abs(self.geot[4]) > 1e-12:
            raise ValueError("a geotransform of six numbers without rotation is needed")
        if self.timestamps_ms is not None and len(self.timestamps_ms) != self.ndates:
            raise ValueError("there must be a timestamp for each date")
        if self.frac_ndates < 1 or self.ndates < 0:
            raise ValueError("a time chunk holds a date at least")

    @property
    def num_x_fracs(self) -> int:
        return self.width // self.frac_width

    @property
    def num_y_fracs(self) -> int:
        return self.height // self.frac_height

    @property
    def num_fracs(self) -> int:
        return self.num_x_fracs * self.num_y_fracs

    @property
    def has_timestamps(self) -> bool:
        return self.timestamps_ms is not None

    @property
    def num_dates_fracs(self) -> int:
        """Time chunks; a grid without timestamps has one."""
        return -(-self.ndates // self.frac_ndates) if self.has_timestamps else 1

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.height, self.width, self.ndates

    @property
    def value_type(self) -> str:
        return SPARK_TYPES[np.dtype(self.dtype).str[1:]]

    @property
    def fill(self) -> float:
        return 0.0 if self.nodata is None else self.nodata

    def copy(self, **changes: Any) -> Header:
        """This header with other values; ``shape`` sets height, width and number of dates at once."""
        if "shape" in changes:
            changes["height"], changes["width"], changes["ndates"] = changes.pop("shape")
        return dataclasses.replace(self, **changes)

    def with_timestamps(self, timestamps_ms: list[int]) -> Header:
        """More dates: those that the grid has must be the first of them."""
        old = self.timestamps_ms or ()
        if tuple(timestamps_ms[: len(old)]) != old:
            raise ValueError("dates can only be added after the last one")
        return self.copy(timestamps_ms=tuple(timestamps_ms), ndates=len(timestamps_ms))

    def in_bounds(self, x: int, y: int) -> bool:
        return 0 <= x < self.width and 0 <= y < self.height

    def frac_for_xy(self, x: int, y: int) -> int:
        if not self.in_bounds(x, y):
            raise ValueError(f"pixel ({x}, {y}) outside the grid")
        return (y // self.frac_height) * self.num_x_fracs + x // self.frac_width

    def frac_xyranges(self, frac: int) -> tuple[tuple[int, int], tuple[int, int]]:
        fy, fx = divmod(frac, self.num_x_fracs)
        return (fx * self.frac_width, (fx + 1) * self.frac_width), (fy * self.frac_height, (fy + 1) * self.frac_height)

    def frac_time_range(self, chunk: int) -> tuple[int, int]:
        return chunk * self.frac_ndates, min(self.ndates, (chunk + 1) * self.frac_ndates)

    def fracs_for_rect(self, x0: int, y0: int, x1: int, y1: int) -> list[int]:
        """Fractions that a half-open rectangle touches; none for an empty one."""
        if x1 <= x0 or y1 <= y0:
            return []
        xs = range(x0 // self.frac_width, (x1 - 1) // self.frac_width + 1)
        ys = range(y0 // self.frac_height, (y1 - 1) // self.frac_height + 1)
        return [fy * self.num_x_fracs + fx for fy in ys for fx in xs]

    def chunk_files(self, frac: int) -> list[str]:
        return [f"{frac}.{k}.jdata" for k in range(self.num_dates_fracs)]

    def same_geogrid(self, other: Header) -> bool:
        """Same reference system, transform, size and fractions, by value."""
        keys = ("sr_wkt", "projection", "geot", "width", "height", "frac_width", "frac_height")
        return all(getattr(self, k) == getattr(other, k) for k in keys)

    def same_place(self, other: Header) -> bool:
        """Pixels with equal numbers are the same place."""
        return (self.sr_wkt, self.projection, self.geot) == (other.sr_wkt, other.projection, other.geot)

    def chunk_bytes(self, ndates: int | None = None) -> int:
        """Memory of a dense fraction with so many dates, one time chunk's by default."""
        return self.frac_width * self.frac_height * (self.frac_ndates if ndates is None else ndates) * np.dtype(self.dtype).itemsize

    def to_json(self) -> str:
        meta = dict(self.meta)
        if self.timestamps_ms is not None:
            meta["timestamps_ms"] = list(self.timestamps_ms)
        if self.nodata is not None:
            meta["nodataval"] = self.nodata
        stored = {
            "width": self.width,
            "height": self.height,
            "fracWidth": self.frac_width,
            "fracHeight": self.frac_height,
            "fracNDates": self.frac_ndates,
            "spatialRefWKT": self.sr_wkt,
            "dtype": self.dtype,
            "geot": list(self.geot),
            "shape": list(self.shape),
            "meta": meta,
        }
        return json.dumps(stored)

    @classmethod
    def from_json(cls, text: str, root: str, grid: str | None = None) -> Header:
        d = json.loads(text)
        meta = dict(d.get("meta") or {})
        stamps, nodata = meta.pop("timestamps_ms", None), meta.pop("nodataval", None)
        shape = d["shape"]
        if shape[0] != d["height"] or shape[1] != d["width"]:
            raise ValueError("a header whose shape isn't its size")
        return cls(
            grid or root.rstrip("/").rpartition("/")[2],
            root,
            d["width"],
            d["height"],
            d["fracWidth"],
            d["fracHeight"],
            shape[2] if len(shape) > 2 else 1,
            d.get("fracNDates"),
            d["dtype"],
            nodata,
            tuple(d["geot"]),
            d["spatialRefWKT"],
            None,
            None if stamps is None else tuple(stamps),
            meta,
        )

    def row(self) -> tuple:
        numbers = (self.width, self.height, self.frac_width, self.frac_height, self.frac_ndates, self.ndates, self.num_x_fracs, self.num_y_fracs, self.num_dates_fracs)
        nodata = None if self.nodata is None else float(self.nodata)
        stamps = None if self.timestamps_ms is None else list(self.timestamps_ms)
        return (self.grid, self.root, *numbers, self.dtype, nodata, list(self.geot), self.sr_wkt, self.projection, stamps, {k: json.dumps(v) for k, v in self.meta.items()})


def catalog(spark: SparkSession, headers: list[Header]) -> DataFrame:
    """The catalog table: a row for each grid."""
    return spark.createDataFrame([h.row() for h in headers], CATALOG)


def dates(spark: SparkSession, header: Header) -> DataFrame:
    """The date dimension (t, ts_ms); without timestamps ts_ms is null."""
    stamps = header.timestamps_ms or (None,) * header.ndates
    return spark.createDataFrame(list(enumerate(stamps)), "t int, ts_ms bigint")
