"""A grid of cells and its reads: windows, fractions, dense slices, series, what is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import addressing as A
from tidegrid.functions import geo
from tidegrid.functions.arrays import filled
from tidegrid.plans.header import Header


def keyed_cells(cells: DataFrame, header: Header) -> DataFrame:
    """Adds frac_num and time_chunk to cells (y, x, t, ...)."""
    return cells.withColumns({"frac_num": A.frac_for_xy("x", "y", header.frac_width, header.frac_height, header.num_x_fracs), "time_chunk": A.time_chunk("t", header.frac_ndates)})


@dataclass(frozen=True)
class Grid:
    """A header with its sparse cells (y, x, t, value, frac_num, time_chunk). Reads are lazy; no row means no data."""

    header: Header
    cells: DataFrame

    @classmethod
    def of(cls, header: Header, cells: DataFrame) -> Grid:
        """From cells (y, x, t, value), keyed here unless they carry their keys."""
        have = {"frac_num", "time_chunk"} <= set(cells.columns)
        return cls(header, cells if have else keyed_cells(cells, header))

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def _dates(self, t_from: int | None, t_to: int | None) -> tuple[int, int]:
        lo, hi = 0 if t_from is None else t_from, self.header.ndates if t_to is None else t_to
        if not 0 <= lo <= hi <= self.header.ndates:
            raise ValueError(f"dates [{lo}, {hi}) outside the grid")
        return lo, hi

    def window(self, xy_from: tuple[int, int], xy_to: tuple[int, int], t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """Sparse cells of a half-open pixel rectangle and date range.

        The fractions and time chunks that it touches are found from the header and added as predicates,
        so that stored partitions and row groups are pruned; the exact predicate follows.
        """
        (x0, y0), (x1, y1) = xy_from, xy_to
        h = self.header
        lo, hi = self._dates(t_from, t_to)
        if min(x0, y0) < 0 or x1 > h.width or y1 > h.height:
            raise ValueError("a window outside the grid")
        if x1 <= x0 or y1 <= y0 or hi <= lo:
            return self.cells.where(F.lit(False))
        out = self.cells.where(F.col("time_chunk").between(lo // h.frac_ndates, (hi - 1) // h.frac_ndates))
        out = out.where(self._frac_rows(x0, y0, x1, y1))
        return out.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("t") >= lo) & (F.col("t") < hi))

    def _frac_rows(self, x0: int, y0: int, x1: int, y1: int):
        """Fractions of the rectangle: a list where it is short, else a range for each row of fractions in one expression."""
        fracs = self.header.fracs_for_rect(x0, y0, x1, y1)
        if len(fracs) <= 1000:
            return F.col("frac_num").isin(fracs)
        column = F.col("frac_num") % self.header.num_x_fracs
        return F.col("frac_num").between(fracs[0], fracs[-1]) & column.between(x0 // self.header.frac_width, (x1 - 1) // self.header.frac_width)

    def scaffold(self, xy_from: tuple[int, int], xy_to: tuple[int, int], t_from: int, t_to: int) -> DataFrame:
        """All (y, x, t) of a window, made in parallel from its row numbers."""
        (x0, y0), (x1, y1) = xy_from, xy_to
        w, d = max(0, x1 - x0), max(0, t_to - t_from)
        n = max(0, y1 - y0) * w * d
        i = F.col("id")
        return self.spark.range(n).select(
            (F.lit(y0) + A.int_div(i, max(1, w * d))).cast("int").alias("y"),
            (F.lit(x0) + A.int_div(i, max(1, d)) % max(1, w)).cast("int").alias("x"),
            (F.lit(t_from) + i % max(1, d)).cast("int").alias("t"),
        )

    def dense(self, xy_from: tuple[int, int], xy_to: tuple[int, int], t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """Every cell (y, x, t, value) of a window; the no-data value, or 0, where nothing is stored.

        Rows multiply to the window's volume: only asked for by name.
        """
        lo, hi = self._dates(t_from, t_to)
        stored = self.window(xy_from, xy_to, lo, hi).select("y", "x", "t", "value")
        kind = dict(self.cells.dtypes)["value"]
        return self.scaffold(xy_from, xy_to, lo, hi).join(stored, ["y", "x", "t"], "left").withColumn("value", filled("value", self.header.nodata, kind))

    def frac(self, frac_num: int, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """A dense fraction with all dates, or those of a range."""
        (x0, x1), (y0, y1) = self.header.frac_xyranges(frac_num)
        return self.dense((x0, y0), (x1, y1), t_from, t_to)

    def chunk_slice(self, frac_num: int, chunk: int, ys: tuple[int, int], xs: tuple[int, int], ts: tuple[int, int]) -> DataFrame:
        """A dense part of one chunk, in coordinates from the chunk's own corner and first date."""
        (x0, _), (y0, _) = self.header.frac_xyranges(frac_num)
        t0, t1 = self.header.frac_time_range(chunk)
        if ts[1] > t1 - t0 or xs[1] > self.header.frac_width or ys[1] > self.header.frac_height:
            raise ValueError("a slice outside the chunk")
        part = self.dense((x0 + xs[0], y0 + ys[0]), (x0 + xs[1], y0 + ys[1]), t0 + ts[0], t0 + ts[1])
        return part.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0, "t": F.col("t") - t0})

    def slice_latlng(self, top_left: tuple[float, float], bottom_right: tuple[float, float], t_from: int | None = None, t_to: int | None = None) -> tuple[DataFrame, tuple[int, int]]:
        """(dense cells, first pixel) of the half-open pixel window between two points (lat, lng)."""
        if top_left[0] <= bottom_right[0] or top_left[1] >= bottom_right[1]:
            raise ValueError("the first point must be north west of the second")
        a, b = self.pixel_of(*top_left), self.pixel_of(*bottom_right)
        return self.dense(a, b, t_from, t_to), a

    def pixel_of(self, lat: float, lng: float) -> tuple[int, int]:
        """One point's pixel, by the same expressions as whole columns."""
        x, y = geo.latlng_to_xy(F.lit(float(lat)), F.lit(float(lng)), self.header.geot, self.header.projection)
        r = self.spark.range(1).select(x.alias("x"), y.alias("y")).first()
        return r["x"], r["y"]

    def available_fractions(self) -> DataFrame:
        return self.cells.select("frac_num", "time_chunk").distinct()

    def available_fracnums(self) -> DataFrame:
        return self.cells.select("frac_num").distinct().orderBy("frac_num")

    def info(self) -> DataFrame:
        """How many chunks and fractions are stored."""
        return self.available_fractions().agg(F.count("*").alias("n_chunks"), F.countDistinct("frac_num").alias("n_fracnums"))

    def first_fractions(self, n: int) -> DataFrame:
        return self.cells.select("frac_num").distinct().orderBy("frac_num").limit(n)

    def latest_chunks(self) -> DataFrame:
        """For each fraction its latest time chunk and how many dates that one holds."""
        per = self.cells.groupBy("frac_num", "time_chunk").agg(F.countDistinct("t").cast("int").alias("nd"))
        return per.groupBy("frac_num").agg(F.max("time_chunk").alias("time_chunk"), F.max_by("nd", "time_chunk").alias("nd"))

    def chunk_stats(self, cells: DataFrame | None = None) -> DataFrame:
        """Count, sum and minimum of the values of each chunk, of all cells or those of a window."""
        cells = self.cells if cells is None else cells
        return cells.groupBy("frac_num", "time_chunk").agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"), F.min("value").alias("min_value"))

    def series(self) -> DataFrame:
        """(y, x, values): a pixel's stored values by date. A pixel has at most as many as the grid has dates."""
        sorted_ = F.sort_array(F.collect_list(F.struct("t", "value")))
        return self.cells.groupBy("y", "x").agg(F.transform(sorted_, lambda s: s["value"]).alias("values"))

    def latlng_grid(self, xy_from: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
        """(y, x, lat, lng) of the top left corners of a sub-grid's pixels."""
        (x0, y0), (h, w) = xy_from, shape
        pixels = self.scaffold((x0, y0), (x0 + w, y0 + h), 0, 1).select("y", "x")
        lat, lng = geo.xy_to_latlng("x", "y", self.header.geot, self.header.projection)
        return pixels.withColumns({"lat": lat, "lng": lng})

    def fraction_polygons(self) -> DataFrame:
        """(frac_num, ring) of the stored fractions, each once."""
        h = self.header
        r = A.frac_ranges("frac_num", h.frac_width, h.frac_height, h.num_x_fracs)
        ring = geo.corners(r["x_start"], r["y_start"], r["x_end"], r["y_end"], h.geot, h.projection)
        return self.cells.select("frac_num").distinct().withColumn("ring", ring)
