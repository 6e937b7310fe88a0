"""Co-registration: joining grids cell by cell, reprojecting where their pixels differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import geo
from tidegrid.operators.grid import Grid, keyed_cells
from tidegrid.operators.mask import Ring, bbox, closed, inside, ring_pixels
from tidegrid.plans.header import Header


def _floor_pixel(lat: Column, lng: Column, header: Header) -> tuple[Column, Column]:
    x, y = geo.pixel_position(lat, lng, header.geot, header.projection)
    return F.floor(x).cast("int"), F.floor(y).cast("int")


def source_pixel(x: Column, y: Column, target: Header, source: Header) -> tuple[Column, Column]:
    """The source pixel that holds the centre of a target pixel."""
    lat, lng = geo.xy_to_latlng(x + F.lit(0.5), y + F.lit(0.5), target.geot, target.projection, 0.0)
    return _floor_pixel(lat, lng, source)


def join_aligned(grids: list[Grid], names: list[str], how: str = "inner") -> DataFrame:
    """Cells of grids with one geogrid, joined on place and date: (frac_num, time_chunk, y, x, t, names...).

    Dates are matched by timestamp where all grids have them, else by number.
    """
    first = grids[0].header
    if any(not first.same_geogrid(g.header) for g in grids[1:]):
        raise ValueError("grids of different geogrids; reproject them first")
    stamps = all(g.header.has_timestamps for g in grids)
    place = {t: i for i, t in enumerate(first.timestamps_ms or ())}
    out: DataFrame | None = None
    for grid, name in zip(grids, names):
        cells = grid.cells.select("y", "x", "t", F.col("value").alias(name))
        if stamps and grid.header.timestamps_ms != first.timestamps_ms:
            pairs = [(t, place[ms]) for t, ms in enumerate(grid.header.timestamps_ms) if ms in place]
            moved = grid.spark.createDataFrame(pairs, "t int, t_first int")  # a row for each date
            cells = cells.join(F.broadcast(moved), "t").select("y", "x", F.col("t_first").alias("t"), name)
        out = cells if out is None else out.join(cells, ["y", "x", "t"], how)
    return keyed_cells(out, first).select("frac_num", "time_chunk", "y", "x", "t", *names)


def frac_of_grids(grids: list[Grid], names: list[str], frac_num: int, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """One fraction of several grids, dense: (y, x, t, names..., mask_names...), on the first grid's pixels.

    A mask is true where the grid covers the pixel, whether or not anything is stored there.
    """
    (x0, x1), (y0, y1) = grids[0].header.frac_xyranges(frac_num)
    return _dense_on_first(grids, names, (x0, y0), (x1, y1), t_from, t_to, None)


def polygon_of_grids(grids: list[Grid], names: list[str], ring_latlng: Ring, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """The bounding box of a ring (lat, lng) in several grids, on the first grid's pixels; masks are true strictly inside the ring."""
    pixels = ring_pixels(grids[0], closed(ring_latlng))
    a, b = bbox(pixels)
    return _dense_on_first(grids, names, a, b, t_from, t_to, pixels)


def _dense_on_first(grids: list[Grid], names: list[str], a: tuple[int, int], b: tuple[int, int], t_from: int | None, t_to: int | None, ring: Ring | None) -> DataFrame:
    first = grids[0]
    within = F.lit(True) if ring is None else inside("x", "y", ring)
    out = first.dense(a, b, t_from, t_to).withColumnRenamed("value", names[0]).withColumn("mask_" + names[0], within)
    for grid, name in zip(grids[1:], names[1:]):
        if first.header.same_place(grid.header) and grid.header.ndates == first.header.ndates:
            part = grid.dense(a, b, t_from, t_to).withColumnRenamed("value", name)
            out = out.join(part, ["y", "x", "t"], "left").withColumn("mask_" + name, within)
            continue
        moved = reproject_nearest(first, grid, a, b).select("y", "x", "t", F.col("value").alias(name), F.col("covered"))
        on = ["y", "x"] if grid.header.ndates == 1 else ["y", "x", "t"]
        moved = moved.drop("t") if grid.header.ndates == 1 else moved
        out = out.join(moved, on, "left").withColumn("mask_" + name, within & F.coalesce("covered", F.lit(False))).drop("covered")
    return out


def reproject_nearest(target: Grid, source: Grid, xy_from: tuple[int, int], xy_to: tuple[int, int], source_xy_from: tuple[int, int] | None = None, source_xy_to: tuple[int, int] | None = None) -> DataFrame:
    """(y, x, t, value, covered): for each target pixel and source date the value of the source pixel under its centre.

    covered is false outside the source (or its given window); a value is null where nothing is stored. The target's window is made on
    the fly and joined on the computed source pixel: both sides shuffle on it once, or the smaller is broadcast.
    """
    h = source.header
    (sx0, sy0), (sx1, sy1) = source_xy_from or (0, 0), source_xy_to or (h.width, h.height)
    sx, sy = source_pixel(F.col("x"), F.col("y"), target.header, h)
    pixels = target.scaffold(xy_from, xy_to, 0, 1).select("y", "x", sx.alias("sx"), sy.alias("sy"))
    pixels = pixels.withColumn("covered", (F.col("sx") >= sx0) & (F.col("sx") < sx1) & (F.col("sy") >= sy0) & (F.col("sy") < sy1))
    pixels = pixels.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(h.ndates - 1))))
    stored = source.window((sx0, sy0), (sx1, sy1)).select(F.col("x").alias("sx"), F.col("y").alias("sy"), "t", "value")
    return pixels.join(stored, ["sx", "sy", "t"], "left").select("y", "x", "t", "value", "covered")


def reproject_grouped(target: Grid, source: Grid, xy_from: tuple[int, int], xy_to: tuple[int, int], how: str) -> DataFrame:
    """(y, x, t, value) by ``mode`` or ``average`` of the source pixels whose centres lie in a target pixel.

    No-data source values don't count. Equal modes go to the smallest value. Averages are partial sums before the shuffle;
    the mode counts (pixel, value) pairs first, so no task holds a pixel's values.
    """
    h = target.header
    lat, lng = geo.xy_to_latlng(F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5), source.header.geot, source.header.projection, 0.0)
    tx, ty = _floor_pixel(lat, lng, h)
    (x0, y0), (x1, y1) = xy_from, xy_to
    cells = source.cells if source.header.nodata is None else source.cells.where(F.col("value") != F.lit(source.header.nodata))
    placed = cells.where("value is not null").select(ty.alias("y"), tx.alias("x"), "t", "value")
    placed = placed.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    if how == "average":
        return placed.groupBy("y", "x", "t").agg(F.avg("value").alias("value"))
    if how != "mode":
        raise ValueError(f"unknown interpolation {how}")
    counted = placed.groupBy("y", "x", "t", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return counted.groupBy("y", "x", "t").agg(best["value"].alias("value"))


def reproject(target: Grid, source: Grid, xy_from: tuple[int, int], xy_to: tuple[int, int], interpolation: str = "near") -> DataFrame:
    """Any raster on a window of a grid: (y, x, t, value), null where masked."""
    if interpolation == "near":
        found = reproject_nearest(target, source, xy_from, xy_to).select("y", "x", "t", "value")
        return found if source.header.nodata is None else found.withColumn("value", F.nullif("value", F.lit(source.header.nodata).cast(dict(found.dtypes)["value"])))
    grouped = reproject_grouped(target, source, xy_from, xy_to, interpolation)
    everywhere = target.scaffold(xy_from, xy_to, 0, source.header.ndates)
    return everywhere.join(grouped, ["y", "x", "t"], "left")


def warped_header(source: Header, projection: str, width: int, height: int, sr_wkt: str = "") -> Header:
    """The header of a raster in another projection that spans the source's corners with so many pixels."""
    from math import cos, degrees, radians

    def to_latlng(x: float, y: float) -> tuple[float, float]:
        px, py = source.geot[0] + x * source.geot[1], source.geot[3] + y * source.geot[5]
        if source.projection == geo.GEOGRAPHIC:
            return py, px
        return degrees(py / geo.RADIUS), degrees(px / (geo.RADIUS * cos(py / geo.RADIUS)))

    def onto(lat: float, lng: float) -> tuple[float, float]:
        return (lng, lat) if projection == geo.GEOGRAPHIC else (geo.RADIUS * radians(lng) * cos(radians(lat)), geo.RADIUS * radians(lat))

    steps = [i / 20 for i in range(21)]
    border = [p for s in steps for p in ((s * source.width, 0), (s * source.width, source.height), (0, s * source.height), (source.width, s * source.height))]
    xs, ys = zip(*(onto(*to_latlng(x, y)) for x, y in border))
    geot = (min(xs), (max(xs) - min(xs)) / width, 0.0, max(ys), 0.0, (min(ys) - max(ys)) / height)
    return source.copy(grid=source.grid + "_warped", width=width, height=height, frac_width=width, frac_height=height, geot=geot, projection=projection, sr_wkt=sr_wkt)


def warp(source: Grid, projection: str, width: int, height: int) -> Grid:
    """A whole raster in another projection, nearest pixel; the header is derived from its corners and edges."""
    header = warped_header(source.header, projection, width, height)
    target = Grid.of(header, source.cells.limit(0).select("y", "x", "t", "value"))
    cells = reproject_nearest(target, source, (0, 0), (width, height)).where("value is not null").select("y", "x", "t", "value")
    return Grid.of(header, cells)
