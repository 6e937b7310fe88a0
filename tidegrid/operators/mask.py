"""Polygons: bounding boxes, pixel masks, masked reads, rasterisation onto a model raster."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import geo
from tidegrid.operators.grid import Grid

Ring = Sequence[tuple[float, float]]


def closed(ring: Ring) -> list[tuple[float, float]]:
    """The ring with its first point at the end."""
    ring = [tuple(p) for p in ring]
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def bbox(ring: Ring) -> tuple[tuple[int, int], tuple[int, int]]:
    """Least and greatest pixel of a ring; as a window the greatest is left out."""
    xs, ys = zip(*ring)
    return (min(xs), min(ys)), (max(xs), max(ys))


def column_bbox(ring: Column | str) -> dict[str, Column]:
    """The same for a column of rings of pixels (x, y)."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def _segments(ring: Ring) -> list[tuple[float, float, float, float]]:
    ring = closed(ring)
    return [(*a, *b) for a, b in zip(ring, ring[1:]) if a != b]


def _bands(segments: list[tuple[float, float, float, float]], low: float, high: float) -> tuple[list[list], float]:
    """Segments by horizontal bands of equal height that they reach into, and that height: as many bands as keep the whole within twice the ring."""
    n = max(1, min(1024, len(segments) // 4))
    while True:
        height = (high - low) / n or 1.0
        bands: list[list] = [[] for _ in range(n)]
        for s in segments:
            first, last = (min(n - 1, int((y - low) / height)) for y in (min(s[1], s[3]), max(s[1], s[3])))
            for k in range(first, last + 1):
                bands[k].append(s)
        if n == 1 or sum(map(len, bands)) <= 2 * len(segments) + n:
            return bands, height
        n //= 2


def _held(x: Column, y: Column, segments: Column) -> Column:
    """Whether a point is strictly inside what an array of segments [ax, ay, bx, by] encloses."""

    def step(found: Column, s: Column) -> Column:
        ax, ay, bx, by = (F.get(s, F.lit(k)) for k in range(4))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on = (cross == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        crossed = (y >= F.least(ay, by)) & (y < F.greatest(ay, by)) & F.when(by > ay, cross > 0).otherwise(cross < 0)
        return F.struct((found["odd"] != crossed).alias("odd"), (found["on"] | on).alias("on"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
    return F.aggregate(segments, start, step, lambda found: found["odd"] & ~found["on"])


def inside(x: Column | str, y: Column | str, ring: Ring) -> Column:
    """Whether a point is strictly inside a ring: even-odd crossings, and on no edge.

    For a grid's integer pixels on an axis-aligned closed rectangle this leaves out the first and last row and
    column, as erasing a filled polygon's outline does. The ring is one literal, whatever its length, and a point is
    compared with the segments of its own band only.
    """
    x, y = ((F.col(c) if isinstance(c, str) else c).cast("double") for c in (x, y))
    segments = [tuple(map(float, s)) for s in _segments(ring)]
    if not segments:
        return F.lit(False)
    xs, ys = [v for s in segments for v in (s[0], s[2])], [v for s in segments for v in (s[1], s[3])]
    low, high = min(ys), max(ys)
    bands, height = _bands(segments, low, high)
    table = F.from_json(F.lit(json.dumps(bands)), "array<array<array<double>>>")  # folded to a literal
    mine = F.get(table, F.least(F.lit(len(bands) - 1), F.floor((y - F.lit(low)) / F.lit(height)).cast("int")))
    known = _held(x, y, mine)
    return F.when(x.between(min(xs), max(xs)) & y.between(low, high), known).otherwise((x.isNull() | y.isNull()) & F.lit(None).cast("boolean"))


def outline(ring: Ring) -> list[tuple[int, int]]:
    """Pixels of a ring's drawn outline: at each step along an edge's longer axis the nearest pixel."""
    out: set[tuple[int, int]] = set()
    for ax, ay, bx, by in _segments(ring):
        n = int(max(abs(bx - ax), abs(by - ay)))
        for k in range(n + 1):
            out.add((int((2 * (ax * (n - k) + bx * k) + n) // (2 * n)), int((2 * (ay * (n - k) + by * k) + n) // (2 * n))))
    return sorted(out)


def polygon_mask(grid: Grid, ring: Ring, shape: tuple[int, int] | None = None, erase_outline: bool = False) -> DataFrame:
    """(y, x, inside) over a raster of ``shape`` (height, width), the grid's own by default.

    With ``erase_outline`` slanted edges also lose every pixel of their drawn outline, not only lattice points that they pass.
    """
    height, width = shape or (grid.header.height, grid.header.width)
    pixels = grid.scaffold((0, 0), (width, height), 0, 1).select("y", "x")
    masked = pixels.withColumn("inside", inside("x", "y", ring))
    if not erase_outline:
        return masked
    drawn = grid.spark.createDataFrame(outline(ring), "x int, y int").withColumn("drawn", F.lit(True))  # as long as the ring
    return masked.join(F.broadcast(drawn), ["x", "y"], "left").withColumn("inside", F.col("inside") & F.col("drawn").isNull()).drop("drawn")


def read_polygon(grid: Grid, ring_xy: Ring, t_from: int | None = None, t_to: int | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """(dense cells of the bounding box with ``inside``, first pixel) for a ring of pixels."""
    a, b = bbox(ring_xy)
    return grid.dense(a, b, t_from, t_to).withColumn("inside", inside("x", "y", ring_xy)), a


def ring_pixels(grid: Grid, ring_latlng: Ring) -> list[tuple[int, int]]:
    """A ring of (lat, lng) as pixels of a grid, by one small query."""
    h = grid.header
    points = grid.spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ring_latlng)], "i int, lat double, lng double")
    x, y = geo.latlng_to_xy("lat", "lng", h.geot, h.projection)
    return [(r["x"], r["y"]) for r in points.select("i", x.alias("x"), y.alias("y")).orderBy("i").collect()]


def read_polygon_latlng(grid: Grid, ring_latlng: Ring, t_from: int | None = None, t_to: int | None = None) -> tuple[DataFrame, tuple[int, int]]:
    return read_polygon(grid, ring_pixels(grid, closed(ring_latlng)), t_from, t_to)


def polygon_cells(grid: Grid, ring_xy: Ring, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """The stored cells strictly inside a ring of pixels: chunks pruned by the bounding box, then the exact test."""
    a, b = bbox(ring_xy)
    return grid.window(a, b, t_from, t_to).where(inside("x", "y", ring_xy))


def fracs_for_polygon(grid: Grid, ring_xy: Ring) -> list[int]:
    """Fractions that a ring's bounding box touches; its points must be in the grid."""
    if not all(grid.header.in_bounds(x, y) for x, y in ring_xy):
        raise ValueError("a polygon outside the grid")
    (x0, y0), (x1, y1) = bbox(ring_xy)
    return grid.header.fracs_for_rect(x0, y0, x1, y1)


def rasterize_like(model: Grid, rings: list[Ring], projection: str | None = None, burn: int | list[int] = 1, nodata: int = 0, all_touched: bool = False) -> DataFrame:
    """(y, x, value): what a ring burns where a pixel's centre lies in one of the rings (lat, lng), else ``nodata``.

    ``burn`` is one value or one for each ring, such as an attribute's; a later ring covers an earlier one. With
    ``all_touched`` a pixel counts as soon as one of its corners or its centre does.
    """
    h, projection = model.header, projection or model.header.projection
    burns = burn if isinstance(burn, list) else [burn] * len(rings)
    if len(burns) != len(rings):
        raise ValueError("a value for each ring is needed")
    kind = "double" if any(isinstance(b, float) for b in [*burns, nodata]) else "int" if all(abs(b) < 1 << 31 for b in [*burns, nodata]) else "bigint"
    pixels = model.scaffold((0, 0), (h.width, h.height), 0, 1).select("y", "x")
    rows = [(n, mine, [[float(v) for v in (s[1], s[0], s[3], s[2])] for s in _segments(ring)]) for n, (ring, mine) in enumerate(zip(rings, burns))]
    shapes = model.spark.createDataFrame([r for r in rows if r[2]], f"n int, burn {kind}, segments array<array<double>>")
    offsets = [(0.5, 0.5), *([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)] if all_touched else [])]

    def ends(c: Column, k: int) -> tuple[Column, Column]:
        both = F.transform(c, lambda s: F.least(s[k], s[k + 2])), F.transform(c, lambda s: F.greatest(s[k], s[k + 2]))
        return F.array_min(both[0]), F.array_max(both[1])

    def reach(low: Column, high: Column, size: int) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor(low).cast("int") - 1), F.least(F.lit(size - 1), F.floor(high).cast("int") + 1))

    def latitude(dy: float) -> Column:
        return geo.xy_to_latlng(F.lit(0), F.col("y") + F.lit(dy), h.geot, projection, 0.0)[0]

    # Each ring is cut into rows of pixels, dealt evenly, that keep the segments which they meet, so a pixel is compared with few of them.
    south, north = ends(F.col("segments"), 1)
    across = [geo.pixel_position(lat, F.lit(0.0), h.geot, projection)[1] for lat in (south, north)]
    low, high = F.least(*across), F.greatest(*across)
    strips = shapes.where((low < h.height + 1) & (high > -1)).withColumn("y", F.explode(reach(low, high, h.height))).repartition("n", "y")
    strips = strips.withColumns({"top": F.greatest(latitude(0.0), latitude(1.0)), "bottom": F.least(latitude(0.0), latitude(1.0))})
    meets = F.filter("segments", lambda s: (F.least(s[1], s[3]) <= F.col("top")) & (F.greatest(s[1], s[3]) >= F.col("bottom")))
    strips = strips.select("n", "burn", "y", meets.alias("segments")).where(F.size("segments") > 0)
    west, east = ends(F.col("segments"), 0)
    along = [geo.pixel_position(latitude(dy), lng, h.geot, projection)[0] for dy in sorted({dy for _, dy in offsets}) for lng in (west, east)]
    strips = strips.withColumns({"low": F.least(*along), "high": F.greatest(*along)}).where((F.col("low") < h.width + 1) & (F.col("high") > -1))
    places = strips.withColumn("x", F.explode(reach(F.col("low"), F.col("high"), h.width)))
    hit = F.lit(False)
    for dx, dy in offsets:
        lat, lng = geo.xy_to_latlng(F.col("x") + F.lit(dx), F.col("y") + F.lit(dy), h.geot, projection, 0.0)
        hit = hit | _held(lng, lat, F.col("segments"))
    burnt = places.where(hit).groupBy("y", "x").agg(F.max(F.struct("n", "burn"))["burn"].alias("value"))
    return pixels.join(burnt, ["y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(nodata).cast(kind)))
