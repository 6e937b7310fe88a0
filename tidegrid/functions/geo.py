"""Affine and sinusoidal projection as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius in metres of the sphere of the sinusoidal grid; what is added to a pixel before projecting it.
RADIUS = 6371007.181
NUDGE = 1e-8
GEOGRAPHIC, SINUSOIDAL = "geographic", "sinusoidal"


def _col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, (int, float)) else c


def projection_of(sr_wkt: str) -> str:
    """The projection that a spatial reference's text names; none is geographic."""
    if "sinusoidal" in sr_wkt.lower():
        return SINUSOIDAL
    if sr_wkt.lstrip().upper().startswith("PROJCS"):
        raise ValueError("only geographic and sinusoidal references are known")
    return GEOGRAPHIC


def project(lat: Column | str, lng: Column | str, projection: str) -> tuple[Column, Column]:
    """Projected (X, Y) of degrees."""
    lat, lng = _col(lat), _col(lng)
    if projection == GEOGRAPHIC:
        return lng, lat
    if projection == SINUSOIDAL:
        return F.lit(RADIUS) * F.radians(lng) * F.cos(F.radians(lat)), F.lit(RADIUS) * F.radians(lat)
    raise ValueError(f"unknown projection {projection}")


def unproject(x: Column, y: Column, projection: str) -> tuple[Column, Column]:
    """(lat, lng) in degrees of projected coordinates."""
    if projection == GEOGRAPHIC:
        return y, x
    if projection == SINUSOIDAL:
        return F.degrees(y / RADIUS), F.degrees(x / (F.lit(RADIUS) * F.cos(y / RADIUS)))
    raise ValueError(f"unknown projection {projection}")


def affine(x: Column | str, y: Column | str, geot: Sequence[float], nudge: float = NUDGE) -> tuple[Column, Column]:
    """Projected coordinates of a pixel's top left corner."""
    return F.lit(geot[0]) + (_col(x) + F.lit(nudge)) * F.lit(geot[1]), F.lit(geot[3]) + (_col(y) + F.lit(nudge)) * F.lit(geot[5])


def xy_to_latlng(x: Column | str, y: Column | str, geot: Sequence[float], projection: str, nudge: float = NUDGE) -> tuple[Column, Column]:
    return unproject(*affine(x, y, geot, nudge), projection)


def pixel_position(lat: Column | str, lng: Column | str, geot: Sequence[float], projection: str) -> tuple[Column, Column]:
    """Fractional (x, y) in pixels."""
    px, py = project(lat, lng, projection)
    return (px - F.lit(geot[0])) / F.lit(geot[1]), (py - F.lit(geot[3])) / F.lit(geot[5])


def latlng_to_xy(lat: Column | str, lng: Column | str, geot: Sequence[float], projection: str) -> tuple[Column, Column]:
    """The pixel that holds a point; positions are cut toward zero, so points less than a pixel outside the west or north edge fall on pixel 0."""
    x, y = pixel_position(lat, lng, geot, projection)
    return x.cast("int"), y.cast("int")


def ring_to_xy(ring: Column | str, geot: Sequence[float], projection: str) -> Column:
    """A ring of (lat, lng) as a ring of pixels (x, y)."""

    def point(p: Column) -> Column:
        x, y = latlng_to_xy(p["lat"], p["lng"], geot, projection)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(_col(ring), point)


def rebased(geot: Sequence[float], x: Column | str, y: Column | str) -> Column:
    """The geotransform of a sub-grid that starts at pixel (x, y)."""
    g = [F.lit(float(v)) for v in geot]
    return F.array(g[0] + _col(x) * g[1], g[1], g[2], g[3] + _col(y) * g[5], g[4], g[5])


def corners(x0: Column, y0: Column, x1: Column, y1: Column, geot: Sequence[float], projection: str, nudge: float = NUDGE) -> Column:
    """Four corners (lat, lng) of a pixel rectangle, not closed: top left, top right, bottom right, bottom left."""

    def corner(x: Column, y: Column) -> Column:
        lat, lng = xy_to_latlng(x, y, geot, projection, nudge)
        return F.struct(lat.alias("lat"), lng.alias("lng"))

    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def bbox_bottom_first(ring: Column | str) -> Column:
    """The same four corners in the order bottom left, bottom right, top right, top left."""
    ring = _col(ring)
    return F.array(*[F.element_at(ring, i) for i in (4, 3, 2, 1)])


def latlon_to_rowcol(lat: Column | str, lon: Column | str, geot: Sequence[float]) -> tuple[Column, Column]:
    """(row, column) of a point in an unprojected raster, cut toward zero."""
    return ((_col(lat) - F.lit(geot[3])) / F.lit(geot[5])).cast("int"), ((_col(lon) - F.lit(geot[0])) / F.lit(geot[1])).cast("int")
