"""Chunk addressing as column expressions: pixels, fractions, time chunks, chunk file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a chunk file's name, after any prefix.
CHUNK_FILE = r"(\d+)\.(\d+)\.jdata$"


def _int(c: Column) -> Column:
    return c.cast("int")


def _col(c: Column | str | int) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c


def int_div(a: Column | str | int, b: Column | str | int) -> Column:
    """Truncating integer division; operands are not negative here, so it is the floor."""
    return F.call_function("div", _col(a), _col(b))


def frac_num(fy: Column | str, fx: Column | str, num_x_fracs: Column | int) -> Column:
    return _int(_col(fy) * _col(num_x_fracs) + _col(fx))


def frac_for_xy(x: Column | str, y: Column | str, frac_width: Column | int, frac_height: Column | int, num_x_fracs: Column | int) -> Column:
    """The fraction that holds a pixel."""
    return _int(int_div(y, frac_height) * _col(num_x_fracs) + int_div(x, frac_width))


def time_chunk(t: Column | str, frac_ndates: Column | int) -> Column:
    return _int(int_div(t, frac_ndates))


def frac_x(frac: Column | str, num_x_fracs: Column | int) -> Column:
    return _int(_col(frac) % _col(num_x_fracs))


def frac_y(frac: Column | str, num_x_fracs: Column | int) -> Column:
    return _int(int_div(frac, num_x_fracs))


def frac_ranges(frac: Column | str, frac_width: int, frac_height: int, num_x_fracs: int) -> dict[str, Column]:
    """Half-open pixel ranges of a fraction: x_start, x_end, y_start, y_end."""
    fx, fy = frac_x(frac, num_x_fracs), frac_y(frac, num_x_fracs)
    return {"x_start": fx * frac_width, "x_end": (fx + 1) * frac_width, "y_start": fy * frac_height, "y_end": (fy + 1) * frac_height}


def time_range(chunk: Column | str, frac_ndates: Column | int, ndates: Column | int) -> tuple[Column, Column]:
    """Half-open date range of a time chunk; the last one is cut at the number of dates."""
    start = _int(_col(chunk) * _col(frac_ndates))
    return start, _int(F.least(start + _col(frac_ndates), _col(ndates)))


def chunk_filename(frac: Column | str, chunk: Column | str) -> Column:
    return F.concat(_col(frac).cast("string"), F.lit("."), _col(chunk).cast("string"), F.lit(".jdata"))


def parse_chunk_filename(name: Column | str) -> tuple[Column, Column]:
    """(frac_num, time_chunk) of a chunk file's name with any prefix; null where it is no such name."""
    part = lambda k: F.nullif(F.regexp_extract(_col(name), CHUNK_FILE, k), F.lit("")).cast("int")
    return part(1), part(2)


def in_bounds(x: Column | str, y: Column | str, width: Column | int, height: Column | int) -> Column:
    return (_col(x) >= 0) & (_col(x) < _col(width)) & (_col(y) >= 0) & (_col(y) < _col(height))
