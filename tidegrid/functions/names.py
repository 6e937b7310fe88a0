"""Source file names, tile names and listing pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.dates import julian_to_ms

#: The patterns of source file names (in lower case), tile names, and links of listing pages.
SOURCE_FILE = r"^(m[oy]d13q1)\.a(\d{7})\.h(\d{2})v(\d{2})\.(\d{3})\.(\d{13})\.hdf$"
TILE = r"^h(\d{2})v(\d{2})$"
FILE_LINK = r'<a\s+href="([\w.]+)">'
DATE_LINK = r'<a\s[^>]*href="(\d{4}\.\d{2}\.\d{2}[^"]*)"'
COLLECTION = "005"
SATELLITES = {"aqua": "myd13q1", "terra": "mod13q1"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def source_parts(path: Column | str) -> Column:
    """satellite, date, h, v and collection of a source file's name, without regard to case, by one match; null for any other name."""
    parts = F.split(F.regexp_replace(F.lower(basename(path)), SOURCE_FILE, "$1|$2|$3|$4|$5"), r"\|")
    return F.when(F.size(parts) == 5, parts)


def source_file(parts: Column | str) -> dict[str, Column]:
    """satellite, tile, h, v, ts_ms and problem of a source file from its source_parts.

    A name that doesn't match, a date that doesn't exist or another collection than 005 is told by ``problem``,
    and all else is null, so one bad name doesn't stop a listing. Give a column, so that names are matched once.
    """
    parts = _col(parts)
    part = [F.get(parts, F.lit(k)) for k in range(5)]
    ts = julian_to_ms(part[1])
    problem = F.when(parts.isNull(), F.lit("name")).when(part[4] != COLLECTION, F.lit("collection")).when(ts.isNull(), F.lit("date"))
    good = part[4] == COLLECTION
    dated = good & ts.isNotNull()
    return {
        "satellite": F.when(dated, part[0]),
        "tile": F.when(dated, F.concat(F.lit("h"), part[2], F.lit("v"), part[3])),
        "h": F.when(dated, part[2].try_cast("int")),
        "v": F.when(dated, part[3].try_cast("int")),
        "ts_ms": F.when(good, ts),
        "problem": problem,
    }


def tile_name(h: Column | str, v: Column | str) -> Column:
    two = lambda c: F.lpad(_col(c).cast("string"), 2, "0")
    return F.concat(F.lit("h"), two(h), F.lit("v"), two(v))


def parse_tile(tile: Column | str) -> tuple[Column, Column]:
    """(h, v) of a tile name; null for any other text."""
    return tuple(F.regexp_extract(_col(tile), TILE, k).try_cast("int") for k in (1, 2))


def satellite_prefix(name: Column | str) -> Column:
    """aqua and terra as the prefixes of their files; other values as they are."""
    name = _col(name)
    out = F.lower(name)
    for alias, prefix in SATELLITES.items():
        out = F.when(F.lower(name) == alias, F.lit(prefix)).otherwise(out)
    return out


def file_links(html: Column | str) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(FILE_LINK), F.lit(1))


def date_links(html: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(html), F.lit(DATE_LINK), F.lit(1)), lambda s: F.rtrim(s, F.lit("/")))
