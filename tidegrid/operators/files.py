"""Source files, dates and tiles: what there is, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import names
from tidegrid.functions.dates import day_of_year, format_date
from tidegrid.functions.layouts import MODIS, Layout, cell_tile


def _parsed(rows: DataFrame, column: str) -> DataFrame:
    """Adds what a file's name tells. A filter would be pushed below the match and repeat it many times; it isn't pushed through explode."""
    matched = rows.select("*", F.explode(F.array(names.source_parts(column))).alias("_parts"))
    return matched.select(*rows.columns, *[c.alias(k) for k, c in names.source_file("_parts").items()])


def source_files(paths: DataFrame, column: str = "path", satellite: str | None = None) -> DataFrame:
    """(path, satellite, tile, h, v, ts_ms) of all paths with a source file's name; of one satellite if given."""
    good = _parsed(paths.select(F.col(column).alias("path")), "path").where("problem is null").drop("problem")
    return good if satellite is None else good.where(F.col("satellite") == names.SATELLITES.get(satellite.lower(), satellite.lower()))


def quarantined(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, problem) of the names that are no source file's."""
    return _parsed(paths.select(F.col(column).alias("path")), "path").select("path", "problem").where("problem is not null")


def files_of_tile(files: DataFrame, tile: str) -> DataFrame:
    return files.where(F.col("tile") == tile).orderBy("ts_ms", "path")


def files_by_tile(files: DataFrame) -> DataFrame:
    """(tile, files): each tile's files by time. A tile has a file for each date and satellite."""
    return files.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "path"))).alias("files"))


def files_per_tile(files: DataFrame) -> DataFrame:
    return files.groupBy("tile").agg(F.count("*").alias("n_files"), F.countDistinct("ts_ms").alias("n_dates"))


def duplicate_dates(files: DataFrame) -> DataFrame:
    """(tile, satellite, ts_ms, n) of dates with more than one file: an alignment by date would be ambiguous."""
    return files.groupBy("tile", "satellite", "ts_ms").agg(F.count("*").alias("n")).where("n > 1")


def one_per_date(files: DataFrame) -> DataFrame:
    """The file of each (tile, ts_ms) with the last name: the latest production."""
    return files.groupBy("tile", "ts_ms").agg(F.max("path").alias("path"))


def missing_dates(files: DataFrame) -> DataFrame:
    """(ts_ms, day, doy, tile): tiles that lack a date which another has.

    Made from the two lists of distinct tiles and dates, both as short as a catalog, with the tiles in an array and
    not by a cross join; the files are one side of an anti join.
    """
    have = files.select("tile", "ts_ms").distinct()
    tiles = have.agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    per_date = have.groupBy("ts_ms").agg(F.collect_set("tile").alias("found")).withColumn("_one", F.lit(1))
    lacking = per_date.join(F.broadcast(tiles.withColumn("_one", F.lit(1))), "_one")
    gone = lacking.select("ts_ms", F.explode(F.array_except("tiles", "found")).alias("tile"))
    return gone.select("ts_ms", format_date("ts_ms").alias("day"), day_of_year("ts_ms").alias("doy"), "tile")


def collect_dates(files: DataFrame, tile: str, satellite: str | None = None) -> DataFrame:
    """(day): the dates of a tile's files as yyyy_MM_dd, in order."""
    files = files.where(F.col("tile") == tile)
    if satellite is not None:
        files = files.where(F.col("satellite") == names.SATELLITES.get(satellite.lower(), satellite.lower()))
    return files.select(format_date("ts_ms").alias("day")).distinct().orderBy("day")


def date_span(files: DataFrame) -> DataFrame:
    """(tile, first, last): the earliest and latest day of each tile's files."""
    per = files.groupBy("tile").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    return per.select("tile", format_date("first").alias("first"), format_date("last").alias("last"))


def model_file(files: DataFrame) -> DataFrame:
    """(tile, path): the earliest file of each tile, the first by name of several."""
    return files.groupBy("tile").agg(F.min(F.struct("ts_ms", "path")).alias("m")).select("tile", "m.path")


def of_both_satellites(terra: DataFrame, aqua: DataFrame) -> DataFrame:
    return terra.unionByName(aqua)


def requested(files: DataFrame, dates: DataFrame) -> DataFrame:
    """Only files of the wanted dates (ts_ms)."""
    return files.join(dates.select("ts_ms").distinct(), "ts_ms", "left_semi")


def absent_dates(dates: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted dates without a file: validation wants none."""
    return dates.select("ts_ms").distinct().join(files, "ts_ms", "left_anti")


def to_download(remote: DataFrame, local: DataFrame, tiles: list[str] | None = None) -> DataFrame:
    """Remote files (name, tile, ...) without a local one of that name, of some tiles if given."""
    remote = remote if tiles is None else remote.where(F.col("tile").isin(tiles))
    have = local.select(F.lower(names.basename("path")).alias("_have")).distinct()
    return remote.join(have, F.lower(F.col("name")) == F.col("_have"), "left_anti")


def remote_files(pages: DataFrame, html: str = "html", base: Column | None = None) -> DataFrame:
    """(name, url, satellite, tile, h, v, ts_ms) of the source files that listing pages link to."""
    found = pages.select((F.lit("") if base is None else base).alias("_base"), F.explode(names.file_links(html)).alias("name"))
    parsed = _parsed(found.select("name", F.concat("_base", "name").alias("url")), "name")
    return parsed.where("problem is null").drop("problem")


def listed_dates(pages: DataFrame, html: str = "html") -> DataFrame:
    """(day): the date folders that an index page links to, as written (yyyy.MM.dd)."""
    return pages.select(F.explode(names.date_links(html)).alias("day")).distinct()


def tile_fraction_counts(cells: DataFrame, layout: Layout = MODIS, column: str = "frac_num") -> DataFrame:
    """(tile, n_fracs): how many distinct fractions of each tile are stored."""
    h, v = cell_tile(F.col(column), layout)
    return cells.select(names.tile_name(h, v).alias("tile"), column).groupBy("tile").agg(F.countDistinct(column).alias("n_fracs"))


def align_files(files: DataFrame, dates: DataFrame) -> DataFrame:
    """(tile, t, ts_ms, path): files on the date axis by timestamp, not by position; a date with two files is an error."""
    joined = files.join(dates.select("t", "ts_ms"), "ts_ms")
    per = joined.groupBy("tile", "t", "ts_ms").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    checked = F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("two files of one date: "), F.col("path"))).cast("string"))
    return per.select("tile", "t", "ts_ms", checked.alias("path"))


def fake_missing(files: DataFrame, prefix: str = "MOD", ndvi: int = -3000, qa: int = 65535) -> DataFrame:
    """(tile, ts_ms, name, ndvi, qa): stand-ins of nothing but bad values for the dates that tiles lack."""
    gone = missing_dates(files)
    day = F.concat(F.substring("day", 1, 4), F.lpad(F.col("doy").cast("string"), 3, "0"))
    name = F.concat(F.lit(prefix.upper() + "13Q1.A"), day, F.lit("."), F.col("tile"), F.lit(".005.0000000000000.hdf"))
    return gone.select("tile", "ts_ms", name.alias("name"), F.lit(ndvi).alias("ndvi"), F.lit(qa).alias("qa"))
