"""Source tiles as observations (tile, ts_ms, i, j, ndvi, qa): what is read from a tile's file of a date, whatever its codec.

Files of a codec that isn't installed here come as Parquet with that schema, partitioned by tile. All else is DataFrame work:
windows are pushed to the scan, pixels are placed on the world layout, and two grids are made of one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.layouts import MODIS, Layout, cell_in_tile, tile_xy
from tidegrid.functions.names import parse_tile
from tidegrid.operators.align import reproject_nearest
from tidegrid.operators.grid import Grid
from tidegrid.operators.lifecycle import create
from tidegrid.plans.header import Header
from tidegrid.sources import store

SCHEMA = "tile string, ts_ms bigint, i int, j int, ndvi int, qa int"
#: What marks a bad pixel in either band.
BAD_NDVI, BAD_QA = -3000, 65535


def write_tiles(observations: DataFrame, path: str) -> None:
    """Sorted by date and pixel within a tile, so that windows and dates prune row groups."""
    rows = observations.selectExpr("tile", "ts_ms", "i", "j", "ndvi", "qa").repartition("tile", F.col("ts_ms"))
    rows.sortWithinPartitions("tile", "ts_ms", "i", "j").write.mode("append").partitionBy("tile").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select("tile", "ts_ms", "i", "j", "ndvi", "qa")


def band(observations: DataFrame, name: str) -> DataFrame:
    """(tile, ts_ms, i, j, value) of the band whose description holds ``name``; an unknown one is an error."""
    bands = {"250m 16 days NDVI": "ndvi", "250m 16 days VI Quality": "qa"}
    found = [column for description, column in bands.items() if name in description]
    if not found:
        raise ValueError(f"no band named {name}")
    return observations.select("tile", "ts_ms", "i", "j", F.col(found[0]).alias("value"))


def window(observations: DataFrame, tile: str, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Both bands of a half-open window of one tile."""
    inside = (F.col("tile") == tile) & (F.col("i") >= rows[0]) & (F.col("i") < rows[1]) & (F.col("j") >= columns[0]) & (F.col("j") < columns[1])
    return observations.where(inside)


def cell_window(spark: SparkSession, observations: DataFrame, tile: str, cell: int, layout: Layout = MODIS) -> DataFrame:
    """Both bands of the part of a tile that one cell covers."""
    h, v = parse_tile(F.lit(tile))
    r = spark.range(1).select(*[c.alias(k) for k, c in cell_in_tile(F.lit(cell), h, v, layout).items()]).first()
    return window(observations, tile, (r["i0"], r["i1"]), (r["j0"], r["j1"]))


def placed(observations: DataFrame, layout: Layout = MODIS) -> DataFrame:
    """Adds x and y on the world layout."""
    h, v = parse_tile("tile")
    x0, y0 = tile_xy(h, v, layout)
    return observations.withColumns({"x": x0 + F.col("j"), "y": y0 + F.col("i")})


def ndvi_qa_grids(observations: DataFrame, ndvi: Header, qa: Header, layout: Layout = MODIS) -> tuple[Grid, Grid]:
    """Two grids of one source, of the headers' dates only."""
    if not ndvi.same_geogrid(qa) or ndvi.timestamps_ms != qa.timestamps_ms:
        raise ValueError("both grids need one geogrid and the same dates")
    rows = placed(observations, layout)
    return tuple(create(header, rows.select("y", "x", "ts_ms", F.col(column).cast(header.value_type).alias("value"))) for header, column in ((ndvi, "ndvi"), (qa, "qa")))


def without_blank(observations: DataFrame) -> DataFrame:
    """NDVI as null where it is 0: what a reprojected tile has outside its source."""
    return observations.withColumn("ndvi", F.nullif("ndvi", F.lit(0)))


def reproject_ndvi_qa(observations: DataFrame, tile: str, ts_ms: int, target: Header, xy_from: tuple[int, int], xy_to: tuple[int, int], layout: Layout = MODIS) -> DataFrame:
    """(y, x, ndvi, qa, valid) of one tile and date on a window of a grid, nearest pixel, both bands by one join.

    Outside the tile, and where nothing is stored, both are 0. An NDVI of 0 can't be told from that, so valid means that it
    isn't 0; a QA word of 0 is a good pixel, so the same mask serves both.
    """
    h, v = int(tile[1:3]), int(tile[4:6])
    geot = (layout.geot[0] + h * layout.tile_width * layout.pixel_x, layout.pixel_x, 0.0, layout.geot[3] + v * layout.tile_height * layout.pixel_y, 0.0, layout.pixel_y)
    header = Header(tile, "", layout.tile_width, layout.tile_height, layout.cell_width, layout.cell_height, geot=geot, projection=layout.projection)
    rows = observations.where((F.col("tile") == tile) & (F.col("ts_ms") == ts_ms))
    source = Grid.of(header, rows.select(F.col("i").alias("y"), F.col("j").alias("x"), F.lit(0).alias("t"), F.struct("ndvi", "qa").alias("value")))
    found = reproject_nearest(Grid.of(target, source.cells.limit(0).select("y", "x", "t", "value")), source, xy_from, xy_to)
    ndvi, qa = (F.coalesce(F.col("value")[c], F.lit(0)).alias(c) for c in ("ndvi", "qa"))
    return found.select("y", "x", ndvi, qa).withColumn("valid", F.col("ndvi") != 0)


def import_tiles(spark: SparkSession, path: str, wanted: list[str], ndvi: Header, qa: Header, layout: Layout = MODIS) -> tuple[Grid, Grid]:
    """Both grids of a list of tiles, created and stored at their headers' roots by one job a grid, however many tiles there are.

    A tile without any observation is an error before anything is written, as a misspelt name would else leave a hole in the grid.
    """
    observations = read_tiles(spark, path).where(F.col("tile").isin(wanted))
    stamps = list(ndvi.timestamps_ms or ())
    have = {r["tile"] for r in observations.where(F.col("ts_ms").isin(stamps)).select("tile").distinct().collect()}  # at most those wanted
    if set(wanted) - have:
        raise ValueError(f"no observations of {', '.join(sorted(set(wanted) - have))}")
    for grid in ndvi_qa_grids(observations, ndvi, qa, layout):
        store.save(grid)
    return store.load(spark, ndvi.root), store.load(spark, qa.root)


def stand_ins(missing: DataFrame, pixels: DataFrame) -> DataFrame:
    """Observations of nothing but bad values for missing (tile, ts_ms), on the pixels (tile, i, j) that a tile has."""
    return missing.select("tile", "ts_ms").join(pixels.select("tile", "i", "j"), "tile").select("tile", "ts_ms", "i", "j", F.lit(BAD_NDVI).alias("ndvi"), F.lit(BAD_QA).alias("qa"))
