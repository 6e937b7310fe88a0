"""Queries that write to files in the shared folder and read them back, and those of small functions, with their SQL."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import geo, names
from tidegrid.operators import align, files, lifecycle, mask
from tidegrid.operators.grid import Grid
from tidegrid.plans import cubes
from tidegrid.plans.cubes import CLASS_SQL, DAY_MS, EVENTS_SQL, FILES_SQL, FIRST_DAY_MS, HEADER, OBSERVATIONS_SQL, POINTS_SQL
from tidegrid.plans.queries import PIXELS_SQL, TILES_SQL, WINDOW, _REGION_SQL, _files, _pixels, _short, query
from tidegrid.plans.session import new_path
from tidegrid.sources import geotiff, jdata, regions, store, text, tiles
from tidegrid.streaming.ingest import ingest

CELLS_SQL = f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells"


def _saved(spark: SparkSession, grid: Grid) -> str:
    root = new_path(spark, "grid")
    store.save(Grid(grid.header.copy(root=root), grid.cells))
    return root


@query(f"""WITH {EVENTS_SQL} SELECT frac_num, time_chunk, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum_value, min(value) AS min_value
FROM cells WHERE x >= 4 AND x < 11 AND y >= 2 AND y < 8 AND t >= 3 AND t < 21 GROUP BY 1, 2""")
def stored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = store.load(spark, _saved(spark, cubes.events(spark, sf_dir)))
    return grid.chunk_stats(grid.window(*WINDOW))


@query(CELLS_SQL)
def stored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load(spark, _saved(spark, cubes.events(spark, sf_dir))).cells


@query(CELLS_SQL)
def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, source = _short(spark, sf_dir, 10)
    root = _saved(spark, short)
    for n in (17, 17, 30):
        grid = store.append(root, list(HEADER.timestamps_ms[:n]), source)
    return grid.cells


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, CASE WHEN frac_num = 1 AND time_chunk = 2 THEN value + 1 ELSE value END AS value, frac_num, time_chunk FROM cells")
def stored_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _saved(spark, cubes.events(spark, sf_dir))
    grid = store.load(spark, root)
    changed = lifecycle.reload_chunk(grid, 1, 2, grid.cells.select("y", "x", "t", (F.col("value") + 1).alias("value")))
    store.rewrite(changed, grid.cells.where("frac_num = 1 and time_chunk = 2"))
    return store.load(spark, root).cells


@query("SELECT 15 AS width, 100 AS height, 5 AS frac_width, 5 AS frac_height, 7 AS frac_ndates, 30 AS ndates, '<i8' AS dtype, true AS replaced")
def stored_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "header")
    for n in (10, 30):
        store.save_header(spark, lifecycle.truncate_dates(Grid(HEADER.copy(root=root), spark.range(0).selectExpr("cast(id as int) as t")), n).header)
    h = store.load_header(spark, root)
    row = (h.width, h.height, h.frac_width, h.frac_height, h.frac_ndates, h.ndates, h.dtype, store.listed(spark, root) == [store.HEADER_FILE])
    return spark.createDataFrame([row], "width int, height int, frac_width int, frac_height int, frac_ndates int, ndates int, dtype string, replaced boolean")


@query(CELLS_SQL)
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "chunks")
    jdata.write_chunks(lifecycle.chunk_arrays(cubes.events(spark, sf_dir)), root, HEADER.dtype, HEADER.frac_ndates)
    return lifecycle.cells_of_chunks(jdata.read_chunks(spark, root, HEADER.dtype), HEADER)


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells WHERE frac_num IN (1, 4) AND time_chunk >= 2")
def chunk_files_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "chunks")
    jdata.write_chunks(lifecycle.chunk_arrays(cubes.events(spark, sf_dir)), root, HEADER.dtype, HEADER.frac_ndates)
    few = jdata.read_chunks(spark, root, HEADER.dtype).where("frac_num in (1, 4) and time_chunk >= 2")
    return lifecycle.cells_of_chunks(few, HEADER)


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells")
def stream_into_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox = new_path(spark, "inbox")
    when = F.lit(FIRST_DAY_MS) + F.col("t").cast("bigint") * DAY_MS
    cubes.events(spark, sf_dir).cells.select("x", "y", when.alias("ts_ms"), "value").write.parquet(inbox)
    header = cubes.covering(HEADER.copy(root=new_path(spark, "streamed")), spark.read.parquet(inbox))
    store.save_header(spark, header)
    stream = spark.readStream.schema("x int, y int, ts_ms bigint, value bigint").parquet(inbox)
    ingest(stream, header, new_path(spark, "progress")).awaitTermination()
    return store.load(spark, header.root).cells


@query(f"WITH {OBSERVATIONS_SQL} SELECT tile, ts_ms, i, j, ndvi, qa FROM obs WHERE tile = 'h06v08' AND i >= 400 AND i < 800 AND j >= 0 AND j < 400")
def stored_tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tiles")
    tiles.write_tiles(cubes.observations(spark, sf_dir), path)
    return tiles.window(tiles.read_tiles(spark, path), "h06v08", (400, 800), (0, 400))


@query(f"WITH {OBSERVATIONS_SQL} SELECT tile, ts_ms, i, j, qa AS value FROM obs")
def tile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.band(cubes.observations(spark, sf_dir), "VI Quality")


def _raster(spark: SparkSession, sf_dir: str) -> str:
    """The land-cover cube as a TIFF file, 255 where there is no class: 15 by 100 pixels, whatever the scale."""
    data = np.full((100, 15), 255, np.int16)
    for r in cubes.landcover(spark, sf_dir).collect():
        data[r["y"], r["x"]] = r["class"]
    path = new_path(spark, "raster") + ".tif"
    text.write_bytes(path, geotiff.write(geotiff.from_window(data, cubes.LANDCOVER, (0, 0), 255)))
    return path


GRID_CLASS_SQL = f"{CLASS_SQL}, px AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(0, 100) a(y), range(0, 15) b(x)), full_ AS (SELECT px.y, px.x, coalesce(class, 255) AS value FROM px LEFT JOIN classes USING (y, x))"


@query(f"WITH {GRID_CLASS_SQL} SELECT y, x, 0 AS t, value FROM full_")
def geotiff_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = cubes.LANDCOVER.copy(frac_width=15, frac_height=100)
    return geotiff.import_tile(spark, _raster(spark, sf_dir), whole, 0)


@query(f"WITH {GRID_CLASS_SQL} SELECT CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, 0 AS t, round(avg(value), 6) AS value FROM full_ GROUP BY 1, 2")
def geotiff_reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TIFF file reprojected onto another grid's pixels."""
    whole = cubes.LANDCOVER.copy(frac_width=15, frac_height=100)
    source = Grid.of(whole, geotiff.import_tile(spark, _raster(spark, sf_dir), whole, 0))
    model = Grid.of(cubes.LANDCOVER.copy(grid="coarse", width=8, height=50, frac_width=8, frac_height=50, geot=(-75.0, 1.0, 0.0, 10.0, 0.0, -1.0)), source.cells.limit(0).select("y", "x", "t", "value"))
    found = align.reproject_grouped(model, source, (0, 0), (8, 50), "average")
    return found.withColumn("value", F.round("value", 6))


@query(_REGION_SQL)
def geojson_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continents as a GeoJSON file and back."""
    path = new_path(spark, "regions") + "/continents.geojson"
    features = [json.loads(r["value"]) for r in regions.to_geojson(regions.continents(spark), ["name"]).collect()]
    store.write_text(spark, path, json.dumps({"type": "FeatureCollection", "features": features}))
    rings = regions.read_geojson(spark, path, "continents").select("name", F.posexplode("ring").alias("i", "p"))
    return rings.select("name", "i", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN x < 6 AND y < 10 THEN 3 WHEN x >= 8 AND x < 12 AND y >= 20 AND y < 40 THEN 5 ELSE 0 END AS value FROM range(0, 100) a(y), range(0, 15) b(x)")
def rasterize_shapefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of a shapefile burnt by an attribute of each."""
    path = new_path(spark, "shapes") + "/a.shp"
    rings = [[(10.0, -75.0), (10.0, -72.0), (5.0, -72.0), (5.0, -75.0)], [(0.0, -71.0), (0.0, -69.0), (-10.0, -69.0), (-10.0, -71.0)]]
    regions.save_shapefile(path, rings, [("kind", "int")], [{"kind": 3}, {"kind": 5}])
    return regions.rasterize_shapefile(cubes.events(spark, sf_dir), path, "kind")


@query("""WITH k AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 0, 0)) v(i, dy, dx))
SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key, CAST(i AS INT) AS i, round(n_nationkey * 3.0::DOUBLE - 40 + dy, 6) AS lat, round(n_nationkey * 7.0::DOUBLE - 80 + dx, 6) AS lng FROM nation, k""")
def shapefile_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box and the attributes of each nation through a shapefile of another projection, read back in degrees."""
    nations = cubes.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()

    def corner(n: int, dy: int, dx: int) -> tuple[float, float]:
        lat, lng = np.radians(n * 3.0 - 40 + dy), np.radians(n * 7.0 - 80 + dx)
        return float(geo.RADIUS * lat), float(geo.RADIUS * lng * np.cos(lat))

    rings = [[corner(r["n_nationkey"], dy, dx) for dy, dx in ((0, 0), (0, 1), (1, 1), (1, 0))] for r in nations]
    path = new_path(spark, "shapes") + "/nations.shp"
    regions.save_shapefile(path, rings, [("name", "str"), ("key", "int")], [{"name": r["n_name"], "key": r["n_nationkey"]} for r in nations], 'PROJCS["Sinusoidal"]')
    points = regions.read_shapes(spark, path).select("attributes", F.posexplode("ring").alias("i", "p"))
    return points.select(F.col("attributes")["name"].alias("name"), F.col("attributes")["key"].cast("bigint").alias("key"), "i", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query(f"""WITH {GRID_CLASS_SQL}, t AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(0, 210) a(y), range(0, 40) b(x))
SELECT t.y, t.x, CASE WHEN value IS NULL OR value = 255 THEN 0 ELSE value END AS value, value IS NOT NULL AND value <> 255 AS valid
FROM t LEFT JOIN full_ f ON f.y = t.y // 2 AND f.x = t.x // 2""")
def geotiff_onto_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TIFF file on a finer grid that reaches beyond it, by one call."""
    found = geotiff.reproject_custom(spark, _raster(spark, sf_dir), 40, 210, (-75.0, 0.25, 0.0, 10.0, 0.0, -0.25))
    return found.withColumn("value", F.col("value").cast("int"))


@query(f"""WITH {OBSERVATIONS_SQL}, t AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(38400, 38600) a(y), range(28800, 29100) b(x))
SELECT t.y, t.x, coalesce(ndvi, 0) AS ndvi, coalesce(qa, 0) AS qa, coalesce(ndvi, 0) <> 0 AS valid
FROM t LEFT JOIN (SELECT * FROM obs WHERE tile = 'h06v08' AND ts_ms = {cubes.MONTHS[4]}) o ON o.i = t.y - 38400 AND o.j = t.x - 28800""")
def tile_reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.reproject_ndvi_qa(cubes.observations(spark, sf_dir), "h06v08", cubes.MONTHS[4], cubes.NDVI, (28800, 38400), (29100, 38600))


@query(f"""WITH {OBSERVATIONS_SQL}, d AS (SELECT * FROM (VALUES {", ".join(f"({t}, {ms})" for t, ms in enumerate(cubes.MONTHS))}) v(t, ts_ms)),
o AS (SELECT CAST(8 * 4800 + i AS INT) AS y, CAST(CAST(substr(tile, 2, 2) AS INT) * 4800 + j AS INT) AS x, CAST(t AS INT) AS t, ndvi, qa FROM obs JOIN d USING (ts_ms) WHERE tile IN ('h05v08', 'h07v08'))
SELECT 'ndvi' AS grid, y, x, t, ndvi AS value FROM o UNION ALL SELECT 'qa', y, x, t, qa FROM o""")
def tiles_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both grids of a list of tiles, stored and read back."""
    path = new_path(spark, "tiles")
    tiles.write_tiles(cubes.observations(spark, sf_dir), path)
    grids = tiles.import_tiles(spark, path, ["h05v08", "h07v08"], cubes.NDVI.copy(root=new_path(spark, "ndvi")), cubes.QA.copy(root=new_path(spark, "qa")))
    parts = [g.cells.select(F.lit(n).alias("grid"), "y", "x", "t", F.col("value").cast("int").alias("value")) for n, g in zip(("ndvi", "qa"), grids)]
    return parts[0].unionByName(parts[1])


@query(f"WITH {FILES_SQL} SELECT DISTINCT ts_ms FROM files")
def date_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dates")
    text.write_dates(_files(spark, sf_dir).select("ts_ms").distinct(), path)
    return text.read_dates(spark, path)


@query(f"WITH {TILES_SQL}, {FILES_SQL} SELECT t.h, t.v, f.path FROM tiles t JOIN files f ON f.tile = 'h' || lpad(CAST(t.h AS VARCHAR), 2, '0') || 'v' || lpad(CAST(t.v AS VARCHAR), 2, '0')")
def files_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = cubes.tiles(spark, sf_dir).withColumn("tile", names.tile_name("h", "v"))
    return named.join(files.files_by_tile(_files(spark, sf_dir)), "tile").select("h", "v", F.explode("files.path").alias("path"))


@query(f"WITH {POINTS_SQL} SELECT c_custkey, CAST(trunc((lng + 75.0) / 0.5) AS INT) AS x, CAST(trunc((lat - 10.0) / -0.5) AS INT) AS y FROM points")
def rings_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = cubes.points(spark, sf_dir).select("c_custkey", F.array(F.struct("lat", "lng")).alias("ring"))
    pixels = rings.select("c_custkey", F.explode(geo.ring_to_xy("ring", HEADER.geot, HEADER.projection)).alias("p"))
    return pixels.select("c_custkey", "p.x", "p.y")


@query(f"WITH {PIXELS_SQL}, k AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 0, 0)) v(corner, dx, dy)) SELECT x, y, CAST(corner AS INT) AS corner, round(10.0 - 0.5 * (y + dy), 5) AS lat, round(-75.0 + 0.5 * (x + dx), 5) AS lng FROM pixels, k")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geo.corners(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1, HEADER.geot, HEADER.projection, 0.0)
    boxes = _pixels(spark, sf_dir).select("x", "y", ring.alias("ring")).select("x", "y", F.posexplode(geo.bbox_bottom_first("ring")).alias("corner", "p"))
    return boxes.select("x", "y", "corner", F.round("p.lat", 5).alias("lat"), F.round("p.lng", 5).alias("lng"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'myd13q1' WHEN 1 THEN 'mod13q1' ELSE lower(s_name) END AS prefix FROM supplier")
def satellite_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("s_suppkey") % 3
    name = F.when(kind == 0, "Aqua").when(kind == 1, "terra").otherwise(F.col("s_name"))
    return cubes.table(spark, sf_dir, "supplier").select("s_suppkey", names.satellite_prefix(name).alias("prefix"))
