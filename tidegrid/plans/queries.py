"""Every operator as a query over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions import addressing as A
from tidegrid.functions import dates as D
from tidegrid.functions import geo, landcover, layouts, names, qa
from tidegrid.functions.arrays import gather, masked
from tidegrid.operators import align, files, lifecycle, mask
from tidegrid.operators.grid import Grid
from tidegrid.plans import cubes
from tidegrid.plans.cubes import CLASS_SQL, DAY_MS, EVENTS_SQL, FILES_SQL, FIRST_DAY_MS, HEADER, LINEITEM_SQL, OBSERVATIONS_SQL, POINTS_SQL
from tidegrid.plans.header import catalog, dates
from tidegrid.sources import regions, tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUAD = [(1, 1), (13, 3), (9, 9), (3, 8), (1, 1)]
WINDOW = ((4, 2), (11, 8), 3, 21)
MODIS_SQL = "(-4800 * 231.65635826374995::DOUBLE * 36 / 2)", "231.65635826374995::DOUBLE", "(4800 * 231.65635826395834::DOUBLE * 18 / 2)", "(-231.65635826395834::DOUBLE)"
QA_SQL = "qa AS (SELECT CAST((l_orderkey * 40503 + l_partkey * 9973 + l_linenumber * 7919) % 65536 AS INT) AS q, CAST(l_quantity AS BIGINT) AS value, CAST(l_suppkey % 15 AS INT) AS x, CAST(l_partkey % 100 AS INT) AS y FROM lineitem)"
MODIS_QA_SQL = "CASE WHEN q & 3 = 3 OR (q >> 6) & 3 = 3 OR (q >> 8) & 1 = 1 OR (q >> 10) & 1 = 1 OR (q >> 11) & 7 <> 1 OR (q >> 14) & 1 = 1 OR (q >> 15) & 1 = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - ((q >> 2) & 15) / 12.0::DOUBLE END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def crossings(x: str, y: str, ring: list[tuple[int, int]] = QUAD) -> str:
    """SQL: strictly inside a ring."""
    odd, on = [], []
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        cross = f"({bx - ax} * ({y} - {ay}) - {by - ay} * ({x} - {ax}))"
        on.append(f"({cross} = 0 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        if ay != by:
            odd.append(f"(CASE WHEN {y} >= {min(ay, by)} AND {y} < {max(ay, by)} AND {cross} {'>' if by > ay else '<'} 0 THEN 1 ELSE 0 END)")
    return f"(({' + '.join(odd)}) % 2 = 1 AND NOT ({' OR '.join(on)}))"


def dense_sql(x0: int, x1: int, y0: int, y1: int, t0: int, t1: int, cells: str = "cells", fill: int = -3000) -> str:
    return f"""SELECT CAST(ys.y AS INT) AS y, CAST(xs.x AS INT) AS x, CAST(ts.t AS INT) AS t, coalesce(c.value, {fill}) AS value
FROM range({y0}, {y1}) ys(y), range({x0}, {x1}) xs(x), range({t0}, {t1}) ts(t) LEFT JOIN {cells} c ON c.x = xs.x AND c.y = ys.y AND c.t = ts.t"""


# Reads of a grid


@query(f"""WITH {EVENTS_SQL} SELECT frac_num, time_chunk, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum_value, min(value) AS min_value
FROM cells WHERE x >= 4 AND x < 11 AND y >= 2 AND y < 8 AND t >= 3 AND t < 21 GROUP BY 1, 2""")
def slice_xy_chunk_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cubes.events(spark, sf_dir)
    return grid.chunk_stats(grid.window(*WINDOW))


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells")
def cube_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).cells.select("y", "x", "t", "value", "frac_num", "time_chunk")


@query(f"WITH {EVENTS_SQL} {dense_sql(4, 11, 2, 8, 3, 21)}")
def dense_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).dense(*WINDOW)


@query(f"WITH {EVENTS_SQL} {dense_sql(5, 10, 0, 5, 0, 30)}")
def frac_by_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).frac(1)


@query(f"WITH {EVENTS_SQL}, d AS ({dense_sql(5, 8, 1, 4, 28, 30)}) SELECT y, x - 5 AS x, t - 28 AS t, value FROM d")
def frac_slice_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).chunk_slice(1, 4, (1, 4), (0, 3), (0, 2))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT frac_num, time_chunk FROM cells")
def available_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).available_fractions()


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT frac_num FROM cells")
def available_fracnums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).available_fracnums()


@query(f"WITH {EVENTS_SQL}, c AS (SELECT DISTINCT frac_num, time_chunk FROM cells) SELECT count(*) AS n_chunks, count(DISTINCT frac_num) AS n_fracnums FROM c")
def grid_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).info()


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT frac_num FROM cells ORDER BY frac_num LIMIT 3")
def first_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).first_fractions(3)


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT frac_num, time_chunk, CAST(count(DISTINCT t) AS INT) AS nd FROM cells GROUP BY 1, 2)
SELECT frac_num, max(time_chunk) AS time_chunk, max_by(nd, time_chunk) AS nd FROM c GROUP BY 1""")
def latest_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).latest_chunks()


@query(f"WITH {EVENTS_SQL} SELECT y, x, string_agg(CAST(value AS VARCHAR), ',' ORDER BY t) AS series FROM cells GROUP BY 1, 2")
def pixel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cubes.events(spark, sf_dir).series()
    return series.select("y", "x", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("series"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT y, x, list(value ORDER BY t) AS v FROM cells GROUP BY 1, 2)
SELECT y, x, v[(x + y) % 30 + 1] AS value FROM s""")
def gather_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cubes.events(spark, sf_dir).series()
    return series.select("y", "x", gather("values", (F.col("x") + F.col("y")) % 30).alias("value"))


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, CASE WHEN value > 0 THEN NULLIF(value, 1000) END AS value, value - lag(value) OVER (PARTITION BY y, x ORDER BY t) AS change FROM cells")
def series_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("y", "x").orderBy("t")
    cells = cubes.events(spark, sf_dir).cells
    return cells.select("y", "x", "t", F.when(F.col("value") > 0, masked("value", 1000)).alias("value"), (F.col("value") - F.lag("value").over(before)).alias("change"))


@query("SELECT 'events' AS grid, 15 AS width, 100 AS height, 3 AS num_x_fracs, 20 AS num_y_fracs, 5 AS num_dates_fracs, -3000.0::DOUBLE AS nodata, 1400 AS chunk_bytes FROM region LIMIT 1")
def grid_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.lit(HEADER.chunk_bytes()).alias("chunk_bytes")
    return catalog(spark, [HEADER]).select("grid", "width", "height", "num_x_fracs", "num_y_fracs", "num_dates_fracs", "nodata", size)


@query(f"SELECT CAST(r AS INT) AS t, {FIRST_DAY_MS} + {DAY_MS} * r AS ts_ms, CAST(r // 7 AS INT) AS time_chunk FROM range(0, 30) q(r)")
def date_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates(spark, HEADER).withColumn("time_chunk", A.time_chunk("t", 7))


# Addressing


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 15).cast("int").alias("x"), (F.col("l_partkey") % 100).cast("int").alias("y")).distinct()


PIXELS_SQL = "pixels AS (SELECT DISTINCT CAST(l_suppkey % 15 AS INT) AS x, CAST(l_partkey % 100 AS INT) AS y FROM lineitem)"


@query(f"WITH {PIXELS_SQL} SELECT x, y, CAST((y // 5) * 3 + x // 5 AS INT) AS frac_num FROM pixels")
def frac_for_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.frac_of_points(_pixels(spark, sf_dir), HEADER)


@query("SELECT DISTINCT CAST(l_partkey % 60 AS INT) AS frac_num, CAST((l_partkey % 60) % 3 * 5 AS INT) AS x_start, CAST(((l_partkey % 60) % 3 + 1) * 5 AS INT) AS x_end, CAST((l_partkey % 60) // 3 * 5 AS INT) AS y_start, CAST(((l_partkey % 60) // 3 + 1) * 5 AS INT) AS y_end FROM lineitem")
def frac_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    fracs = cubes.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).cast("int").alias("frac_num")).distinct()
    return fracs.withColumns(A.frac_ranges("frac_num", 5, 5, 3))


@query("SELECT DISTINCT CAST(l_linenumber % 5 AS INT) AS time_chunk, CAST(l_linenumber % 5 * 7 AS INT) AS t_start, CAST(least(l_linenumber % 5 * 7 + 7, 30) AS INT) AS t_end FROM lineitem")
def time_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = cubes.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5).cast("int").alias("time_chunk")).distinct()
    start, end = A.time_range("time_chunk", 7, 30)
    return chunks.withColumns({"t_start": start, "t_end": end})


CHUNK_IDS_SQL = "ids AS (SELECT DISTINCT CAST(l_partkey % 60 AS INT) AS frac_num, CAST(l_linenumber % 5 AS INT) AS time_chunk FROM lineitem)"


def _chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).cast("int").alias("frac_num"), (F.col("l_linenumber") % 5).cast("int").alias("time_chunk")).distinct()


@query(f"WITH {CHUNK_IDS_SQL} SELECT frac_num, time_chunk, frac_num || '.' || time_chunk || '.jdata' AS name FROM ids")
def chunk_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_ids(spark, sf_dir).withColumn("name", A.chunk_filename("frac_num", "time_chunk"))


@query(f"WITH {CHUNK_IDS_SQL} SELECT 'hdfs:///cubes/42/' || frac_num || '.' || time_chunk || '.jdata' AS path, frac_num, time_chunk FROM ids")
def parse_chunk_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _chunk_ids(spark, sf_dir).select(F.concat(F.lit("hdfs:///cubes/42/"), A.chunk_filename("frac_num", "time_chunk")).alias("path"))
    frac, chunk = A.parse_chunk_filename("path")
    return paths.withColumns({"frac_num": frac, "time_chunk": chunk})


@query(f"WITH {POINTS_SQL} SELECT c_custkey, CAST(trunc((lng + 75.0) / 0.5) AS INT) AS x, CAST(trunc((lat - 10.0) / -0.5) AS INT) AS y FROM points WHERE trunc((lng + 75.0) / 0.5) >= 0 AND trunc((lng + 75.0) / 0.5) < 15 AND trunc((lat - 10.0) / -0.5) >= 0 AND trunc((lat - 10.0) / -0.5) < 100")
def in_bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.latlng_to_xy("lat", "lng", HEADER.geot, HEADER.projection)
    return cubes.points(spark, sf_dir).select("c_custkey", x.alias("x"), y.alias("y")).where(A.in_bounds("x", "y", 15, 100))


@query("SELECT DISTINCT CAST((y // 5) * 3 + x // 5 AS INT) AS frac_num FROM range(2, 8) a(y), range(4, 11) b(x)")
def rect_fracs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in HEADER.fracs_for_rect(4, 2, 11, 8)], "frac_num int")


@query("SELECT DISTINCT CAST((y // 5) * 3 + x // 5 AS INT) AS frac_num FROM range(1, 9) a(y), range(1, 13) b(x)")
def poly_bbox_fracs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cubes.events(spark, sf_dir)
    return spark.createDataFrame([(f,) for f in mask.fracs_for_polygon(grid, QUAD)], "frac_num int")


# World layouts

TILES_SQL = "tiles AS (SELECT CAST(n_nationkey + 5 AS INT) AS h, CAST(n_nationkey % 18 AS INT) AS v FROM nation)"
TILE_CELLS_SQL = f"{TILES_SQL}, tc AS (SELECT h, v, CAST(v * 12 + i AS INT) AS i, CAST(h * 12 + j AS INT) AS j, CAST((v * 12 + i) * 432 + h * 12 + j AS INT) AS cell FROM tiles, range(0, 12) a(i), range(0, 12) b(j))"


@query(f"WITH {TILE_CELLS_SQL} SELECT h, v, i, j, cell FROM tc")
def tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.tile_cells(cubes.tiles(spark, sf_dir))


@query(f"WITH {TILE_CELLS_SQL} SELECT cell, h, v, CAST(h * 4800 AS INT) AS x, CAST(v * 4800 AS INT) AS y FROM tc")
def cell_to_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = layouts.cell_tile("cell")
    cells = layouts.tile_cells(cubes.tiles(spark, sf_dir)).select("cell").withColumns({"h": h, "v": v})
    x, y = layouts.tile_xy("h", "v")
    return cells.withColumns({"x": x, "y": y})


@query(f"WITH {TILE_CELLS_SQL} SELECT cell, CAST((i - v * 12) * 400 AS INT) AS i0, CAST((i - v * 12 + 1) * 400 AS INT) AS i1, CAST((j - h * 12) * 400 AS INT) AS j0, CAST((j - h * 12 + 1) * 400 AS INT) AS j1 FROM tc")
def cell_indices_in_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layouts.tile_cells(cubes.tiles(spark, sf_dir))
    return cells.select("cell", *[c.alias(k) for k, c in layouts.cell_in_tile("cell", "h", "v").items()])


@query("""WITH t AS (SELECT DISTINCT substr('XWVUTSRQPNMLKJHGFEDC', CAST(p_partkey % 20 + 1 AS INT), 1) || substr('XWVUTSRQPNMLKJHGFEDC', CAST(p_partkey % 20 + 1 AS INT), 1) ||
 lpad(CAST(p_size % 60 + 1 AS VARCHAR), 2, '0') || lpad(CAST(p_size % 60 + 2 AS VARCHAR), 2, '0') AS tile FROM part)
SELECT tile, CAST((instr('XWVUTSRQPNMLKJHGFEDC', substr(tile, 1, 1)) - 1) // 2 * 30 + (CAST(substr(tile, 3, 2) AS INT) - 1) // 2 AS INT) AS cell FROM t""")
def glcf_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit(layouts.ZONE_ROWS), (F.col("p_partkey") % 20 + 1).cast("int"), F.lit(1))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tile = F.concat(letter, letter, two(F.col("p_size") % 60 + 1), two(F.col("p_size") % 60 + 2))
    named = cubes.table(spark, sf_dir, "part").select(tile.alias("tile")).distinct()
    return named.withColumn("cell", layouts.glcf_cell("tile"))


@query("""WITH c AS (SELECT DISTINCT CAST((l_suppkey * 997 + l_partkey * 31) % 93312 AS INT) AS cell FROM lineitem)
SELECT 'h' || lpad(CAST(cell % 432 // 12 AS VARCHAR), 2, '0') || 'v' || lpad(CAST(cell // 5184 AS VARCHAR), 2, '0') AS tile, count(DISTINCT cell) AS n_fracs FROM c GROUP BY 1""")
def tile_fraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cubes.table(spark, sf_dir, "lineitem").select(((F.col("l_suppkey") * 997 + F.col("l_partkey") * 31) % 93312).cast("int").alias("frac_num"))
    return files.tile_fraction_counts(cells)


# Projection

SINUSOIDAL_XY = f"""CAST(trunc((6371007.181::DOUBLE * radians(lng) * cos(radians(lat)) - {MODIS_SQL[0]}) / {MODIS_SQL[1]}) AS INT) AS x,
CAST(trunc((6371007.181::DOUBLE * radians(lat) - {MODIS_SQL[2]}) / {MODIS_SQL[3]}) AS INT) AS y"""


@query(f"WITH {POINTS_SQL} SELECT c_custkey, {SINUSOIDAL_XY} FROM points")
def latlng_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.latlng_to_xy("lat", "lng", layouts.MODIS.geot, layouts.MODIS.projection)
    return cubes.points(spark, sf_dir).select("c_custkey", x.alias("x"), y.alias("y"))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT c_custkey, {SINUSOIDAL_XY} FROM points),
g AS (SELECT c_custkey, {MODIS_SQL[0]} + (x + 1e-8::DOUBLE) * {MODIS_SQL[1]} AS gx, {MODIS_SQL[2]} + (y + 1e-8::DOUBLE) * {MODIS_SQL[3]} AS gy FROM p)
SELECT c_custkey, round(degrees(gy / 6371007.181::DOUBLE), 6) AS lat, round(degrees(gx / (6371007.181::DOUBLE * cos(gy / 6371007.181::DOUBLE))), 6) AS lng FROM g""")
def pixel_to_latlng(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = latlng_to_pixel(spark, sf_dir)
    lat, lng = geo.xy_to_latlng("x", "y", layouts.MODIS.geot, layouts.MODIS.projection)
    return pixels.select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT DISTINCT frac_num, frac_num % 3 AS fx, frac_num // 3 AS fy FROM cells),
k AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) v(corner, dx, dy))
SELECT frac_num, CAST(corner AS INT) AS corner, round(10.0 - 0.5 * ((fy + dy) * 5 + 1e-8::DOUBLE), 6) AS lat, round(-75.0 + 0.5 * ((fx + dx) * 5 + 1e-8::DOUBLE), 6) AS lng FROM f, k""")
def fraction_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = cubes.events(spark, sf_dir).fraction_polygons().select("frac_num", F.posexplode("ring").alias("corner", "p"))
    return rings.select("frac_num", "corner", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(10.0 - 0.5 * (y + 1e-8::DOUBLE), 6) AS lat, round(-75.0 + 0.5 * (x + 1e-8::DOUBLE), 6) AS lng FROM range(2, 8) a(y), range(4, 11) b(x)")
def latlng_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).latlng_grid((4, 2), (6, 7)).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(f"WITH {PIXELS_SQL} SELECT x, y, round(-75.0 + 0.5 * x, 6) AS g0, round(10.0 - 0.5 * y, 6) AS g3 FROM pixels")
def rebased_geot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo.rebased(HEADER.geot, "x", "y")
    return _pixels(spark, sf_dir).select("x", "y", F.round(g[0], 6).alias("g0"), F.round(g[3], 6).alias("g3"))


@query(f"WITH {EVENTS_SQL} {dense_sql(4, 11, 2, 8, 0, 5)}")
def slice_latlng(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).slice_latlng((8.9, -72.9), (5.9, -69.4), 0, 5)[0]


@query(f"WITH {POINTS_SQL} SELECT c_custkey, CAST(trunc((lat - 80.0) / -0.004166666666667::DOUBLE) AS INT) AS r, CAST(trunc((lng + 180.0) / 0.004166666666667::DOUBLE) AS INT) AS c FROM points")
def latlon_to_rowcol(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = geo.latlon_to_rowcol("lat", "lng", (-180.0, 0.004166666666667, 0.0, 80.0, 0.0, -0.004166666666667))
    return cubes.points(spark, sf_dir).select("c_custkey", r.alias("r"), c.alias("c"))


# Polygons


@query(f"SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {crossings('x', 'y')} AS inside FROM range(0, 100) a(y), range(0, 15) b(x)")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.polygon_mask(cubes.events(spark, sf_dir), QUAD)


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value FROM cells WHERE x >= 1 AND x < 13 AND y >= 1 AND y < 9 AND {crossings('x', 'y')}")
def polygon_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.polygon_cells(cubes.events(spark, sf_dir), QUAD).select("y", "x", "t", "value")


@query(f"WITH {EVENTS_SQL}, d AS ({dense_sql(1, 13, 1, 9, 2, 6)}) SELECT y, x, t, value, {crossings('x', 'y')} AS inside FROM d")
def polygon_dense_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = [(10.0 - 0.5 * (y + 0.2), -75.0 + 0.5 * (x + 0.2)) for x, y in QUAD]
    return mask.read_polygon_latlng(cubes.events(spark, sf_dir), ring, 2, 6)[0]


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN x < 6 AND y < 10 THEN 1 ELSE 0 END AS value FROM range(0, 100) a(y), range(0, 15) b(x)")
def rasterize_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = [(10.0, -75.0), (10.0, -72.0), (5.0, -72.0), (5.0, -75.0)]
    return mask.rasterize_like(cubes.events(spark, sf_dir), [ring])


_REGION_SQL = " UNION ALL ".join(f"SELECT '{name}' AS name, {i} AS i, round({lat!r}::DOUBLE, 6) AS lat, round({lng!r}::DOUBLE, 6) AS lng" for name, ring in regions.CONTINENTS.items() for i, (lng, lat) in enumerate(ring))


@query(_REGION_SQL)
def regions_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = regions.continents(spark).select("name", F.posexplode("ring").alias("i", "p"))
    return rings.select("name", "i", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


# Quality bits, land cover


@query(f"WITH {QA_SQL} SELECT q, round({MODIS_QA_SQL}, 6) AS conf, count(*) AS n FROM qa GROUP BY 1, 2")
def modis_qa_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.qa(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n")).select("q", F.round(qa.modis_confidence("q"), 6).alias("conf"), "n")


@query(f"WITH {QA_SQL} SELECT q, CASE WHEN q & 7 <> 0 OR (q >> 4) & 3 = 3 OR (q >> 10) & 3 = 3 OR (q >> 12) & 3 = 3 OR (q >> 14) & 3 = 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS conf, count(*) AS n FROM qa GROUP BY 1, 2")
def landsat8_qa_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.qa(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n")).select("q", qa.landsat8_confidence("q").alias("conf"), "n")


@query(f"WITH {QA_SQL}, c AS (SELECT x, y, value, greatest(0, CAST(round(({MODIS_QA_SQL}) * 12) AS BIGINT)) AS w FROM qa) SELECT x, y, CAST(sum(value * w) AS BIGINT) AS weighted, CAST(sum(w) AS BIGINT) AS weight FROM c GROUP BY 1, 2")
def qa_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.round(qa.modis_confidence("q", clamp=True) * 12).cast("bigint")
    rows = cubes.qa(spark, sf_dir).select("x", "y", "value", weight.alias("w"))
    return rows.groupBy("x", "y").agg(F.sum(F.col("value") * F.col("w")).alias("weighted"), F.sum("w").alias("weight"))


_CLASS_VALUES = ", ".join(f"({c}, '{name}', {r}, {g}, {b})" for c, name, r, g, b in landcover.CLASSES)
DIM_SQL = f"dim AS (SELECT * FROM (VALUES {_CLASS_VALUES}) v(class, class_name, r, g, b))"


@query(f"WITH {CLASS_SQL}, {DIM_SQL} SELECT x, y, class, class_name FROM classes LEFT JOIN dim USING (class)")
def landcover_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landcover.with_names(cubes.landcover(spark, sf_dir))


@query(f"WITH {CLASS_SQL}, {DIM_SQL} SELECT x, y, class, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM classes LEFT JOIN dim USING (class)")
def landcover_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landcover.with_rgb(cubes.landcover(spark, sf_dir))


@query(f"WITH {CLASS_SQL}, {DIM_SQL} SELECT DISTINCT class, class_name FROM classes LEFT JOIN dim USING (class)")
def classes_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landcover.present(cubes.landcover(spark, sf_dir))


# Source files and dates


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.source_files(cubes.file_names(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT * FROM files")
def parse_source_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)


@query(f"WITH {FILES_SQL} SELECT tile, count(*) AS n_files, count(DISTINCT ts_ms) AS n_dates FROM files GROUP BY 1")
def files_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.files_per_tile(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT tile, string_agg(path, '|' ORDER BY ts_ms, path) AS paths FROM files GROUP BY 1")
def files_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = files.files_by_tile(_files(spark, sf_dir))
    return grouped.select("tile", F.array_join(F.transform("files", lambda f: f["path"]), "|").alias("paths"))


@query(f"WITH {FILES_SQL} SELECT path, ts_ms FROM files WHERE tile = 'h05v06'")
def tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.files_of_tile(_files(spark, sf_dir), "h05v06").select("path", "ts_ms")


@query(f"WITH {FILES_SQL} SELECT path, tile, ts_ms FROM files WHERE satellite = 'myd13q1'")
def satellite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.source_files(cubes.file_names(spark, sf_dir), satellite="aqua").select("path", "tile", "ts_ms")


@query(f"WITH {FILES_SQL} SELECT DISTINCT strftime(make_timestamp(ts_ms * 1000), '%Y_%m_%d') AS day FROM files WHERE tile = 'h05v06'")
def collect_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.collect_dates(_files(spark, sf_dir), "h05v06")


MISSING_SQL = f"""{FILES_SQL}, gone AS (SELECT d.ts_ms, t.tile FROM (SELECT DISTINCT ts_ms FROM files) d, (SELECT DISTINCT tile FROM files) t
 EXCEPT SELECT ts_ms, tile FROM files)"""


@query(f"WITH {MISSING_SQL} SELECT ts_ms, strftime(make_timestamp(ts_ms * 1000), '%Y_%m_%d') AS day, CAST(strftime(make_timestamp(ts_ms * 1000), '%j') AS INT) AS doy, tile FROM gone")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.missing_dates(_files(spark, sf_dir))


@query(f"WITH {MISSING_SQL} SELECT tile, ts_ms, 'MOD13Q1.A' || strftime(make_timestamp(ts_ms * 1000), '%Y%j') || '.' || tile || '.005.0000000000000.hdf' AS name, -3000 AS ndvi, 65535 AS qa FROM gone")
def fake_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.fake_missing(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT path AS name, tile FROM files r WHERE NOT EXISTS (SELECT 1 FROM files l WHERE l.satellite = 'myd13q1' AND lower(l.path) = lower(r.path))")
def files_to_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = _files(spark, sf_dir)
    local = remote.where("satellite = 'myd13q1'").select("path")
    return files.to_download(remote.select(F.col("path").alias("name"), "tile"), local)


@query(f"WITH {FILES_SQL} SELECT tile, strftime(make_timestamp(min(ts_ms) * 1000), '%Y_%m_%d') AS first, strftime(make_timestamp(max(ts_ms) * 1000), '%Y_%m_%d') AS last FROM files GROUP BY 1")
def date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.date_span(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ts_ms, path) AS k FROM files) SELECT tile, path FROM r WHERE k = 1")
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.model_file(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT satellite, path FROM files")
def union_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = cubes.file_names(spark, sf_dir)
    return files.of_both_satellites(files.source_files(paths, satellite="terra"), files.source_files(paths, satellite="aqua")).select("satellite", "path")


@query(f"WITH {OBSERVATIONS_SQL} SELECT tile, ts_ms, i, j, ndvi, qa FROM obs WHERE tile = 'h06v08' AND i >= 400 AND i < 800 AND j >= 0 AND j < 400")
def tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = (8 * 12 + 1) * 432 + 6 * 12
    return tiles.cell_window(spark, cubes.observations(spark, sf_dir), "h06v08", cell)


@query(f"""WITH {OBSERVATIONS_SQL}, axis AS (SELECT * FROM (VALUES {', '.join(f'({t}, {ms})' for t, ms in enumerate(cubes.MONTHS))}) v(t, ts_ms)),
g AS (SELECT CAST(8 * 4800 + i AS INT) AS y, CAST(CAST(substr(tile, 2, 2) AS INT) * 4800 + j AS INT) AS x, t, ndvi, qa AS q FROM obs JOIN axis USING (ts_ms))
SELECT CAST((y // 400) * 432 + x // 400 AS INT) AS frac_num, CAST(t // 4 AS INT) AS time_chunk, y, x, t, CAST(ndvi AS SMALLINT) AS ndvi, q AS qa, round({MODIS_QA_SQL}, 6) AS conf FROM g""")
def create_ndvi_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = tiles.ndvi_qa_grids(cubes.observations(spark, sf_dir), cubes.NDVI, cubes.QA)
    return align.join_aligned(list(pair), ["ndvi", "qa"]).withColumn("conf", F.round(qa.modis_confidence("qa"), 6))


@query(f"WITH {FILES_SQL} SELECT path, ts_ms FROM files WHERE ts_ms IN (SELECT ts_ms FROM files WHERE tile = 'h05v06')")
def requested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir)
    return files.requested(found, found.where("tile = 'h05v06'")).select("path", "ts_ms")


@query(f"WITH {FILES_SQL} SELECT DISTINCT ts_ms FROM files WHERE tile = 'h05v06' AND ts_ms NOT IN (SELECT ts_ms FROM files WHERE tile = 'h06v07')")
def absent_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _files(spark, sf_dir)
    return files.absent_dates(found.where("tile = 'h05v06'"), found.where("tile = 'h06v07'"))


@query(f"WITH {FILES_SQL} SELECT tile, ts_ms, max(path) AS path FROM files GROUP BY 1, 2")
def one_file_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.one_per_date(_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT tile, satellite, ts_ms, count(*) AS n FROM files GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_file_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.duplicate_dates(_files(spark, sf_dir))


@query("SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) AS ts_ms FROM orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy_MM_dd")
    return cubes.table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date(text).alias("ts_ms"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = D.day_to_ms(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"))
    return cubes.table(spark, sf_dir, "orders").select("o_orderkey", D.format_date(ms, "-").alias("day"))


@query("SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INT) AS doy FROM orders")
def day_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = D.day_to_ms(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"))
    return cubes.table(spark, sf_dir, "orders").select("o_orderkey", D.day_of_year(ms).alias("doy"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS n_links, coalesce(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)[1], '') AS first_link FROM pages""")
def scrape_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    pages = cubes.table(spark, sf_dir, "pages").select("page_id", links.alias("links"))
    return pages.select("page_id", F.size("links").cast("bigint").alias("n_links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"))


@query(f"WITH {FILES_SQL} SELECT path AS name, 'http://example.org/' || path AS url, tile, ts_ms FROM files")
def remote_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<tr><td><a href="'), "path", F.lit('">x</a> <a href="index.html">up</a>'))
    pages = cubes.file_names(spark, sf_dir).select(html.alias("html"))
    return files.remote_files(pages, base=F.lit("http://example.org/")).select("name", "url", "tile", "ts_ms")


# Several grids


@query(f"WITH {EVENTS_SQL}, {LINEITEM_SQL} SELECT a.frac_num, a.time_chunk, y, x, t, a.value AS a, b.value AS b FROM cells a JOIN cells2 b USING (y, x, t)")
def multi_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.join_aligned([cubes.events(spark, sf_dir), cubes.lineitem(spark, sf_dir)], ["a", "b"])


@query(f"""WITH {EVENTS_SQL}, {LINEITEM_SQL}, a AS ({dense_sql(0, 5, 5, 10, 0, 4)}), b AS ({dense_sql(0, 5, 5, 10, 0, 4, 'cells2', 0)})
SELECT y, x, t, a.value AS a, true AS mask_a, b.value AS b, true AS mask_b FROM a JOIN b USING (y, x, t)""")
def frac_multi_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.frac_of_grids([cubes.events(spark, sf_dir), cubes.lineitem(spark, sf_dir)], ["a", "b"], 3, 0, 4)


COARSE = cubes.LANDCOVER.copy(grid="coarse", width=8, height=50, frac_width=8, frac_height=50, geot=(-75.0, 1.0, 0.0, 10.0, 0.0, -1.0))
COARSE_SQL = f"{CLASS_SQL}, coarse AS (SELECT x // 2 AS sx, y // 2 AS sy, max(class) AS class FROM classes GROUP BY 1, 2)"


def _coarse(spark: SparkSession, sf_dir: str) -> Grid:
    cells = cubes.landcover(spark, sf_dir).groupBy(A.int_div("y", 2).cast("int").alias("y"), A.int_div("x", 2).cast("int").alias("x")).agg(F.max("class").alias("value"))
    return Grid.of(COARSE, cells.withColumn("t", F.lit(0)))


@query(f"""WITH {COARSE_SQL}, p AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, x // 2 AS sx, y // 2 AS sy FROM range(2, 40) a(y), range(1, 15) b(x))
SELECT y, x, 0 AS t, class AS value, true AS covered FROM p LEFT JOIN coarse USING (sx, sy)""")
def reproject_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.reproject_nearest(cubes.events(spark, sf_dir), _coarse(spark, sf_dir), (1, 2), (15, 40))


def _fine(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid.of(cubes.LANDCOVER, cubes.landcover(spark, sf_dir).withColumnRenamed("class", "value").withColumn("t", F.lit(0)))


@query(f"""WITH {CLASS_SQL}, n AS (SELECT CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, class AS value, count(*) AS n FROM classes GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, value) AS k FROM n) SELECT y, x, 0 AS t, value FROM r WHERE k = 1""")
def reproject_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.reproject_grouped(_coarse(spark, sf_dir), _fine(spark, sf_dir), (0, 0), (8, 50), "mode")


@query(f"WITH {CLASS_SQL} SELECT CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, 0 AS t, round(avg(class), 6) AS value FROM classes GROUP BY 1, 2")
def reproject_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.reproject_grouped(_coarse(spark, sf_dir), _fine(spark, sf_dir), (0, 0), (8, 50), "average")
    return found.withColumn("value", F.round("value", 6))


@query(f"""WITH {EVENTS_SQL}, {COARSE_SQL}, a AS ({dense_sql(1, 13, 1, 9, 0, 3)})
SELECT y, x, t, a.value AS a, {crossings('x', 'y')} AS mask_a, CAST(c.class AS INT) AS b, {crossings('x', 'y')} AS mask_b FROM a LEFT JOIN coarse c ON c.sx = x // 2 AND c.sy = y // 2""")
def polygon_multi_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = [(10.0 - 0.5 * (y + 0.2), -75.0 + 0.5 * (x + 0.2)) for x, y in QUAD]
    return align.polygon_of_grids([cubes.events(spark, sf_dir), _coarse(spark, sf_dir)], ["a", "b"], ring, 0, 3)


@query(f"WITH {EVENTS_SQL}, d AS ({dense_sql(4, 11, 2, 8, 3, 21)}) SELECT y, x, t, NULLIF(value, -3000) AS value FROM d")
def masked_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.events(spark, sf_dir).dense(*WINDOW).withColumn("value", masked("value", -3000))


# Lifecycle


@query(f"WITH {EVENTS_SQL}, {LINEITEM_SQL} SELECT DISTINCT frac_num FROM cells INTERSECT SELECT DISTINCT frac_num FROM cells2")
def frac_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.common_fractions([cubes.events(spark, sf_dir), cubes.lineitem(spark, sf_dir)])


TODO_SQL = f"{EVENTS_SQL}, {LINEITEM_SQL}, both_ AS (SELECT frac_num, time_chunk FROM cells INTERSECT SELECT frac_num, time_chunk FROM cells2), todo AS (SELECT * FROM both_ EXCEPT SELECT frac_num, time_chunk FROM cells WHERE t < 9)"


@query(f"WITH {TODO_SQL} SELECT * FROM todo")
def todo_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cubes.events(spark, sf_dir), cubes.lineitem(spark, sf_dir)
    return lifecycle.todo_chunks([a, b], a.cells.where("t < 9"))


@query(f"WITH {TODO_SQL} SELECT (SELECT count(*) FROM both_) AS total, (SELECT count(*) FROM todo) AS todo")
def count_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cubes.events(spark, sf_dir), cubes.lineitem(spark, sf_dir)
    return lifecycle.counts_to_process([a, b], a.cells.where("t < 9"))


def _short(spark: SparkSession, sf_dir: str, ndates: int) -> tuple[Grid, DataFrame]:
    """The events cube cut to its first dates, and its observations by timestamp."""
    grid = cubes.events(spark, sf_dir)
    source = grid.cells.select("y", "x", (F.lit(FIRST_DAY_MS) + F.col("t").cast("bigint") * DAY_MS).alias("ts_ms"), "value")
    return lifecycle.truncate_dates(grid, ndates), source


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells")
def append_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, source = _short(spark, sf_dir, 10)
    return lifecycle.append_dates(grid, list(HEADER.timestamps_ms), source)[0].cells.select("y", "x", "t", "value", "frac_num", "time_chunk")


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells")
def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, source = _short(spark, sf_dir, 10)
    for n in (17, 17, 30, 30):
        grid = lifecycle.append_dates(grid, list(HEADER.timestamps_ms[:n]), source)[0]
    return grid.cells.select("y", "x", "t", "value", "frac_num", "time_chunk")


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells WHERE t < 10")
def truncate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, 10)[0].cells.select("y", "x", "t", "value", "frac_num", "time_chunk")


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, CASE WHEN frac_num = 1 AND time_chunk = 2 THEN value + 1 ELSE value END AS value, frac_num, time_chunk FROM cells")
def reload_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cubes.events(spark, sf_dir)
    source = grid.cells.select("y", "x", "t", (F.col("value") + 1).alias("value"))
    return lifecycle.reload_chunk(grid, 1, 2, source).cells.select("y", "x", "t", "value", "frac_num", "time_chunk")


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, CAST(t // 4 AS INT) AS time_chunk FROM cells")
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.rechunk(cubes.events(spark, sf_dir), 4).cells.select("y", "x", "t", "value", "time_chunk")


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells WHERE t < 12")
def create_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, source = _short(spark, sf_dir, 12)
    return lifecycle.create(grid.header, source).cells.select("y", "x", "t", "value", "frac_num", "time_chunk")


MAP_SQL = f"""WITH {EVENTS_SQL}, {LINEITEM_SQL}, f AS (SELECT frac_num FROM cells INTERSECT SELECT frac_num FROM cells2),
px AS (SELECT CAST(fy * 5 + y AS INT) AS y, CAST(fx * 5 + x AS INT) AS x FROM (SELECT frac_num // 3 AS fy, frac_num % 3 AS fx FROM f), range(0, 5) a(y), range(0, 5) b(x)),
a AS (SELECT y, x, sum(value) AS s FROM cells GROUP BY 1, 2), b AS (SELECT y, x, max(value) AS m FROM cells2 GROUP BY 1, 2)
SELECT px.y, px.x, 0 AS t, CAST(coalesce(a.s, 0) + coalesce(b.m, 0) AS DOUBLE) AS value FROM px LEFT JOIN a USING (y, x) LEFT JOIN b USING (y, x)"""


@query(MAP_SQL)
def map_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cubes.events(spark, sf_dir), cubes.lineitem(spark, sf_dir)
    a = Grid(HEADER.copy(nodata=None), a.cells)
    output = HEADER.copy(grid="mapped", dtype="<f8", ndates=1, frac_ndates=1, timestamps_ms=None, nodata=None)
    cells = lifecycle.map_fractions([a, b], ["a", "b"], output, lambda arrays: arrays[0].sum(axis=2) + arrays[1].max(axis=2))
    return cells.select("y", "x", "t", "value")


@query(f"WITH {EVENTS_SQL} SELECT y, x, 0 AS t, max(value) - min(value) AS value FROM cells GROUP BY 1, 2")
def map_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cubes.events(spark, sf_dir)
    output = HEADER.copy(grid="mapped", ndates=1, frac_ndates=1, timestamps_ms=None)
    return lifecycle.map_pixels(grid, output, lambda value, t: F.max(value) - F.min(value)).select("y", "x", "t", "value")


@query(f"WITH {EVENTS_SQL} SELECT y, x, t, value, frac_num, time_chunk FROM cells WHERE x < 15 AND y < 100")
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = cubes.events(spark, sf_dir).cells.where(A.in_bounds("x", "y", HEADER.width, HEADER.height))
    return lifecycle.cells_of_chunks(lifecycle.chunk_arrays(Grid(HEADER, inside)), HEADER)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.streaming.ingest import tumbling_sums

    events = cubes.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    found = tumbling_sums(events, "ts", "cents", ["event_type"], "1 hour", "1 day")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slice_xy_chunk_agg over a window from the first row on, which the smallest scale fills too."""
    grid = cubes.events(spark, sf_dir)
    return grid.chunk_stats(grid.window((4, 0), (11, 8), 3, 21))
