"""Cubes over the sample tables: an observation cube, one aligned to it, a land-cover cube, points, file names, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.addressing import int_div
from tidegrid.functions.layouts import MODIS
from tidegrid.operators.grid import Grid
from tidegrid.plans.header import Header

FIRST_DAY_MS, DAY_MS = 1_704_067_200_000, 86_400_000
HEADER = Header("events", "events", 15, 100, 5, 5, 30, 7, "<i8", -3000, (-75.0, 0.5, 0.0, 10.0, 0.0, -0.5), timestamps_ms=tuple(FIRST_DAY_MS + DAY_MS * t for t in range(30)))
LANDCOVER = Header("landcover", "landcover", 15, 100, 5, 5, 1, 1, "<i4", None, HEADER.geot)

EVENTS_SQL = """cube AS (
  SELECT CAST(user_id % 15 AS INT) AS x, CAST(user_id // 15 AS INT) AS y,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value
  FROM events GROUP BY 1, 2, 3),
cells AS (SELECT *, CAST((y // 5) * 3 + x // 5 AS INT) AS frac_num, CAST(t // 7 AS INT) AS time_chunk FROM cube)"""
LINEITEM_SQL = """cube2 AS (
  SELECT CAST(l_suppkey % 15 AS INT) AS x, CAST(l_partkey % 100 AS INT) AS y,
         CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) % 30 AS INT) AS t,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
  FROM lineitem GROUP BY 1, 2, 3),
cells2 AS (SELECT *, CAST((y // 5) * 3 + x // 5 AS INT) AS frac_num, CAST(t // 7 AS INT) AS time_chunk FROM cube2 WHERE t >= 0)"""
CLASS_SQL = """classes AS (
  SELECT CAST(p_partkey % 15 AS INT) AS x, CAST((p_partkey // 15) % 100 AS INT) AS y,
         CAST(max(CASE p_size % 19 WHEN 17 THEN 254 WHEN 18 THEN 255 ELSE p_size % 19 END) AS INT) AS class
  FROM part GROUP BY 1, 2)"""
POINTS_SQL = """points AS (
  SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0::DOUBLE - 80 + 0.013::DOUBLE AS lat, (c_custkey * 101 % 3600) / 10.0::DOUBLE - 180 + 0.007::DOUBLE AS lng
  FROM customer)"""
FILES_SQL = """names AS (
  SELECT DISTINCT (CASE WHEN o_orderkey % 2 = 1 THEN 'MYD13Q1.A' ELSE 'MOD13Q1.A' END) || strftime(o_orderdate, '%Y%j') || '.h' ||
         lpad(CAST(o_custkey % 36 AS VARCHAR), 2, '0') || 'v' || lpad(CAST(o_orderkey % 18 AS VARCHAR), 2, '0') || '.005.2008238013448.hdf' AS path
  FROM orders),
files AS (
  SELECT path, lower(substr(path, 1, 7)) AS satellite, lower(substr(path, 18, 6)) AS tile, CAST(substr(path, 19, 2) AS INT) AS h, CAST(substr(path, 22, 2) AS INT) AS v,
         epoch_ms(strptime(substr(path, 10, 7), '%Y%j')) AS ts_ms
  FROM names)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str, first: str) -> F.Column:
    return F.datediff(F.to_date(c), F.lit(first).cast("date"))


def events(spark: SparkSession, sf_dir: str) -> Grid:
    """Sums of cents by user place and day: sparse at the small scales."""
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 15).cast("int").alias("x"), int_div("user_id", 15).cast("int").alias("y"), _day("ts", "2024-01-01").alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return Grid.of(HEADER, t.groupBy("y", "x", "t").agg(F.sum("value").alias("value")))


def covering(header: Header, cells: DataFrame) -> Header:
    """The header with rows of fractions added until it holds all of the cells: a table has as many rows of pixels as its users fill."""
    rows = (cells.agg(F.max("y")).first()[0] or 0) + 1
    return header.copy(height=max(header.height, -(-rows // header.frac_height) * header.frac_height))


def lineitem(spark: SparkSession, sf_dir: str) -> Grid:
    """Quantities on the same geogrid and dates."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 15).cast("int").alias("x"), (F.col("l_partkey") % 100).cast("int").alias("y"), (_day("l_shipdate", "1995-01-02") % 30).alias("t"), F.col("l_quantity").cast("bigint").alias("value"))
    return Grid.of(HEADER.copy(grid="lineitem", nodata=None), t.where("t >= 0").groupBy("y", "x", "t").agg(F.sum("value").alias("value")))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = (F.col("l_orderkey") * 40503 + F.col("l_partkey") * 9973 + F.col("l_linenumber") * 7919) % 65536
    return table(spark, sf_dir, "lineitem").select(word.cast("int").alias("q"), F.col("l_quantity").cast("bigint").alias("value"), (F.col("l_suppkey") % 15).cast("int").alias("x"), (F.col("l_partkey") % 100).cast("int").alias("y"))


def landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 19
    cls = F.when(size == 17, 254).when(size == 18, 255).otherwise(size)
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 15).cast("int").alias("x"), (int_div("p_partkey", 15) % 100).cast("int").alias("y")).agg(F.max(cls).cast("int").alias("class"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = (F.col("c_custkey") * 37 % 1600) / F.lit(10.0) - 80 + F.lit(0.013)
    lng = (F.col("c_custkey") * 101 % 3600) / F.lit(10.0) - 180 + F.lit(0.007)
    return table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lng.alias("lng"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    prefix = F.when(F.col("o_orderkey") % 2 == 1, "MYD13Q1.A").otherwise("MOD13Q1.A")
    name = F.concat(prefix, F.date_format("o_orderdate", "yyyyDDD"), F.lit(".h"), two(F.col("o_custkey") % 36), F.lit("v"), two(F.col("o_orderkey") % 18), F.lit(".005.2008238013448.hdf"))
    return table(spark, sf_dir, "orders").select(name.alias("path")).distinct()


OBSERVATIONS_SQL = """obs AS (
  SELECT 'h' || lpad(CAST(l_suppkey % 3 + 5 AS VARCHAR), 2, '0') || 'v08' AS tile, epoch_ms(date_trunc('month', l_shipdate)) AS ts_ms,
         CAST(l_partkey % 700 AS INT) AS i, CAST(l_orderkey % 900 AS INT) AS j, CAST(max(l_quantity) * 100 AS INT) AS ndvi,
         CAST(max((l_orderkey * 40503 + l_partkey * 9973 + l_linenumber * 7919) % 65536) AS INT) AS qa
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
MONTHS = tuple(ms for ms in (694_224_000_000, 725_846_400_000, 757_382_400_000, 788_918_400_000, 820_454_400_000, 852_076_800_000))
NDVI = Header("ndvi", "ndvi", MODIS.width, MODIS.height, MODIS.cell_width, MODIS.cell_height, 6, 4, "<i2", -3000, MODIS.geot, projection=MODIS.projection, timestamps_ms=MONTHS)
QA = NDVI.copy(grid="qa", root="qa", dtype="<u2", nodata=65535)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of three world tiles by month."""
    month = F.unix_date(F.trunc(F.to_date("l_shipdate"), "month")).cast("bigint") * DAY_MS
    word = (F.col("l_orderkey") * 40503 + F.col("l_partkey") * 9973 + F.col("l_linenumber") * 7919) % 65536
    tile = F.concat(F.lit("h"), F.lpad((F.col("l_suppkey") % 3 + 5).cast("string"), 2, "0"), F.lit("v08"))
    rows = table(spark, sf_dir, "lineitem").select(tile.alias("tile"), month.alias("ts_ms"), (F.col("l_partkey") % 700).cast("int").alias("i"), (F.col("l_orderkey") % 900).cast("int").alias("j"), "l_quantity", word.alias("word"))
    return rows.groupBy("tile", "ts_ms", "i", "j").agg((F.max("l_quantity") * 100).cast("int").alias("ndvi"), F.max("word").cast("int").alias("qa"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).cast("int").alias("h"), (F.col("n_nationkey") % 18).cast("int").alias("v"))
