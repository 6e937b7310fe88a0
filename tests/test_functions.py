import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.functions import addressing as A
from tidegrid.functions import dates as D
from tidegrid.functions import geo, layouts, names, qa
from tidegrid.functions.arrays import gather


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_quality_bits_of_all_words(spark):
    def modis(q):
        if q & 3 == 3 or q >> 6 & 3 == 3 or q >> 8 & 1 or q >> 10 & 1 or q >> 11 & 7 != 1 or q >> 14 & 1 or q >> 15 & 1:
            return 0.0
        return 1.0 - (q >> 2 & 15) / 12.0

    def landsat(q):
        return 0.0 if q & 7 or any(q >> s & 3 == 3 for s in (4, 10, 12, 14)) else 1.0

    rows = spark.range(65536).select("id", qa.modis_confidence("id").alias("m"), qa.landsat8_confidence("id").alias("l"), qa.modis_confidence("id", clamp=True).alias("c")).collect()
    assert all(r.m == modis(r.id) and r.l == landsat(r.id) and r.c == max(0.0, modis(r.id)) for r in rows)
    assert {hex(r.id): round(r.m, 6) for r in rows if r.id in (0x0800, 0x0802, 0x0804, 0x0830, 0x0834, 0x0838, 0x083C, 0x0803, 0xFFFF)} == {
        "0x800": 1, "0x802": 1, "0x804": 0.916667, "0x830": 0, "0x834": -0.083333, "0x838": -0.166667, "0x83c": -0.25, "0x803": 0, "0xffff": 0,
    }


def test_quality_of_signed_and_null_words(spark):
    assert one(spark, qa.modis_confidence(F.lit(-1)), qa.modis_confidence(F.lit(None).cast("int")), qa.landsat8_confidence(F.lit(None).cast("int"))) == (0.0, None, None)


@pytest.mark.parametrize("name, key", [("33.0.jdata", (33, 0)), ("hdfs:///test/42/bouh/56.42.jdata", (56, 42)), ("/test/bouh//weroi/weroi/woerwer/4543.3.jdata", (4543, 3)), ("x.jdata", (None, None))])
def test_chunk_names(spark, name, key):
    assert one(spark, *A.parse_chunk_filename(F.lit(name))) == key


@pytest.mark.parametrize("text, ms", [("2000049", 950832000000), ("2000065", 952214400000), ("2015065", 1425600000000), ("2004361", 1104019200000), ("2001366", None), ("2004366", 1104451200000)])
def test_julian_days(spark, text, ms):
    assert one(spark, D.julian_to_ms(F.lit(text))) == (ms,)


@settings(max_examples=20, deadline=None)
@given(day=st.dates(datetime.date(1970, 1, 1), datetime.date(2100, 1, 1)))
def test_dates_round_trip(spark, day):
    ms = int(datetime.datetime(day.year, day.month, day.day, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    text = day.strftime("%Y_%m_%d")
    assert one(spark, D.parse_date(F.lit(text)), D.format_date(F.lit(ms)), D.day_of_year(F.lit(ms + 5))) == (ms, text, day.timetuple().tm_yday)


def test_other_text_is_no_date(spark):
    assert one(spark, D.parse_date(F.lit("2000-01-01")), D.parse_date(F.lit("2000-01-01"), "-")) == (None, 946684800000)


def test_source_file_names(spark):
    good = "/x/2000/MOD13Q1.A2000065.h29v07.005.2008238013448.hdf"
    parts = names.source_file(names.source_parts(F.lit(good)))
    assert one(spark, *parts.values()) == ("mod13q1", "h29v07", 29, 7, 952214400000, None)
    for bad, why in [("MOD13Q1.A2000065.h29v07.006.2008238013448.hdf", "collection"), ("MOD13Q1.A2000400.h29v07.005.2008238013448.hdf", "date"), ("MOD11A1.hdf", "name"), ("MOD13Q1.A200065.h29v07.005.2008238013448.hdf", "name")]:
        assert one(spark, *names.source_file(names.source_parts(F.lit(bad))).values()) == (None, None, None, None, None, why)


def test_tiles(spark):
    assert one(spark, *names.parse_tile(F.lit("h10v09")), *names.parse_tile(F.lit("h1v9"))) == (10, 9, None, None)
    assert one(spark, names.satellite_prefix(F.lit("Aqua")), names.satellite_prefix(F.lit("terra")), names.satellite_prefix(F.lit("MOD13Q1"))) == ("myd13q1", "mod13q1", "mod13q1")


@pytest.mark.parametrize("h, v, cells", [(10, 8, [41592, 41593, 42024, 46355]), (29, 7, [36636, 36637, 37068, 41399]), (20, 11, [57264, 57265, 57696, 62027])])
def test_cells_of_tiles(spark, h, v, cells):
    found = layouts.tile_cells(spark.createDataFrame([(h, v)], "h int, v int"))
    back = layouts.cell_tile("cell")
    ranges = layouts.cell_in_tile("cell", "h", "v")
    rows = found.select("cell", back[0].alias("bh"), back[1].alias("bv"), *[c.alias(k) for k, c in ranges.items()]).orderBy("cell").collect()
    ids = [r.cell for r in rows]
    assert len(ids) == 144 and {(r.bh, r.bv) for r in rows} == {(h, v)}
    assert [ids[0], ids[1], ids[12], ids[-1]] == cells
    covered = {(i, j) for r in rows for i in range(r.i0, r.i1, 400) for j in range(r.j0, r.j1, 400)}
    assert len(covered) == 144 and sum((r.i1 - r.i0) * (r.j1 - r.j0) for r in rows) == 4800 * 4800


def test_cell_of_another_tile_is_an_error(spark):
    with pytest.raises(Exception, match="outside tile"):
        one(spark, layouts.cell_in_tile(F.lit(0), F.lit(1), F.lit(1))["i0"])


@pytest.mark.parametrize("tile, cell", [("HG5152", 235), ("ML1920", 159), ("FE1718", 248), ("VU3334", 46)])
def test_land_cover_tiles(spark, tile, cell):
    assert one(spark, layouts.glcf_cell(F.lit(tile))) == (cell,)


def test_pixels_of_points(spark):
    m = layouts.MODIS
    assert one(spark, *geo.latlng_to_xy(F.lit(0.0), F.lit(0.0), m.geot, m.projection)) == (86400, 43200)


def test_pixel_round_trip(spark):
    m = layouts.MODIS
    pixels = spark.range(5000).select((F.lit(30_000) + F.col("id") * 7919 % 90_000).cast("int").alias("x"), (F.lit(20_000) + F.col("id") * 104_729 % 45_000).cast("int").alias("y"))
    lat, lng = geo.xy_to_latlng("x", "y", m.geot, m.projection)
    x, y = geo.latlng_to_xy("lat", "lng", m.geot, m.projection)
    there = pixels.withColumns({"lat": lat, "lng": lng}).withColumns({"bx": x, "by": y})
    assert there.where("abs(bx - x) > 1 or abs(by - y) > 1").count() == 0


def test_gather(spark):
    a = spark.createDataFrame([([0, 1, 2, 3], 0), ([4, 5, 6, 7], 1), ([8, 9, 10, 11], 9)], "a array<int>, i int")
    assert [r.v for r in a.select(gather("a", "i").alias("v")).collect()] == [0, 5, None]


def test_links(spark):
    html = '<a href="2000.02.18/">x</a><a  href="MOD13Q1.A2000065.h29v07.005.2008238013448.hdf">f</a> <a href="../up">u</a>'
    assert one(spark, names.file_links(F.lit(html)), names.date_links(F.lit(html))) == (["MOD13Q1.A2000065.h29v07.005.2008238013448.hdf"], ["2000.02.18"])
