import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.geo import RADIUS
from tidegrid.operators import lifecycle
from tidegrid.operators.grid import Grid
from tidegrid.plans.header import Header
from tidegrid.plans.settings import Settings
from tidegrid.sources import geotiff, jdata, regions, store, text


@pytest.fixture
def grid(spark, tmp_path):
    data = np.random.default_rng(1).random((48, 60, 5))
    header = Header("s", str(tmp_path / "s"), 60, 48, 6, 8, 5, 2, "<f8", None, timestamps_ms=(1, 2, 3, 5, 6))
    return data, Grid.of(header, text.cells_of_array(spark, data))


def values(cells, shape):
    out = np.full(shape, np.nan)
    for r in cells.collect():
        out[r.y, r.x, r.t] = r.value
    return out


def test_store_round_trip(spark, grid):
    data, g = grid
    assert not store.header_exists(spark, g.header.root)
    store.save(g)
    back = store.load(spark, g.header.root)
    assert back.header.timestamps_ms == (1, 2, 3, 5, 6) and (values(back.cells, data.shape) == data).all()
    assert store.uri("fs:///a/b") == "file:///a/b" and store.listed(spark, g.header.root + "/none") == []


def test_stored_append_is_idempotent(spark, grid):
    data, g = grid
    cut = lifecycle.truncate_dates(g, 3)
    store.save(cut)
    source = g.cells.select("y", "x", F.element_at(F.array(*[F.lit(t).cast("bigint") for t in g.header.timestamps_ms]), F.col("t") + 1).alias("ts_ms"), "value")
    for _ in range(2):
        back = store.append(g.header.root, [1, 2, 3, 5, 6], source)
        assert back.header.ndates == 5 and back.cells.count() == data.size and (values(back.cells, data.shape) == data).all()


def test_unpublished_dates_stay_out(spark, grid):
    _, g = grid
    store.save(g)
    store.save_header(spark, lifecycle.truncate_dates(g, 3).header)
    assert store.load(spark, g.header.root).cells.agg(F.max("t")).first()[0] == 2


def test_chunk_files(spark, grid):
    data, g = grid
    root = g.header.root
    jdata.write_chunks(lifecycle.chunk_arrays(g), root, "<f8", 2)
    assert jdata.read_chunk(f"{root}/jdata/0.2.jdata").shape == (8, 6, 1) and jdata.read_chunk(f"{root}/jdata/999.0.jdata") is None
    chunks = jdata.read_chunks(spark, root)
    assert (values(lifecycle.cells_of_chunks(chunks, g.header), data.shape) == data).all()
    few = chunks.where("frac_num in (1, 3) and time_chunk >= 1")
    assert sorted((r.frac_num, r.time_chunk) for r in few.collect()) == [(1, 1), (1, 2), (3, 1), (3, 2)]
    with pytest.raises(ValueError):
        jdata.write_chunk(f"{root}/x.jdata", np.zeros((8, 6, 3)), "<f8", 2)
    with pytest.raises(ValueError):
        jdata.write_chunk(f"{root}/x.jdata", np.zeros((8, 6, 2), "f4"), "<f8", 2)


def test_no_chunk_files(spark, tmp_path):
    assert jdata.read_chunks(spark, str(tmp_path / "none")).count() == 0


def test_geotiff_round_trip(spark, tmp_path):
    data = np.random.default_rng(2).integers(-3000, 9000, (150, 70)).astype("i2")
    header = Header("t", "t", 140, 150, 70, 150, 1, dtype="<i2", nodata=-3000, geot=(10.0, 0.5, 0, 20.0, 0, -0.25), sr_wkt="GEOGCS[x]")
    raw = geotiff.write(geotiff.from_window(data, header, (4, 8)))
    back = geotiff.read(gzip.compress(raw))
    assert (back.data == data).all() and back.geot == (12.0, 0.5, 0, 18.0, 0, -0.25) and back.nodata == -3000 and back.sr_wkt == "GEOGCS[x]"
    (tmp_path / "a.tif.gz").write_bytes(gzip.compress(raw))
    cells = geotiff.import_tile(spark, str(tmp_path / "a.tif.gz"), header, 1)
    assert cells.count() == data.size and cells.where("x = 70 and y = 3").first().value == data[3, 0]
    with pytest.raises(ValueError):
        geotiff.read(b"nothing")


def test_regions(spark, tmp_path):
    from_file = regions.read_geojson(spark, text.asset_path("continents.geojson"), "file")
    table = regions.Regions(regions.continents(spark)).register(from_file)
    assert table.names("continents") == ["africa", "asia", "southamerica"]
    assert table.polygon("file.asia") == table.polygon("continents.asia") == [(lat, lng) for lng, lat in regions.CONTINENTS["asia"]]
    with pytest.raises(ValueError):
        table.polygon("nowhere.asia")
    with pytest.raises(ValueError):
        table.polygon("continents.atlantis")
    spec = text.asset_path("continents.geojson") + ":asia,africa"
    assert {r["name"] for r in regions.regions_of_argument(spark, spec).collect()} == {"asia", "africa"}
    feature = json.loads(regions.to_geojson(regions.continents(spark).where("name = 'asia'"), ["name"]).first()["value"])
    assert feature["geometry"]["coordinates"][0] == regions.CONTINENTS["asia"] and feature["properties"] == {"name": "asia"}


def test_shapefiles(spark, tmp_path):
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
    (tmp_path / "a.shp").write_bytes(regions.write_shapefile(rings))
    found = regions.read_shapefile(spark, str(tmp_path / "a.shp"), "c").orderBy("name").collect()
    assert [(p["lng"], p["lat"]) for p in found[0]["ring"]] == [*rings[0], rings[0][0]] and [(p["lng"], p["lat"]) for p in found[1]["ring"]] == rings[1]


def test_shapefile_attributes_and_references(spark, tmp_path):
    rings = [[(1.0, 2.0), (1.0, 5.0), (4.0, 5.0)], [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]
    rows = [{"name": "Ünï " + "x" * 300, "kind": 7, "share": 0.25}, {"name": None, "kind": -12, "share": None}]
    path = str(tmp_path / "a [1].shp")
    regions.save_shapefile(path, rings, [("name", "str"), ("kind", "int"), ("share", "float")], rows)
    (tmp_path / "a [1]b.shp").write_bytes(b"another file")
    found = regions.read_shapes(spark, path).orderBy("number").collect()
    assert [[(p["lat"], p["lng"]) for p in r["ring"]] for r in found] == [[*rings[0], rings[0][0]], rings[1]]
    assert found[0]["attributes"] == {"name": ("Ünï " + "x" * 300).encode()[:254].decode(), "kind": "7", "share": "0.250000000"}
    assert found[1]["attributes"] == {"name": "", "kind": "-12", "share": ""}
    shp, shx = ((tmp_path / f"a [1].{s}").read_bytes() for s in ("shp", "shx"))
    for i in range(2):
        at, words = struct.unpack(">2i", shx[100 + 8 * i : 108 + 8 * i])
        assert struct.unpack(">2i", shp[2 * at : 2 * at + 8]) == (i + 1, words)
    assert 2 * struct.unpack(">i", shx[24:28])[0] == len(shx) and 2 * (at + 4 + words) == len(shp)
    moved = regions.read_shapes(spark, path, "sinusoidal").orderBy("number").first()["ring"][1]
    assert moved["lat"] == pytest.approx(RADIUS * np.radians(1)) and moved["lng"] == pytest.approx(RADIUS * np.radians(5) * np.cos(np.radians(1)))
    (tmp_path / "a [1].prj").write_text('PROJCS["UTM zone 18N"]')
    with pytest.raises(ValueError):
        regions.read_shapes(spark, path)
    with pytest.raises(ValueError):
        regions.read_shapes(spark, str(tmp_path / "nothing.shp"))
    with pytest.raises(ValueError):
        regions.write_dbf([("a_long_name_1", "int"), ("a_long_name_2", "int")], [])


def test_null_shapes_keep_attributes_in_step(spark, tmp_path):
    regions.save_shapefile(str(tmp_path / "a.shp"), [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]] * 2, [("k", "int")], [{"k": 1}, {"k": 2}])
    raw = bytearray((tmp_path / "a.shp").read_bytes())
    raw[108:112] = struct.pack("<i", 0)
    (tmp_path / "a.shp").write_bytes(bytes(raw))
    assert [(r["number"], r["attributes"]["k"]) for r in regions.read_shapes(spark, str(tmp_path / "a.shp")).collect()] == [(1, "2")]


def test_a_raster_on_another_grid(spark, tmp_path):
    data = np.array([[0, 1, 2, 9], [3, 4, 9, 5]], "i2")
    header = Header("t", "", 4, 2, 4, 2, dtype="<i2", geot=(10.0, 1.0, 0, 20.0, 0, -1.0))
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(geotiff.write(geotiff.from_window(data, header, (0, 0), 9)))
    opened = geotiff.open_grid(spark, path).header
    assert (opened.width, opened.height, opened.nodata, opened.geot, opened.dtype, opened.projection) == (4, 2, 9, header.geot, "<i2", "geographic")
    found = geotiff.reproject_custom(spark, path, 3, 3, (11.0, 1.0, 0, 20.0, 0, -1.0)).collect()
    assert {(r.y, r.x): (r.value, r.valid) for r in found} == {(0, 0): (1, True), (0, 1): (2, True), (0, 2): (0, False), (1, 0): (4, True), (1, 1): (0, False), (1, 2): (5, True), **{(2, x): (0, False) for x in range(3)}}
    zero = geotiff.reproject_file(spark, path, opened).where("y = 0 and x = 0").first()
    assert (zero.value, zero.valid) == (0, True)
    halves = geotiff.reproject_custom(spark, path, 2, 1, (10.0, 2.0, 0, 20.0, 0, -2.0), interpolation="average").orderBy("x").collect()
    assert [(r.value, r.valid) for r in halves] == [(2.0, True), (3.5, True)]
    (tmp_path / "b.tif").write_bytes((tmp_path / "a.tif").read_bytes())
    with pytest.raises(ValueError, match="one raster"):
        geotiff.open_grid(spark, str(tmp_path / "*.tif"))


def test_text_sources(spark, tmp_path):
    (tmp_path / "dates.csv").write_text("2000_03_05\n2000_02_18\n")
    dates = text.read_dates(spark, str(tmp_path / "dates.csv"))
    assert [r.ts_ms for r in dates.collect()] == [950832000000, 952214400000]
    text.write_dates(dates, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["2000_02_18", "2000_03_05"]
    (tmp_path / "p.properties").write_text("; note\na = 1\n\nb=x\n")
    assert text.read_properties(spark, str(tmp_path / "p.properties")) == {"a": "1", "b": "x"}
    (tmp_path / "bad.csv").write_text("yesterday\n")
    with pytest.raises(Exception, match="not a date"):
        text.read_dates(spark, str(tmp_path / "bad.csv")).collect()


def test_settings(spark):
    s = Settings.of(spark, "/data/")
    assert s.worldgrid == "/data/worldgrid" and s.source_dir == "/data/input/ndvi"


def test_stream_into_a_grid(spark, tmp_path):
    from tidegrid.streaming.ingest import ingest

    header = Header("i", str(tmp_path / "grid"), 4, 4, 2, 2, 3, 2, "<f8", None, timestamps_ms=(10, 20, 30))
    store.save_header(spark, header)
    inbox = str(tmp_path / "in")
    schema = "x int, y int, ts_ms bigint, value double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        ingest(spark.readStream.schema(schema).parquet(inbox), header, str(tmp_path / "ck")).awaitTermination()
        return {(r.x, r.y, r.t): r.value for r in store.load(spark, header.root).cells.collect()}

    assert arrive([(0, 0, 10, 1.0), (3, 3, 20, 2.0), (9, 9, 10, 5.0), (1, 1, 99, 5.0)]) == {(0, 0, 0): 1.0, (3, 3, 1): 2.0}
    assert arrive([(0, 0, 10, 7.0), (2, 1, 30, 3.0)]) == {(0, 0, 0): 7.0, (3, 3, 1): 2.0, (2, 1, 2): 3.0}


def test_watermarked_windows(spark, tmp_path):
    from tidegrid.streaming.ingest import tumbling_sums

    inbox = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k, 2L v union all select timestamp'2024-01-01 00:50:00', 'a', 3L union all select timestamp'2024-01-01 01:00:00', 'b', 4L").write.parquet(inbox)
    stream = spark.readStream.schema("ts timestamp, k string, v bigint").parquet(inbox)
    q = tumbling_sums(stream, "ts", "v", ["k"], "1 hour", "10 minutes").writeStream.format("memory").queryName("sums").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n, r.total) for r in spark.table("sums").collect()) == [("a", 2, 5), ("b", 1, 4)]
