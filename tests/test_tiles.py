import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.geo import RADIUS
from tidegrid.operators import lifecycle
from tidegrid.plans import cubes
from tidegrid.plans.header import Header
from tidegrid.sources import tiles


@pytest.fixture(scope="module")
def observations(spark):
    rows = [("h29v07", ms, i, j, i * 10 + j + 1, 2048 + 4 * (i % 3)) for ms in cubes.MONTHS[:4] for i in range(5) for j in range(4)]
    return spark.createDataFrame(rows, tiles.SCHEMA)


def test_stored_tiles_prune(spark, tmp_path, observations):
    path = str(tmp_path / "tiles")
    tiles.write_tiles(observations, path)
    back = tiles.read_tiles(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, observations.collect()))
    found = tiles.window(back, "h29v07", (1, 3), (0, 2))
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 16 and "PartitionFilters: [isnotnull(tile" in plan and "GreaterThanOrEqual(i,1)" in plan
    assert tiles.window(back, "h00v00", (0, 9), (0, 9)).count() == 0


def test_bands(observations):
    assert tiles.band(observations, "250m 16 days NDVI").agg(F.max("value")).first()[0] == 44
    assert tiles.band(observations, "VI Quality").agg(F.min("value")).first()[0] == 2048
    with pytest.raises(ValueError):
        tiles.band(observations, "EVI")


def test_created_grids_read_back_and_append(observations):
    first = cubes.NDVI.copy(ndates=2, timestamps_ms=cubes.MONTHS[:2])
    ndvi, qa = tiles.ndvi_qa_grids(observations, first, cubes.QA.copy(ndates=2, timestamps_ms=cubes.MONTHS[:2]))
    x0, y0 = 29 * 4800, 7 * 4800
    got = {(r.y - y0, r.x - x0, r.t): r.value for r in ndvi.dense((x0, y0), (x0 + 4, y0 + 5)).collect()}
    assert got == {(i, j, t): i * 10 + j + 1 for i in range(5) for j in range(4) for t in range(2)}
    assert qa.cells.count() == 40 and qa.header.dtype == "<u2"
    source = tiles.placed(observations).select("y", "x", "ts_ms", F.col("ndvi").cast("smallint").alias("value"))
    grown, new = lifecycle.append_dates(ndvi, list(cubes.MONTHS[:4]), source)
    assert new.count() == 40 and grown.cells.count() == 80
    with pytest.raises(ValueError):
        tiles.ndvi_qa_grids(observations, first, cubes.QA)


def test_stand_ins_and_blanks(spark, observations):
    missing = spark.createDataFrame([("h29v07", 5), ("h01v01", 5)], "tile string, ts_ms bigint")
    found = tiles.stand_ins(missing, observations.select("tile", "i", "j").distinct())
    assert found.count() == 20 and found.select("ndvi", "qa").distinct().collect() == [(-3000, 65535)]
    blank = spark.createDataFrame([("h29v07", 1, 0, 0, 0, 7)], tiles.SCHEMA)
    assert tiles.without_blank(blank).first().ndvi is None


def test_both_bands_on_another_grid(observations):
    """A geographic grid around the tile's first pixels, each value as found by hand; 0 and outside are not valid."""
    ms = cubes.MONTHS[0]
    spec = cubes.MODIS
    left, top = spec.geot[0] + 29 * 4800 * spec.pixel_x, spec.geot[3] + 7 * 4800 * spec.pixel_y
    lat0 = np.degrees(top / RADIUS)
    lng0 = np.degrees(left / (RADIUS * np.cos(top / RADIUS)))
    target = Header("g", "", 12, 8, 12, 8, geot=(lng0 - 0.004, 0.0011, 0, lat0 + 0.003, 0, -0.0013))
    found = {(r.y, r.x): (r.ndvi, r.qa, r.valid) for r in tiles.reproject_ndvi_qa(observations, "h29v07", ms, target, (0, 0), (12, 8)).collect()}
    have = {(r.i, r.j): (r.ndvi, r.qa) for r in observations.where(F.col("ts_ms") == ms).collect()}
    for (y, x), got in found.items():
        lat, lng = target.geot[3] - 0.0013 * (y + 0.5), target.geot[0] + 0.0011 * (x + 0.5)
        i = int(np.floor((RADIUS * np.radians(lat) - top) / spec.pixel_y))
        j = int(np.floor((RADIUS * np.radians(lng) * np.cos(np.radians(lat)) - left) / spec.pixel_x))
        ndvi, qa = have.get((i, j), (0, 0))
        assert got == (ndvi, qa, ndvi != 0)
    assert len(found) == 96 and 0 < sum(v for _, _, v in found.values()) < 96


def test_many_tiles_at_once(spark, tmp_path, observations):
    path = str(tmp_path / "tiles")
    tiles.write_tiles(observations, path)
    ndvi, qa = cubes.NDVI.copy(root=str(tmp_path / "ndvi")), cubes.QA.copy(root=str(tmp_path / "qa"))
    with pytest.raises(ValueError, match="h30v07"):
        tiles.import_tiles(spark, path, ["h29v07", "h30v07"], ndvi, qa)
    assert not (tmp_path / "ndvi").exists()
    grids = tiles.import_tiles(spark, path, ["h29v07"], ndvi, qa)
    assert [g.cells.count() for g in grids] == [80, 80]
