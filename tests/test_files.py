import pytest

from tidegrid.operators import files

NAMES = [
    "/d/2000/MOD13Q1.A2000049.h29v07.005.2008238013448.hdf",
    "/d/2000/MOD13Q1.A2000065.h29v07.005.2008238013448.hdf",
    "/d/2000/MYD13Q1.A2000073.h29v07.005.2008238013448.hdf",
    "/d/2000/MOD13Q1.A2000049.h10v08.005.2008238013448.hdf",
    "/d/2000/MOD13Q1.A2000049.h10v08.005.2009238013448.hdf",
    "/d/2000/MOD13Q1.A2000049.h10v08.006.2008238013448.hdf",
    "/d/readme.txt",
]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "path string")


def test_listing(paths):
    found = files.source_files(paths)
    assert found.count() == 5
    assert {(r.problem) for r in files.quarantined(paths).collect()} == {"collection", "name"}
    assert files.source_files(paths, satellite="aqua").count() == 1
    assert files.files_of_tile(found, "h00v00").count() == 0
    assert [r.day for r in files.collect_dates(found, "h29v07").collect()] == ["2000_02_18", "2000_03_05", "2000_03_13"]
    assert {r.tile: (r.n_files, r.n_dates) for r in files.files_per_tile(found).collect()} == {"h29v07": (3, 3), "h10v08": (2, 1)}


def test_duplicates_are_errors_unless_resolved(paths, spark):
    found = files.source_files(paths)
    axis = spark.createDataFrame([(0, 950832000000)], "t int, ts_ms bigint")
    assert files.duplicate_dates(found).first().n == 2
    with pytest.raises(Exception, match="two files of one date"):
        files.align_files(found, axis).collect()
    assert files.align_files(files.one_per_date(found), axis).where("tile = 'h10v08'").first().path.endswith("2009238013448.hdf")


def test_missing(paths):
    found = files.source_files(paths)
    assert {(r.day, r.doy, r.tile) for r in files.missing_dates(found).collect()} == {("2000_03_05", 65, "h10v08"), ("2000_03_13", 73, "h10v08")}
    names = {r.name for r in files.fake_missing(found, "myd").collect()}
    assert names == {"MYD13Q1.A2000065.h10v08.005.0000000000000.hdf", "MYD13Q1.A2000073.h10v08.005.0000000000000.hdf"}


def test_nothing_is_missing_from_nothing(spark):
    empty = files.source_files(spark.createDataFrame([], "path string"))
    assert files.missing_dates(empty).count() == 0 and files.files_per_tile(empty).count() == 0
