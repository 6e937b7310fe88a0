"""Chunk files in number: few tasks, chunks that come in pieces, all stored types."""

import numpy as np
import pytest

from tests.test_sources import values
from tidegrid.operators import lifecycle
from tidegrid.operators.grid import Grid
from tidegrid.plans.header import Header
from tidegrid.sources import jdata, text


def stored(spark, folder, dtype, data, nodata=None):
    """(header, cells) of an array; 60 fractions of three time chunks."""
    header = Header("c", str(folder / "c"), 60, 48, 6, 8, 5, 2, dtype, nodata, timestamps_ms=(1, 2, 3, 5, 6))
    return header, text.cells_of_array(spark, data).selectExpr("y", "x", "t", f"cast(value as {header.value_type}) as value")


def written(spark, header, cells):
    jdata.write_chunks(lifecycle.chunk_arrays(Grid.of(header, cells)), header.root, header.dtype, header.frac_ndates)
    return jdata.read_chunks(spark, header.root, header.dtype)


def test_a_task_reads_many_files(spark, tmp_path):
    data = np.random.default_rng(3).random((48, 60, 5))
    header, cells = stored(spark, tmp_path, "<f8", data)
    chunks = written(spark, header, cells)
    assert len(list((tmp_path / "c" / "jdata").iterdir())) == 180
    assert chunks.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert (values(lifecycle.cells_of_chunks(chunks, header), data.shape) == data).all()
    assert chunks.where("frac_num = 7").rdd.getNumPartitions() == 3


def test_bytes_of_a_task(tmp_path, monkeypatch):
    for frac, n in enumerate((1, 1, 400, 1, 400)):
        jdata.write_chunk(f"{tmp_path}/jdata/{frac}.0.jdata", np.zeros((n, 100, 1)), "<f8", 1)
    monkeypatch.setattr(jdata, "TASK_BYTES", 150_000)
    parts = jdata.ChunkReader({"path": str(tmp_path)}).partitions()
    assert [[frac for _, frac, _ in p.files] for p in parts] == [[0, 1], [2], [3], [4]]


def test_chunks_in_pieces(spark, tmp_path):
    data = np.random.default_rng(4).random((48, 60, 5))
    header, cells = stored(spark, tmp_path, "<f8", data)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunks = written(spark, header, cells)
        assert chunks.count() == 180 and (values(lifecycle.cells_of_chunks(chunks, header), data.shape) == data).all()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("dtype", ["|i1", "|u1", "<i2", "<u2", "<i4", "<u4", "<i8", "<f4", "<f8", "|b1"])
def test_stored_types(spark, tmp_path, dtype):
    data = np.random.default_rng(5).integers(0, 2 if dtype == "|b1" else 127, (48, 60, 5)).astype(dtype)
    header, cells = stored(spark, tmp_path, dtype, data.astype("f8"))
    chunks = written(spark, header, cells)
    assert jdata.read_chunk(f"{header.root}/jdata/0.0.jdata").dtype == np.dtype(dtype)
    assert (values(lifecycle.cells_of_chunks(chunks, header), data.shape) == data).all()


def test_values_that_do_not_fit(spark, tmp_path):
    for value in ("300", "-1", "null"):
        chunk = spark.sql(f"select 0 as frac_num, 0 as time_chunk, 1 as h, 1 as w, 1 as nd, array(cast({value} as smallint)) as data")
        with pytest.raises(Exception):
            jdata.write_chunks(chunk, str(tmp_path / "n"), "|u1", 1)


def test_a_null_cell_is_no_data(spark, tmp_path):
    header, cells = stored(spark, tmp_path, "<i2", np.ones((48, 60, 5)), -3000)
    chunks = written(spark, header, cells.selectExpr("y", "x", "t", "if(y = 3, null, value) as value"))
    assert lifecycle.cells_of_chunks(chunks, header).count() == 47 * 60 * 5
