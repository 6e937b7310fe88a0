"""A grid over time: create, append dates, reload a chunk, truncate, and the incremental map step.

Each works on cells, and only on those of the chunks that it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.addressing import frac_for_xy, frac_x, frac_y, int_div, time_chunk
from tidegrid.functions.arrays import filled
from tidegrid.operators.grid import Grid, keyed_cells
from tidegrid.plans.header import Header
from tidegrid.plans.session import ship_package
from tidegrid.sources.jdata import ARROW, lists

CHUNK = ["frac_num", "time_chunk"]


def chunk_keys(cells: DataFrame) -> DataFrame:
    return cells.select(*CHUNK).distinct()


def create(header: Header, source: DataFrame) -> Grid:
    """A grid from source cells (y, x, ts_ms, value): dates of the header only, aligned by timestamp."""
    if not header.has_timestamps:
        return Grid.of(header, source.select("y", "x", "t", "value"))
    axis = source.sparkSession.createDataFrame(list(enumerate(header.timestamps_ms)), "t int, ts_ms bigint")  # a row for each date
    return Grid.of(header, source.join(F.broadcast(axis), "ts_ms").select("y", "x", "t", "value"))


def append_dates(grid: Grid, timestamps_ms: list[int], source: DataFrame) -> tuple[Grid, DataFrame]:
    """(grid with all dates, the cells that are new): the dates that the grid has must be the first of the list.

    Only rows of dates past the last are taken from ``source`` (y, x, ts_ms, value), so appending the same dates again adds
    nothing. The chunk that the last date left unfilled is filled up first, as its key follows from the date alone.
    """
    header = grid.header.with_timestamps(timestamps_ms)
    fresh = [(t, ms) for t, ms in enumerate(timestamps_ms) if t >= grid.header.ndates]
    axis = grid.spark.createDataFrame(fresh, "t int, ts_ms bigint")  # a row for each new date
    new = keyed_cells(source.join(F.broadcast(axis), "ts_ms").select("y", "x", "t", "value"), header)
    new = new.join(grid.cells.where(F.col("t") >= grid.header.ndates).select("y", "x", "t"), ["y", "x", "t"], "left_anti") if fresh else new
    return Grid(header, grid.cells.unionByName(new.select(*grid.cells.columns))), new


def rechunk(grid: Grid, frac_ndates: int) -> Grid:
    """The same cells under another length of time chunks."""
    header = grid.header.copy(frac_ndates=frac_ndates)
    return Grid(header, grid.cells.withColumn("time_chunk", time_chunk("t", frac_ndates)))


def touched_chunks(grid: Grid, new: DataFrame) -> DataFrame:
    """All cells of the chunks that have new cells: what an append rewrites."""
    return grid.cells.join(chunk_keys(new), CHUNK, "left_semi")


def reload_chunk(grid: Grid, frac_num: int, chunk: int, source: DataFrame) -> Grid:
    """One chunk's cells replaced by those of ``source`` (y, x, t, value); t runs from the chunk's first date to its own end."""
    lo, hi = grid.header.frac_time_range(chunk)
    (x0, x1), (y0, y1) = grid.header.frac_xyranges(frac_num)
    mine = (F.col("t") >= lo) & (F.col("t") < hi) & (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    kept = grid.cells.where(~((F.col("frac_num") == frac_num) & (F.col("time_chunk") == chunk)))
    fresh = keyed_cells(source.where(mine).select("y", "x", "t", "value"), grid.header)
    return Grid(grid.header, kept.unionByName(fresh.select(*kept.columns)))


def truncate_dates(grid: Grid, ndates: int) -> Grid:
    """Only the first dates, in cells and header: repairs chunks that hold more dates than they should."""
    stamps = None if grid.header.timestamps_ms is None else grid.header.timestamps_ms[:ndates]
    return Grid(grid.header.copy(ndates=ndates, timestamps_ms=stamps), grid.cells.where(F.col("t") < ndates))


def common_chunks(grids: list[Grid]) -> DataFrame:
    """Chunks (frac_num, time_chunk) that all grids have."""
    out = chunk_keys(grids[0].cells)
    for grid in grids[1:]:
        out = out.join(chunk_keys(grid.cells), CHUNK, "left_semi")
    return out


def common_fractions(grids: list[Grid]) -> DataFrame:
    """Fractions that all grids have."""
    out = grids[0].cells.select("frac_num").distinct()
    for grid in grids[1:]:
        out = out.join(grid.cells.select("frac_num").distinct(), "frac_num", "left_semi")
    return out


def todo_chunks(grids: list[Grid], done: DataFrame | None, force_all: bool = False) -> DataFrame:
    """Chunks that all inputs have and the output lacks; all of them if forced. A half-written fraction is not taken as done."""
    todo = common_chunks(grids)
    return todo if done is None or force_all else todo.join(chunk_keys(done), CHUNK, "left_anti")


def counts_to_process(grids: list[Grid], done: DataFrame | None) -> DataFrame:
    """(total, todo) numbers of chunks."""
    total = common_chunks(grids).agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    todo = todo_chunks(grids, done).agg(F.count("*").alias("todo")).withColumn("_one", F.lit(1))
    return total.join(F.broadcast(todo), "_one").select("total", "todo")


def _check(grids: list[Grid]) -> None:
    first = grids[0].header
    for grid in grids[1:]:
        if not first.same_geogrid(grid.header):
            raise ValueError("inputs of different geogrids")
        if first.has_timestamps and grid.header.has_timestamps and first.timestamps_ms != grid.header.timestamps_ms:
            raise ValueError("inputs of different dates")


def map_fractions(grids: list[Grid], names: list[str], output: Header, map_fn: Callable[[list[np.ndarray]], np.ndarray], done: DataFrame | None = None, force_all: bool = False) -> DataFrame:
    """New cells (y, x, t, value, frac_num, time_chunk) of an output grid: ``map_fn`` over dense fractions of all inputs.

    For each fraction that all inputs have and ``done`` lacks, ``map_fn`` gets an array (height, width, dates) for each input, filled
    with its no-data value, and returns one for the output. Only fractions to do are read. Cells become arrays chunk by
    chunk, in the stored type, and chunks move as bytes: a worker holds a fraction's arrays, some rows of the output's
    cells, and never its cells as rows.
    """
    _check(grids)
    first = grids[0].header
    ship_package(grids[0].spark)
    todo = common_fractions(grids)
    if done is not None and not force_all:
        complete = done.select(*CHUNK).distinct().groupBy("frac_num").agg(F.count("*").alias("n")).where(F.col("n") >= output.num_dates_fracs)
        todo = todo.join(complete, "frac_num", "left_anti")
    parts = None
    for i, grid in enumerate(grids):
        mine = _chunk_bytes(Grid(grid.header, grid.cells.join(todo, "frac_num", "left_semi"))).withColumn("input", F.lit(i))
        parts = mine if parts is None else parts.unionByName(mine)
    headers = [g.header for g in grids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: list[np.ndarray | None] = []
        at = None
        for batch in batches:
            for frac, chunk, k, raw in zip(*(batch.column(n) for n in ("frac_num", "time_chunk", "input", "data"))):
                if frac.as_py() != at:
                    if at is not None:
                        yield from _output_cells(at, arrays, output, map_fn)
                    at, arrays = frac.as_py(), [np.full((h.frac_height, h.frac_width, h.ndates), h.fill, dtype=np.dtype(h.dtype)) for h in headers]
                h = headers[k.as_py()]
                t0, t1 = h.frac_time_range(chunk.as_py())
                arrays[k.as_py()][:, :, t0:t1] = np.frombuffer(raw.as_buffer(), np.dtype(h.dtype)).reshape(h.frac_height, h.frac_width, t1 - t0)
        if at is not None:
            yield from _output_cells(at, arrays, output, map_fn)

    dealt = parts.repartition("frac_num").sortWithinPartitions("frac_num", "input", "time_chunk")
    cells = dealt.mapInArrow(run, "y int, x int, t int, value double")
    return keyed_cells(cells.withColumn("value", F.col("value").cast(output.value_type)), output)


def _output_cells(frac: int, arrays: list[np.ndarray], output: Header, map_fn: Callable[[list[np.ndarray]], np.ndarray], slice_cells: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The cells of what ``map_fn`` returns for a fraction, some rows of pixels at a time."""
    out = np.asarray(map_fn(arrays))
    out = out[:, :, None] if out.ndim == 2 else out
    if out.shape != (output.frac_height, output.frac_width, output.ndates):
        raise ValueError(f"map_fn returned {out.shape}")
    (x0, _), (y0, _) = output.frac_xyranges(frac)
    step = max(1, slice_cells // max(1, out.shape[1] * out.shape[2]))
    for lo in range(0, out.shape[0], step):
        part = out[lo : lo + step]
        y, x, t = (a.reshape(-1) for a in np.indices(part.shape, dtype=np.int32))
        columns = [y + (y0 + lo), x + x0, t]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(part.reshape(-1).astype("f8"))], names=["y", "x", "t", "value"])


def map_pixels(grid: Grid, output: Header, expression: Callable, done: DataFrame | None = None) -> DataFrame:
    """The same with a column expression over (value, t): grouped by pixel, in generated code and without Python.

    ``expression`` is an aggregate such as ``lambda value, t: F.avg(value)``; the output has one date.
    """
    cells = grid.cells if done is None else grid.cells.join(done.select("frac_num").distinct(), "frac_num", "left_anti")
    out = cells.groupBy("y", "x").agg(expression(F.col("value"), F.col("t")).alias("value")).withColumn("t", F.lit(0))
    return keyed_cells(out.select("y", "x", "t", "value"), output)


def frac_of_points(points: DataFrame, header: Header, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the fraction of each pixel (x, y) in bounds; null for others."""
    inside = (F.col(x) >= 0) & (F.col(x) < header.width) & (F.col(y) >= 0) & (F.col(y) < header.height)
    return points.withColumn("frac_num", F.when(inside, frac_for_xy(x, y, header.frac_width, header.frac_height, header.num_x_fracs)))


def _dense_chunks(batches: Iterator[pa.RecordBatch], header: Header, batch_bytes: int = 1 << 22) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (frac_num, time_chunk, array) from cells that come chunk after chunk; a list has some megabytes, or one chunk."""
    at, array, out, size = None, np.empty(0), [], 0
    for batch in batches:
        frac, chunk, y, x, t, value = (batch.column(n).to_numpy(zero_copy_only=False) for n in CHUNK + ["y", "x", "t", "value"])
        starts = np.flatnonzero(np.r_[True, (np.diff(frac) != 0) | (np.diff(chunk) != 0)])
        for lo, hi in zip(starts, [*starts[1:], len(frac)]):
            key = int(frac[lo]), int(chunk[lo])
            if key != at:
                if at is not None:
                    out.append((*at, array))
                    size += array.nbytes
                if size >= batch_bytes:
                    yield out
                    out, size = [], 0
                (x0, _), (y0, _) = header.frac_xyranges(key[0])
                t0, t1 = header.frac_time_range(key[1])
                at, array = key, np.full((header.frac_height, header.frac_width, t1 - t0), header.fill, dtype=np.dtype(header.dtype))
            array[y[lo:hi] - y0, x[lo:hi] - x0, t[lo:hi] - t0] = value[lo:hi]
    if at is not None:
        yield [*out, (*at, array)]


def _map_chunks(grid: Grid, columns: Callable[[list[np.ndarray]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """(frac_num, time_chunk, ...): each stored chunk's cells as a dense array, and the columns of some arrays at a time."""
    header = grid.header
    ship_package(grid.spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in _dense_chunks((b for b in batches if b.num_rows), header):
            fracs, times, arrays = zip(*chunks)
            yield pa.RecordBatch.from_pydict({"frac_num": pa.array(fracs, pa.int32()), "time_chunk": pa.array(times, pa.int32()), **columns(arrays)})

    value = filled("value", header.nodata, dict(grid.cells.dtypes)["value"])
    cells = grid.cells.select(*CHUNK, "y", "x", "t", value.alias("value")).repartition(*CHUNK).sortWithinPartitions(*CHUNK)
    return cells.mapInArrow(run, f"frac_num int, time_chunk int, {schema}")


def chunk_arrays(grid: Grid) -> DataFrame:
    """(frac_num, time_chunk, h, w, nd, data): each stored chunk as a dense array, time innermost, no-data filled."""
    kind = ARROW[grid.header.value_type]

    def columns(arrays: list[np.ndarray]) -> dict[str, pa.Array]:
        sizes = {n: pa.array([a.shape[i] for a in arrays], pa.int32()) for i, n in enumerate(("h", "w", "nd"))}
        return sizes | {"data": lists([pa.array(a.reshape(-1)) for a in arrays], kind)}

    return _map_chunks(grid, columns, f"h int, w int, nd int, data array<{grid.header.value_type}>")


def _chunk_bytes(grid: Grid) -> DataFrame:
    """(frac_num, time_chunk, data): each stored chunk's dense array as bytes of the stored type."""
    return _map_chunks(grid, lambda arrays: {"data": pa.array([a.tobytes() for a in arrays], pa.binary())}, "data binary")


def cells_of_chunks(chunks: DataFrame, header: Header, drop_nodata: bool = True) -> DataFrame:
    """Cells (y, x, t, value, frac_num, time_chunk) of dense chunks, in generated code; each chunk says how many dates it has."""
    rows = chunks.select("frac_num", "time_chunk", "w", "nd", F.posexplode("data").alias("pos", "value"))
    y = frac_y("frac_num", header.num_x_fracs) * header.frac_height + int_div("pos", F.col("w") * F.col("nd"))
    x = frac_x("frac_num", header.num_x_fracs) * header.frac_width + int_div("pos", "nd") % F.col("w")
    t = F.col("time_chunk") * header.frac_ndates + F.col("pos") % F.col("nd")
    out = rows.select(y.cast("int").alias("y"), x.cast("int").alias("x"), t.cast("int").alias("t"), "value", "frac_num", "time_chunk")
    return out.where(F.col("value") != F.lit(header.nodata)) if drop_nodata and header.nodata is not None else out
