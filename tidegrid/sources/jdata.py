"""Chunk files: one array file (.npy encoding) for each (fraction, time chunk), as a Spark data source.

Values keep the type that the option ``dtype`` names, double without it. ``spark.read.format("jdata").load(root)`` gives chunks (frac_num, time_chunk, h, w, nd, data); filters on frac_num and time_chunk
are pushed to the file names when ``spark.sql.python.filterPushdown.enabled`` is set, so other files aren't opened. A task reads several
small files: the option ``tasks`` names the fewest tasks that are wanted.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tidegrid.plans.header import SPARK_TYPES
from tidegrid.plans.session import ship_package

SCHEMA = "frac_num int, time_chunk int, h int, w int, nd int, data array<{}>"
#: Arrow's types of Spark's value types.
ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}
NAME = re.compile(r"(\d+)\.(\d+)\.jdata$")
#: Bytes of files that a task reads, those that opening a file counts for, and those that a batch holds.
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 1 << 26, 1 << 16, 1 << 22


def value_type(dtype: str) -> str:
    """Spark's type of a stored type."""
    return SPARK_TYPES[np.dtype(dtype).str[1:]]


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith(("file:", "fs://")):
        return pa.fs.LocalFileSystem(), "/" + path.partition(":")[2].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def lists(arrays: list[pa.Array], kind: pa.DataType) -> pa.ListArray:
    """A column with a list of values of one type for each array."""
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([a.cast(kind) for a in arrays]))


def _get(system: pa.fs.FileSystem, place: str) -> np.ndarray:
    with system.open_input_stream(place) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)


def _put(system: pa.fs.FileSystem, place: str, array: np.ndarray, dtype: str, frac_ndates: int) -> None:
    if array.dtype != np.dtype(dtype) or array.ndim != 3 or array.shape[2] > frac_ndates:
        raise ValueError(f"a chunk {array.dtype} {array.shape} doesn't fit the grid")
    buffer = io.BytesIO()
    np.save(buffer, np.ascontiguousarray(array), allow_pickle=False)
    with system.open_output_stream(place + ".new") as f:
        f.write(buffer.getvalue())
    system.move(place + ".new", place)


def read_chunk(path: str) -> np.ndarray | None:
    """A chunk's array, or None where there is no such file."""
    system, place = opened(path)
    return None if system.get_file_info(place).type == pa.fs.FileType.NotFound else _get(system, place)


def write_chunk(path: str, array: np.ndarray, dtype: str, frac_ndates: int) -> None:
    """One chunk file; its type and number of dates must be the grid's."""
    system, place = opened(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    _put(system, place, array, dtype, frac_ndates)


class Chunks(InputPartition):
    """Files that one task reads: their names, each with its key."""

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        super().__init__(None)
        self.files = files


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.keep, self.kind = options["path"].rstrip("/") + "/jdata", [], value_type(options.get("dtype", "<f8"))
        self.tasks = int(options.get("tasks", 1))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a key with values are met by file names; Spark keeps all others."""
        meets = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        place = {("frac_num",): 0, ("time_chunk",): 1}
        for f in filters:
            if type(f) in meets and f.attribute in place:
                self.keep.append((place[f.attribute], meets[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Chunks]:
        """Files in the order of their keys, as many for a task as its bytes allow; a large file has a task of its own."""
        system, place = opened(self.root)
        files = system.get_file_info(pa.fs.FileSelector(place, allow_not_found=True))
        found = [(f.base_name, *map(int, m.groups()), f.size + OPEN_BYTES) for f in files if (m := NAME.search(f.base_name))]
        kept = sorted((c for c in found if all(meets(c[1 + i], value) for i, meets, value in self.keep)), key=lambda c: c[1:3])
        most = min(TASK_BYTES, sum(c[3] for c in kept) // self.tasks)
        out, size = [Chunks([])], 0
        for *file, n in kept:
            if size and size + n > most:
                out.append(Chunks([]))
                size = 0
            out[-1].files.append(tuple(file))
            size += n
        return out

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        system, place = opened(self.root)
        chunks, size = [], 0
        for name, frac, chunk in partition.files:
            try:
                array = _get(system, f"{place}/{name}")
            except FileNotFoundError:
                continue
            if chunks and size + array.nbytes > BATCH_BYTES:
                yield self._batch(chunks)
                chunks, size = [], 0
            chunks.append((frac, chunk, array))
            size += array.nbytes
        if chunks:
            yield self._batch(chunks)

    def _batch(self, chunks: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        ints = zip(*((frac, chunk, *array.shape) for frac, chunk, array in chunks))
        data = lists([pa.array(array.reshape(-1)) for _, _, array in chunks], ARROW[self.kind])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in ints), data], names=["frac_num", "time_chunk", "h", "w", "nd", "data"])


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.dtype, self.nd = options["path"].rstrip("/") + "/jdata", options.get("dtype", "<f8"), int(options.get("frac_ndates", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, place = opened(self.root)
        system.create_dir(place, recursive=True)
        stored = pa.from_numpy_dtype(np.dtype(self.dtype).newbyteorder("="))
        for batch in iterator:
            keys = zip(*(batch.column(n).to_pylist() for n in ("frac_num", "time_chunk", "h", "w", "nd")))
            for (frac, chunk, *shape), data in zip(keys, batch.column("data")):
                values = data.values.cast(stored)  # an error where a value doesn't fit
                if values.null_count and not pa.types.is_floating(stored):
                    raise ValueError(f"chunk {frac}.{chunk} has a null")
                array = values.to_numpy(zero_copy_only=False).astype(self.dtype).reshape(shape)
                _put(system, f"{place}/{frac}.{chunk}.jdata", array, self.dtype, self.nd)
        return WriterCommitMessage()


class JData(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jdata"

    def schema(self) -> str:
        return SCHEMA.format(value_type(self.options.get("dtype", "<f8")))

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JData)


def read_chunks(spark: SparkSession, root: str, dtype: str = "<f8") -> DataFrame:
    register(spark)
    return spark.read.format("jdata").option("dtype", dtype).option("tasks", str(spark.sparkContext.defaultParallelism)).load(root)


def write_chunks(chunks: DataFrame, root: str, dtype: str, frac_ndates: int) -> None:
    """Chunks (frac_num, time_chunk, h, w, nd, data) as files; a retried task writes the same files again, each in one step."""
    register(chunks.sparkSession)
    rows = chunks.selectExpr("frac_num", "time_chunk", "h", "w", "nd", f"cast(data as array<{value_type(dtype)}>) as data")
    rows.write.format("jdata").option("dtype", dtype).option("frac_ndates", str(frac_ndates)).mode("append").save(root)
