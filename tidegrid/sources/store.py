"""Grids in storage: a header file and cells in Parquet, partitioned by time chunk and range of fractions, clustered by fraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.addressing import int_div
from tidegrid.operators.grid import Grid
from tidegrid.plans.header import Header

#: Fixed value: the name of a grid's header file.
HEADER_FILE = "header.jghdr3"
#: Fractions of a stored partition: what an append or a batch of a stream rewrites at least.
RANGE = 64
CELLS = ["y", "x", "t", "value", "frac_num", "time_chunk"]


def uri(path: str) -> str:
    """``fs://`` paths are local ones; hdfs:// and bare paths stay as they are."""
    return "file://" + path[len("fs://") :] if path.startswith("fs://") else path


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(uri(path))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, place = _file(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    """Deletes a file or folder, but never a root."""
    system, place = _file(spark, path)
    if place.getParent() is None:
        raise ValueError("a root isn't deleted")
    return system.delete(place, recursive)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(uri(path), wholetext=True).first()["value"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced in one step: written beside its place, then renamed over it."""
    system, place = _file(spark, path)
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    place = system.makeQualified(place)
    beside = fs.Path(place.toString() + ".new")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    how = context._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(place.toUri(), context._jsc.hadoopConfiguration()).rename(beside, place, how)


def save_header(spark: SparkSession, header: Header) -> None:
    write_text(spark, f"{header.root}/{HEADER_FILE}", header.to_json())


def load_header(spark: SparkSession, root: str) -> Header:
    return Header.from_json(read_text(spark, f"{root}/{HEADER_FILE}"), root)


def header_exists(spark: SparkSession, root: str) -> bool:
    return exists(spark, f"{root}/{HEADER_FILE}")


def cells_path(root: str) -> str:
    return uri(f"{root}/cells")


def write_cells(grid: Grid, cells: DataFrame | None = None, mode: str = "append") -> None:
    """Cells by time chunk and range of fractions, sorted, so that row groups prune by fraction and pixel.

    Each fraction of a time chunk is in one task, and adaptive execution joins small ones, so tasks follow the data's size.
    ``overwrite`` replaces the partitions that have cells here, and no other.
    """
    cells = grid.cells if cells is None else cells
    rows = cells.select(*[F.col(c).cast("int").alias(c) for c in ("y", "x", "t")], F.col("value").cast(grid.header.value_type).alias("value"), *[F.col(c).cast("int").alias(c) for c in ("frac_num", "time_chunk")])
    rows = rows.withColumn("frac_range", int_div("frac_num", RANGE).cast("int")).repartition("time_chunk", "frac_num")
    writer = rows.sortWithinPartitions("time_chunk", "frac_range", "frac_num", "y", "x", "t").write.partitionBy("time_chunk", "frac_range")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode(mode).parquet(cells_path(grid.header.root))


def rewrite(grid: Grid, new: DataFrame) -> None:
    """Writes the partitions that cells of ``new`` lie in from all of ``grid``'s cells there; what is read for it is staged first, then removed."""
    parts = ["time_chunk", "frac_range"]
    ranged = grid.cells.withColumn("frac_range", int_div("frac_num", RANGE).cast("int"))
    touched = new.select("time_chunk", int_div("frac_num", RANGE).cast("int").alias("frac_range")).distinct()
    staged = f"{uri(grid.header.root)}/staged-{uuid.uuid4().hex}"
    ranged.join(touched, parts, "left_semi").select(*CELLS).write.parquet(staged)
    write_cells(Grid(grid.header, grid.spark.read.parquet(staged)), mode="overwrite")
    delete(grid.spark, staged, True)


def save(grid: Grid) -> None:
    """All of a new grid: cells first, then the header that makes them visible."""
    write_cells(grid, mode="overwrite")
    save_header(grid.cells.sparkSession, grid.header)


def load(spark: SparkSession, root: str) -> Grid:
    """A stored grid, lazily; dates past the header's last are not yet published and stay out."""
    header = load_header(spark, root)
    schema = f"y int, x int, t int, value {header.value_type}, frac_num int, time_chunk int"
    if not exists(spark, f"{root}/cells"):
        return Grid(header, spark.createDataFrame([], schema))
    cells = spark.read.schema(schema + ", frac_range int").parquet(cells_path(root))
    return Stored(header, cells.where(F.col("t") < header.ndates).select(*CELLS, "frac_range"))


class Stored(Grid):
    """A grid as it is stored: windows name the partitions of their fractions too."""

    def __init__(self, header: Header, ranged: DataFrame) -> None:
        super().__init__(header, ranged.drop("frac_range"))
        object.__setattr__(self, "ranged", ranged)

    def window(self, xy_from: tuple[int, int], xy_to: tuple[int, int], t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        ranges = sorted({f // RANGE for f in self.header.fracs_for_rect(*xy_from, *xy_to)})
        pruned = self.ranged.where(F.col("frac_range").isin(ranges)) if len(ranges) <= 1000 else self.ranged.where(F.col("frac_range").between(ranges[0], ranges[-1]))
        return Grid(self.header, pruned.drop("frac_range")).window(xy_from, xy_to, t_from, t_to)


def append(root: str, timestamps_ms: list[int], source: DataFrame) -> Grid:
    """Appends dates to a stored grid: new cells are added to their chunks, then the header is published.

    Only ranges of fractions that have new cells are rewritten. A run that was cut off before the header may be repeated: its
    cells lie past the header's dates and are replaced by the same ones.
    """
    from tidegrid.operators.lifecycle import append_dates

    spark = source.sparkSession
    old = load(spark, root)
    grid, new = append_dates(old, timestamps_ms, source)
    if grid.header.ndates == old.header.ndates:
        return old
    rewrite(grid, new)  # chunks that are filled up are read and rewritten, range by range
    save_header(spark, grid.header)
    return load(spark, root)
