"""Small text sources and sinks: date lists, properties, listing pages, arrays as cells."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.dates import format_date, parse_date
from tidegrid.plans.header import SPARK_TYPES
from tidegrid.sources.jdata import opened


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """(ts_ms) of a file with a date yyyy_MM_dd on each line, in order; a line that is no date is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    wrong = F.raise_error(F.concat(F.lit("not a date: "), F.col("line"))).cast("bigint")
    return lines.select(F.coalesce(parse_date("line"), wrong).alias("ts_ms")).orderBy("ts_ms")


def write_bytes(path: str, data: bytes) -> None:
    """A small file such as a shapefile or raster, on any file system."""
    system, place = opened(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place, compression=None) as f:
        f.write(data)


def write_dates(dates: DataFrame, path: str) -> None:
    """One file with a line for each date (ts_ms): a list as short as a time axis."""
    dates.select(format_date("ts_ms").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines; those that start with ; are comments."""
    lines = (r["value"].strip() for r in spark.read.text(path).collect())
    pairs = (line.partition("=") for line in lines if line and not line.startswith(";"))
    return {k.strip(): v.strip() for k, _, v in pairs}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of mirrored listing pages."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files in a folder's folders, one level down (a folder for each year); contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def cells_of_array(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """(y, x, t, value) of an array in memory: (height, width) or (height, width, dates)."""
    array = array[:, :, None] if array.ndim == 2 else array
    if array.ndim != 3:
        raise ValueError("an array of two or three dimensions is needed")
    import pandas as pd

    y, x, t = (a.reshape(-1).astype("int32") for a in np.indices(array.shape))
    kind = SPARK_TYPES[np.dtype(array.dtype).str[1:]]
    return spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "t": t, "value": array.reshape(-1)}), f"y int, x int, t int, value {kind}")


def asset_path(name: str) -> str:
    """The path of a file that comes with the package."""
    return str(Path(__file__).resolve().parents[1] / "assets" / name)
