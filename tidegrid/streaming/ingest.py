"""Streams of observations into a stored grid, and windowed sums over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidegrid.operators.grid import Grid, keyed_cells
from tidegrid.plans.header import Header
from tidegrid.sources.store import CELLS, load, rewrite


def cells_of_stream(observations: DataFrame, header: Header) -> DataFrame:
    """Observations (x, y, ts_ms, value) as keyed cells, aligned to the header's dates; others are left out."""
    axis = observations.sparkSession.createDataFrame(list(enumerate(header.timestamps_ms)), "t int, ts_ms bigint")  # a row for each date
    inside = (F.col("x") >= 0) & (F.col("x") < header.width) & (F.col("y") >= 0) & (F.col("y") < header.height)
    return keyed_cells(observations.where(inside).join(F.broadcast(axis), "ts_ms").select("y", "x", "t", "value"), header)


def ingest(observations: DataFrame, header: Header, checkpoint: str) -> StreamingQuery:
    """Merges a stream of observations into the stored grid at the header's root, batch by batch.

    A batch rewrites only the time chunks and ranges of fractions that it touches; a later value of a cell replaces the earlier one, so a batch that is
    run again after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        grid = load(spark, header.root)
        new = cells_of_stream(batch, header).groupBy("y", "x", "t", "frac_num", "time_chunk").agg(F.max("value").alias("value"))
        old = grid.cells.join(new.select("y", "x", "t"), ["y", "x", "t"], "left_anti")
        rewrite(Grid(header, old.select(*CELLS).unionByName(new.select(*CELLS))), new)

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_sums(events: DataFrame, time: str, value: str, keys: list[str], window: str, lateness: str) -> DataFrame:
    """(window_start, keys, n, total) over event time; rows later than ``lateness`` are left out and state is let go."""
    marked = events.withWatermark(time, lateness)
    grouped = marked.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")
