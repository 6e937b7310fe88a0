"""Per-pixel array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gather(values: Column | str, index: Column | str) -> Column:
    """The element at a position from 0; null past the end, also under ANSI."""
    values, index = (F.col(c) if isinstance(c, str) else c for c in (values, index))
    return F.get(values, index.cast("int"))


def masked(value: Column | str, nodata: float | None) -> Column:
    """Null instead of the no-data value."""
    value = F.col(value) if isinstance(value, str) else value
    return value if nodata is None else F.nullif(value, F.lit(nodata))


def filled(value: Column | str, nodata: float | None, kind: str) -> Column:
    """The no-data value, or 0 where a grid has none, instead of null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(0 if nodata is None else nodata).cast(kind))
