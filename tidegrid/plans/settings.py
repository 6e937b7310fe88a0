"""Where inputs and grids are: from the session's settings, never from code that is read and run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Folders under ``data_dir``; each may be set alone as spark.tidegrid.<name>."""

    data_dir: str
    worldgrid: str
    source_dir: str
    landcover_dir: str

    @classmethod
    def of(cls, spark: SparkSession, data_dir: str | None = None) -> Settings:
        get = lambda name, other: spark.conf.get(f"spark.tidegrid.{name}", other)
        base = data_dir or get("data_dir", None)
        if base is None:
            raise ValueError("set spark.tidegrid.data_dir or pass a data folder")
        base = base.rstrip("/")
        return cls(base, get("worldgrid", f"{base}/worldgrid"), get("source_dir", f"{base}/input/ndvi"), get("landcover_dir", f"{base}/input/landcover"))
