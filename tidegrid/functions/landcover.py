"""Land-cover classes: names and colours as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class, name, red, green, blue.
CLASSES = [
    (0, "Water", 31, 120, 180),
    (1, "Evergreen needleleaf forest", 51, 160, 44),
    (2, "Evergreen broadleaf forest", 51, 121, 44),
    (3, "Deciduous needleleaf forest", 178, 223, 138),
    (4, "Deciduous broadleaf forest", 178, 188, 138),
    (5, "Mixed forest", 90, 160, 44),
    (6, "Closed shrublands", 119, 160, 44),
    (7, "Open shrublands", 104, 160, 44),
    (8, "Woody savannas", 205, 191, 111),
    (9, "Savannas", 202, 160, 44),
    (10, "Grasslands", 51, 219, 44),
    (11, "Permanent wetlands", 166, 206, 227),
    (12, "Croplands", 255, 127, 0),
    (13, "Urban and built-up", 106, 106, 106),
    (14, "Cropland/Natural vegetation mosaic", 255, 77, 0),
    (15, "Snow and ice", 36, 243, 253),
    (16, "Barren or sparsely vegetated", 220, 240, 0),
    (254, "Unclassified", 255, 0, 255),
    (255, "Fill value", 255, 0, 255),
]


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class int, class_name string, r int, g int, b int")


def with_names(cells: DataFrame, column: str = "class") -> DataFrame:
    """Adds class_name, null for an unknown class. The dimension's size is fixed."""
    dim = classes(cells.sparkSession).select(F.col("class").alias(column), "class_name")
    return cells.join(F.broadcast(dim), column, "left")


def with_rgb(cells: DataFrame, column: str = "class") -> DataFrame:
    """Adds r, g, b; black for an unknown class."""
    dim = classes(cells.sparkSession).select(F.col("class").alias(column), "r", "g", "b")
    joined = cells.join(F.broadcast(dim), column, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("r", "g", "b")})


def present(cells: DataFrame, column: str = "class") -> DataFrame:
    """The distinct classes with their names: what a legend shows."""
    return with_names(cells.select(column).distinct(), column)
