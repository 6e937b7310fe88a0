"""The two fixed world layouts: the sinusoidal 250 m grid and the geographic land-cover grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.addressing import int_div
from tidegrid.functions.geo import GEOGRAPHIC, SINUSOIDAL


@dataclass(frozen=True)
class Layout:
    tile_width: int
    tile_height: int
    tiles_x: int
    tiles_y: int
    cell_width: int
    cell_height: int
    pixel_x: float
    pixel_y: float
    projection: str

    @property
    def width(self) -> int:
        return self.tiles_x * self.tile_width

    @property
    def height(self) -> int:
        return self.tiles_y * self.tile_height

    @property
    def cells_x(self) -> int:
        return self.width // self.cell_width

    @property
    def cells_y(self) -> int:
        return self.height // self.cell_height

    @property
    def per_tile_x(self) -> int:
        return self.tile_width // self.cell_width

    @property
    def per_tile_y(self) -> int:
        return self.tile_height // self.cell_height

    @property
    def geot(self) -> tuple[float, ...]:
        """Its origin is half the grid away from that of the projection."""
        return (-self.tile_width * self.pixel_x * self.tiles_x / 2, self.pixel_x, 0.0, -self.tile_height * self.pixel_y * self.tiles_y / 2, 0.0, self.pixel_y)


#: Tile sizes, numbers of tiles, cell sizes and pixel sizes of the layouts.
MODIS = Layout(4800, 4800, 36, 18, 400, 400, 231.65635826374995, -231.65635826395834, SINUSOIDAL)
GLCF = Layout(2880, 3840, 30, 10, 2880, 3840, 0.004166666666667, -0.004166666666667, GEOGRAPHIC)
#: Fixed value: the rows of the geographic zones from north to south.
ZONE_ROWS = "XWVUTSRQPNMLKJHGFEDC"


def tile_cells(tiles: DataFrame, h: str = "h", v: str = "v", layout: Layout = MODIS) -> DataFrame:
    """Adds ``i``, ``j`` and ``cell``: a row for each cell of each tile, row by row."""
    rows = tiles.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(layout.per_tile_y - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(layout.per_tile_x - 1))))
    i, j = F.col(v) * layout.per_tile_y + F.col("_i"), F.col(h) * layout.per_tile_x + F.col("_j")
    return rows.withColumns({"i": i.cast("int"), "j": j.cast("int"), "cell": (i * layout.cells_x + j).cast("int")}).drop("_i", "_j")


def cell_tile(cell: Column | str, layout: Layout = MODIS) -> tuple[Column, Column]:
    """(h, v) of the tile that a cell lies in."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    h = int_div(cell % layout.cells_x, layout.per_tile_x)
    return h.cast("int"), int_div(cell, layout.cells_x * layout.per_tile_y).cast("int")


def tile_xy(h: Column | str, v: Column | str, layout: Layout = MODIS) -> tuple[Column, Column]:
    """The top left pixel of a tile."""
    h, v = (F.col(c) if isinstance(c, str) else c for c in (h, v))
    return (h * layout.tile_width).cast("int"), (v * layout.tile_height).cast("int")


def cell_in_tile(cell: Column | str, h: Column | str, v: Column | str, layout: Layout = MODIS) -> dict[str, Column]:
    """Half-open row and column ranges (i0, i1, j0, j1) of a cell within its tile; a cell of another tile is an error."""
    cell, h, v = (F.col(c) if isinstance(c, str) else c for c in (cell, h, v))
    i = int_div(cell, layout.cells_x) - v * layout.per_tile_y
    j = cell % layout.cells_x - h * layout.per_tile_x
    inside = (i >= 0) & (i < layout.per_tile_y) & (j >= 0) & (j < layout.per_tile_x)
    wrong = F.raise_error(F.concat(F.lit("cell outside tile: "), cell.cast("string"))).cast("bigint")
    i, j = F.when(inside, i).otherwise(wrong), F.when(inside, j).otherwise(wrong)
    return {
        "i0": (i * layout.cell_height).cast("int"),
        "i1": ((i + 1) * layout.cell_height).cast("int"),
        "j0": (j * layout.cell_width).cast("int"),
        "j1": ((j + 1) * layout.cell_width).cast("int"),
    }


def glcf_cell(tile: Column | str) -> Column:
    """The cell of a land-cover tile name such as HG5152: half the row of its first letter, half the first column number less one."""
    tile = F.col(tile) if isinstance(tile, str) else tile
    row = F.instr(F.lit(ZONE_ROWS), F.upper(F.substring(tile, 1, 1))) - 1
    i = F.when(row >= 0, int_div(row, 2))
    j = int_div(F.substring(tile, 3, 2).cast("int") - 1, 2)
    return (i * GLCF.cells_x + j).cast("int")
