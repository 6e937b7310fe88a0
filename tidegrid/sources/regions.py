"""Named regions: GeoJSON collections, lookups, shapefiles, and polygons as GeoJSON."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import geo
from tidegrid.operators.grid import Grid
from tidegrid.operators.mask import rasterize_like
from tidegrid.sources.text import write_bytes

#: The three closed rings (lng, lat) of the continents collection.
CONTINENTS = {
    "southamerica": [[-91.87388431130077, 9.957058242804091], [-29.089128992937567, 11.523606136880481], [-30.085712410689375, -51.046465057441402], [-94.265684513905086, -51.60692546444416], [-91.87388431130077, 9.957058242804091]],
    "africa": [[-23.408603511752318, 30.99696654356876], [56.617044933716969, 30.825960483947128], [58.012261718569491, -22.663139722079659], [-23.009970144651597, -22.846942872188063], [-23.408603511752318, 30.99696654356876]],
    "asia": [[85.517964048519062, 29.533759252956511], [160.162062038128653, 30.311115623388151], [160.8596704305549, -9.973023726230984], [84.920013997867983, -10.267346755777664], [85.517964048519062, 29.533759252956511]],
}
RING = "array<struct<lat:double,lng:double>>"


def read_geojson(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """(collection, name, ring) of the polygon features of a GeoJSON file: outer rings as (lat, lng)."""
    kind = "features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).where("f.geometry.type = 'Polygon'")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
    return features.select(F.lit(collection).alias("collection"), F.col("f.properties.name").alias("name"), ring.alias("ring"))


def continents(spark: SparkSession) -> DataFrame:
    rows = [("continents", name, [(lat, lng) for lng, lat in ring]) for name, ring in CONTINENTS.items()]
    return spark.createDataFrame(rows, f"collection string, name string, ring {RING}")


class Regions:
    """Collections that are registered by name; a region is ``collection.region``."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def register(self, more: DataFrame) -> Regions:
        return Regions(self.table.unionByName(more))

    def names(self, collection: str) -> list[str]:
        return [r["name"] for r in self.table.where(F.col("collection") == collection).select("name").orderBy("name").collect()]

    def polygon(self, spec: str) -> list[tuple[float, float]]:
        """The ring (lat, lng) of ``collection.region``."""
        collection, _, name = spec.partition(".")
        if not self.table.where(F.col("collection") == collection).take(1):
            raise ValueError(f"unknown collection {collection}")
        found = self.table.where((F.col("collection") == collection) & (F.col("name") == name)).take(1)
        if not found:
            raise ValueError(f"unknown region {name}")
        return [(p["lat"], p["lng"]) for p in found[0]["ring"]]


def parse_region_argument(text: str) -> tuple[str, list[str]]:
    """(file, names) of an argument such as ``file.geojson:r1,r2``."""
    path, _, names = text.rpartition(":")
    if not path or not names:
        raise ValueError("expected <file>:<region>[,<region>...]")
    return path, names.split(",")


def regions_of_argument(spark: SparkSession, text: str) -> DataFrame:
    path, names = parse_region_argument(text)
    return read_geojson(spark, path, path).where(F.col("name").isin(names))


def to_geojson(polygons: DataFrame, properties: list[str], ring: str = "ring") -> DataFrame:
    """(value): a GeoJSON feature for each row, its ring closed and in (lng, lat) order."""
    r = F.col(ring)
    closed = F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    coordinates = F.array(F.transform(closed, lambda p: F.array(p["lng"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return polygons.select(F.to_json(feature).alias("value"))


def shapefile_rings(data: bytes, nulls: bool = False) -> list[list[tuple[float, float]] | None]:
    """Outer rings (x, y) of the polygons of a .shp file; other shapes and open rings are errors, null shapes are passed over or, with ``nulls``, None."""
    if len(data) < 100:
        raise ValueError("no shapefile")
    code, length = struct.unpack(">i", data[:4])[0], struct.unpack(">i", data[24:28])[0] * 2
    if code != 9994:
        raise ValueError("no shapefile")
    rings, at = [], 100
    while at < length:
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            rings += [None] * nulls
            continue
        if kind != 5:
            raise ValueError(f"shape type {kind} isn't a polygon")
        parts, points = struct.unpack("<ii", body[36:44])
        starts = struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts])
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        ring = list(zip(flat[::2], flat[1::2]))[: starts[1] if parts > 1 else points]
        if ring[0] != ring[-1]:
            raise ValueError("an open ring")
        rings.append(ring)
    return rings


def _shape_head(words: int, rings: list[list[tuple[float, float]]]) -> bytes:
    xs, ys = zip(*([p for r in rings for p in r] or [(0.0, 0.0)]))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)


def _shape_records(rings: list[list[tuple[float, float]]]) -> list[bytes]:
    out = []
    for i, ring in enumerate(rings, 1):
        ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        xs, ys = zip(*ring)
        body = struct.pack("<i4d2ii", 5, min(xs), min(ys), max(xs), max(ys), 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        out.append(struct.pack(">2i", i, len(body) // 2) + body)
    return out


def write_shapefile(rings: list[list[tuple[float, float]]]) -> bytes:
    """A .shp file of polygons (x, y), one ring each, closed here if they aren't."""
    records = b"".join(_shape_records(rings))
    return _shape_head(50 + len(records) // 2, rings) + records


def shape_index(rings: list[list[tuple[float, float]]]) -> bytes:
    """The .shx file beside it: where each record stands and how long it is, in words of two bytes."""
    entries, at = b"", 50
    for record in _shape_records(rings):
        entries += struct.pack(">2i", at, len(record) // 2 - 4)
        at += len(record) // 2
    return _shape_head(50 + 4 * len(rings), rings) + entries


def write_dbf(fields: list[tuple[str, str]], rows: list[dict[str, object]]) -> bytes:
    """A .dbf file of fields (name, ``int``, ``float`` or ``str``): names are cut to ten bytes, nulls are blank.

    A field is as wide as its widest value, of 254 bytes at most; longer text is cut at a whole character.
    """
    kinds = {"int": (b"N", 0), "float": (b"N", 9), "str": (b"C", 0)}
    places = [name.encode("utf-8")[:10] for name, _ in fields]
    if len(set(places)) < len(places) or any(kind not in kinds for _, kind in fields):
        raise ValueError("fields need different names of ten bytes and known types")

    def text(value: object, kind: str) -> bytes:
        if value is None:
            return b""
        plain = str(int(value)) if kind == "int" else f"{float(value):.9f}" if kind == "float" else str(value)
        return plain.encode("utf-8")[:254].decode("utf-8", "ignore").encode("utf-8")

    table = [[text(row.get(name), kind) for name, kind in fields] for row in rows]
    widths = [max([1, *(len(row[k]) for row in table)]) for k in range(len(fields))]
    described = b"".join(place.ljust(11, b"\0") + kinds[kind][0] + bytes(4) + bytes([width, kinds[kind][1]]) + bytes(14) for place, (_, kind), width in zip(places, fields, widths))
    head = struct.pack("<4BIHH20x", 3, 95, 7, 26, len(rows), 33 + len(described), 1 + sum(widths)) + described + b"\r"
    put = lambda value, width, kind: value.ljust(width) if kind == "str" else value.rjust(width)
    return head + b"".join(b" " + b"".join(put(v, w, kind) for v, w, (_, kind) in zip(row, widths, fields)) for row in table) + b"\x1a"


def save_shapefile(path: str, rings: list[list[tuple[float, float]]], fields: list[tuple[str, str]] | None = None, rows: list[dict[str, object]] | None = None, sr_wkt: str = "") -> None:
    """All files of a shapefile: polygons of (lat, lng), or (Y, X) of ``sr_wkt``, their index, attributes and spatial reference.

    Without fields the attribute is a number, ``FID``.
    """
    if fields is None:
        fields, rows = [("FID", "int")], [{"FID": i} for i in range(len(rings))]
    if rows is None or len(rows) != len(rings):
        raise ValueError("a row of attributes for each polygon is needed")
    points = [[(x, y) for y, x in ring] for ring in rings]
    stem = path.removesuffix(".shp")
    parts = {".shp": write_shapefile(points), ".shx": shape_index(points), ".dbf": write_dbf(fields, rows), ".prj": sr_wkt.encode("utf-8"), ".cpg": b"UTF-8"}
    for suffix, data in parts.items():
        if data:
            write_bytes(stem + suffix, data)


def dbf_rows(data: bytes, encoding: str = "latin-1") -> list[dict[str, str]]:
    """The attribute rows of a .dbf file, as stripped text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "ignore"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        raw, place, row = data[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            row[name] = raw[place : place + width].decode(encoding, "ignore").strip()
            place += width
        rows.append(row)
    return rows


def _parts(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The files of a shapefile by suffix, on any file system that Spark reads."""
    folder, _, name = path.removesuffix(".shp").rpartition("/")
    pattern = re.sub(r"([\[\]{}?*\\])", r"\\\1", name) + ".{shp,dbf,prj,cpg}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder or ".").select("path", "content").collect()
    return {r["path"].rpartition(".")[2]: bytes(r["content"]) for r in found}


def read_shapes(spark: SparkSession, path: str, target: str = geo.GEOGRAPHIC) -> DataFrame:
    """(number, ring, attributes) of a shapefile's polygons, in file order by number.

    Rings are (lat, lng) in degrees, or (Y, X) of another ``target`` projection, whatever the file's own: its .prj names it,
    and without one it is geographic. A null shape is passed over with its attributes. Files are read whole on the driver:
    polygons that no .shp file can hold (2 GB) belong into a table.
    """
    parts = _parts(spark, path)
    source = geo.projection_of(parts.get("prj", b"").decode("utf-8", "ignore"))
    rings = shapefile_rings(parts.get("shp", b""), nulls=True)
    named = dbf_rows(parts["dbf"], parts.get("cpg", b"latin-1").decode("ascii").strip()) if "dbf" in parts else [{} for _ in rings]
    rows = [(i, [(y, x) for x, y in ring], attrs) for i, (ring, attrs) in enumerate(zip(rings, named)) if ring is not None]
    shapes = spark.createDataFrame(rows, f"number int, ring {RING}, attributes map<string,string>")
    if source == target:
        return shapes

    def moved(p: Column) -> Column:
        x, y = geo.project(*geo.unproject(p["lng"], p["lat"], source), target)
        return F.struct(y.alias("lat"), x.alias("lng"))

    return shapes.withColumn("ring", F.transform("ring", moved))


def read_shapefile(spark: SparkSession, path: str, collection: str, name: str | None = None) -> DataFrame:
    """(collection, name, ring) of a shapefile in degrees; names are those of its attribute, or numbers."""
    number = F.col("number").cast("string")
    named = number if name is None else F.coalesce(F.col("attributes")[name], number)
    return read_shapes(spark, path).select(F.lit(collection).alias("collection"), named.alias("name"), "ring")


def rasterize_shapefile(model: Grid, path: str, attribute: str | None = None, nodata: int = 0, all_touched: bool = False) -> DataFrame:
    """(y, x, value) of a shapefile's polygons on a model raster: 1, or what each polygon's whole-number attribute says."""
    shapes = read_shapes(model.spark, path).orderBy("number").collect()
    burn = 1 if attribute is None else [int(float(r["attributes"][attribute])) for r in shapes]
    return rasterize_like(model, [[(p["lat"], p["lng"]) for p in r["ring"]] for r in shapes], burn=burn, nodata=nodata, all_touched=all_touched)
