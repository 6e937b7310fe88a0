"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by a key: the checksum of the text, then a hash of the id, so that equal texts stand
together and yet can be cut anywhere. Records alike in all that counts are one row with their number until each gets
its place. Size-weighted samples of the keys give quantile boundaries, which cut
the order into ranges; ranges that turn out to hold too many rows are cut again by samples of their own.
Exact sums over the ranges then give each record its place in the whole order, and the order is dealt to
the shards in equal runs of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import stored

SHARDS = 8
FAN = 64  # ranges that a range is cut into
SAMPLES = 64 * FAN  # sampled keys of a range that is cut, in expectation
RANGE_ROWS = 50_000  # a range of more rows is cut again
UNIT = 1 << 30


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(doc_id, size, text_crc32, key, copies, range, carried) for the different rows; at first all are one range."""
    text = F.col("text").cast("string")
    checksum = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        checksum.alias("text_crc32"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    if carry:  # what is carried may tell rows apart, so each stays one
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    else:
        rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    key = F.col("text_crc32") * F.lit(1 << 31) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    return rows.select("doc_id", "size", "text_crc32", key.alias("key"), "copies", F.lit(0).cast("bigint").alias("range"), *(["carried"] if carry else []))


def _splitters(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range, cuts): ascending keys that cut each of ``ranges`` (range, n, bytes, lo) into up to FAN parts.

    A row is drawn by its share of the range's bytes and, to a half, of its rows, so that parts are even in both. The least key
    above the range's lowest is a cut too: it parts a key that would fill all quantiles from what follows.
    """
    inside = rows.join(ranges, "range")
    expected = (F.col("size") * F.col("copies") / F.col("bytes") + 1 / F.col("n")) * F.lit(SAMPLES / 2.0)
    chance = F.pmod(F.xxhash64("doc_id", "text_crc32", "range"), F.lit(UNIT)) / F.lit(float(UNIT))
    weight = F.floor(expected) + (chance < expected - F.floor(expected)).cast("bigint")
    drawn = inside.select("range", "key", weight.alias("weight")).where("weight > 0")
    upto = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("weight").over(upto), F.lit(0)) * FAN / F.sum("weight").over(Window.partitionBy("range"))
    firsts = drawn.select("range", "key", F.floor(place).alias("part")).groupBy("range", "part").agg(F.min("key").alias("cut"))
    second = inside.where("key > lo").groupBy("range").agg(F.min("key").alias("cut"))
    cuts = firsts.where("part > 0").select("range", "cut").unionByName(second)
    return cuts.groupBy("range").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))


def _cut(cuts: Column) -> Column:
    """How many of the few ascending cuts are not above the key."""
    return F.size(F.filter(cuts, lambda c: c <= F.col("key"))).cast("bigint")


def ranged(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Stored rows with finer values of ``range``: numbers in key order, no range of more than ``range_rows`` rows unless its keys are all equal."""
    level = 0
    while True:
        sums = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = stored(sums.where((F.col("n") > range_rows) & (F.col("lo") < F.col("hi"))).select("range", "n", "bytes", "lo"), "overfull")
        if not over.take(1):
            return rows
        if level:  # keep the numbers small: count the ranges anew, a row for each
            number = sums.select("range", (F.row_number().over(Window.orderBy("range")) - 1).cast("bigint").alias("number"))
            rows = stored(rows.join(number, "range").drop("range").withColumnRenamed("number", "range"), "renumbered")
            over = stored(over.join(number, "range").drop("range").withColumnRenamed("number", "range"), "overfull")
        cuts = stored(_splitters(rows, over), "splitters")
        part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(_cut(F.col("cuts"))).cast("bigint")
        rows = rows.join(cuts, "range", "left").withColumn("range", F.col("range") * (FAN + 2) + part).drop("cuts")
        rows, level = stored(rows, "ranged"), level + 1


def shard_documents(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) and the struct ``carried`` of the columns in ``carry``.

    Law ``bytes``: a record goes to the shard in whose eighth (for 8 shards) of all bytes its middle lies, so shards
    differ by less than the largest record; equal texts stay together but for those that a boundary parts. Slots
    number a shard's records from 0 without gaps, in key order.

    Defined cases: a null text counts as empty (size 1, checksum 0); a null doc_id is hashed as null; repeated rows
    each get a slot, equal ones in either order; an empty table gives no rows; more shards than records leave shards empty.
    """
    rows = stored(keyed(docs, carry or []), "sharding-keys")
    rows = ranged(rows, range_rows)
    sums = stored(rows.groupBy("range").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("bytes")), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one thin row for each range
    whole = Window.partitionBy()
    offsets = sums.select(
        "range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(whole).alias("bytes_all"),
    )
    within = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bytes_before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(upto), F.lit(0))
    placed = rows.join(offsets, "range").withColumns({"start": start, "rank": F.col("rows_before") + F.coalesce(F.sum("copies").over(upto), F.lit(0))})
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    placed = placed.withColumns({"middle": (F.col("start") + F.col("copy") * F.col("size")) * 2 + F.col("size"), "rank": F.col("rank") + F.col("copy")})
    shard = F.least(F.lit(shards - 1), F.floor(F.col("middle") * F.lit(shards) / (F.col("bytes_all") * 2))).cast("int")
    columns = ["doc_id", "size", "text_crc32", "rank", shard.alias("shard"), *(["carried"] if carry else [])]
    placed = stored(placed.select(*columns), "sharded")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return placed.join(firsts, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["carried"] if carry else []),
    )
