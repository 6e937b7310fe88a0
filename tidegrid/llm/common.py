"""What several operators share: tables in the shared folder, prefix sums, components."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegrid.plans.session import new_path, shared_folder, ship_package

#: Rows and bytes in an Arrow batch at most: texts are long, and a batch is held whole.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get batches of at most BATCH_ROWS rows and, but for a single row, BATCH_BYTES; they can import this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder.

    This cuts the lineage: a lost executor costs no more than the stage at hand, and the
    rows are computed once whatever number of plans reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Removes the tables that this application has written to the shared folder. Results that read them must be written first."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidegrid/{context.applicationId}")
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def prefix_sums(df: DataFrame, group: list[str], order: str, values: dict[str, str], ties: list[str], bucket_rows: int = 4_000) -> DataFrame:
    """Adds, for each name in ``values``, the sum of the named column over the rows that stand before.

    ``order`` is a column of doubles in [0, 1), spread evenly in each group except for ties;
    rows stand by it, then by ``ties``. No task holds a group: a group is cut along the order into
    buckets of about ``bucket_rows`` rows by an exact count, sums of the buckets are accumulated
    (one thin row a bucket), and only rows of one bucket are sorted together.
    """
    def same(extra: list[str]) -> Column:
        cond = F.col("l." + group[0]).eqNullSafe(F.col("r." + group[0]))
        for g in group[1:]:
            cond = cond & F.col("l." + g).eqNullSafe(F.col("r." + g))
        for e in extra:
            cond = cond & (F.col("l." + e) == F.col("r." + e))
        return cond

    counts = df.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(bucket_rows))).alias("_n"))
    cut = F.least(F.floor(F.col("l." + order) * F.col("r._n")), F.col("r._n") - 1).alias("_bucket")
    rows = df.alias("l").join(counts.alias("r"), same([])).select("l.*", cut)
    per = rows.groupBy(*group, "_bucket").agg(*[F.sum(c).alias("_sum_" + v) for v, c in values.items()])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "_bucket", *[F.coalesce(F.sum("_sum_" + v).over(before), F.lit(0)).alias("_before_" + v) for v in values])
    joined = rows.alias("l").join(per.alias("r"), same(["_bucket"])).select("l.*", *["r._before_" + v for v in values])
    within = Window.partitionBy(*group, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumns({v: F.col("_before_" + v) + F.coalesce(F.sum(c).over(within), F.lit(0)) for v, c in values.items()})
    return joined.drop("_bucket", *["_before_" + v for v in values])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is one node of it.

    Each round every node takes the smallest of itself and its neighbours by that round's order as
    its parent, and the graph is contracted to the parents. From the second round on the order is
    a hash that changes with the round, so that chains shrink by a constant factor too; rounds go on
    until no edge is left. All is done by joins and aggregates; nothing but whether a row is left comes to the driver.
    """
    cur = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for rnd in count():
        if not cur.take(1):
            break

        def rank(c: str, rnd: int = rnd) -> Column:
            return F.xxhash64(F.col(c), F.lit(rnd)) if rnd else F.col(c)

        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("b"))
        parents = stored(least.select("a", F.least(F.col("m"), own)["b"].alias("p")), "parents")
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = labels.join(parents.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        pa, pb = parents.select("a", F.col("p").alias("pa")), parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = cur.join(pa, "a").join(pb, "b").where("pa <> pb")
        cur = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        labels = stored(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels
