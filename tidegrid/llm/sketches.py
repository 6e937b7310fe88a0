"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame operations only.

A sketch is the sorted array of the SIZE smallest distinct 32-bit hashes of a text's shingles of WIDTH words.
The sketch of a union is the bottom of the united sketches, so sketches of parts merge. Below SIZE hashes a
sketch is the whole set and its estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import stored
from tidegrid.llm.shingles import rolling_hashes, white_words

WIDTH = 5
SIZE = 128
SPACE = float(1 << 32)
BUCKET_BYTES = 2 << 20  # of texts that stand together while each looks for its next
MOST_CUTS = 1 << 12  # sampled quantiles of the ids; ranges between them are divided evenly as far as bytes ask for
HASHES = 1 << 31
LEAST_ID = -(1 << 63)


def sketch(words: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a column of words."""
    hashes = F.transform(rolling_hashes(words, width), lambda h: F.shiftrightunsigned(h, 32))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) * SPACE / (F.element_at(a, -1) + 1))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of common among all distinct shingles; 1 for two texts without words. For columns, not expressions."""
    whole = (F.size(a) < size) & (F.size(b) < size)
    union = F.size(F.array_union(a, b))
    bottom = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.array_intersect(a, b)
    exact = F.size(common) / union
    drawn = F.size(F.array_intersect(common, bottom)) / F.lit(float(size))
    return F.when(union == 0, F.lit(1.0)).when(whole | (union < size), exact).otherwise(drawn)


def containment(likeness: Column, a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's distinct shingles that b has, from their resemblance."""
    na, nb = distinct_shingles(a, size), distinct_shingles(b, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), likeness * (na + nb) / ((likeness + 1) * na)))


def as_text(a: Column) -> Column:
    """Eight hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def merge(parts: DataFrame, keys: list[str], column: str = "sketch", size: int = SIZE) -> DataFrame:
    """(keys, column): sketches of the unions of all parts with equal keys.

    Nothing gathers a group's parts: what lies above the least full part's largest hash cannot be in the result,
    so only hashes up to it are compared, about SIZE for each part that holds low ones.
    """
    full = F.when(F.size(column) >= size, F.element_at(column, -1))
    limits = parts.groupBy(*keys).agg(F.min(full).alias("_limit"))
    hashes = parts.select(*keys, F.explode(column).alias("_hash")).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col("p." + k).eqNullSafe(F.col("l." + k))
    low = hashes.alias("p").join(limits.alias("l"), cond).where("_limit is null or _hash <= _limit").select(*["p." + k for k in keys], "_hash")
    first = low.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).where(F.col("_place") <= size)
    merged = first.groupBy(*keys).agg(F.sort_array(F.collect_set("_hash")).alias(column))
    groups = parts.select(*keys).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col("g." + k).eqNullSafe(F.col("m." + k))
    empty = F.array().cast("array<bigint>")
    return groups.alias("g").join(merged.alias("m"), cond, "left").select(*["g." + k for k in keys], F.coalesce(F.col("m." + column), empty).alias(column))


def _fewer(cuts: Column, n: int, or_equal: bool) -> Column:
    """How many of the ``n`` ascending cuts are less than the column ``key``, or no more than it, by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        cut = F.get(cuts, middle)
        before = cut <= F.col("key") if or_equal else cut < F.col("key")
        go = acc["low"] < acc["high"]
        return F.struct(F.when(go & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(go & ~before, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve)["low"]


def _bucket(cuts: list[int], parts: int = 1, least: int = LEAST_ID) -> Column:
    """The bucket of a row by its columns ``key`` and ``hash``, which never falls as (key, hash) grows.

    ``least`` is the smallest key but LEAST_ID. Cuts are ascending, with repeats: a range between two different ones is divided evenly into ``parts``, and a key that fills
    several quantiles is divided by the hash, into ``parts`` for each of them.
    """
    if not cuts:
        return F.lit(0).cast("bigint")
    n = len(cuts)
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # one literal, folded
    less, upto = _fewer(array, n, False), _fewer(array, n, True)
    low, high = F.greatest(F.get(array, upto - 1), F.lit(least)).cast("double"), F.get(array, upto).cast("double")
    along = F.when((upto == 0) | (upto == n) | (low >= high), F.lit(0.0)).otherwise((F.col("key").cast("double") - low) / (high - low))
    between = upto * parts + F.least(F.lit(parts - 1), F.floor(along * parts))
    steps = (upto - less) * parts
    within = (less + 1) * parts + F.least(steps - parts, F.floor(F.col("hash") * (steps - parts + 1) / F.lit(float(HASHES))))
    return F.when(upto - less > 1, within).otherwise(between).cast("bigint")


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_cuts: int = MOST_CUTS) -> tuple[DataFrame, Window]:
    """Rows (bucket, donor, key, hash, doc_id, text) in buckets by doc_id, and the window in which the following row is the next document.

    Documents stand by descending doc_id, null ids last, those of one id by a hash of the text, then the text; after the last
    comes the first. The buckets are ranges of ids, or of hashes of an id that many rows have, so the whole order is never
    in one task; only rows alike in id and text can't be parted. Each bucket ends with a copy (donor) of the next bucket's first document. Texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(LEAST_ID)), "hash": F.pmod(F.xxhash64("text"), F.lit(HASHES))})
    whole = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least")).first()
    total, least = whole["bytes"] or 0, LEAST_ID if whole["least"] is None else whole["least"]
    wanted = max(1, total // bucket_bytes)
    n = min(most_cuts, wanted)
    cuts: list[int] = []
    if n > 1:
        shares = F.split(F.lit(",".join(str(i / n) for i in range(1, n))), ",").cast("array<double>")
        cuts = sorted(rows.agg(F.percentile_approx("key", shares, F.lit(max(10_000, 4 * n))).alias("cuts")).first()["cuts"])
    rows = rows.withColumn("bucket", _bucket(cuts, -(-wanted // n), least))
    place = F.struct("key", "hash")
    tops = rows.groupBy("bucket").agg(F.max(place).alias("top"))  # a row for each bucket
    lower, everything = Window.orderBy("bucket"), Window.partitionBy()
    following = tops.select("bucket", F.coalesce(F.lag("top").over(lower), F.max("top").over(everything)).alias("top"))
    following = stored(following.select("bucket", "top.key", "top.hash"), "next-buckets")
    donors = rows.select("doc_id", "text", "key", "hash").join(following, ["key", "hash"]).groupBy("bucket", "key", "hash").agg(F.min("text").alias("text"))
    last = donors.select("bucket", F.lit(1).alias("donor"), "key", "hash", F.lit(None).cast("bigint").alias("doc_id"), "text")
    own = rows.select("bucket", F.lit(0).alias("donor"), "key", "hash", "doc_id", "text")
    return own.unionByName(last), Window.partitionBy("bucket").orderBy("donor", F.desc("key"), F.desc("hash"), "text")


def fingerprint_documents(docs: DataFrame, size: int = SIZE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, contained_next.

    The edited text is the document's with its last half of code points replaced by as many of the next one's
    first (all where it has fewer). Defined cases: a null text counts as empty; texts without words have an empty
    fingerprint, at likeness 1 to each other and 0 to others; a single document is its own next; repeated rows
    each come back, equal ids ordered by a hash of the text; a null doc_id comes last; an empty table gives no rows.
    """
    rows, window = with_next(docs, bucket_bytes)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(window))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "donor", "key", "hash", "doc_id", "text", edited.alias("edited"))
    rows = rows.withColumns({"words": white_words(F.col("text")), "edited_words": white_words(F.col("edited"))})
    rows = rows.withColumns({"sketch": sketch(F.col("words"), size), "edited_sketch": sketch(F.col("edited_words"), size)})
    rows = rows.select("bucket", "donor", "key", "hash", "doc_id", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(window)).where("donor = 0")
    rows = rows.withColumns({"near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), size), "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), size)})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        distinct_shingles(F.col("sketch"), size).alias("n_shingles"),
        containment(F.col("near_next"), F.col("sketch"), F.col("next_sketch"), size).alias("contained_next"),
    )
