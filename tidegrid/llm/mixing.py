"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame operations only.

Each source's documents stand in an order permuted by a hash. A mix takes the order from its start until the
source's target, going round once more where the target exceeds the source: that stretch is cut into blocks,
the source's exact quota. A tree splits the quotas of all sources among the output shards: at each node half of
the node's blocks, drawn without regard to the source, go to the left, so the counts by source follow the
multivariate hypergeometric law and add up exactly. A shard then takes its own run of each source's permuted
blocks, disjoint from the other shards', and its records are shuffled by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import prefix_sums, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words that the mix takes
MOST = 2  # times that a document is taken at most
DEPTH = 3  # of the tree: 2 ** DEPTH output shards
BLOCKS = 2048  # of the whole mix, about
SEED = 20240501
UNIT = 1 << 52
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of other than space and \\t-\\r; 0 for null. Every white character becomes a blank, then word starts are counted."""
    blanks = F.concat(F.lit(" "), F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.coalesce(F.regexp_count(blanks, F.lit(" [^ ]")), F.lit(0)).cast("bigint")


def row_key(text: Column) -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), text)


def targets(sources: DataFrame) -> DataFrame:
    """Adds sid, weight and target to rows (source, source_size).

    Targets in proportion to the weights, none above MOST times its source, what exceeds that shared anew: the
    target is the lesser of that limit and weight times a level, and the level is the one at which the targets
    add up to SHARE of all words. With the sources by the level at which they reach their limit, it is the
    first level that the sources from there on share without reaching theirs.
    """
    named = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    named = named.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("reach", F.col("cap") / F.col("weight"))
    ahead = Window.orderBy("reach", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("reach", "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    level = named.withColumn("level", left / F.sum("weight").over(rest))
    chosen = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "sid", "level"))).over(everything)["level"]
    return level.withColumn("target", F.least(F.col("cap"), F.coalesce(chosen * F.col("weight"), F.col("cap")))).select("source", "source_size", "sid", "weight", "target")


def split_quotas(quotas: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(shard, sid, quota): the exact quotas (sid, quota) split among 2 ** depth shards, level by level."""
    level = quotas.select(F.lit(0).cast("bigint").alias("node"), "sid", "quota")
    for at in range(depth):
        blocks = level.where("quota > 0").select("node", "sid", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota"))).alias("i"))
        node = Window.partitionBy("node")
        drawn = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed + at), "node", "sid", "i"), "sid", "i"))
        right = (drawn * 2 > F.count("*").over(node)).cast("bigint")
        sides = blocks.select((F.col("node") * 2 + right).alias("node"), "sid")
        level = sides.groupBy("node", "sid").agg(F.count("*").alias("quota"))
    return level.select(F.col("node").cast("int").alias("shard"), "sid", "quota")


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size, copies): the distinct rows of the table."""
    text = F.col("text").cast("string")
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), row_key(text).alias("row"), n_words(text).alias("size"))
    return stored(thin.groupBy("doc_id", "source", "row", "size").agg(F.count("*").alias("copies")), "mix-units")


def _place(row: Column, seed: int) -> Column:
    """A row's place in its source's permuted order, from 0 to UNIT."""
    return F.pmod(F.xxhash64(F.lit(seed), row), F.lit(UNIT))


def decide(docs: DataFrame, depth: int = DEPTH, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(decisions, blocks): a row for each distinct (doc_id, source, text), and the shard of each source's blocks (sid, block, shard).

    Decisions are doc_id, source, sid, row, place, copies, size, source_size, target, times, and block_1, block_2: the
    blocks that the first and the second taking are in.
    """
    units = _units(docs)
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    named = targets(sizes)
    per_block = F.greatest(F.lit(1.0), F.sum("target").over(Window.partitionBy()) / F.lit(float(blocks)))
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / per_block))).otherwise(0).cast("bigint")
    named = stored(named.withColumn("quota", quota), "mix-sources")
    leaves = split_quotas(named.select("sid", "quota"), depth, seed)
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("quota").over(upto), F.lit(0))
    dealt = leaves.withColumn("first", first).select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("block"))
    dealt = stored(dealt, "mix-blocks")

    known = units.alias("u").join(named.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.doc_id", "u.source", "u.row", "u.size", "u.copies", "s.sid", "s.source_size", "s.target", "s.quota")
    known = known.withColumns({"words": F.col("size") * F.col("copies"), "place": _place(F.col("row"), seed)}).withColumn("ord", F.col("place") / F.lit(float(UNIT)))
    placed = prefix_sums(known, ["sid"], "ord", {"before": "words"}, ["row", "doc_id"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("full") * F.col("source_size")
    more = ((F.col("full") < MOST) & (rest > 0) & (F.col("before") + F.col("words") / 2 <= rest)).cast("bigint")
    placed = placed.withColumn("full", full.cast("bigint")).withColumn("times", F.col("full") + more)

    def block(turn: int) -> Column:
        at = (F.col("before") + F.lit(turn) * F.col("source_size")) * F.col("quota") / F.col("target")
        return F.when(F.col("times") > turn, F.least(F.col("quota") - 1, F.floor(at)))

    placed = placed.withColumns({f"block_{turn + 1}": block(turn) for turn in range(MOST)})
    return placed.select("doc_id", "source", "sid", "row", "place", "copies", "size", "source_size", "target", "times", *[f"block_{t}" for t in range(1, MOST + 1)]), dealt


def plan(docs: DataFrame, depth: int = DEPTH, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The decisions with shard_1 and shard_2: where the first and the second taking go."""
    placed, dealt = decide(docs, depth, blocks, seed)
    for turn in range(1, MOST + 1):
        where = dealt.select("sid", F.col("block").alias(f"block_{turn}"), F.col("shard").alias(f"shard_{turn}"))
        placed = placed.join(where, ["sid", f"block_{turn}"], "left")
    return placed.select("doc_id", "row", "copies", "size", "source_size", "target", "times", *[f"shard_{t}" for t in range(1, MOST + 1)])


def mix_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, shard_1, shard_2) for every row of ``docs``.

    Documents are taken whole, so a source's taken words differ from its target by less than its largest row.
    Defined cases: a null text has no words, as has an empty one, and takes none; a null source is a source, the
    last; repeated rows are taken alike; a null doc_id stays null; an empty table gives no rows; where no
    document has a word all targets are 0. Reruns on the same rows decide alike, in whatever order rows come.
    """
    decided = plan(docs)
    rows = decided.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), F.col("times").cast("int").alias("times"), "shard_1", "shard_2")


def _stretches(docs: DataFrame, seed: int) -> DataFrame:
    """(source, last_1, from_1, last_2, from_2): what a source's takings are, told by places in its permuted order.

    The k-th taking goes over the places up to last_k, null if there is none; from_k holds the first place and the shard of each
    block, in order. Together no more than two entries a block: about BLOCKS, whatever the corpus.
    """
    placed, dealt = decide(docs, seed=seed)
    at = F.struct("place", "row")
    rows = None
    for turn in range(1, MOST + 1):
        mine = placed.where(F.col("times") >= turn).select("source", "sid", F.lit(turn).alias("turn"), F.col(f"block_{turn}").alias("block"), at.alias("at"))
        rows = mine if rows is None else rows.unionByName(mine)
    firsts = rows.groupBy("source", "sid", "turn", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    firsts = firsts.join(dealt, ["sid", "block"], "left")
    per = firsts.groupBy("source", "sid", "turn").agg(F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("from"))
    out = None
    for turn in range(1, MOST + 1):
        mine = per.where(F.col("turn") == turn).select("source", "sid", F.col("last").alias(f"last_{turn}"), F.col("from").alias(f"from_{turn}"))
        out = mine if out is None else out.join(mine.drop("source"), "sid", "left")
    return out.drop("sid")


def _shard_at(starts: Column, at: Column) -> Column:
    """The shard of the last stretch that starts at or before a place, by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        beyond = F.get(starts, middle)["first"] > at
        go = acc["low"] < acc["high"]
        return F.struct(F.when(go & ~beyond, middle + 1).otherwise(acc["low"]).alias("low"), F.when(go & beyond, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")), halve)["low"]
    return F.get(starts, found - 1)["shard"]


def draw(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: the rows of ``docs``, all columns as they are, each as often as it is taken, dealt by shard and shuffled in it.

    A shard's shuffled order is cut into pieces, and each piece lies whole in one partition of the result. A row's takings
    follow from its place in its source's order, so texts are not joined to decisions: they move once, to their shard.
    """
    spark = docs.sparkSession
    stretches = stored(_stretches(docs, seed), "mix-stretches")  # a row for each source: its size decides how it is joined
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", F.col("text").cast("string").alias("text"))
    key = row_key(F.col("text"))
    rows = whole.select("doc", F.col("source").cast("string").alias("from_source"), key.alias("row"), F.struct(_place(key, seed).alias("place"), key.alias("row")).alias("at"))
    rows = rows.join(stretches, F.col("from_source").eqNullSafe(F.col("source")))
    turns = [F.when(F.col("at") <= F.col(f"last_{t}"), F.struct(F.lit(t).alias("turn"), _shard_at(F.col(f"from_{t}"), F.col("at")).alias("shard"))) for t in range(1, MOST + 1)]
    rows = rows.select("doc", "row", F.explode(F.filter(F.array(*turns), lambda s: s.isNotNull())).alias("taking"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pieces = 4 * parts  # of each shard's shuffled order
    rows = rows.withColumn("order", F.pmod(F.xxhash64(F.lit(seed + 1), "row", "taking.turn"), F.lit(UNIT)))
    rows = rows.withColumns({"shard": F.col("taking.shard"), "piece": F.floor(F.col("order") * pieces / F.lit(float(UNIT)))})
    dealt = rows.repartition(parts, "shard", "piece").sortWithinPartitions("shard", "order")
    return dealt.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
