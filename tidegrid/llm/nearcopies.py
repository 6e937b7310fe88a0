"""Near copies by the similarity of their shingles: wide SimHash fingerprints, Golay-code fuzzy keys, verified pairs.

Texts are sets of shingles of WIDTH words. Two of Jaccard similarity 0.8 differ in about 19 of the 128 bits of a
fingerprint, too many for a few keys of its bits alone. So keys are narrowed by what near copies share: each text's
ANCHORS smallest shingle hashes. A key is an anchor with a segment's index of a near codeword (see simhash): six
segments of 21 or 22 bits, each with one or six codewords. By the pigeonhole principle one of six segments holds at
most 3 of 19 differing bits; segments within 2 bits always share a codeword, those 3 or 4 bits apart in 6 of 10 cases.

Only anchors that two texts have give keys. Two passes go over the buckets of equal keys. The first joins most of what is
alike at little cost: its candidates are pairs within WIDE bits, and of a bucket of more than SMALL texts only a minimum
spanning tree by differing bits and each text's next nearest; beyond REFERENCES texts, each other one with the nearest of
these, or as one more of them where none is near. The second is exact: every other pair of a bucket, whatever its bits and
the bucket's size, is a candidate too unless links have joined its texts already, as one link more would change no group,
or bounds from sizes and bins of the sketches show that it is no link (see _pairs).
So a dense group costs few pairs, and no pair of the second pass is a row. A bucket of more than BLOCK texts is dealt as
pairs of blocks of about BLOCK, so memory is bounded.
Every candidate is verified by the shingles themselves: sketches of the SKETCH smallest hashes, which hold all of them for texts of no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import bounded_batches, connected_components, stored
from tidegrid.llm.simhash import SEGMENTS, _majority, _votes, hash_blocks, near_codewords
from tidegrid.llm.sketches import resemblance

WIDTH, LEAST = 5, 0.8
ANCHORS, SKETCH = 4, 512
WIDE = 32  # differing bits of 128 of a candidate at most: three deviations above those of similarity LEAST
SMALL, REFERENCES = 4, 1024
BINS = 32  # of a sketch's hashes by their last bits: the lesser counts of two texts bound what they have in common
BLOCK = 1024  # texts of a bucket that are paired with as many others in one go
GATHERED = 65_536  # rows that are looked at together


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash: the finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    fresh = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def text_row(text: str | None, width: int = WIDTH) -> tuple[int, int, int, int, np.ndarray, np.ndarray]:
    """(two hashes of the set of shingles, two fingerprints of it, anchors, sketch); zeros without words."""
    found = np.zeros(0, np.uint64)
    for hashes in hash_blocks(text, width):
        found = _distinct(np.concatenate([found, hashes]) if len(found) else hashes)
    if not len(found):
        return 0, 0, 0, 0, found.view(np.int64), found.astype(np.int32)
    raw = found.tobytes()
    prints = []
    for bits in (found, _mixed(found)):
        votes = sum(_votes(bits[lo : lo + (1 << 17)]) for lo in range(0, len(bits), 1 << 17))
        prints.append(_majority(votes, len(bits)))
    sketch = _distinct(found[: 2 * SKETCH] >> np.uint64(33))[:SKETCH]
    return xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(raw, 43), *prints, found[:ANCHORS].view(np.int64), sketch.astype(np.int32)


def _bins(sketch: np.ndarray) -> bytes:
    """How many of the hashes are in each bin, a byte each, 255 for more."""
    return np.minimum(np.bincount(sketch % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


_SIGNED = ["set_1", "set_2", "print_1", "print_2"]


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_row(t) for t in batch.column(0).to_pylist()]
        fixed = np.array([r[:4] for r in rows], dtype=np.uint64).reshape(-1, 4).view(np.int64)
        lists = [pa.array([r[4] for r in rows], pa.list_(pa.int64())), pa.array([r[5] for r in rows], pa.list_(pa.int32())), pa.array([_bins(r[5]) for r in rows], pa.binary())]
        columns = [batch.column(1), *(pa.array(fixed[:, k].copy()) for k in range(4)), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *_SIGNED, "anchors", "sketch", "bins"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, anchor, print_1, print_2): a row for each key, with the codeword it has; columns that follow go on."""
    for batch in batches:
        node, anchor, *prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        for p, half in enumerate(prints):
            for s, (start, width) in enumerate(SEGMENTS):
                segment = ((half.view(np.uint64) >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
                near, count = near_codewords(segment, width)
                row, col = np.nonzero(np.arange(6)[None, :] < count[:, None])
                kind = np.uint64(p * len(SEGMENTS) + s + 1) << np.uint64(12)
                codes = kind | near[row, col].astype(np.uint64)
                columns = [_mixed(anchor.view(np.uint64)[row] ^ _mixed(codes)).view(np.int64), codes.astype(np.int32)]
                rows = batch.take(pa.array(row))
                names = [f.name for f in batch.schema]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(rows.column(k) for k in range(len(names)) if k != 1)], names=["key", "code", *names[:1], *names[2:]])


class _Bucket:
    """The references of the bucket that the rows at hand end in; it may go on in the next rows."""

    def __init__(self, key: int | None = None) -> None:
        self.key = key
        self.nodes = np.zeros(0, np.int64)
        self.prints = np.zeros((0, 2), np.uint64)

    def add(self, nodes: np.ndarray, prints: np.ndarray) -> None:
        self.nodes, self.prints = np.concatenate([self.nodes, nodes]), np.concatenate([self.prints, prints])


def _apart(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ one).sum(axis=-1, dtype=np.int64)


def _tree(nodes: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The edges within WIDE of a minimum spanning tree by differing bits, and each text's next nearest when it joins the tree."""
    rest = np.arange(1, len(nodes))
    apart, beside = _apart(prints[1:], prints[0]), np.zeros(len(rest), np.int64)
    next_apart, next_beside = np.full(len(rest), WIDE + 1), np.zeros(len(rest), np.int64)
    left, right = [], []
    while len(rest):
        k = int(np.argmin(apart))
        here = int(rest[k])
        for bits, other in ((apart[k], beside[k]), (next_apart[k], next_beside[k])):
            if bits <= WIDE:
                left.append(int(other))
                right.append(here)
        for x in (rest, apart, beside, next_apart, next_beside):
            x[k] = x[-1]
        rest, apart, beside, next_apart, next_beside = rest[:-1], apart[:-1], beside[:-1], next_apart[:-1], next_beside[:-1]
        new = _apart(prints[rest], prints[here])
        nearer = new < apart
        next_apart[nearer], next_beside[nearer] = apart[nearer], beside[nearer]
        apart[nearer], beside[nearer] = new[nearer], here
        second = ~nearer & (new < next_apart)
        next_apart[second], next_beside[second] = new[second], here
    yield nodes[left], nodes[right]


def _linked(nodes: np.ndarray, prints: np.ndarray, bucket: _Bucket) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates that join rows to a bucket's references and to each other; some become references."""
    if not len(bucket.nodes):
        first = slice(0, REFERENCES)
        yield from _tree(nodes[first], prints[first])
        bucket.add(nodes[first], prints[first])
        nodes, prints = nodes[REFERENCES:], prints[REFERENCES:]
    for lo in range(0, len(nodes), 256):
        mine, of = nodes[lo : lo + 256], prints[lo : lo + 256]
        apart = _apart(of[:, None, :], bucket.prints[None, :, :])
        nearest = np.argmin(apart, axis=1)
        near = apart[np.arange(len(mine)), nearest] <= WIDE
        yield bucket.nodes[nearest[near]], mine[near]
        if not near.all():
            yield from _tree(mine[~near], of[~near])
            bucket.add(mine[~near], of[~near])


def _gathered(batches: Iterator[pa.RecordBatch], least: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of the first pass, of rows sorted by key; memory holds a batch and the references of one bucket."""
    bucket = _Bucket()
    for batch in _gathered(batches):
        if not len(batch):
            continue
        keys, nodes, *prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        prints = np.stack(prints, axis=1).view(np.uint64)
        left, right = [], []
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        large = size > SMALL
        large[-1] = True  # it may go on in the next batch
        large[0] |= keys[0] == bucket.key
        for k in np.flatnonzero(large).tolist():
            lo, hi = int(first[k]), int(first[k] + size[k])
            if keys[lo] != bucket.key:
                bucket = _Bucket(int(keys[lo]))
            for a, b in _linked(nodes[lo:hi], prints[lo:hi], bucket):
                left.append(a)
                right.append(b)
        after = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(first, size)) - 1
        after[np.repeat(large, size)] = 0
        at, lag = np.flatnonzero(after >= 1), 1
        while len(at):
            hit = at[_apart(prints[at], prints[at + lag]) <= WIDE]
            left.append(nodes[hit])
            right.append(nodes[hit + lag])
            lag += 1
            at = at[after[at] >= lag]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where groups (key, lo, hi) begin, which are the first three columns."""
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = False
    for c in rows.columns[:3]:
        x = c.to_numpy(zero_copy_only=False)
        fresh[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by group, in batches that no group goes beyond; memory holds one and the group that is not over yet."""
    held: list[pa.RecordBatch] = []
    for batch in _gathered(batches, least):
        if not len(batch):
            continue
        rows = pa.concat_batches([*held, batch])
        last = int(_starts(rows)[-1])
        if last:
            yield rows.slice(0, last)
        held = [rows.slice(last)]
    yield from held


def _codes(print_1: np.ndarray, print_2: np.ndarray) -> np.ndarray:
    """The codes (n, 6 segments, 6) that keys are made of; -1 where there are fewer."""
    found = []
    for p, half in enumerate((print_1, print_2)):
        for s, (start, width) in enumerate(SEGMENTS):
            near, count = near_codewords(((half.view(np.uint64) >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64), width)
            found.append(np.where(np.arange(6)[None, :] < count[:, None], near | p * len(SEGMENTS) + s + 1 << 12, -1))
    return np.stack(found, axis=1).astype(np.int32)


def _pairs(rows: pa.RecordBatch, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of a group that may be links and are of different components, each in one of its groups only: that of the least anchor and the least code of both.

    Rows (key, lo, hi, block, node, component, size, bins, code, lower, print_1, print_2); of different lo and hi, pairs across the two blocks.
    Two bounds leave out only what cannot be a link: sketches have no resemblance above the ratio of their sizes, and no more
    in common than the sum of the lesser counts of their bins (a count of 255 stands for any more, so texts with one are held by their sizes alone).
    """
    lo, hi, block, component, size, code, print_1, print_2 = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "block", "component", "size", "code", "print_1", "print_2"))
    bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
    many = (bins == 255).any(axis=1)
    lists = rows.column("lower").to_pylist()
    lower, some = np.zeros((len(rows), ANCHORS), np.int64), np.zeros((len(rows), ANCHORS), bool)
    for k, x in enumerate(lists):
        lower[k, : len(x)], some[k, : len(x)] = x, True
    codes = _codes(print_1, print_2)
    first = _starts(rows)
    n = np.diff(np.append(first, len(rows)))
    after = np.repeat(first + n, n) - np.arange(len(rows)) - 1

    def once(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = np.minimum(bins[i], bins[j]).sum(axis=1, dtype=np.int64)
        need = least / (1 + least) * (size[i] + size[j])
        need = np.where((size[i] < SKETCH) & (size[j] < SKETCH), need, np.minimum(need, least * SKETCH))
        fresh = (common >= need - 1e-6) | many[i] | many[j]
        i, j = i[fresh], j[fresh]
        for x in range(ANCHORS):
            for y in range(ANCHORS):
                fresh = ~(some[i, x] & some[j, y] & (lower[i, x] == lower[j, y]))
                i, j = i[fresh], j[fresh]
        for s in range(codes.shape[1]):
            both = codes[i, s][:, :, None] == codes[j, s][:, None, :]
            both &= ((codes[i, s] >= 0) & (codes[i, s] < code[i][:, None]))[:, :, None]
            fresh = ~both.any(axis=(1, 2))
            i, j = i[fresh], j[fresh]
        return i, j

    found, held = [], 0
    at, lag = np.flatnonzero(after >= 1), 1
    while len(at):
        to = at + lag
        hit = (component[at] != component[to]) & ((lo[at] == hi[at]) | (block[at] != block[to]))
        hit &= np.minimum(size[at], size[to]) / np.maximum(size[at], size[to]) >= least
        found.append((at[hit], to[hit]))
        held, lag = held + len(found[-1][0]), lag + 1
        at = at[after[at] >= lag]
        if held >= GATHERED or not len(at):
            yield once(*(np.concatenate(x) for x in zip(*found)))
            found, held = [], 0


def _open_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Those of the rows that have a pair in their group (see _pairs)."""
    for rows in _whole_groups(batches, GATHERED):
        paired = np.zeros(len(rows), dtype=bool)
        for i, j in _pairs(rows, least):
            paired[i] = paired[j] = True
        yield rows.filter(pa.array(paired))


def _alike(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sketches have a resemblance of ``least`` or more to the one (see sketches.resemblance); none is empty."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    union = len(one) + sizes - common
    drawn = ~((len(one) < SKETCH) & (sizes < SKETCH) | (union < SKETCH))
    alike = common / np.where(drawn, SKETCH, union) >= least
    for k in np.flatnonzero(drawn & alike).tolist():  # what both have may lie above the bottom of the union
        bottom = np.union1d(one, others[k])[SKETCH - 1]
        alike[k] = np.count_nonzero(np.intersect1d(one, others[k], assume_unique=True) <= bottom) / SKETCH >= least
    return alike


def _rest_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components, of all pairs of rows (as for _pairs, with ``sketch``); pairs that links found here have joined by then are left out."""
    for rows in _whole_groups(batches, GATHERED // 16):
        component, sketches = rows.column("component").to_numpy(zero_copy_only=False), rows.column("sketch")
        values, ends = sketches.values.to_numpy(zero_copy_only=False), sketches.offsets.to_numpy(zero_copy_only=False)
        label = np.unique(component, return_inverse=True)[1]
        left, right = [], []
        for i, j in _pairs(rows, least):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(i)]):
                k, to = int(i[lo]), j[lo:hi]
                to = to[label[to] != label[k]]
                if not len(to):
                    continue
                for x in to[_alike(values[ends[k] : ends[k + 1]], [values[ends[x] : ends[x + 1]] for x in to.tolist()], least)].tolist():
                    if label[x] != label[k]:
                        left.append(component[k])
                        right.append(component[x])
                        label[label == label[x]] = label[k]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right)], names=["a", "b"])


def row_identity(docs: DataFrame) -> list[Column]:
    """Two hashes over all columns of a row: rows alike in every column are one row."""
    plain = [F.col(f"`{f.name}`") if not _has_map(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]
    known = F.concat(*[c.isNull().cast("string") for c in plain])
    return [F.xxhash64(F.lit(seed), known, *plain) for seed in (1, 2)]


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _keyed(classes: DataFrame, *more: str) -> DataFrame:
    """(key, code, node, print_1, print_2, lower, more) for each key of each node; ``lower``: its anchors below that of the key."""
    anchored = classes.select("node", F.explode("anchors").alias("anchor"), "print_1", "print_2", "anchors", *more)
    shared = anchored.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    lower = F.expr("filter(anchors, x -> x < anchor)").alias("lower")
    keyed = anchored.join(shared, "anchor").select("node", "anchor", "print_1", "print_2", lower, *more)
    types = "".join(f", {c} {classes.schema[c].dataType.simpleString()}" for c in more)
    return keyed.mapInArrow(_key_batches, "key bigint, code int, node bigint, print_1 bigint, print_2 bigint, lower array<bigint>" + types)


def near_links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """Verified links (a, b) of the first pass between the nodes of ``classes`` (node, anchors, sketch, print_1, print_2)."""
    spark = classes.sparkSession
    bounded_batches(spark)
    keyed = _keyed(classes).select("key", "node", "print_1", "print_2")
    dealt = keyed.repartition(_parts(spark), "key").sortWithinPartitions("key", "node")
    pairs = stored(dealt.mapInArrow(_candidate_batches, "a bigint, b bigint").distinct(), "near-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = stored(classes.select("node", "sketch").join(needed, "node", "left_semi"), "near-sketches")
    left, right = (found.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    likeness = resemblance(F.col("sketch_a"), F.col("sketch_b"), SKETCH)
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(likeness >= least).select("a", "b")


def rest_links(named: DataFrame, sketches: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) between components, of all pairs of nodes that share a key and are of two components; no other pair is left out.

    ``named``: (node, component, anchors, size, bins, print_1, print_2); ``sketches``: (node, sketch). Pairs are never rows: the texts of a group of
    two blocks that have pairs to be looked at come together with their sketches.
    """
    spark = named.sparkSession
    bounded_batches(spark)
    keyed = _keyed(named, "component", "size", "bins")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    blocks = counts.where("least < most").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = keyed.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    group, parts = ["key", "lo", "hi"], _parts(spark)
    columns = [*group, "block", "node", "component", "size", "bins", "code", "lower", "print_1", "print_2"]
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).select(*columns)
    rows = rows.repartition(parts, *group).sortWithinPartitions(*group, "node")
    rows = rows.mapInArrow(lambda batches: _open_batches(batches, least), rows.schema)
    whole = stored(rows, "near-rest").join(sketches.hint("merge"), "node").select(*columns, "sketch")
    whole = whole.repartition(parts, *group).sortWithinPartitions(*group, "node")
    return whole.mapInArrow(lambda batches: _rest_batches(batches, least), "a bigint, b bigint").distinct()


def near_groups(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, component, first) for every row of ``classes``: all pairs that share a key are held against ``least``, or joined by such that are."""
    labels = connected_components(stored(near_links(classes, least), "near-links"))
    named = classes.select("node", "anchors", F.size("sketch").alias("size"), "bins", "print_1", "print_2", "first").join(labels, "node", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "node")), "near-named")
    joined = connected_components(stored(rest_links(named, classes.select("node", "sketch"), least), "near-rest-links")).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return named.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"), "first")


def keep_one_of_each_group(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns as they are: one of each group that links of similarity ``least`` or more join.

    That of the smallest doc_id stays, null after all others; of several rows of that id, the one of the least hash.
    Defined cases: texts of equal sets of shingles are one class, null texts and those without words too, a text shorter
    than WIDTH words is one shingle; rows alike in every column are one row; an empty table gives no rows; columns
    of any name and type pass through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("bigint").alias("doc_id"), *[h.alias(f"row_{k}") for k, h in enumerate(row_identity(docs), 1)])
    row_type = "struct<unnamed: boolean, doc_id: bigint, row_1: bigint, row_2: bigint>"
    thin = docs.select(F.col("text").cast("string").alias("text"), row.alias("row"))
    rows = thin.mapInArrow(_row_batches, f"row {row_type}, " + "".join(f"{c} bigint, " for c in _SIGNED) + "anchors array<bigint>, sketch array<int>, bins binary")
    shape = [F.first(c).alias(c) for c in ("print_1", "print_2", "anchors", "sketch", "bins")]  # equal in all rows of a class
    classes = rows.groupBy("set_1", "set_2").agg(F.min("row").alias("first"), *shape)
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    kept = near_groups(classes, least).groupBy("component").agg(F.min("first").alias("first"))
    names = unused(docs, 2)
    kept = stored(kept.select(*[F.col(f"first.row_{k}").alias(n) for k, n in enumerate(names, 1)]), "near-kept")
    # Rows alike collapse before they move. The list of kept rows grows with the corpus, so it is never broadcast: texts move once, at any size.
    keyed = docs.withColumns(dict(zip(names, row_identity(docs)))).dropDuplicates(names)
    return keyed.join(kept.hint("merge"), names, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def unused(docs: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of a table has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    stem = "_key"
    while any(c.startswith(stem) for c in taken):
        stem = "_" + stem
    return [f"{stem}{k}" for k in range(n)]
