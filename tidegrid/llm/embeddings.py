"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of the rotated vectors are balanced binary codes of
64 bits that keep angles; there are CODES of them, from different starts. Each code is cut into TABLES substrings; each vector goes
under its substring and all that differ from it in one bit, so two vectors meet in a table when their substrings differ
in at most two bits. Vectors that meet and whose codes are near are candidates. The rerank is exact: candidates name pairs of blocks of up to BLOCK
vectors that stand together in code order, and all pairs of the two blocks are compared by their
original components. So a dense group costs block pairs, not pairs of rows, and only counts of links and a spanning
forest leave a task. A bucket of more than CROWD vectors names all pairs of its blocks instead of comparing codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bounded_batches, connected_components, stored
from tidegrid.llm.sharding import ranged
from tidegrid.llm.simhash import Forest

BITS, TABLES, CODES = 64, 4, 2
WIDTH = BITS // TABLES
NEAR = 18  # differing bits of candidates at most
BLOCK = 64
LEAST = 0.93
#: Vectors that the rotation is learned on, in expectation, drawn by a hash: the bound of the sample.
SAMPLE, ROUNDS, SEED = 20_000, 40, 20240307
CODE_NAMES = ["code", *[f"code_{k}" for k in range(2, CODES + 1)]]
CROWD = 512  # a bucket of more vectors names all pairs of its blocks


def learn_rotation(sample: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(dimension, BITS): principal directions, turned so that the signs lose least; several turns where there are fewer directions than bits."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    k = min(d, BITS)
    directions = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :k] if len(sample) else np.eye(d)[:, :k]
    low = sample @ directions
    turns = []
    for _ in range(-(-BITS // k)):
        turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(ROUNDS if len(sample) else 0):
            signs = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ low)
            turn = (u @ v).T
        turns.append(directions @ turn)
    return np.concatenate(turns, axis=1)[:, :BITS]


class Codes:
    """CODES rotations for each dimension of the sample; other dimensions get theirs without learning."""

    def __init__(self, samples: dict[int, np.ndarray]) -> None:
        self.rotations = {d: self._learned(x) for d, x in samples.items()}

    @staticmethod
    def _learned(sample: np.ndarray) -> np.ndarray:
        return np.concatenate([learn_rotation(sample, SEED + k) for k in range(CODES)], axis=1)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes (n, CODES) of unit vectors (n, dimension)."""
        d = vectors.shape[1]
        if d not in self.rotations:
            self.rotations[d] = self._learned(np.zeros((0, d)))
        return np.packbits(vectors @ self.rotations[d] >= 0, axis=1, bitorder="little").view("<u8")


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code_batches(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            found = np.zeros((len(vectors), CODES), dtype=np.uint64)
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                found[at] = codes.of(_units([vectors[i] for i in at]))
            columns = [pa.array(found[:, k].copy().view(np.int64)) for k in range(CODES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["cid", *CODE_NAMES])

    return run


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], 1 << np.arange(WIDTH)]).astype(np.uint64)
    for batch in batches:
        group, block, *codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + CODES))
        for t in range(TABLES * CODES):
            code = codes[t // TABLES]
            part = (code.view(np.uint64) >> np.uint64(t % TABLES * WIDTH)) & np.uint64((1 << WIDTH) - 1)
            keys = (part[:, None] ^ flips[None, :]).astype(np.int64) | (t << WIDTH) | ((group & 0xFFFFFFFFFF) << (WIDTH + 4))[:, None]
            each = len(flips)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(code, each)), pa.array(np.repeat(block, each))], names=["key", "code", "block"])


def _some(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[np.ndarray]:
    """The columns (key, code, block) of some ``least`` rows at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
        if sum(h.shape[1] for h in held) >= least:
            yield np.concatenate(held, axis=1)
            held = []
    if held:
        yield np.concatenate(held, axis=1)


def _near_blocks(rows: np.ndarray) -> np.ndarray:
    """Different pairs of blocks (2, n) that hold candidates, of whole buckets of up to CROWD rows."""
    keys, codes, blocks = rows
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    after = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(first, size)) - 1
    at, lag = np.flatnonzero(after >= 1), 1
    bits = codes.view(np.uint64)
    found = [np.zeros((2, 0), np.int64)]
    while len(at):
        hit = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= NEAR]
        found.append(_pairs(blocks[hit], blocks[hit + lag]))
        lag += 1
        at = at[after[at] >= lag]
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def _crowd_blocks(blocks: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs of a crowd's blocks, each with itself too, some at a time."""
    for i in range(len(blocks)):
        yield np.stack([np.full(len(blocks) - i, blocks[i]), blocks[i:]])


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks that hold candidates, from rows sorted by key.

    Memory holds some 100 000 rows and, of a bucket that goes on beyond them, its different blocks alone.
    """

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["a", "b"])

    def finished(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Whole buckets."""
        first = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.diff(np.append(first, rows.shape[1]))
        small = np.repeat(size <= CROWD, size)
        if small.any():
            yield _near_blocks(np.ascontiguousarray(rows[:, small]))
        for k in np.flatnonzero(size > CROWD):
            yield from _crowd_blocks(np.unique(rows[2, first[k] : first[k] + size[k]]))

    last = np.zeros((3, 0), np.int64)  # the bucket that may go on
    crowd: np.ndarray | None = None  # its blocks, once it is a crowd
    for rows in _some(batches):
        if last.shape[1]:
            same = int(np.searchsorted(rows[0], last[0, 0], "right")) if rows[0, 0] == last[0, 0] else 0
            if crowd is not None:
                crowd = np.unique(np.concatenate([crowd, rows[2, :same]]))
            else:
                last = np.concatenate([last, rows[:, :same]], axis=1)
                if last.shape[1] > CROWD:
                    crowd, last = np.unique(last[2]), last[:, :1]
            rows = rows[:, same:]
            if not rows.shape[1]:
                continue
            yield from map(out, finished(last) if crowd is None else _crowd_blocks(crowd))
            crowd = None
        cut = int(np.searchsorted(rows[0], rows[0, -1], "left"))
        if cut:
            yield from map(out, finished(rows[:, :cut]))
        last = rows[:, cut:]
        if last.shape[1] > CROWD:
            crowd, last = np.unique(last[2]), last[:, :1]
    if last.shape[1]:
        yield from map(out, finished(last) if crowd is None else _crowd_blocks(crowd))


def _rerank_batches(least: float):
    """Exact links of block pairs: rows (node, other, links); other is null in counts, links in edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            counts: dict[int, int] = {}
            groups: dict[tuple, int] = {}
            left, right = _blocks(batch.column(2), groups), _blocks(batch.column(3), groups)
            for a, b, lefts, rights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), left, right):
                for group, x in lefts.items():
                    if group not in rights:
                        continue
                    y = rights[group]
                    hit = x[2] @ y[2].T >= least
                    if a == b:
                        np.fill_diagonal(hit, False)
                    i, j = np.nonzero(hit)
                    if not len(i):
                        continue
                    forest.link(x[0][i], y[0][j])
                    for ids, n in ((x[0], hit @ y[1]), *([] if a == b else [(y[0], x[1] @ hit)])):
                        for c, k in zip(ids.tolist(), n.tolist()):
                            if k:
                                counts[c] = counts.get(c, 0) + k
            none = pa.nulls(len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), none, pa.array(list(counts.values()), pa.int64())], names=["node", "other", "links"])
        edges = np.array(forest.edges(), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy()), pa.nulls(len(edges), pa.int64())], names=["node", "other", "links"])

    return run


def _blocks(column: pa.ListArray, groups: dict[tuple, int]) -> list[dict[int, tuple]]:
    """For each block (ids, copies, unit vectors) by group: its vectors of one label and length. ``groups`` numbers the groups of a batch."""
    starts = column.offsets.to_numpy()
    first, last = int(starts[0]), int(starts[-1])
    members = column.values.slice(first, last - first)
    cid, copies, label, vector = (members.field(k) for k in ("cid", "copies", "label", "vector"))
    cid, copies = cid.to_numpy(), copies.to_numpy()
    ends = vector.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = vector.values.to_numpy()
    named = label.dictionary_encode()
    label_of, names = named.indices.to_numpy(), named.dictionary.to_pylist()
    group = np.zeros(len(cid), dtype=np.int64)
    units: dict[int, np.ndarray] = {}
    at = np.zeros(len(cid), dtype=np.int64)
    for d in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == d)
        units[d] = _units(flat[ends[mine][:, None] + np.arange(d)[None, :]])
        at[mine] = np.arange(len(mine))
        for k in np.unique(label_of[mine]).tolist():
            group[mine[label_of[mine] == k]] = groups.setdefault((names[k], d), len(groups))
    out = []
    for lo, hi in zip(starts[:-1] - first, starts[1:] - first):
        block = {}
        for g in np.unique(group[lo:hi]).tolist():
            rows = lo + np.flatnonzero(group[lo:hi] == g)
            block[g] = (cid[rows], copies[rows], units[int(sizes[rows[0]])][at[rows]])
        out.append(block)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Whether a row can link: a label, and a vector of finite components that aren't all zero."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & some, F.lit(False))


def embedding_components(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label collapse first and count as links to each other. Defined cases: rows whose label is
    null, or whose vector is null, empty, zero or has null or non-finite components, link with nothing; vectors of
    different lengths aren't compared; repeated rows count as vectors of their own; a null vec_id names no component that has
    another; an empty table gives no rows. No link below ``least`` is reported; the recall above it is measured in the tests.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # floats stay as short as they are
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    content = [F.when(usable(rows), F.xxhash64(F.lit(seed), "label", F.size("embedding"), "embedding")).alias(f"same_{seed}") for seed in (1, 2)]
    rows = rows.select("*", *content)
    same = ["same_1", "same_2"]
    classes = rows.where("same_1 is not null").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("vector"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    share = F.pmod(F.col("same_1"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.where(share * F.lit(classes.count()) < SAMPLE).select(*same, "vector").toArrow().sort_by([(c, "ascending") for c in same])["vector"].combine_chunks()
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = sample.flatten().to_numpy(zero_copy_only=False)
    codes = Codes({int(d): _units(flat[ends[:-1][sizes == d][:, None] + np.arange(d)[None, :]]) for d in np.unique(sizes)})

    coded = classes.select("cid", "vector").mapInArrow(_code_batches(codes), "cid bigint" + "".join(f", {c} bigint" for c in CODE_NAMES))
    group = F.xxhash64("label", F.size("vector"))
    thin = coded.join(classes.select("cid", group.alias("group")), "cid")
    key = F.pmod("group", F.lit(1 << 11)) * F.lit(1 << 52) + F.shiftrightunsigned("code", 12)
    thin = stored(thin.select("cid", "group", *CODE_NAMES, key.alias("key"), F.col("cid").alias("doc_id"), F.col("code").alias("text_crc32"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("range")), "vector-codes")
    inside = Window.partitionBy("range").orderBy("key", "cid")
    block = F.col("range") * F.lit(1 << 20) + F.floor((F.row_number().over(inside) - 1) / BLOCK)
    thin = stored(ranged(thin, 20_000).withColumn("block", block.cast("bigint")).select("cid", "group", "block", *CODE_NAMES), "vector-blocks")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = thin.select("group", "block", *CODE_NAMES).mapInArrow(_key_batches, "key bigint, code bigint, block bigint")
    pairs = dealt.repartition(parts, "key").sortWithinPartitions("key", "code").mapInArrow(_pair_batches, "a bigint, b bigint").distinct()
    members = classes.join(thin.select("cid", "block"), "cid").groupBy("block").agg(F.collect_list(F.struct("cid", "copies", "label", "vector")).alias("members"))  # BLOCK at most
    members = stored(members, "vector-members")
    left, right = members.select(F.col("block").alias("a"), F.col("members").alias("left")), members.select(F.col("block").alias("b"), F.col("members").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    found = stored(joined.mapInArrow(_rerank_batches(least), "node bigint, other bigint, links bigint"), "vector-links")

    links = found.where("other is null").groupBy(F.col("node").alias("cid")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("cid", "least", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").join(links, "cid", "left")
    known = known.select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = known.join(classes.select("cid", *same), "cid")
    out = rows.select("vec_id", *same).join(known, same, "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
