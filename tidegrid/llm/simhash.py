"""SimHash near-duplicates through Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each put into the high bits of
a word of the binary [23, 12, 7] Golay code. That code is perfect: every word is within 3 bits of one
codeword, and two words within 2 bits of each other have a codeword in common among those within 4
bits of each. A segment's keys are the indices of the codewords within 4 bits: one where the word is
within 2 bits of its codeword, else six.

Of 4 differing bits over three segments, at most 2 fall on the two that differ least. So these have

* no difference in one and at most 2 bits in the other: found by the exact bits of the one with a
  codeword index of the other, the same keys on both sides; or
* one differing bit each: found by a codeword index of both, where one side takes the nearest
  codeword of the first segment and all near codewords of the second, the other side the reverse.

Both sides' keys go into one bucket, whose fingerprints are then compared bit by bit, so that no pair
is linked in error and none within the limit is missed. A dense bucket costs no pairs: a search from
one fingerprint takes out of the bucket all that it reaches, and only a spanning forest is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches, connected_components, stored

#: Fixed value: the generator polynomial of the Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0xAE3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LIMIT = 4
BLOCK = 1 << 20  # bytes of a text whose shingles are hashed at once
_WHITE = re.compile(rb"[\x20\t-\r]")
SMALL = 32  # a bucket of more distinct fingerprints is searched, not paired
SALTS = 16  # tasks that a component's classes are named in


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator of words of 23 bits."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: error patterns of the codewords within 4 bits, nearest first, and their number (1 or 6)."""
    from itertools import combinations

    patterns = np.zeros((2048, 6), dtype=np.int64)
    found = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for s, m in zip(_syndromes(masks), masks):
            patterns[s, found[s]] = m
            found[s] += 1
    return patterns, found


@cache
def _remainders() -> np.ndarray:
    return _syndromes(np.arange(1 << 23)).astype(np.int16)


def near_codewords(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords within 4 bits, nearest first, and how many of the six count."""
    patterns, found = code_tables()
    words = segment.astype(np.int64) << (23 - width)
    s = _remainders()[words]
    return (words[:, None] ^ patterns[s]) >> 11, found[s]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bucket keys of fingerprints (uint64): for each key the position of its fingerprint, and the key."""
    segs = [((prints >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64) for start, width in SEGMENTS]
    near = [near_codewords(s, width) for s, (_, width) in zip(segs, SEGMENTS)]
    valid = [np.arange(6)[None, :] < n[:, None] for _, n in near]
    at, keys, kind = [], [], 0

    def put(key: np.ndarray, ok: np.ndarray) -> None:
        row, col = np.nonzero(ok)
        at.append(row)
        keys.append(key[row, col] | (kind << 40))

    for a in range(3):
        for b in range(3):
            if a != b:
                put((segs[a][:, None] << 12) | near[b][0], valid[b])
                kind += 1
    for a, b in ((0, 1), (0, 2), (1, 2)):
        put((near[a][0][:, :1] << 12) | near[b][0], valid[b])
        put((near[a][0] << 12) | near[b][0][:, :1], valid[a])
        kind += 1
    return np.concatenate(at), np.concatenate(keys)


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some BLOCK bytes at a time; blocks end between words."""
    lo = 0
    while lo < len(data):
        found = _WHITE.search(data, min(len(data), lo + BLOCK))
        hi = found.start() if found else len(data)
        yield data[lo:hi].split()
        lo = hi


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[a:b], 42) for a, b in cuts], dtype="<u8")


def hash_blocks(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The shingles' hashes of a whole text, some BLOCK bytes of words at a time; fewer words than ``width`` make one shingle, none without words.

    A-Z are lowered; words are runs of other than space and \\t-\\r. The last words of a block go on with the next, so
    a very long text is never a list of words.
    """
    held, some = [], False
    for words in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + words
        if len(words) >= width:
            some = True
            yield shingle_hashes(words, width)
        held = words[-(width - 1) :] if width > 1 else []
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), 42)], dtype="<u8")


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(votes: np.ndarray, n: int) -> int:
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority vote of the bits of all shingles' hashes (see hash_blocks); 0 without words."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashes in hash_blocks(text, width):
        votes += _votes(hashes)
        n += len(hashes)
    return _majority(votes, n) if n else 0


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) for every row; ``print`` holds the 64 bits as a signed long. A null text has no words: 0."""
    bounded_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(_print_batches, "doc_id bigint, print bigint")


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(prints), 5000):
            part = prints[lo : lo + 5000]
            at, keys = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at].view(np.int64))], names=["key", "print"])


class Forest:
    """A spanning forest of the links that one task has found; each tree a star around its least node."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        top = x
        while (up := p.get(top, top)) != top:
            top = up
        while (up := p.get(x, x)) != top:
            p[x] = top
            x = up
        return top

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        pairs = np.unique(np.stack([left, right], axis=1), axis=0)
        for a, b in pairs.tolist():
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                self.parent[hi] = lo
                self.parent.setdefault(lo, lo)

    def edges(self) -> list[tuple[int, int]]:
        return [(self.root(x), x) for x in list(self.parent) if self.root(x) != x]


def _search(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges of the components of distinct fingerprints: each search step takes what it reaches out of the rest."""
    left, right, rest = [], [], prints
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            here = frontier.pop()
            hit = np.bitwise_count(rest ^ here) <= limit
            if hit.any():
                got = rest[hit]
                left.append(np.full(len(got), here))
                right.append(got)
                frontier.extend(got)
                rest = rest[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (prints[:0], prints[:0])


def _link_buckets(keys: np.ndarray, prints: np.ndarray, forest: Forest, limit: int) -> None:
    """Links within runs of equal keys; rows are sorted by key, then fingerprint."""
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[fresh], prints[fresh].view(np.uint64)
    if len(keys) < 2:
        return
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    left, right = [], []
    for k in np.flatnonzero(size > SMALL):
        a, b = _search(prints[first[k] : first[k] + size[k]], limit)
        left.append(a)
        right.append(b)
    of = np.repeat(size, size)
    left_in_run = of - (np.arange(len(keys)) - np.repeat(first, size)) - 1  # rows of the run that follow
    left_in_run[of > SMALL] = 0
    at = np.flatnonzero(left_in_run >= 1)
    lag = 1
    while len(at):
        hit = at[np.bitwise_count(prints[at] ^ prints[at + lag]) <= limit]
        left.append(prints[hit])
        right.append(prints[hit + lag])
        lag += 1
        at = at[left_in_run[at] >= lag]
    if left:
        forest.link(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))


def _link_batches(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held_k: list[np.ndarray] = []
        held_p: list[np.ndarray] = []
        held = 0
        for batch in batches:
            held_k.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_p.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += len(held_k[-1])
            if held < 100_000:
                continue
            keys, prints = np.concatenate(held_k), np.concatenate(held_p)
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on in the next batch
            _link_buckets(keys[:cut], prints[:cut], forest, limit)
            held_k, held_p = [keys[cut:]], [np.unique(prints[cut:])]
            held_k[0] = held_k[0][: len(held_p[0])]
            held = len(held_k[0])
        if held:
            _link_buckets(np.concatenate(held_k), np.concatenate(held_p), forest, limit)
        edges = np.array(forest.edges(), dtype=np.int64).reshape(-1, 2)
        for lo in range(0, len(edges), 50_000):
            part = edges[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    return run


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: a spanning forest of all pairs that differ in at most ``limit`` bits.

    ``prints`` has one column of distinct fingerprints. The keys are complete for limits up to 4.
    """
    if not 0 <= limit <= LIMIT:
        raise ValueError(f"the keys find pairs of up to {LIMIT} differing bits")
    spark = prints.sparkSession
    keyed = prints.mapInArrow(_key_batches, "key bigint, print bigint")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(_link_batches(limit), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints collapse first, so copies cost one row whatever their number. component_id is the
    smallest doc_id that links reach. Defined cases: null and empty texts and texts of white space have
    fingerprint zero and link like any other; repeated rows each come back; a null doc_id never names a
    component unless the component has no other; an empty table gives no rows; other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    labels = connected_components(stored(links(classes.select("print"), limit), "links"))
    linked = classes.join(labels.withColumnRenamed("node", "print"), "print")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # A component may hold a third of all classes: its name goes out SALTS times, and its classes over as many tasks.
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.withColumn("salt", F.pmod(F.hash("print"), F.lit(SALTS)))
    named = linked.join(names, ["component", "salt"]).select("print", "component_id")
    known = classes.join(named, "print", "left").select("print", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(known, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
