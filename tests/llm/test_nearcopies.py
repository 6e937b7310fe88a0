"""Near copies against brute force: all pairs of texts compared by their sets of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, edited, prose
from tidegrid.llm import nearcopies


def shingles(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts, least=0.8):
    """The least position of each text's group."""
    sets, places = [], {}
    for t in texts:
        places.setdefault(shingles(t), len(places))
        sets.append(places[shingles(t)])
    classes = list(places)
    parent = list(range(len(classes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = {}
    for i, s in enumerate(classes):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(classes):
        for j in {j for g in s for j in by[g] if j < i}:
            common = len(s & classes[j])
            if common / (len(s) + len(classes[j]) - common) >= least:
                parent[root(i)] = root(j)
    first = {}
    return [first.setdefault(root(c), i) for i, c in enumerate(sets)]


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in nearcopies.keep_one_of_each_group(docs).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = [prose(i, rng.randint(30, 400)) for i in range(60)]
    texts = base + [edited(base[i % 60], i, 0.02 * (i % 4)) for i in range(240)]
    texts += [" ".join(t.split(" ")[:-3]) for t in base] + [prose(900 + i, 60) + " " + prose(7, 40) for i in range(100)]
    want = set(groups(texts))
    found = kept_of(spark, texts)
    assert want <= found and len(found - want) <= 0.01 * (len(texts) - len(want))


def test_a_large_group_of_near_copies(spark):
    """A thousand copies with two words changed each: all but one go, without pairs of them all."""
    base = prose(5, 300)
    texts = [edited(base, i, 0.007) for i in range(1000)] + [prose(10_000 + i, 100) for i in range(50)]
    want, found = set(groups(texts)), kept_of(spark, texts)
    assert want <= found and len(found) <= len(want) + 2


def test_a_bucket_goes_on_over_batches():
    """All rows of a bucket but those near none are joined, by a pair or two each, whatever the batches."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 100_000
    one = rng.integers(0, 1 << 62, 2)
    alone = rng.random(n) < 0.001
    prints = np.where(alone[:, None], rng.integers(0, 1 << 62, (n, 2)), one[None, :] ^ (1 << rng.integers(0, 60, (n, 2))))
    columns = [np.zeros(n, np.int64), np.arange(n), prints[:, 0].copy(), prints[:, 1].copy()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 500]) for c in columns], names=["key", "node", "print_1", "print_2"]) for lo in range(0, n, 500)]
    pairs = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in nearcopies._candidate_batches(iter(batches))])
    assert n - alone.sum() - 1 <= len(pairs) <= n + nearcopies.REFERENCES and not alone[pairs].any() and len(np.unique(pairs)) == n - alone.sum()


@pytest.mark.parametrize("block", [1024, 16])
def test_no_link_of_a_bucket_is_lost(spark, monkeypatch, block):
    """Copies of one text around the least similarity: fingerprints mislead on which are alike, so trees of them miss links. Buckets are cut into blocks, or not."""
    monkeypatch.setattr(nearcopies, "BLOCK", block, raising=False)
    texts = [edited(prose(80 + i % 3, 300), i, 0.018) for i in range(450)]
    want = set(groups(texts))
    assert 20 < len(want) < 400 and kept_of(spark, texts) == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_that_share_a_key_come_once(blocks):
    """All pairs that share a key, whatever their bits, but those of one component and those that sizes or bins show to be no links, over batches of any size."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n, least = 150, 0.6
    prints = rng.integers(-(1 << 62), 1 << 62, (3, 2))[rng.integers(0, 3, n)]
    for _ in range(10):
        prints ^= 1 << rng.integers(0, 63, (n, 2))
    anchors = [sorted(rng.choice(7, rng.integers(1, 5), replace=False).tolist()) for _ in range(n)]
    component = rng.integers(0, 9, n)
    sketches = [np.unique(rng.integers(0, 400, rng.integers(70, 200))) for _ in range(n)]
    size, bins = [len(x) for x in sketches], [np.bincount(x % 32, minlength=32) for x in sketches]
    each = [(i, a, int(prints[i, 0]), int(prints[i, 1]), [x for x in anchors[i] if x < a]) for i in range(n) for a in anchors[i]]
    columns = [pa.array(c, k) for c, k in zip(zip(*each), [pa.int64()] * 4 + [pa.list_(pa.int64())])]
    keyed = pa.Table.from_batches(nearcopies._key_batches(iter([pa.RecordBatch.from_arrays(columns, names=["node", "anchor", "print_1", "print_2", "lower"])]))).to_pylist()
    keys = {}
    for r in keyed:
        keys.setdefault(r["key"], set()).add(r["node"])
    want = {(i, j) for of in keys.values() for i in of for j in of if i < j and component[i] != component[j] and min(size[i], size[j]) / max(size[i], size[j]) >= least and np.minimum(bins[i], bins[j]).sum() >= least / (1 + least) * (size[i] + size[j])}
    assert want >= {(i, j) for of in keys.values() for i in of for j in of if i < j and component[i] != component[j] and len(np.intersect1d(sketches[i], sketches[j])) >= least * len(np.union1d(sketches[i], sketches[j]))}
    rows = []
    for r in keyed:
        i, block = r["node"], r["node"] % blocks
        for other in range(blocks):
            rows.append((r["key"], min(block, other), max(block, other), block, i, int(component[i]), size[i], nearcopies._bins(sketches[i]), r["code"], r["lower"], r["print_1"], r["print_2"]))
    rows.sort(key=lambda r: (*r[:3], r[4]))
    names = ["key", "lo", "hi", "block", "node", "component", "size", "bins", "code", "lower", "print_1", "print_2"]
    kinds = [pa.list_(pa.int64()) if c == "lower" else pa.binary() if c == "bins" else pa.int64() for c in names]
    for step in (7, 1000, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + step]), kinds)], names=names) for at in range(0, len(rows), step)]
        found = []
        for whole in nearcopies._whole_groups(iter(batches), 500):
            node = whole.column("node").to_numpy()
            for i, j in nearcopies._pairs(whole, least):
                found += [tuple(sorted(x)) for x in zip(node[i].tolist(), node[j].tolist())]
        assert len(found) == len(want) > 500 and set(found) == want


def test_sketches_alike_as_in_sql(spark):
    from tidegrid.llm.sketches import resemblance

    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 40, 500, 511, 512, 700, 3000):
        for share in (0.1, 0.17, 0.2, 0.22, 0.25):
            both = rng.integers(0, 1 << 31, size)
            one, other = (np.unique(np.concatenate([both[int(share * size / 2) :] if k else both[: size - int(share * size / 2)], rng.integers(0, 1 << 31, k)]))[: nearcopies.SKETCH] for k in (0, 3))
            rows.append((one.tolist(), other.tolist()))
    df = spark.createDataFrame(rows, "x array<int>, y array<int>")
    want = [r[0] >= 0.8 for r in df.select(resemblance(F.col("x"), F.col("y"), nearcopies.SKETCH)).collect()]
    assert 3 < sum(want) < len(want) - 3
    assert want == [bool(nearcopies._alike(np.array(x), [np.array([5]), np.array(y)], 0.8)[1]) for x, y in rows]


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = docs.collect()
    found = nearcopies.keep_one_of_each_group(docs)
    assert found.columns == docs.columns
    got = found.collect()
    of = dict(zip(map(repr, rows), groups([r.text for r in rows])))
    assert len(got) == len(set(of.values())) and {of[repr(r)] for r in got} == set(of.values())
    for r in got:
        ids = [x.doc_id for x in rows if of[repr(x)] == of[repr(r)] and x.doc_id is not None]
        assert r.doc_id == (min(ids) if ids else None)


@pytest.mark.parametrize("name", ["_kept", "_key0", "_key1", "row", "first", "node", "a b.c"])
def test_columns_of_any_name(spark, name):
    rows = [(i, prose(i % 3, 50), f"x{i}", {"k": i}) for i in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, `{name}` string, m map<string, int>")
    assert sorted(tuple(r) for r in nearcopies.keep_one_of_each_group(docs).collect()) == rows[:3]


def test_repeats_that_differ_elsewhere(spark):
    """Rows alike but for another column are rows of one group: one of them stays, whole."""
    rows = [(1, prose(1, 50), "u"), (1, prose(1, 50), "v"), (1, prose(1, 50), "v"), (None, prose(2, 50), None), (None, prose(2, 50), "")]
    found = [tuple(r) for r in nearcopies.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string, other string")).collect()]
    assert len(found) == 2 and set(found) <= set(rows)


def test_empty_table(spark):
    assert nearcopies.keep_one_of_each_group(documents(spark).limit(0)).count() == 0
