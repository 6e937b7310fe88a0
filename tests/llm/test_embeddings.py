import numpy as np
import pytest

from tidegrid.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, cid string, block string"


def brute(rows, least=0.93):
    usable = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(v != 0 for v in r[1]) for r in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], "f4").astype("f8"), np.array(rows[j][1], "f4").astype("f8")
                near[i, j] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    least_id = {}
    for i, r in enumerate(rows):
        least_id[label[i]] = min(least_id.get(label[i], r[0]), r[0])
    return near.sum(axis=1), [least_id[c] for c in label]


def cloud(rng, n, d, spread):
    centre = rng.normal(size=d)
    return [(centre + spread * np.linalg.norm(centre) / np.sqrt(d) * rng.normal(size=d)).tolist() for _ in range(n)]


def test_links_and_components(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for k, spread in enumerate((0.05, 0.15, 0.2)):
        vectors += [(v, k % 2) for v in cloud(rng, 60, 64, spread)]
    vectors += [(rng.normal(size=64).tolist(), int(rng.integers(0, 3))) for _ in range(200)]
    vectors += [vectors[0], vectors[0], (vectors[0][0], 1), (vectors[0][0], None), (None, 0), ([], 0), ([0.0] * 64, 0), ([float("nan")] * 64, 0), ([None, 1.0], 0), ([float("inf"), 1.0], 0)]
    vectors += [([1.0, 2.0], 0), ([2.0, 4.0], 0), ([2.0, -1.0], 0)]
    rows = [(1000 - i, v, label) for i, (v, label) in enumerate(vectors)]
    links, components = brute(rows)
    found = {r.vec_id: r for r in embeddings.embedding_components(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    assert len(found) == len(rows)
    got = np.array([found[r[0]].n_links for r in rows])
    assert (got <= links).all() and got.sum() >= 0.999 * links.sum()
    assert [found[r[0]].component_id for r in rows] == components
    assert all(f.kept == (f.vec_id == f.component_id) for f in found.values())


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to find."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        x, z = rng.normal(size=64), rng.normal(size=64)
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        c = rng.uniform(0.9301, 0.95)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * z).tolist(), 0)]
    found = embeddings.embedding_components(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert found.agg({"n_links": "sum"}).first()[0] >= 0.999 * len(rows)


def test_repeated_rows_and_nothing(spark):
    rows = [(5, [1.0, 0.0], 1, "", ""), (5, [1.0, 0.0], 1, "", ""), (3, [-1.0, 0.0], 1, "", "")]
    found = sorted(tuple(r) for r in embeddings.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True)]
    assert embeddings.embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("d", [2, 16, 64, 100])
def test_rotation_gives_balanced_codes(d):
    x = np.random.default_rng(1).normal(size=(2000, d)) * np.linspace(0.5, 2, d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = embeddings.learn_rotation(x)
    share = (x @ r >= 0).mean(axis=0)
    assert r.shape == (d, 64) and (abs(share - 0.5) < 0.1).all()


def test_pairs_of_blocks_whatever_the_batches():
    """Buckets of any size, cut by batches anywhere: candidates within NEAR bits, and all pairs of blocks of a crowd."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sizes = [1, 2, 40, 600, 3, 513, 512, 1500, 1, 700]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    codes = rng.integers(0, 1 << 62, len(keys))
    blocks = rng.integers(0, 30, len(keys))
    want = set()
    for k, size in enumerate(sizes):
        c, b = codes[keys == k], blocks[keys == k]
        near = np.bitwise_count(c[:, None] ^ c[None, :]) <= embeddings.NEAR
        for i, j in zip(*np.nonzero(np.triu(near | (size > embeddings.CROWD), 1))):
            want.add((min(b[i], b[j]), max(b[i], b[j])))
    for least in (1, 97, 100_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50]) for c in (keys, codes, blocks)], names=["key", "code", "block"]) for lo in range(0, len(keys), 50)]
        some = embeddings._some
        embeddings._some = lambda b, least=least: some(b, least)
        try:
            found = {(a, b) for out in embeddings._pair_batches(iter(batches)) for a, b in zip(*(c.to_pylist() for c in out.columns))}
        finally:
            embeddings._some = some
        assert found - {(b, b) for b in range(30)} == {p for p in want if p[0] != p[1]} and {p for p in want if p[0] == p[1]} <= found


def test_a_bucket_of_a_million_vectors_takes_little_memory():
    import resource

    import pyarrow as pa

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    def batches():
        for lo in range(0, 1_000_000, 50_000):
            at = np.arange(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int64)), pa.array(at), pa.array(at // embeddings.BLOCK // 16)], names=["key", "code", "block"])

    n = 1_000_000 // embeddings.BLOCK // 16 + 1
    assert sum(len(b) for b in embeddings._pair_batches(batches())) == n * (n + 1) // 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
