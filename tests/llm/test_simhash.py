import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, edited, prose
from tidegrid.llm import simhash
from tidegrid.llm.common import connected_components


def brute_print(text):
    import xxhash

    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{position: least position reachable} of a list of fingerprints."""
    a = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            return label
        label = new


def test_code_is_perfect():
    patterns, found = simhash.code_tables()
    assert sorted(np.bincount(found).tolist()) == [0] * 5 + [277, 1771]
    assert np.bitwise_count(patterns[:, 0].astype(np.uint64)).max() == 3


@settings(max_examples=50, deadline=None)
@given(value=st.integers(0, 2**64 - 1), bits=st.sets(st.integers(0, 63), max_size=4))
def test_keys_meet_within_four_bits(value, bits):
    other = value
    for b in bits:
        other ^= 1 << b
    at, keys = simhash.fuzzy_keys(np.array([value, other], dtype=np.uint64))
    assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())


def test_fingerprints_and_components(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    labels = brute_components(prints)
    ids = {}
    for r, g in zip(rows, labels):
        ids[g] = min((x for x in (ids.get(g), r.doc_id) if x is not None), default=None)
    want = sorted(((r.doc_id, f"{p:016x}", ids[g]) for r, p, g in zip(rows, prints, labels)), key=repr)
    found = simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == want


def test_blocks_of_a_long_text_add_up(monkeypatch):
    texts = [prose(3, 900), "a b\tc", " x" * 9, "one", " \n"]
    whole = [simhash.fingerprint(t) for t in texts]
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert [simhash.fingerprint(t) for t in texts] == whole == [brute_print(t) for t in texts]


def test_dense_group_and_chain(spark):
    """A ball of near fingerprints (searched, not paired) and a chain whose ends are far apart."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    ball = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 5)}
    chain, x = [], 2**63 + 12345
    for i in range(0, 60, 4):
        chain.append(x)
        x ^= 0xF << i
    alone = [int(v) for v in rng.integers(0, 2**63, 50)]
    prints = [*sorted(ball), *chain, *alone]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "print bigint"))
    found = {r.node: r.component for r in connected_components(edges).collect()}
    got = [found.get(s, s) for s in signed]
    want = brute_components(prints)
    assert len({(g, w) for g, w in zip(got, want)}) == len(set(got)) == len(set(want))
    assert edges.count() < 20 * len(prints)


def test_planted_copies_meet(spark):
    text = prose(8, 2000)
    rows = [(i, text if i % 2 else edited(text, i, 0.0005)) for i in range(20)] + [(i, prose(i, 300)) for i in range(100, 120)]
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[i] == i for i in range(100, 120)) and all(found[i] == found[1] for i in range(1, 20, 2))


def test_limit_is_checked_and_empty_is_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.simhash_components(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.links(empty.selectExpr("doc_id as print"), 5)


def test_components_of_long_chains(spark):
    n = 300
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001)], "a bigint, b bigint")
    found = {r.node: r.component for r in connected_components(path).collect()}
    assert len({found[i] for i in range(n + 1)}) == 1 and found[2000] == found[2001] != found[0] and 1000 not in found
