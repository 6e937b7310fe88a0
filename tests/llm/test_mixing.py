import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import documents, prose
from tidegrid.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights):
    """Targets by sharing the excess again and again."""
    out, left, room = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while room and left > 1e-9:
        total, more, left = sum(weights[i] for i in room), {}, left
        for i in room:
            more[i] = left * weights[i] / total
        left = 0.0
        for i, add in more.items():
            out[i] += add
            if out[i] >= 2 * sizes[i]:
                left += out[i] - 2 * sizes[i]
                out[i] = 2.0 * sizes[i]
                room.discard(i)
    return out


@settings(max_examples=25, deadline=None)
@given(sizes=st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    found = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint")).collect()
    got = {r.source: r.target for r in found}
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want, abs=1e-6)


def test_quotas_are_split_exactly(spark):
    quotas = [(0, 400), (1, 50), (2, 1), (3, 0)]
    rows = mixing.split_quotas(spark.createDataFrame(quotas, "sid int, quota bigint"), 3).collect()
    total, shards = {}, {}
    for r in rows:
        total[r.sid] = total.get(r.sid, 0) + r.quota
        shards[r.shard] = shards.get(r.shard, 0) + r.quota
    assert total == {0: 400, 1: 50, 2: 1} and max(shards.values()) - min(shards.values()) <= 3


def test_split_follows_the_law(spark):
    """Over many seeds the share of a source in a half has the hypergeometric mean and spread."""
    quotas = spark.createDataFrame([(0, 30), (1, 50)], "sid int, quota bigint").coalesce(1)
    counts = [next((r.quota for r in mixing.split_quotas(quotas, 1, seed).collect() if (r.shard, r.sid) == (0, 0)), 0) for seed in range(40)]
    mean = sum(counts) / len(counts)
    spread = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert abs(mean - 15) < 1.2 and 1.5 < spread < 12  # 4.75 in expectation


def test_documents(spark):
    docs = documents(spark)
    rows = docs.collect()
    found = mixing.mix_documents(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(((r.doc_id, r["size"]) for r in found), key=repr) == sorted(((r.doc_id, size(r.text)) for r in rows), key=repr)
    sources = {}
    for r in rows:
        sources[r.source] = sources.get(r.source, 0) + size(r.text)
    names = sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])
    want = dict(zip(names, fill([sources[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert sorted({(r.source_size, round(r.target, 6)) for r in found}) == sorted({(sources[n], round(want[n], 6)) for n in names})
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in found)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_taken_is_near_the_target(spark):
    rows = [(i, prose(i, 20 + i % 50), "abcd"[min(3, i % 7)]) for i in range(1500)]
    found = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    per = found.join(spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id bigint, source string"), "doc_id").groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.k - r.t) <= r.m for r in per)


def test_drawn_rows(spark):
    docs = documents(spark)
    times = {}
    for r in mixing.mix_documents(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + r.times
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    got = {}
    for r in drawn.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v}


def test_shards_are_disjoint_and_even(spark):
    rows = [(i, prose(i, 30), "abcd"[min(3, i % 9)]) for i in range(3000)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    sizes = {}
    for r in plan.collect():
        for s in [r.shard_1, r.shard_2][: r.times]:
            assert s is not None
            sizes[s] = sizes.get(s, 0) + r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.2 * min(sizes.values())


def test_nothing_to_mix(spark):
    docs = documents(spark)
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.draw(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.mix_documents(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python_in_the_plan(spark):
    for df in (mixing.mix_documents(documents(spark)), mixing.draw(documents(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
