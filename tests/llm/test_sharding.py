import zlib

import pytest

from tests.llm.helpers import documents, prose
from tidegrid.llm import sharding


def check(rows, texts, shards):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = {}
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_shards_are_even_and_gapless(spark, range_rows):
    docs = documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check(sharding.shard_documents(docs, range_rows=range_rows).collect(), texts, 8)


def test_a_third_of_equal_texts_is_cut(spark):
    rows = [(i, "the same text" if i % 3 == 0 else prose(i, 10)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = sharding.stored(sharding.keyed(docs, []), "keys")
    sizes = [r["count"] for r in sharding.ranged(keyed, 40).groupBy("range").count().collect()]
    assert max(sizes) <= 40
    found = sharding.shard_documents(docs, range_rows=40).collect()
    check(found, rows, 8)
    order = {}
    for r in sorted(found, key=lambda r: (r.shard, r.slot)):
        order.setdefault(r.text_crc32, []).append((r.shard, r.slot))
    places = sorted((r.shard, r.slot) for r in found)
    same = order[zlib.crc32(b"the same text")]
    start = places.index(same[0])
    assert places[start : start + len(same)] == same  # equal texts stand together


def test_repeated_rows_and_few_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(2, None)], "doc_id bigint, text string")
    check(sharding.shard_documents(docs, range_rows=5).collect(), [(1, "a")] * 50 + [(2, None)], 8)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    one = sharding.shard_documents(docs.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_rows_alike_are_one_until_they_are_placed(spark):
    """A third of all rows has no id and one text: no range holds them, and each gets its slot."""
    rows = [(None, "same")] * 500 + [(i, prose(i, 10)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sharding.keyed(docs, []).count() == 1001
    check(sharding.shard_documents(docs, range_rows=40).collect(), rows, 8)


def test_columns_are_carried(spark):
    docs = documents(spark)
    found = sharding.shard_documents(docs, carry=["text", "key"]).select("text_crc32", "carried.text", "carried.key").collect()
    assert all(zlib.crc32((r.text or "").encode()) == r.text_crc32 and r.key == "key" for r in found)


def test_reruns_agree(spark):
    docs = documents(spark)
    a = sharding.shard_documents(docs, range_rows=7).select("doc_id", "text_crc32", "shard", "slot")
    b = sharding.shard_documents(docs.repartition(5), range_rows=7).select("doc_id", "text_crc32", "shard", "slot")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_no_python_in_the_plan(spark):
    plan = sharding.shard_documents(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_one_key_that_fills_all_quantiles(spark):
    """A heavy key amid light ones: ranges are cut until only equal keys are left together."""
    keys = [5] * 3000 + list(range(10)) + [10**12 + i for i in range(30)]
    rows = spark.createDataFrame([(i, k, 0, 1 + (i == 4) * 10**6, 1, 0) for i, k in enumerate(keys)], "doc_id bigint, key bigint, text_crc32 bigint, size bigint, copies bigint, range bigint")
    found = sharding.ranged(sharding.stored(rows, "keys"), 8).groupBy("range").agg({"key": "min", "*": "count"}).collect()
    spans = sharding.ranged(sharding.stored(rows, "keys"), 8).groupBy("range").agg(sharding.F.min("key").alias("lo"), sharding.F.max("key").alias("hi"), sharding.F.count("*").alias("n")).orderBy("range").collect()
    assert len(found) == len(spans) and all(r.n <= 8 or r.lo == r.hi for r in spans)
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
