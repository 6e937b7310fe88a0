import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, edited, prose
from tidegrid.llm import sketches
from tidegrid.llm.shingles import white_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 2000])
def test_fingerprints(spark, bucket_bytes):
    docs = documents(spark).where("doc_id is not null and doc_id not in (5, 7)")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in sketches.fingerprint_documents(docs, bucket_bytes=bucket_bytes).collect()}
    assert len(found) == len(rows)
    for i, r in enumerate(rows):
        text, following = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        f = found[r.doc_id]
        assert (f.n_chars, f.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        small = max(len(shingles(t)) for t in (text, changed, following)) < sketches.SIZE
        for got, other in ((f.near_edited, changed), (f.near_next, following)):
            assert got == pytest.approx(jaccard(shingles(text), shingles(other)), abs=1e-9 if small else 0.2)
    same = [found[i].fingerprint for i in (0, 12, 13)]
    assert len(set(same)) == 1 and found[16].fingerprint == found[17].fingerprint == ""


def test_repeated_and_null_ids(spark):
    docs = documents(spark)
    found = sketches.fingerprint_documents(docs, bucket_bytes=2000).collect()
    assert len(found) == docs.count() and sum(r.doc_id is None for r in found) == 2
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(by_id[5]) == 1 and len(by_id[7]) == 2


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(4, "one two three four five six")], "doc_id bigint, text string")
    r = sketches.fingerprint_documents(docs).first()
    assert r.near_next == 1.0 and r.n_shingles == 2.0 and r.contained_next == 1.0
    assert sketches.fingerprint_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_buckets_never_fall(spark, parts):
    cuts = sorted(random.Random(1).sample(range(-1000, 1000), 300) + [7] * 9 + [sketches.LEAST_ID] * 4)
    keys = spark.range(-1100, 1100).withColumnRenamed("id", "key").unionByName(spark.createDataFrame([(sketches.LEAST_ID,)], "key bigint"))
    rows = keys.crossJoin(spark.createDataFrame([(h * 1_073_741,) for h in range(0, 2000, 40)], "hash bigint"))
    got = rows.select("key", "hash", sketches._bucket(cuts, parts).alias("b")).orderBy("key", "hash").collect()
    assert all(a.b <= b.b for a, b in zip(got, got[1:])) and got[0].b >= 0
    assert len({r.b for r in got if r.key == 7}) >= 8 * parts and len({r.b for r in got if r.key == sketches.LEAST_ID}) >= 3 * parts
    if parts == 1:
        assert all(r.b == sum(c <= r.key for c in cuts) for r in got if cuts.count(r.key) < 2)


@pytest.mark.parametrize("most_cuts", [4096, 3])
def test_next_document_in_many_buckets(spark, most_cuts):
    """A third of all rows has no id: the order is that of id, hash and text, however it is cut."""
    rows = [(None if i % 3 == 0 else i * i, prose(i, 20)) for i in range(300)] + [(None, prose(0, 20))] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed, window = sketches.with_next(docs, bucket_bytes=500, most_cuts=most_cuts)
    assert placed.select("bucket").distinct().count() > 20
    found = placed.withColumn("next", F.lead("text").over(window)).where("donor = 0").collect()
    order = sorted(found, key=lambda r: (-r.key, -r.hash, r.text))
    assert len(order) == len(rows) and [r.next for r in order] == [r.text for r in order[1:]] + [order[0].text]


def test_estimates(spark):
    a = prose(1, 3000)
    b = edited(a, 5, 0.05)
    c = " ".join(a.split(" ")[:1500])
    rows = spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(*[white_words(F.col(k)).alias(k) for k in "abc"])
    s = rows.select(*[sketches.sketch(F.col(k)).alias(k) for k in "abc"])
    s = s.select("a", "b", "c", sketches.resemblance(F.col("a"), F.col("b")).alias("ab"), sketches.resemblance(F.col("a"), F.col("c")).alias("ac"))
    r = s.select("ab", "ac", sketches.distinct_shingles(F.col("a")).alias("n"), sketches.containment(F.col("ac"), F.col("c"), F.col("a")).alias("c_in_a")).first()
    assert r.ab == pytest.approx(jaccard(shingles(a), shingles(b)), abs=0.15)
    assert r.n == pytest.approx(len(shingles(a)), rel=0.3) and r.c_in_a > 0.8


def test_merged_parts_are_the_sketch_of_the_union(spark):
    rng = random.Random(6)
    parts = [(k, sorted(rng.sample(range(1, 1 << 32), n))[: sketches.SIZE]) for k, n in (("x", 500), ("x", 90), ("x", 300), ("y", 10), ("y", 3), ("z", 0), (None, 4))]
    merged = {r.k: r.sketch for r in sketches.merge(spark.createDataFrame(parts, "k string, sketch array<bigint>"), ["k"]).collect()}
    for k in ("x", "y", "z", None):
        assert merged[k] == sorted({h for key, s in parts if key == k for h in s})[: sketches.SIZE]


def test_no_python_in_the_plan(spark):
    plan = sketches.fingerprint_documents(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
