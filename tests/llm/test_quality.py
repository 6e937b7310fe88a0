import math
import zlib

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.helpers import documents
from tidegrid.llm import quality, queries


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, quality.FACTORS)))
    rows = [(rng.choice(50, 7, replace=False), rng.normal(size=7)) for _ in range(5)]
    for (i, x), got in zip(rows, m.margins(rows)):
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(7) for b in range(a))
        assert got == pytest.approx(0.3 + m.weights[i] @ x + pairs)


def test_blocks_of_a_long_text_add_up(monkeypatch):
    text = "a a b B\n\nb c  c\tc d " * 50
    whole = quality.features(text, 7)
    counts, runs = quality.word_counts(text)
    words = text.lower().split()
    assert counts == quality.Counter(words) and runs == sum(x == y for x, y in zip(words, words[1:]))
    monkeypatch.setattr(quality, "BLOCK", 5)
    assert quality.word_counts(text) == (counts, runs) and all((x == y).all() for x, y in zip(quality.features(text, 7), whole))


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    found = queries.op2_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.99 and np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.99
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def plain_features(text, n_chars):
    """{index: value} of a document, by plain loops over its words, characters and lines."""
    text = text or ""
    words, raw, lines = text.lower().split(), text.encode("utf-8"), text.split("\n")
    n, size = max(1, len(words)), max(1, len(raw))
    upper, lower, digits = (sum(b in kind for b in raw) for kind in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
    high, white = sum(b > 127 for b in raw), sum(b <= 32 for b in raw)
    often = {w: words.count(w) for w in set(words)}
    share = lambda part: int(15 * min(1.0, part))
    bins = [
        min(15, int(math.log2(1 + len(words)))),
        min(15, len(text) // n),
        share(len(often) / n),
        share(max(often.values(), default=0) / n),
        share(upper / max(1, upper + lower)),
        share(4 * digits / size),
        share(3 * (len(raw) - upper - lower - digits - high - white) / size),
        share(sum(not w[-1].isalnum() for w in words) / n),
        share(8 * len(lines) / n),
        share(sum(line in lines[:i] for i, line in enumerate(lines)) / len(lines)),
        share(4 * high / size),
        0 if n_chars is None else 2 - (n_chars == len(text)),
        share(sum(a == b for a, b in zip(words, words[1:])) / n),
    ]
    hashed = [(zlib.crc32(w.encode()) >> 16, math.log(1 + k)) for w, k in often.items()]
    length = math.sqrt(sum(v * v for _, v in hashed)) or 1.0
    return [(i, v / length) for i, v in hashed] + [(65536 + 16 * i + b, 1 / math.sqrt(13)) for i, b in enumerate(bins)]


def test_query_equals_brute_force(spark):
    """Every score is the sigmoid of the machine's sum over all pairs of a document's features, formed one by one."""
    sf = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.learn(docs, labels)
    w, v = machine.weights.astype(float), machine.factors.astype(float)
    want = {}
    for r in docs.collect():
        x = plain_features(r.text, r.n_chars)
        index, value = np.array([i for i, _ in x]), np.array([a for _, a in x])
        rows = v[index] * value[:, None]
        pairs = sum(float(rows[a] @ rows[a + 1 :].sum(axis=0)) for a in range(len(x)))
        margin = min(30.0, max(-30.0, machine.bias + float(w[index] @ value) + pairs))
        want[r.doc_id] = 1 / (1 + math.exp(-margin)), zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    found = queries.op2_quality_classifier(spark, sf).collect()
    assert len(found) == len(want) == docs.count()
    for r in found:
        score, held_out = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-6) and r.held_out == held_out and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_teach_nothing(spark):
    docs = documents(spark)
    labels = [(i, i % 2) for i in range(25)]
    held = {r.doc_id for r in docs.select("doc_id", quality.fold("doc_id", 5).alias("f")).collect() if r.f == 0}
    a = quality.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    b = quality.learn(docs, spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id bigint, quality int"))
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all() and a.bias == b.bias


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (3, 0), (4, 1), (999, 1)], "doc_id bigint, quality int")
    rows = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    fives = {r.score for r in rows if r.doc_id == 5}
    assert len(fives) == 1
    assert all(r.held_out for r in rows if r.doc_id is None)


def test_without_labels_and_without_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.learn(docs, none)
    assert all(abs(r.score - 0.5) < 0.1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_filter_keeps_rows_as_they_are(spark):
    docs = documents(spark)
    model = quality.Machine(0.0, np.zeros(quality.DIMENSION), np.zeros((quality.DIMENSION, quality.FACTORS)))
    assert sorted(map(repr, quality.keep_good(docs, model, 0.4).collect())) == sorted(map(repr, docs.collect()))
    assert quality.keep_good(docs, model, 0.6).count() == 0
