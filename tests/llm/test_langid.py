import random
import zlib
from collections import Counter

import numpy as np

from tests.conftest import DATA
from tests.llm.helpers import documents
from tidegrid.llm import langid, queries


def brute_grams(text):
    run = [" "]
    for ch in text.lower():
        if ch.isalpha():
            run.append(ch)
        elif run[-1] != " ":
            run.append(" ")
    if run[-1] != " ":
        run.append(" ")
    s = "".join(run)
    grams = Counter(ch for ch in s if ch != " ") + Counter(s[i : i + 2] for i in range(len(s) - 1))
    return grams + Counter(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")


def as_text(code):
    parts = [code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF]
    return "".join(chr(p) for p in parts if p)


def test_counts_are_those_of_the_text(monkeypatch):
    rng = random.Random(2)
    for size in (1 << 20, 16, 1, 2):
        monkeypatch.setattr(langid, "BLOCK", size)
        for _ in range(60):
            text = "".join(rng.choice("ab cé1-Ü\n你 ") for _ in range(rng.randrange(0, 200)))
            codes, counts = langid.count_grams(text)
            want = brute_grams(text) if any(c.isalpha() for c in text) else Counter()
            assert {as_text(int(c)): int(n) for c, n in zip(codes, counts)} == dict(want)


def test_words_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 1000)
    for text in ("a" * 5000, "ab" * 2500 + " c", "x" * 999 + " y", "x" * 1000 + " y", "1" * 3000 + "a"):
        codes, counts = langid.count_grams(text)
        assert {as_text(int(c)): int(n) for c, n in zip(codes, counts)} == dict(brute_grams(text))


def test_ranks_and_distance():
    codes, counts = np.array([5, 6, 7, 8]), np.array([2, 9, 2, 9])
    assert langid.ranked(codes, counts, 3).tolist() == [6, 8, 5]
    model = langid.Profiles.of([("x", 97, 0), ("x", 32 << 21 | 97, 1), ("y", 98, 0)], top=4)
    found = langid.ranked(*langid.count_grams("a"), 4).tolist()
    apart = sum(abs(i - {97: 0, 32 << 21 | 97: 1}.get(c, i + 4)) for i, c in enumerate(found))
    assert model.predict("a") == ("x", 1 - apart / (4 * len(found)))
    assert model.predict("123") == model.predict(None) == model.predict("") == ("und", 0.0)


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    found = queries.op5_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.99


def test_held_out_rows_teach_nothing(spark):
    docs = documents(spark, extra=False)
    held = langid.fold("doc_id", 4) == 2
    changed = docs.withColumn("lang", langid.F.when(held, "zz").otherwise(langid.F.col("lang"))).withColumn("text", langid.F.when(held, "qqq").otherwise(langid.F.col("text")))
    a, b = langid.learn_from_documents(docs), langid.learn_from_documents(changed)
    assert a.langs == b.langs and (a.codes == b.codes).all() and (a.ranks == b.ranks).all()


def test_awkward_rows(spark):
    docs = documents(spark)
    model = langid.learn_from_documents(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" and r.score > 0 for r in rows)


def test_nothing_learned(spark):
    empty = documents(spark).limit(0)
    model = langid.learn_from_documents(empty)
    assert model.langs == [] and langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark), model).collect()} == {"und"}


def test_query_equals_brute_force(spark, tmp_path):
    """Profiles by counting all texts, distances by lists: the same predictions and scores."""
    docs = [r for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect() if r.text]
    learned = {}
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, Counter()).update(brute_grams(r.text) if any(c.isalpha() for c in r.text) else {})

    def code(gram):
        return tuple([0] * (3 - len(gram)) + [ord(c) for c in gram])

    def ranks(grams):
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[: langid.PROFILE]]

    profiles = {lang: {g: i for i, g in enumerate(ranks(grams))} for lang, grams in learned.items()}
    found = {r.doc_id: r for r in queries.op5_language_id(spark, f"{DATA}/sf0.001").collect()}
    for r in docs:
        f = found[r.doc_id]
        assert f.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r.text):
            assert (f.lang_pred, f.score) == ("und", 0.0)
            continue
        mine = ranks(brute_grams(r.text))
        apart = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert f.lang_pred == best and abs(f.score - (1 - apart[best] / (langid.PROFILE * len(mine)))) < 1e-12
