"""The pipeline against its operators applied one by one in plain Python, on a small table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.helpers import documents, prose
from tests.llm.test_nearcopies import groups as near_groups
from tidegrid.llm import langid, mixing, quality

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = documents(spark, extra=False).unionByName(spark.createDataFrame([(100 + i, prose(i, 60), "en", "src", 1) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    docs = docs.where("doc_id is not null and doc_id not in (5, 7)")
    docs.write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(140)], "doc_id bigint, quality int").write.parquet(path + "/labels.parquet")
    return path


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "source_mixing", "bpe_encode_decode"]


def test_equals_the_plain_version(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    labels = spark.read.parquet(folder + "/labels.parquet")
    profiles = langid.learn_from_documents(docs)
    rows = docs.collect()
    rows = [r for r in rows if (p := profiles.predict(r.text))[0] != "und" and p[1] > corpus_pipeline.LEAST_LANGUAGE_SCORE]
    machine = quality.learn(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if machine.scores([quality.features(r.text, r.n_chars)])[0] >= quality.THRESHOLD]
    groups = near_groups([r.text for r in rows])
    least = {}
    for r, g in zip(rows, groups):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id in set(least.values())]
    times = {r.doc_id: r.times for r in mixing.mix_documents(spark.createDataFrame(rows, docs.schema)).collect()}
    tok = tokenizers.Tokenizer.from_file(corpus_pipeline.byte_bpe_path())
    want = []
    for r in rows:
        ids = tok.encode(r.text, add_special_tokens=False).ids
        want += [(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] * times[r.doc_id]
    found = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) > 20 and sorted(map(tuple, found)) == sorted(want)


def test_stages_keep_columns_and_survive_nothing(spark, folder):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


@pytest.mark.parametrize("name", ["_kept", "_mix", "_mix_row", "_mix_at", "_key0", "_row", "_turn"])
def test_extra_columns_pass_as_they_are(spark, folder, name):
    docs = documents(spark, extra=False)
    values = docs.select("*", F.concat(F.lit("v"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name))
    for stage_name, stage in corpus_pipeline.STAGES[2:4]:
        rows = stage(spark, values, folder).collect()
        assert rows and all(r[name] == "v" + ("none" if r.doc_id is None else str(r.doc_id)) for r in rows), stage_name


def test_one_of_each_group_stays(spark, folder):
    docs = documents(spark)
    kept = corpus_pipeline.dedup_stage(spark, docs, folder)
    ids = sorted(r.doc_id for r in kept.collect())
    assert [i for i in ids if ids.count(i) > 1] == [7, 7] and {12, 13, 14, 15, 26} & set(ids) == {14} and 0 in ids  # two texts of id 7; 3 and 14 are less alike


def test_different_texts_stay_whatever_their_ids(spark, folder):
    """Null and repeated ids of texts that aren't alike: a row of each group stays; rows alike and near copies don't."""
    ids = [None] * 5 + [7] * 5 + [1, 2]
    rows = [(d, prose(300 + i, 80), "en", "a", 1) for i, d in enumerate(ids)]
    copies = [rows[0], rows[5], (9, rows[6][1], "en", "a", 1), (None, rows[10][1], "en", "a", 1), (8, rows[1][1], "en", "a", 1)]
    docs = spark.createDataFrame(rows + copies, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.dedup_stage(spark, docs, folder).collect()
    want = [r for i, r in enumerate(rows) if i != 1] + [copies[4]]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_clean_texts_of_many_letters_stay(spark, folder):
    """Ideographs by Zipf's law: 400 n-grams a profile hold little of such a language, so its texts score low."""
    rng = random.Random(5)
    letters, weights = [chr(0x4E00 + i) for i in range(2500)], [1 / (i + 1) for i in range(2500)]
    texts = ["".join(rng.choices(letters, weights, k=rng.randint(40, 100))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "zh", "a", len(t)) for i, t in enumerate(texts)] + [(400, "!!! 123", "zh", "a", 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, folder).collect()) == list(range(400))


def test_clean_documents_stay(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = corpus_pipeline.quality_stage(spark, corpus_pipeline.language_stage(spark, docs, sf), sf)
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(good - left) <= 0.01 * len(good)
