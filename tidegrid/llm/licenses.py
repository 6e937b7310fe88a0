"""Licence scan by diagonal voting.

All rolling hashes of K words of all documents are joined to the positions at which the licence templates have
them. A copy of a template shows as many matches on one diagonal (position in the document less position in the
template); words put in or left out move the rest to a diagonal nearby. Votes are counted by diagonal, and
neighbouring diagonals are merged: in their order, as long as the next is no further away than the template is
long, so a stray match can't part what belongs together. A merged run of enough votes is a stretch of the document,
whose runs of K words are then compared with the template's for the spans to report.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bounded_batches, stored
from tidegrid.llm.license_texts import PHRASES, TEMPLATES
from tidegrid.llm.shingles import plain_words, rolling_hashes

K = 3
LEAST = 0.8  # similarity of a verified span


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def template_positions(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """((template, at, hash) for all positions, (template, label, template_words)). Their size is that of the list."""
    rows = [(i, label, template_words(text)) for i, (label, text) in enumerate(templates)]
    named = spark.createDataFrame(rows, "template int, label string, template_words array<string>")
    places = named.select("template", F.posexplode(rolling_hashes(F.col("template_words"), K)).alias("at", "hash"))
    return places, named


def _phrase_starts(words: Column, phrase: list[str]) -> Column:
    def here(i: Column) -> Column:
        cond = F.get(words, i) == F.lit(phrase[0])
        for j, w in enumerate(phrase[1:], 1):
            cond = cond & (F.get(words, i + j) == F.lit(w))
        return cond

    return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 1)), here)


def _with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, row, words): ``row``, two hashes, tells texts apart, so texts alike are scanned as one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row.alias("row"), plain_words(text).alias("words"))


def matches(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(row, template, diagonal, first, last, votes): all matches of rolling hashes, counted by diagonal; copies of a text vote once."""
    places, _ = template_positions(docs.sparkSession, templates)
    grams = _with_words(docs).select("row", F.posexplode(rolling_hashes(F.col("words"), K)).alias("pos", "hash"))
    found = grams.join(F.broadcast(places), "hash")  # a row for each position of the template list above
    return (
        found.withColumn("diagonal", F.col("pos") - F.col("at"))
        .groupBy("row", "template", "diagonal")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("pos").alias("votes"))
    )


def stretches(votes: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, template, first, last, votes, runs): neighbouring diagonals of ``votes`` (see matches) merged.

    ``runs`` (template, runs) is the number of distinct runs of K words of each template. Diagonals of a text and template
    stand in order; one that is more than ``runs`` behind the last starts a new stretch. What a text has of one template
    is in one task: a row for each diagonal, no more than the text has words.
    """
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("runs")).cast("int"), F.lit(0))
    dealt = votes.join(F.broadcast(runs), "template").withColumn("apart", apart)  # a row for each template of the list
    dealt = dealt.withColumn("stretch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = dealt.groupBy("row", "template", "stretch", "runs").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"))
    return merged.select("row", "template", "first", "last", "votes", "runs")


def _gram_ids(codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of word codes from 1 the ids of its runs of K words, equal for equal runs; one of all where there are fewer."""
    padded = [np.pad(c.astype(np.int64), (0, max(0, K - len(c)))) for c in codes]
    size = int(max(c.max(initial=0) for c in padded)) + 1
    ids = [c[: len(c) - K + 1] for c in padded]
    for k in range(1, K):
        keys = np.concatenate([i * size + c[k : len(c) - K + 1 + k] for i, c in zip(ids, padded)])
        ids = np.split(np.unique(keys, return_inverse=True)[1], np.cumsum([len(i) for i in ids])[:-1])
    return ids


def best_spans(grams: list[int], template: set[int], least: float) -> list[tuple[float, int, int]]:
    """(similarity, first, last) of runs' places: the span of the greatest similarity, then that of the rest, and so on down to ``least``.

    Spans share no word. A span that starts or ends with a run that the template lacks, or whose first run comes again in it,
    is no better than a shorter one, and one with too many other runs can't reach ``least``; all others are tried. A span
    goes on over the runs beside it that it has already.
    """
    starts = [i for i, g in enumerate(grams) if g in template]
    size = len(template)
    if not starts or len({grams[i] for i in starts}) / size < least:
        return []

    def best(first: int, end: int) -> tuple[float, int, int] | None:
        common, other, top = set(), set(), None
        for at in range(first, end):
            g = grams[at]
            if g not in template:
                other.add(g)
                if size / (size + len(other)) < least:
                    break
            elif g not in common:
                common.add(g)
                score = len(common) / (size + len(other))
                if score >= least and (top is None or score > -top[0]):
                    top = (-score, first, at)
                if len(common) == size:
                    break
            elif g == grams[first]:
                break
        return top

    heap = [top for i in starts if (top := best(i, len(grams)))]
    heapify(heap)
    taken: list[tuple[int, int]] = []
    found = []
    while heap:
        score, first, last = heappop(heap)
        k = bisect_left(taken, (first, -1))
        start = taken[k - 1][1] + K if k else 0
        if start > first:
            continue
        end = taken[k][0] - K + 1 if k < len(taken) else len(grams)
        if last >= end:
            if top := best(first, end):
                heappush(heap, top)
            continue
        held = template.intersection(grams[first : last + 1])
        while first > start and grams[first - 1] in held:
            first -= 1
        while last + 1 < end and grams[last + 1] in held:
            last += 1
        insort(taken, (first, last))
        found.append((-score, first, last))
    return found


def _span_batches(templates: list[list[str]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w for t in templates for w in t], pa.string())
        ends = np.cumsum([len(t) for t in templates])
        for batch in batches:
            found = []
            for i, places in enumerate(batch.column(1).to_pylist()):
                words = batch.column(2)[i].values.cast(pa.string())
                codes = pa.concat_arrays([known, words]).dictionary_encode().indices.to_numpy(zero_copy_only=False) + 1
                *parts, text = _gram_ids(np.split(codes, ends))
                for p in sorted(places, key=lambda p: (p["template"], p["first"])):
                    grams = text[p["first"] : p["last"] + 1].tolist()
                    for score, first, last in best_spans(grams, set(parts[p["template"]].tolist()), least):
                        found.append((i, p["template"], p["first"] + first, p["first"] + last, score))
            rows = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types, 1)]
            yield pa.RecordBatch.from_arrays([rows, *columns], names=["row", "template", "first", "last", "similarity"])

    return run


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(row, label, template, first_word, last_word, similarity): verified spans; ``row`` as in _with_words.

    similarity is the share of common among all distinct runs of K words of the span and the template. Of a stretch
    the best span comes first, then the best of what it leaves (see best_spans). A span of that similarity has votes for
    that share of the template's runs, so stretches of fewer are left out. Copies may be edited by any changes that keep the
    similarity; of words put in, no more than the template is long stand in one place.
    """
    templates = TEMPLATES if templates is None else templates
    bounded_batches(docs.sparkSession)
    places, named = template_positions(docs.sparkSession, templates)
    runs = places.groupBy("template").agg(F.count_distinct("hash").alias("runs"))
    likely = stretches(matches(docs, templates), runs).where(F.col("votes") / F.col("runs") >= F.lit(least))
    likely = likely.groupBy("row").agg(F.collect_list(F.struct("template", "first", "last")).alias("places"))  # of one text
    likely = stored(likely, "license-likely")
    texts = _with_words(docs).select("row", "words").join(likely.select("row"), "row", "left_semi").dropDuplicates(["row"])
    cut = likely.join(texts, "row").select("row", "places", "words")
    row = "row struct<one: bigint, two: bigint>"
    found = cut.mapInArrow(_span_batches([template_words(text) for _, text in templates], least), row + ", template int, first bigint, last bigint, similarity double")
    found = found.join(F.broadcast(named), "template")  # the template list above
    return found.select("row", "label", "template", F.col("first").alias("first_word"), (F.col("last") + K - 1).alias("last_word"), "similarity")


def scan_documents(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    n_base counts the places of the base phrases, first_word and last_word are their least and largest start;
    labels are the base labels and those of verified spans; score is the largest similarity of a verified span, 1 where a base phrase
    stands. Defined cases: null and empty texts have no words; a text shorter than K words matches no template of
    K words or more; nested and repeated copies are all counted in votes, one label each; repeated rows each come
    back; an empty table gives no rows.
    """
    whole = _with_words(docs)
    holds = F.array_contains(F.col("words"), "license")
    none = F.array().cast("array<int>")
    starts = {f"base_{i}": F.when(holds, _phrase_starts(F.col("words"), phrase)).otherwise(none) for i, (_, phrase) in enumerate(PHRASES)}
    base = whole.withColumns(starts)
    every = F.flatten(F.array(*[F.col(c) for c in starts]))
    named = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (label, _) in zip(starts, PHRASES)]), lambda x: x.isNotNull())
    base = base.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), every.alias("starts"), F.array_sort(F.array_distinct(named)).alias("base"))
    found = spans(docs, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("similarity").alias("best"))
    found = stored(found, "license-labels")  # a row for each text with a span: its size decides how it is joined
    both = base.join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
