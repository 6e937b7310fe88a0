"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, a blank at either
end of a word), most frequent first. A document is ranked the same way, over its whole text, and goes to
the language at the least out-of-place distance: the sum, over the document's n-grams, of how far the
n-gram's rank is from its rank in the profile, PROFILE if it isn't there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bounded_batches, fold, stored

PROFILE = 400
#: Documents of a language that its profile is learned from, in expectation: the bound of the sample.
TRAIN_PER_LANG = 2000
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
BLANK = 32
BLOCK = 1 << 20  # characters counted at once


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(cp: np.ndarray, known: int) -> np.ndarray:
    """Codes of the n-grams that end after the first ``known`` code points of words with single blanks between."""
    one = cp[known:]
    two = ((cp[:-1] << 21) | cp[1:])[max(0, known - 1) :]
    three = ((cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:])[max(0, known - 2) :]
    return np.concatenate([one[one != BLANK], two, three[cp[max(1, known - 1) : -1] != BLANK]])


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of the whole text; empty without letters.

    The text is read BLOCK characters at a time; the last two code points of a block go on with the next, so blocks may
    end anywhere, in a word of any length too.
    """
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = text.lower()
    held = np.array([BLANK], np.int64)
    for lo in range(0, len(text) + 1, BLOCK):
        cp = np.frombuffer(text[lo : lo + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _letters()[cp]
        before = np.concatenate([held[-1:] != BLANK, letter])[: len(cp)]
        new = np.where(letter, cp, BLANK)[letter | before]  # of what lies between words, one blank
        if lo + BLOCK > len(text) and np.concatenate([held, new])[-1] != BLANK:
            new = np.append(new, BLANK)
        if not len(new):
            continue
        run = np.concatenate([held, new])
        c, n = np.unique(_grams(run, len(held)), return_counts=True)
        held = run[-2:]
        if len(codes):
            merged, at = np.unique(np.concatenate([codes, c]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
            codes = merged
        else:
            codes, counts = c, n
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The ``top`` most frequent codes, most frequent first, equal counts by code (codes come sorted)."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        few = counts >= least
        codes, counts = codes[few], counts[few]
    return codes[np.argsort(-counts, kind="stable")[:top]]


@dataclass
class Profiles:
    langs: list[str]
    codes: np.ndarray  # all n-grams of all profiles, sorted
    ranks: np.ndarray  # (language, n-gram): rank, or -1
    top: int = PROFILE

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], top: int = PROFILE) -> Profiles:
        """From (lang, gram, rank from 0)."""
        langs = sorted({r[0] for r in rows})
        codes = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        ranks = np.full((len(langs), len(codes)), -1, dtype=np.int32)
        place = {lang: i for i, lang in enumerate(langs)}
        for lang, gram, rank in rows:
            ranks[place[lang], np.searchsorted(codes, gram)] = rank
        return cls(langs, codes, ranks, top)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 less the distance over the largest possible one."""
        mine = ranked(*count_grams(text), self.top) if text else np.zeros(0, np.int64)
        if not len(mine) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        known = self.codes[at] == mine
        ranks = np.where(known[None, :], self.ranks[:, at], -1)
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(mine))[None, :]), self.top).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.top * len(mine))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            langs.setdefault(lang, []).append(count_grams(text))
        for lang, found in langs.items():
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])


def learn(train: DataFrame, per_lang: int = TRAIN_PER_LANG, top: int = PROFILE) -> Profiles:
    """Profiles from rows (doc_id, text, lang): about ``per_lang`` documents a language, chosen by a hash of the id.

    Rows with a null text, language or id teach nothing. A language of fewer rows gives them all.
    """
    bounded_batches(train.sparkSession)
    known = train.where("lang is not null and text is not null and doc_id is not null")
    thin = known.select("doc_id", "lang")
    counts = thin.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = stored(thin.join(counts, "lang").where(share * F.col("rows") < per_lang).select("doc_id").distinct(), "langid-sample")
    sample = known.join(chosen, "doc_id", "left_semi").select("lang", "text")
    grams = sample.mapInArrow(_count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return Profiles.of([(r.lang, r.gram, r.place - 1) for r in best.select("lang", "gram", "place").collect()], top)


def learn_from_documents(docs: DataFrame) -> Profiles:
    """Profiles from the text and language of the documents outside the held-out fold."""
    return learn(docs.where(fold("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"))


def _predict_batches(model: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Defined cases: a null text and one without a letter is ``und`` at score 0, as is every text where no
    profile was learned; equal distances go to the language that is first by code point; repeated rows each
    come back; a null doc_id counts as an empty text for its fold; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = thin.mapInArrow(_predict_batches(model), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Profiles, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is determined at a score above ``least``."""
    bounded_batches(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (model.predict(t) for t in batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score > least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
