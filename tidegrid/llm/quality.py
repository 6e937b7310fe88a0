"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a sparse vector x is the sigmoid of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j.
The pairs are never formed: their sum is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), which
is linear in the number of features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches, fold, stored

WORD_BITS = 16
FACTORS = 4
BINS = 16
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows that the machine is trained on, in expectation: the bound of the sample, drawn by a hash of the id.
TRAIN_ROWS = 8192
EPOCHS, BATCH, RATE, SHRINK = 40, 256, 0.2, 1e-5
SEED = 20240229
BLOCK = 1 << 20  # characters of a text that are split at once
_WHITE = re.compile(r"\s")
STATISTICS = ("words", "word_length", "distinct", "top_word", "upper", "digits", "marks", "marked_words", "lines", "line_repeats", "high_bytes", "declared", "runs")
DIMENSION = (1 << WORD_BITS) + BINS * len(STATISTICS)


class _Buckets(dict):
    """Hash buckets of words, kept for the words met last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - WORD_BITS)
        return bucket


_buckets = _Buckets()


def _blocks(text: str) -> Iterator[str]:
    """A text, some BLOCK characters at a time; blocks end at white space."""
    lo = 0
    while lo < len(text):
        found = _WHITE.search(text, min(len(text), lo + BLOCK))
        hi = found.start() if found else len(text)
        yield text[lo:hi]
        lo = hi


def word_counts(text: str) -> tuple[Counter, int]:
    """Counts of the lowered words, and how often a word follows itself; a very long text is never a list of words."""
    counts, runs, last = Counter(), 0, None
    for block in _blocks(text):
        words = block.lower().split()
        counts.update(words)
        runs += sum(map(eq, words, words[1:])) + (bool(words) and words[0] == last)
        last = words[-1] if words else last
    return counts, runs


def statistics(text: str, counts: Counter, runs: int, n_chars: int | None) -> list[int]:
    """A bin from 0 to BINS - 1 for each of STATISTICS."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    total = counts.total()
    n, size = max(1, total), max(1, len(raw))
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    lower = np.count_nonzero((raw >= 97) & (raw <= 122))
    digits = np.count_nonzero((raw >= 48) & (raw <= 57))
    high = np.count_nonzero(raw >= 128)
    white = np.count_nonzero(raw <= 32)
    marks = len(raw) - upper - lower - digits - high - white
    lines = text.split("\n")
    marked = sum(k for w, k in counts.items() if not w[-1].isalnum())
    share = lambda a, b: int((BINS - 1) * min(1.0, a / b))
    log = lambda a: min(BINS - 1, int(np.log2(1 + a)))
    return [
        log(total),
        min(BINS - 1, int(len(text) / n)),
        share(len(counts), n),
        share(max(counts.values(), default=0), n),
        share(upper, max(1, upper + lower)),
        share(4 * digits, size),
        share(3 * marks, size),
        share(marked, n),
        share(8 * len(lines), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(4 * high, size),
        0 if n_chars is None else 1 if n_chars == len(text) else 2,
        share(runs, n),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features; the hashed words have length 1 together, the statistics too."""
    text = text or ""
    counts, runs = word_counts(text)
    base = 1 << WORD_BITS
    bins = [base + BINS * i + b for i, b in enumerate(statistics(text, counts, runs, n_chars))]
    if counts:
        index = np.fromiter(map(_buckets.__getitem__, counts), np.int64, len(counts))
        tf = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        tf /= np.sqrt((tf * tf).sum())
    else:
        index, tf = np.zeros(0, np.int64), np.zeros(0)
    weight = 1.0 / np.sqrt(len(bins))
    return np.concatenate([index, bins]), np.concatenate([tf, np.full(len(bins), weight)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # (DIMENSION,) float32
    factors: np.ndarray  # (DIMENSION, FACTORS) float32

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """w0 + linear part + pairs by the sum-of-squares identity, for many documents at once."""
        if not rows:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])[:-1]])
        index = np.concatenate([i for i, _ in rows])
        x = np.concatenate([v for _, v in rows])
        linear = np.add.reduceat(self.weights[index] * x, starts)
        vx = self.factors[index] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Log loss by AdaGrad over small batches, in an order that SEED fixes. Without rows every score is 0.5."""
    rng = np.random.default_rng(SEED)
    machine = Machine(0.0, np.zeros(DIMENSION), rng.normal(0, 0.02, (DIMENSION, FACTORS)))
    if rows:
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        machine.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(DIMENSION, 1e-6), np.full((DIMENSION, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if rows else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            pick = order[lo : lo + BATCH]
            part = [rows[i] for i in pick]
            lengths = np.array([len(i) for i, _ in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            error = (machine.scores(part) - labels[pick]) / len(part)
            index = np.concatenate([i for i, _ in part])
            x = np.concatenate([v for _, v in part])
            each = np.repeat(error, lengths)
            vx = machine.factors[index] * x[:, None]
            sums = np.repeat(np.add.reduceat(vx, starts, axis=0), lengths, axis=0)
            used, at = np.unique(index, return_inverse=True)
            dw = np.bincount(at, each * x, len(used)) + SHRINK * machine.weights[used]
            pull = (each * x)[:, None] * (sums - vx)
            dv = np.stack([np.bincount(at, pull[:, f], len(used)) for f in range(FACTORS)], axis=1) + SHRINK * machine.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            machine.weights[used] -= RATE * dw / np.sqrt(gw[used])
            machine.factors[used] -= 0.2 * RATE * dv / np.sqrt(gv[used])
            db = float(error.sum())
            gb += db * db
            machine.bias -= RATE * db / np.sqrt(gb)
    return Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = [batch.column(0), batch.column(3), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "at", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine from labelled documents outside the held-out fold: ``rows`` of them in expectation, by a hash of the id, or all if there are fewer.

    Null labels and ids teach nothing; a document with several labels counts by their majority, and not at all on a tie.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    voted = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("mean")).where("mean <> 0.5")
    voted = stored(voted.select("doc_id", (F.col("mean") > 0.5).cast("double").alias("label")), "quality-labels")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = stored(voted.where(share * F.lit(voted.count()) < rows), "quality-sample")
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("bigint").alias("n_chars"))
    sample = thin.join(chosen, "doc_id").select("doc_id", "text", "n_chars", "label")
    made = sample.mapInArrow(_feature_batches, "doc_id bigint, label double, at array<bigint>, x array<double>")
    made = made.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    rows_ = [(np.asarray(a, np.int64), np.asarray(x)) for a, x in zip(_lists(made["at"]), _lists(made["x"]))]
    return fit(rows_, made["label"].to_numpy().astype(float))


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in filter(len, column.chunks):
        flat, ends = chunk.flatten().to_numpy(zero_copy_only=False), chunk.value_lengths().to_numpy(zero_copy_only=False).cumsum()
        yield from np.split(flat, ends[:-1])


def _batch_scores(model: Machine, texts: pa.Array, n_chars: pa.Array) -> np.ndarray:
    return model.scores([features(t, n) for t, n in zip(texts.to_pylist(), n_chars.to_pylist())])


def _score_batches(model: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _batch_scores(model, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its text and n_chars alone.

    Defined cases: null and empty texts have no words and are scored by their statistics; a null n_chars has
    a bin of its own; repeated rows each come back, with equal scores; an empty table gives no rows; without
    labelled rows every score is about 0.5.
    """
    bounded_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("bigint").alias("n_chars"))
    found = thin.mapInArrow(_score_batches(model), "doc_id bigint, score double")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``threshold``."""
    bounded_batches(docs.sparkSession)
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(model, batch.column(text), batch.column(n_chars)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
