"""Words and their rolling hashes as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII characters between words, for words of other than white space and for words of letters and digits.
WHITE = "\t\n\x0b\x0c\r"
UPPER = "".join(map(chr, range(65, 91)))
MARKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _parted(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != F.lit(""))


def white_words(text: Column) -> Column:
    """Runs of other than space and \\t-\\r, in order; none for an empty text."""
    return _parted(F.translate(text, WHITE, " " * len(WHITE)))


def plain_words(text: Column) -> Column:
    """Runs of ASCII digits and letters, A-Z lowered, and of all characters beyond ASCII, in order."""
    return _parted(F.translate(text, UPPER + MARKS, UPPER.lower() + " " * len(MARKS)))


def rolling_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash for each run of ``width`` words, repeats included; one of all where there are fewer, none without words.

    ``words`` must be a column of a DataFrame, not an expression: it is read at every step.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - width)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(words))).otherwise(runs)
