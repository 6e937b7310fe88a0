"""Quality bit-fields as confidence, in generated code: no Python runs on a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(qa: Column, first: int, count: int) -> Column:
    return F.shiftright(qa, first).bitwiseAND(F.lit((1 << count) - 1))


def _word(qa: Column | str) -> Column:
    """16 unsigned bits, also of values that were read as signed."""
    qa = F.col(qa) if isinstance(qa, str) else qa
    return qa.cast("int").bitwiseAND(F.lit(0xFFFF))


def modis_confidence(qa: Column | str, clamp: bool = False) -> Column:
    """Confidence of a vegetation-index pixel: 0 where its bits rule it out, else 1 less its usefulness (0 to 15) over 12.

    Ruled out: quality 3 (bits 0-1), aerosol 3 (6-7), adjacent cloud (8), mixed clouds (10), other than land
    (11-13), snow or ice (14), shadow (15). Usefulness over 12 gives values below 0, cut off only with ``clamp``.
    """
    q = _word(qa)
    bad = (_bits(q, 0, 2) == 3) | (_bits(q, 6, 2) == 3) | (_bits(q, 8, 1) == 1) | (_bits(q, 10, 1) == 1) | (_bits(q, 11, 3) != 1) | (_bits(q, 14, 1) == 1) | (_bits(q, 15, 1) == 1)
    conf = F.lit(1.0) - _bits(q, 2, 4).cast("double") / F.lit(12.0)
    conf = F.greatest(F.lit(0.0), conf) if clamp else conf
    return F.when(q.isNull(), F.lit(None).cast("double")).when(bad, F.lit(0.0)).otherwise(conf)


def landsat8_confidence(qa: Column | str) -> Column:
    """1, or 0 for fill, dropped frame, terrain occlusion (bits 0-2), and for 3 in water (4-5), snow (10-11), cirrus (12-13) or cloud (14-15)."""
    q = _word(qa)
    bad = _bits(q, 0, 3) != 0
    for first in (4, 10, 12, 14):
        bad = bad | (_bits(q, first, 2) == 3)
    return F.when(q.isNull(), F.lit(None).cast("double")).when(bad, F.lit(0.0)).otherwise(F.lit(1.0))
