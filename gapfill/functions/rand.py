"""Reproducible randomness.

``rand()`` depends on how a table happens to be partitioned, so a lost executor
would change results. Every draw here is a pure function of (seed, tag, key):
recomputing a partition gives the same numbers, and any SQL engine with md5 can
replay them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapfill.frames import col

_TWO32 = 4294967296.0


def _text(key) -> list[Column]:
    cols = [key] if isinstance(key, (str, Column)) else list(key)
    return [(col(c) if isinstance(c, str) else c).cast("string") for c in cols]


def digest(seed: int, tag: str, key) -> Column:
    """Hex md5 of ``seed|tag|key...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *_text(key)))


def _number(hex_text: Column, at: int) -> Column:
    """Eight hex digits as a number; reading an integer is cheaper than reading a double."""
    return F.conv(F.substring(hex_text, at, 8), 16, 10).cast("bigint").cast("double")


def uniform(seed: int, tag: str, key) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the digest."""
    return _number(digest(seed, tag, key), 1) / _TWO32


def normal(seed: int, tag: str, key) -> Column:
    """Standard normal draw (Box-Muller on two halves of one digest)."""
    d = digest(seed, tag, key)
    u1, u2 = _number(d, 1), _number(d, 9) / _TWO32
    # shift by half a step so that log never sees zero
    return F.sqrt(-2.0 * F.log((u1 + 0.5) / _TWO32)) * F.cos(2.0 * math.pi * u2)
