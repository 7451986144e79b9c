"""Random draws as functions of keys: the same for any partitioning, order or repetition of a task."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 1 << 53


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *keys), F.lit(_SPAN)) / F.lit(float(_SPAN))


def between(low: float, high: float, seed: int, tag: str, *keys: Column | str) -> Column:
    return low + (high - low) * uniform(seed, tag, *keys)


def integer(low: int, high: int, seed: int, tag: str, *keys: Column | str) -> Column:
    """low to high - 1."""
    return (F.floor(uniform(seed, tag, *keys) * (high - low)) + low).cast("int")


def normal(spread: float, seed: int, tag: str, *keys: Column | str) -> Column:
    """Mean 0, by Box and Muller."""
    u = F.greatest(uniform(seed, f"{tag}-radius", *keys), F.lit(1.0 / _SPAN))
    return spread * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, f"{tag}-angle", *keys))
