"""Reproducible picks: the md5 of a key stands in for a random draw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4294967296  # 2^32, one more than the largest 8-digit hex number


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def draw(*parts) -> Column:
    """A whole number in [0, 2^32) that depends only on ``parts``."""
    text = F.concat_ws(":", *[_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1)."""
    return draw(*parts) / F.lit(float(SCALE))


def choose(options: Column, *parts) -> Column:
    """One element of an array column; null when the array is empty."""
    ix = draw(*parts) % F.greatest(F.size(options), F.lit(1)) + 1
    return F.get(options, (ix - 1).cast("int"))


def weighted(pairs: list[tuple[str, float]], u: Column) -> Column:
    """The first name whose cumulative weight exceeds ``u``."""
    total = sum(w for _, w in pairs)
    out, reached = None, 0.0
    for name, weight in pairs[:-1]:
        reached += weight / total
        out = F.when(u < reached, name) if out is None else out.when(u < reached, name)
    return F.lit(pairs[-1][0]) if out is None else out.otherwise(pairs[-1][0])
