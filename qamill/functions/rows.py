"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, items: Column | str, keep: list, pos: str | None = None,
           item: str = "item") -> DataFrame:
    """One row per array element, empty arrays gone: ``keep…, [pos], item``.

    A plain explode makes the optimizer add ``size(array) > 0`` below it, which would
    compute a costly array expression twice, and before any repartitioning. The outer
    form with a check of the position afterwards computes it once.
    """
    at = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(items).alias(at, item)).where(F.col(at).isNotNull())
    return out if pos else out.drop(at)
