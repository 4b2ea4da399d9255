"""Arrays to rows without paying for the array twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, elements: Column | str, *keep: Column | str) -> DataFrame:
    """Rows (keep..., pos, e), one per element.

    A plain explode makes the optimizer add a filter "array is not empty" and push it to the scan, where it
    computes the whole array a second time. The outer form escapes that; the row it makes for
    an empty array is dropped by a test that cannot move below the explode.
    """
    return df.select(*keep, F.posexplode_outer(elements).alias("pos", "e")).where(F.col("pos").isNotNull())
