"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a plain computed column is pushed below its projection, where
    the optimizer writes the whole expression out again for every use.  Coming
    out of a generator, the values are computed once and filters stay above.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(row)))
