"""Rounding that gives the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(col: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded on the exact binary value."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def round_exact(col: Column, digits: int) -> Column:
    """Round on the exact binary value (``F.round`` rounds the shortest text)."""
    return fixed(col, digits).cast("double") + F.lit(0.0)


def thousandths(score: Column) -> Column:
    return F.round(score * 1000).cast("bigint")


def mean3(score: Column) -> Column:
    """Mean of a three-decimal score, half up to three decimals, in integers.

    Null for a group without any score; partial sums combine before the shuffle.
    """
    total, n = F.sum(thousandths(score)), F.count(score)
    return F.when(n > 0, F.floor((total * 2 + n) / (n * 2)).cast("double") / 1000)


def share1(part: Column, whole: Column) -> Column:
    """Percentage of ``whole``, half up to one decimal; 0 when there is none."""
    return F.when(whole > 0, F.floor((part * 2000 + whole) / (whole * 2)).cast("double") / 10).otherwise(F.lit(0.0))
