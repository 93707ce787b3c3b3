"""Order statistics of short arrays, for use next to folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates a value once and hands it to an expression that needs it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def middle(ordered: Column) -> Column:
    """Mean of the middle two entries of a sorted array; null when it is empty."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / F.lit(2.0)).cast("int"))
    high = F.get(ordered, F.floor(n / F.lit(2.0)).cast("int"))
    return F.when(n > 0, 0.5 * (low + high))


def positive_median(values: Column) -> Column:
    """Median of the entries above 1e-6, mean of the middle two; null when there are none."""
    return let(F.array_sort(F.filter(values, lambda v: v > 1e-6)), middle)


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted values."""
    return let(F.array_sort(values), lambda s: F.get(s, F.floor(F.size(s) / F.lit(2.0)).cast("int")))
