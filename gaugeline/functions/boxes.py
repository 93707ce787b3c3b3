"""Geometry of one or two boxes, on columns or on lambda variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def area(b) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a, b) -> Column:
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def touching(a, b) -> Column:
    """Whether two boxes share any area; a cheap test ahead of the ratios."""
    return (a["y2"] > b["y1"]) & (a["y1"] < b["y2"]) & (a["x2"] > b["x1"]) & (a["x1"] < b["x2"])


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole <= 1e-6, F.lit(0.0)).otherwise(part / F.greatest(whole, F.lit(1e-6)))


def overlap_over_smaller(a, b) -> Column:
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def vertical_overlap_over_smaller(a, b) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return _ratio(shared, F.least(F.greatest(F.lit(0.0), a["h"]), F.greatest(F.lit(0.0), b["h"])))


def from_corners(df):
    """Corners to centre and size; a negative size becomes 0."""
    w = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1"))
    h = F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    return df.withColumns(
        {"w": w, "h": h, "xc": F.col("x1") + 0.5 * w, "yc": F.col("y1") + 0.5 * h}
    )
