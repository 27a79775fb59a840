"""Box functions as columns; a box is an array (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when((i > 0) & (u > 0), i / u).otherwise(0.0)


def containment(inner: Column, outer: Column) -> Column:
    """The share of the inner box that lies in the outer."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def gap(a: Column, b: Column) -> Column:
    """The distance of two boxes' edges; 0 where they touch or overlap."""
    h = F.greatest(F.lit(0.0), b[0] - a[2], a[0] - b[2])
    v = F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3])
    return F.sqrt(h * h + v * v)


def decay(overlap: Column, sigma: float) -> Column:
    """The Gaussian factor of soft suppression."""
    return F.exp(-F.pow(overlap, F.lit(2.0)) / sigma)


def padded(b: Column, pad: float, width: Column, height: Column) -> Column:
    """A region with padding, inside the page."""
    return F.array(F.greatest(F.lit(0.0), b[0] - pad), F.greatest(F.lit(0.0), b[1] - pad), F.least(width, b[2] + pad), F.least(height, b[3] + pad))
