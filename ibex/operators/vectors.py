"""Element-wise vector transforms (image-like dense inputs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _arr(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale_vector(c: Column | str, divisor: float = 255.0) -> Column:
    """``v / divisor`` for every element, as doubles."""
    return F.transform(_arr(c), lambda v: v.cast("double") / F.lit(float(divisor)))


def center_vector(c: Column | str) -> Column:
    """Map [0, 1] to [-1, 1]: ``2 v - 1``."""
    return F.transform(_arr(c), lambda v: F.lit(2.0) * v.cast("double") - F.lit(1.0))


def flatten_matrix(c: Column | str) -> Column:
    """Row-major flatten of an ``array<array<...>>`` column."""
    return F.flatten(_arr(c))


def outer_image(c: Column | str, side: int = 28) -> Column:
    """A ``side`` x ``side`` grey image (rows of whole numbers from 0 to 255)
    of a vector: the sizes of the products of its first ``side`` values, 1 and
    above being white.  Stands in for digit images where a table has vectors
    only."""
    lead = F.transform(F.slice(_arr(c), 1, side), lambda v: v.cast("double"))
    return F.transform(lead, lambda a: F.transform(lead, lambda b: F.floor(F.lit(255.0) * F.least(F.abs(a * b), F.lit(1.0))).cast("int")))
