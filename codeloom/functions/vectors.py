"""Expressions on array-of-float vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: lower bound of the norm, so that zero vectors stay zero.
NORM_FLOOR = 1e-12


def l2_norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalise(vector: Column) -> Column:
    """The vector scaled to unit length, in double precision."""
    scale = F.greatest(l2_norm(vector), F.lit(NORM_FLOOR))
    # One-element array: the norm is worked out once per row, not once per element.
    return F.flatten(
        F.transform(F.array(scale), lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    )
