"""What the operators on vectors share: which rows count, and components as integers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this have squared distances that a long might not hold; up to 128 components stay exact.
MOST = 1 << 27


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers (an infinite one less itself is NaN, which isn't zero)."""
    return F.coalesce(F.forall(F.col(f"`{column}`"), lambda x: F.coalesce(x - x == 0, F.lit(False))), F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """vec_id, vector (doubles), and other columns under their own names; only rows whose vector is finite."""
    held = table.where(finite(vector_col))
    return held.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), *[F.col(f"`{c}`") for c in more])


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; exact, as the scales are powers of two."""
    made = np.floor(np.float64(scale) * values)
    if made.size and np.abs(made).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}: its squared distances don't fit a long")
    return made.astype(np.int64)


def floor_mean(sums: list[int], n: int) -> list[int]:
    """Componentwise floor(sum / n) of integers."""
    return [s // n for s in sums]
