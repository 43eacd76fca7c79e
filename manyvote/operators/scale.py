"""Min-max scaling to [0, 1]."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.operators.layout import NARROW

Ranges = dict[str, tuple[float, float]]


def column_ranges(df: DataFrame, columns: Sequence[str]) -> Ranges:
    """Lowest and highest value per column, all in one aggregation."""
    if not columns:
        return {}
    bounds = []
    for i, c in enumerate(columns):
        bounds += [F.min(f"`{c}`").alias(f"lo{i}"), F.max(f"`{c}`").alias(f"hi{i}")]
    row = df.agg(*bounds).first()
    if row["lo0"] is None:
        raise ValueError("cannot scale: the table has no rows")
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def scaled(value: Column, bounds: tuple[float, float]) -> Column:
    """The value's place in its range; 0.5 in a range of one value; outside values at the border."""
    lo, hi = bounds
    if lo == hi:
        return F.lit(0.5)
    return F.least(F.greatest((value - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0)), F.lit(1.0))


def array_ranges(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Lowest and highest value per element of an array column of equal sizes, in one aggregation."""
    summary = Summarizer.metrics("min", "max").summary(array_to_vector(F.col(column))).alias("s")
    row = df.filter(F.size(column) > 0).select(summary).select("s.min", "s.max").first()
    if row is None or row["min"] is None or not len(row["min"]):
        return [], []
    return [float(x) for x in row["min"]], [float(x) for x in row["max"]]


def scaled_array(column: Column, lows: Sequence[float], highs: Sequence[float]) -> Column:
    """``scaled`` for every element of an array; a few elements as columns, which compile, many by one function over the array."""
    if len(lows) <= NARROW:
        return F.array(*[scaled(F.get(column, i), bounds) for i, bounds in enumerate(zip(lows, highs))]).cast("array<double>")
    lo, span = F.lit(np.array(lows, dtype=np.float64)), F.lit(np.array(highs, dtype=np.float64) - np.array(lows, dtype=np.float64))

    def one(x, i):
        place = (x - F.get(lo, i)) / F.get(span, i)
        return F.when(F.get(span, i) == 0, F.lit(0.5)).otherwise(F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)))

    return F.transform(column, one)


def scaled_code(code: Column, size: int) -> Column:
    """Place of a nominal index among ``size`` known ones; that of an unknown value lies beyond them, apart from all."""
    if size <= 1:
        return F.when(code == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    return code / F.lit(float(size - 1))
