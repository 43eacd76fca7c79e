"""Repeatable random splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.functions.hashing import POINTS, hex_mark, split_draw
from manyvote.operators.layout import ROW_ID


def split_filters(weights: Sequence[float], seed: int, row_id: Column | None = None) -> list[Column]:
    """One predicate per part; every row satisfies exactly one of them."""
    draw = split_draw(seed, F.col(ROW_ID) if row_id is None else row_id)
    total, ends = float(sum(weights)), []
    for i in range(1, len(weights)):
        ends.append(hex_mark(int(sum(weights[:i]) / total * POINTS)))
    filters = []
    for lo, hi in zip([None, *ends], [*ends, None]):
        bounds = ([draw >= lo] if lo is not None else []) + ([draw < hi] if hi is not None else [])
        filters.append(reduce(lambda a, b: a & b, bounds, F.lit(True)))
    return filters


def hash_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Split rows by the hash of their key: a filter per part and no shuffle."""
    return [df.filter(part) for part in split_filters(weights, seed)]
