"""Seeded randomness as a function of the row key.

A draw depends only on (purpose, seed, row_id), never on partitioning or task retries, so a re-run
or a recomputed partition makes the same choices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 8
POINTS = 16**DIGITS
# One md5 has room for the draws of this many bags.
BAGS_PER_HASH = 32 // DIGITS


def split_draw(seed: int, row_id: Column) -> Column:
    """Eight hex digits, uniform, for the train/test split."""
    return F.substring(F.md5(F.concat(F.lit(f"split:{seed}:"), row_id.cast("string"))), 1, DIGITS)


def hex_mark(point: int) -> str:
    """A number in [0, 2**32] as text that compares with draws; the end compares above all of them."""
    return "g" if point >= POINTS else f"{point:0{DIGITS}x}"


def bag_hash_prefix(seed: int, group: int) -> str:
    """What is hashed before the key's text, giving the draws of ``BAGS_PER_HASH`` consecutive bags."""
    return f"bag:{seed}:{group}:"


def bag_draw(hashed: Column, bag: int) -> Column:
    """Eight hex digits, uniform, that order the rows of one bag; equal draws go by the key's text."""
    return F.substring(hashed, bag % BAGS_PER_HASH * DIGITS + 1, DIGITS)
