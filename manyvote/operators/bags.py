"""Training subsets of one size, drawn without replacement, overlapping between bags."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyvote.functions.hashing import BAGS_PER_HASH, POINTS, bag_draw, bag_hash_prefix, hex_mark
from manyvote.operators.layout import LABEL, ROW_ID
from manyvote.operators.numbering import number_rows
from manyvote.workspace import Workspace

WORD_BITS = 60
BITS = "bag_bits"


def _with_hashes(df: DataFrame, seed: int, bags: int) -> DataFrame:
    """Append ``_h0, _h1...``, each computed once for the bags that share it."""
    groups = -(-bags // BAGS_PER_HASH)
    key = F.col(ROW_ID).cast("string")
    return df.select(
        "*", *[F.md5(F.concat(F.lit(bag_hash_prefix(seed, g)), key)).alias(f"_h{g}") for g in range(groups)]
    )


def _draw(bag: int) -> Column:
    return bag_draw(F.col(f"_h{bag // BAGS_PER_HASH}"), bag)


@dataclass(frozen=True)
class BagPlan:
    """For every bag the draw and key text of its last row; rows up to there are in the bag.

    Membership is a predicate on the row key, so bags need no copies of the rows.
    """

    seed: int
    rows: int
    size: int
    last: tuple[tuple[str, str], ...]

    column = BITS

    def _contains(self, bag: int) -> Column:
        draw, (last_draw, last_key) = _draw(bag), self.last[bag]
        return (draw < last_draw) | ((draw == last_draw) & (F.col(ROW_ID).cast("string") <= last_key))

    def mark(self, df: DataFrame) -> DataFrame:
        """Append ``bag_bits``: words of 60 bits, one bit per bag, for tests without hashing."""
        words = []
        for start in range(0, len(self.last), WORD_BITS):
            word = F.lit(0).cast("bigint")
            for bag in range(start, min(start + WORD_BITS, len(self.last))):
                bit = F.lit(1 << (bag - start)).cast("bigint")
                word = word + F.when(self._contains(bag), bit).otherwise(F.lit(0).cast("bigint"))
            words.append(word)
        return _with_hashes(df, self.seed, len(self.last)).select(*df.columns, F.array(*words).alias(BITS))

    def members(self, df: DataFrame) -> DataFrame:
        """``bag`` and the columns of ``df``, one row per bag a row is in."""
        inside = [F.when(self._contains(bag), F.lit(bag)) for bag in range(len(self.last))]
        hashed = _with_hashes(df, self.seed, len(self.last))
        return hashed.select(F.explode(F.array_compact(F.array(*inside))).alias("bag"), *df.columns)

    def bag(self, df: DataFrame, bag: int) -> DataFrame:
        """The rows of one bag: a filter, no shuffle."""
        return _with_hashes(df, self.seed, len(self.last)).filter(self._contains(bag)).select(*df.columns)


def marked_in(bag: int) -> Column:
    """Membership test on a marked table."""
    word, bit = divmod(bag, WORD_BITS)
    return F.col(BITS)[word].bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0


def draw_bags(
    ids: DataFrame, bags: int, fraction: float, seed: int, slack: float = 8.0, rows: int | None = None
) -> BagPlan:
    """Find, per bag, the row with the ``int(fraction * rows)``-th smallest draw.

    Draws are uniform, so that row lies in a range around the fraction whose size grows with the
    square root of the number of rows only. One pass counts the rows below and inside the range of
    every bag, a second one ranks the rows inside. A range that misses, at ``slack`` standard
    deviations, is widened until it does not: the result is exact. ``rows`` saves counting them.
    """
    rows = ids.count() if rows is None else rows
    size = int(fraction * rows)
    if size == 0:
        return BagPlan(seed, rows, 0, (("", ""),) * bags)
    hashed = _with_hashes(ids.select(ROW_ID), seed, bags)
    while True:
        span = _span(rows, size, slack)
        below, inside = _count(hashed, bags, span)
        if all(b < size <= b + n for b, n in zip(below, inside)):
            break
        slack *= 4
    return BagPlan(seed, rows, size, tuple(_rank(hashed, bags, span, [size - b for b in below])))


def _span(rows: int, size: int, slack: float) -> tuple[int, int]:
    share = size / rows
    # The second term matters when almost all or almost no rows are wanted.
    margin = slack * (math.sqrt(share * (1 - share) / rows) + 1 / rows)
    return max(0, int((share - margin) * POINTS)), min(POINTS, int((share + margin) * POINTS) + 1)


def _count(hashed: DataFrame, bags: int, span: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Rows before and inside the span, per bag: one pass, each row read once for all bags."""
    lo, hi = map(hex_mark, span)
    counts = []
    for bag in range(bags):
        counts.append(F.count_if(_draw(bag) < lo).alias(f"below{bag}"))
        counts.append(F.count_if((_draw(bag) >= lo) & (_draw(bag) < hi)).alias(f"inside{bag}"))
    row = hashed.agg(*counts).first()
    return [row[f"below{b}"] for b in range(bags)], [row[f"inside{b}"] for b in range(bags)]


def _rank(hashed: DataFrame, bags: int, span: tuple[int, int], places: list[int]) -> list[tuple[str, str]]:
    """The draw and key at the wanted place inside each bag's span."""
    lo, hi = map(hex_mark, span)
    cells = []
    for bag in range(bags):
        draw = _draw(bag)
        cells.append(F.when((draw >= lo) & (draw < hi), F.struct(F.lit(bag).alias("bag"), draw.alias("draw"))))
    candidates = hashed.select(
        F.col(ROW_ID).cast("string").alias("key"), F.explode(F.array_compact(F.array(*cells))).alias("cell")
    ).select("key", "cell.bag", "cell.draw")
    wanted = F.get(F.array(*map(F.lit, places)), F.col("bag"))
    found = (
        candidates.withColumn("rank", F.row_number().over(Window.partitionBy("bag").orderBy("draw", "key")))
        .filter(F.col("rank") == wanted)
        .collect()
    )
    by_bag = {r["bag"]: (r["draw"], r["key"]) for r in found}
    return [by_bag[bag] for bag in range(bags)]


def approximate_bags(df: DataFrame, bags: int, fraction: float, seed: int) -> DataFrame:
    """``bag`` and the columns of ``df``: every row joins every bag with the given probability.

    Needs no pass to find the sizes, which vary around ``fraction * rows``.
    """
    mark = hex_mark(int(fraction * POINTS))
    inside = [F.when(_draw(bag) < mark, F.lit(bag)) for bag in range(bags)]
    return _with_hashes(df, seed, bags).select(F.explode(F.array_compact(F.array(*inside))).alias("bag"), *df.columns)


def bag_by_label(df: DataFrame, plan: BagPlan, bag: int, workspace: Workspace) -> DataFrame:
    """One bag in ascending label order, with the position of every row in it."""
    return number_rows(plan.bag(df, bag), [F.asc(LABEL), F.asc(ROW_ID)], workspace)
