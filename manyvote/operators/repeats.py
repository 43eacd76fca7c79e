"""Training subsets of one size, drawn with replacement.

Every row gets, for every bag, a Poisson number of draws with a random mark each, all functions of the row's key. The draws
with the smallest marks, as many as the bag has room for, are the bag: whatever their number was, draws of independent Poisson
rows fall on the rows uniformly, so a row's copies follow the multinomial distribution exactly (to 52 bits of the
Poisson distribution). The rate is set so that fewer draws than wanted are improbable; if that happens, it is raised.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyvote.functions.hashing import DIGITS, POINTS, hex_mark
from manyvote.operators.layout import ROW_ID

COUNTS = "bag_counts"
#: Hex digits of the draw of a row's number of copies, and how many such draws one md5 holds.
RATE_DIGITS = 13
RATES_PER_HASH = 32 // RATE_DIGITS


def poisson_marks(rate: float) -> list[str]:
    """Hex marks of the Poisson distribution: a draw's number is that of the marks at or below it."""
    points = 16**RATE_DIGITS
    number, share, below = 0, math.exp(-rate), math.exp(-rate)
    marks = []
    while number <= rate or share * points >= 0.5:
        if below < 1:
            marks.append(f"{int(below * points):0{RATE_DIGITS}x}")
        number += 1
        share = share * rate / number
        below += share
    return marks


def draw_rate(rows: int, size: int, slack: float) -> float:
    """Draws per row, ``slack`` standard deviations more than wanted."""
    return (size + slack * (math.sqrt(size) + 1)) / rows


def _hashed(df: DataFrame, seed: int, bags: int) -> DataFrame:
    key = F.col(ROW_ID).cast("string")
    groups = range(-(-bags // RATES_PER_HASH))
    return df.select("*", *[F.md5(F.concat(F.lit(f"count:{seed}:{g}:"), key)).alias(f"_c{g}") for g in groups])


def _draws(seed: int, bag: int, marks: list[str]) -> Column:
    """A row's draws for a bag as an array of (mark, key, copy); null without any."""
    draw = F.substring(f"_c{bag // RATES_PER_HASH}", bag % RATES_PER_HASH * RATE_DIGITS + 1, RATE_DIGITS)
    number = F.when(draw < marks[0], 0)
    for n, mark in enumerate(marks[1:], 1):
        number = number.when(draw < mark, n)
    number = number.otherwise(len(marks))
    key = F.col(ROW_ID).cast("string")

    def one(copy: Column) -> Column:
        hashed = F.md5(F.concat(F.lit(f"copy:{seed}:{bag}:"), copy.cast("string"), F.lit(":"), key))
        return F.struct(F.substring(hashed, 1, DIGITS).alias("mark"), key.alias("key"), copy.alias("copy"))

    # The draw lies at or above the first mark where there is a copy, so the sequence never runs downwards.
    return F.when(draw >= marks[0], F.transform(F.sequence(F.lit(1), number), one))


def _up_to(mark: str, key: str, copy: int) -> Callable[[Column], Column]:
    end = F.struct(F.lit(mark).alias("mark"), F.lit(key).alias("key"), F.lit(copy).alias("copy"))
    return lambda draw: draw <= end


def _of_bag(bag: int) -> Callable[[Column], Column]:
    return lambda draw: F.struct(F.lit(bag).alias("bag"), draw.alias("draw"))


@dataclass(frozen=True)
class RepeatPlan:
    """For every bag its last draw (mark, key text, copy); draws up to there are in the bag.

    How often a row is in a bag is a function of its key, so bags need no copies of the rows.
    """

    seed: int
    rows: int
    size: int
    rate: float
    last: tuple[tuple[str, str, int], ...]

    column = COUNTS

    def _counts(self) -> Column:
        marks = poisson_marks(self.rate)
        cells = []
        for bag, last in enumerate(self.last):
            kept = F.size(F.filter(_draws(self.seed, bag, marks), _up_to(*last)))
            cells.append(F.when(kept > 0, kept).otherwise(0))
        return F.array(*cells)

    def mark(self, df: DataFrame) -> DataFrame:
        """Append ``bag_counts``: how often the row is in each bag."""
        return _hashed(df, self.seed, len(self.last)).select(*df.columns, self._counts().alias(COUNTS))

    def members(self, df: DataFrame) -> DataFrame:
        """``bag``, the columns of ``df`` and ``copies``, one row per bag a row is in."""
        marked = self.mark(df).select(*df.columns, F.posexplode(COUNTS).alias("bag", "copies"))
        return marked.where("copies > 0").select("bag", *df.columns, "copies")


def copies_in(bag: int) -> Column:
    """How often a row of a marked table is in the bag."""
    return F.col(COUNTS)[bag]


def draw_repeats(ids: DataFrame, bags: int, fraction: float, seed: int, slack: float = 8.0, rows: int | None = None) -> RepeatPlan:
    """Bags of ``int(fraction * rows)`` draws with replacement from unique row keys, found in two passes over the keys.

    The last draw of a bag lies among the largest marks. One pass counts the draws below and inside that range, a second
    one ranks those inside, a number that grows with the square root of the rows. ``slack`` is multiplied until the
    range holds the last draw of every bag.
    """
    rows = ids.count() if rows is None else rows
    size = int(fraction * rows)
    if size == 0:
        return RepeatPlan(seed, rows, 0, 1.0, (("", "", 0),) * bags)  # no draw lies below this end
    while True:
        rate = draw_rate(rows, size, slack)
        marks = poisson_marks(rate)
        draws = F.flatten(F.array_compact(F.array(*[F.transform(_draws(seed, bag, marks), _of_bag(bag)) for bag in range(bags)])))
        drawn = _hashed(ids.select(ROW_ID), seed, bags).select(F.explode(draws).alias("x")).select("x.bag", "x.draw")
        # The wanted draws are all but some 2 * slack standard deviations at most.
        low = hex_mark(max(0, int((1 - 3 * slack * (math.sqrt(size) + 1) / (rate * rows)) * POINTS)))
        counts = (F.count_if(F.col("draw.mark") < low).alias("below"), F.count(F.lit(1)).alias("all"))
        below = {r["bag"]: (r["below"], r["all"]) for r in drawn.groupBy("bag").agg(*counts).collect()}
        if len(below) == bags and all(b < size <= n for b, n in below.values()):
            break
        slack *= 4
    wanted = F.get(F.array(*[F.lit(size - below[bag][0]) for bag in range(bags)]), F.col("bag"))
    found = (
        drawn.where(F.col("draw.mark") >= low)
        .withColumn("rank", F.row_number().over(Window.partitionBy("bag").orderBy("draw")))
        .where(F.col("rank") == wanted)
        .collect()
    )
    last = {r["bag"]: tuple(r["draw"]) for r in found}
    return RepeatPlan(seed, rows, size, rate, tuple(last[bag] for bag in range(bags)))
