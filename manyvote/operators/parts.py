"""Statistics of the parts of one table, merged into those of any train side.

A cross-validated table is typed, deduplicated and dealt to parts once. Values are counted and ranges taken per part, in one pass
each; what a fold learns comes from the statistics of the other parts, so no pass over the rows is repeated per fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.config import CLASSIFICATION
from manyvote.functions.hashing import POINTS, split_draw
from manyvote.operators.encode import build_dictionary, value_counts
from manyvote.operators.layout import LABEL, NUMBERS, PART, ROW_ID, TableLayout
from manyvote.operators.prepare import Encoding, label_text
from manyvote.operators.profile import Profile
from manyvote.workspace import Workspace


def part_number(parts: int, seed: int) -> Column:
    """The part of a row by the hash of its key: even shares, no shuffle."""
    draw = F.conv(split_draw(seed, F.col(ROW_ID)), 16, 10).cast("bigint")
    return F.floor(draw * parts / F.lit(POINTS)).cast("int")


@dataclass(frozen=True)
class _Part:
    rows: int
    lows: list[float]
    highs: list[float]
    lowest: float | None
    highest: float | None


@dataclass(frozen=True)
class PartStatistics:
    """``counts(part, column, value, n)`` of nominal columns and, where it may be indexed, of the label; per part the number of rows,
    ranges of the numbers and of a numeric label."""

    layout: TableLayout
    task: str
    counts: DataFrame | None
    parts: dict[int, _Part]

    def fold(self, held_out: int, workspace: Workspace) -> tuple[Encoding, Profile]:
        """What the rows outside a part teach, and how many they are."""
        others = [p for i, p in self.parts.items() if i != held_out]
        if not others:
            raise ValueError(f"part {held_out} holds all rows")
        nominal = self.layout.label_is_nominal
        indexed = nominal or (self.task == CLASSIFICATION and min(p.lowest for p in others) < 0)
        dictionary = None
        if self.layout.nominal or indexed:
            names = [*self.layout.nominal, *([LABEL] if indexed else [])]
            merged = self.counts.filter((F.col(PART) != held_out) & F.col("column").isin(names))
            dictionary = build_dictionary(merged.groupBy("column", "value").agg(F.sum("n").alias("n")), workspace)
        lows = [min(values) for values in zip(*(p.lows for p in others))]
        highs = [max(values) for values in zip(*(p.highs for p in others))]
        classes = 0
        if self.task == CLASSIFICATION:
            classes = dictionary.sizes[LABEL] if indexed else int(max(p.highest for p in others)) + 1
        size = Profile(sum(p.rows for p in others), self.layout.n_features, classes)
        return Encoding(self.layout, dictionary, lows, highs, indexed), size


def part_statistics(rows: DataFrame, layout: TableLayout, task: str, parts: int, workspace: Workspace) -> PartStatistics:
    """Statistics of every part of distinct rows with their ``part``; a part without rows is an error."""
    numeric = bool(layout.numeric)
    label = F.lit(None).cast("double") if layout.label_is_nominal else F.col(LABEL)
    summary = Summarizer.metrics("min", "max").summary(array_to_vector(F.col(NUMBERS)))
    wanted = [F.count(F.lit(1)).alias("rows"), F.min(label).alias("lowest"), F.max(label).alias("highest")]
    found = rows.groupBy(PART).agg(*wanted, *([summary.alias("s")] if numeric else [])).collect()
    sides = {
        r[PART]: _Part(
            r["rows"], r["s"]["min"].tolist() if numeric else [], r["s"]["max"].tolist() if numeric else [], r["lowest"], r["highest"]
        )
        for r in found
    }
    empty = sorted(set(range(parts)) - set(sides))
    if empty:
        raise ValueError(f"no rows fall into the folds {[i + 1 for i in empty]}: use fewer folds")
    indexed = layout.label_is_nominal or (task == CLASSIFICATION and min(p.lowest for p in sides.values()) < 0)
    names, texts = list(layout.nominal), rows
    if indexed:
        names, texts = [*names, LABEL], label_text(rows, layout)
    counts = workspace.save(value_counts(texts, names, by=[PART]), "part_counts") if names else None
    return PartStatistics(layout, task, counts, sides)
