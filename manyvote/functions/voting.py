"""Combining the predictions one row received."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def majority_vote(preds: Column) -> Column:
    """The class most members chose; the smallest such class when several tie."""
    tallies = F.transform(
        F.array_distinct(preds),
        lambda c: F.struct(F.size(F.filter(preds, lambda p: p == c)).alias("votes"), (-c).alias("rank")),
    )
    return -F.array_max(tallies)["rank"]


def mean_of(preds: Column) -> Column:
    """The unweighted mean of the members' predictions."""
    return F.aggregate(preds, F.lit(0.0), lambda total, p: total + p) / F.size(preds)
