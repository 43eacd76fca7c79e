"""One answer per row from the predictions of all members."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvote.config import CLASSIFICATION
from manyvote.functions.voting import majority_vote, mean_of
from manyvote.operators.layout import LABEL, ROW_ID

ENSEMBLE = "baggingPrediction"
_CLASS_SPACE = 1 << 32


def combine(preds: DataFrame, task: str) -> DataFrame:
    """``row_id, label, baggingPrediction`` from ``row_id, label, preds``; no shuffle."""
    rule = majority_vote if task == CLASSIFICATION else mean_of
    return preds.select(ROW_ID, LABEL, rule(F.col("preds")).alias(ENSEMBLE))


def vote_long(long: DataFrame) -> DataFrame:
    """Majority vote over ``row_id, label, member, prediction``; predictions are class numbers.

    Both counts are taken on rows placed by ``row_id``, so there is one shuffle. Votes and class go
    into one number, of which the highest has most votes and, among those, the smallest class.
    """
    votes = long.repartition(ROW_ID).groupBy(ROW_ID, LABEL, "prediction").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.col("votes") * F.lit(_CLASS_SPACE) - F.col("prediction").cast("bigint")
    best = F.pmod(-F.max(rank), F.lit(_CLASS_SPACE)).cast("double")
    return votes.groupBy(ROW_ID, LABEL).agg(best.alias(ENSEMBLE))


def mean_long(long: DataFrame) -> DataFrame:
    """Mean over ``row_id, label, member, prediction``."""
    return long.groupBy(ROW_ID, LABEL).agg(F.avg("prediction").alias(ENSEMBLE))


def gather_members(frames: Sequence[DataFrame]) -> DataFrame:
    """``row_id, label, preds`` from one ``row_id, label, prediction`` table per member.

    For members scored apart from each other. Rows missing from a table are left out, as a join
    would; but all tables meet in one shuffle, and a group has one row per member.
    """
    tagged = [f.select(ROW_ID, LABEL, F.lit(i).alias("member"), "prediction") for i, f in enumerate(frames)]
    grouped = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(ROW_ID)
        .agg(F.min_by(LABEL, "member").alias(LABEL), F.collect_list(F.struct("member", "prediction")).alias("_all"))
        .filter(F.size("_all") == len(frames))
    )
    return grouped.select(
        ROW_ID, LABEL, F.transform(F.array_sort("_all"), lambda e: e["prediction"]).alias("preds")
    )


def to_long(preds: DataFrame) -> DataFrame:
    """``row_id, label, member, prediction`` from ``row_id, label, preds``."""
    return preds.select(ROW_ID, LABEL, F.posexplode("preds").alias("member", "prediction"))
