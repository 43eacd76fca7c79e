"""Quality of predictions, for any number of members in one job."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvote.config import CLASSIFICATION
from manyvote.operators.layout import LABEL

CLASS_METRICS = ("accuracy", "weightedPrecision")
VALUE_METRICS = ("rmse", "mse", "r2", "mae")


def class_metrics(long: DataFrame) -> DataFrame:
    """``member, accuracy, weightedPrecision`` from ``member, label, prediction``.

    Rows are first counted by (member, label, prediction); the rest works on those counts. A class
    that is never predicted has precision 0.
    """
    cells = long.groupBy("member", LABEL, "prediction").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col(LABEL) == F.col("prediction"), F.col("n")).otherwise(zero)
    roles = F.array(
        F.struct(F.col(LABEL).alias("class"), F.col("n").alias("actual"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("actual"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    per_class = (
        cells.select("member", F.inline(roles))
        .groupBy("member", "class")
        .agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    return per_class.groupBy("member").agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        (F.sum(precision * F.col("actual")) / F.sum("actual")).alias("weightedPrecision"),
    )


def value_metrics(long: DataFrame) -> DataFrame:
    """``member, rmse, mse, r2, mae`` from ``member, label, prediction``; r2 is null for one label value."""
    error = F.col(LABEL) - F.col("prediction")
    mse = F.avg(error * error)
    return long.groupBy("member").agg(
        F.sqrt(mse).alias("rmse"),
        mse.alias("mse"),
        (F.lit(1.0) - F.try_divide(mse, F.var_pop(LABEL))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )


def value_metrics_of_arrays(preds: DataFrame, shift: int = 0) -> DataFrame:
    """The same from ``label, preds``: one sum over the vectors of all members' errors, no row per member.

    ``member`` counts from ``shift``.
    """
    error = F.transform("preds", lambda p: p - F.col(LABEL))
    errors = F.concat(F.transform(error, lambda e: e * e), F.transform(error, lambda e: F.abs(e)))
    means = Summarizer.metrics("mean").summary(array_to_vector(errors)).alias("s")
    row = preds.groupBy(F.lit(1)).agg(means, F.var_pop(LABEL).alias("spread"))  # no group, and so no row, of no rows
    half = F.expr("cast(size(m) / 2 as int)")
    pairs = F.arrays_zip(F.slice("m", F.lit(1), half).alias("mse"), F.slice("m", half + 1, half).alias("mae"))
    each = row.select(vector_to_array("s.mean").alias("m"), "spread").select("spread", F.posexplode(pairs).alias("member", "e"))
    return each.select(
        (F.col("member") + shift).alias("member"),
        F.sqrt("e.mse").alias("rmse"),
        F.col("e.mse").alias("mse"),
        (F.lit(1.0) - F.try_divide(F.col("e.mse"), F.col("spread"))).alias("r2"),
        F.col("e.mae").alias("mae"),
    )


def array_metrics(preds: DataFrame, task: str, shift: int = 0) -> DataFrame:
    """``member, metric, value`` for the task's metrics from ``row_id, label, preds``."""
    if task != CLASSIFICATION:
        return _told(value_metrics_of_arrays(preds, shift), VALUE_METRICS)
    long = preds.select(LABEL, F.posexplode("preds").alias("member", "prediction"))
    return member_metrics(long.withColumn("member", F.col("member") + shift), task)


def member_metrics(long: DataFrame, task: str) -> DataFrame:
    """``member, metric, value`` for the task's metrics."""
    if task == CLASSIFICATION:
        wide, names = class_metrics(long), CLASS_METRICS
    else:
        wide, names = value_metrics(long), VALUE_METRICS
    return _told(wide, names)


def _told(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select("member", F.inline(cells))
