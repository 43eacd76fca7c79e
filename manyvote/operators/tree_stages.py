"""Column stages the tree learners need: labels by frequency, categorical features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorIndexer, VectorIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.operators.layout import LABEL

INDEXED_LABEL = "indexed_label"
#: Classes that are broadcast at most, 16 bytes each; more of them are joined by a shuffle.
BROADCAST_CLASSES = 100_000


def class_order(rows: DataFrame) -> list[float]:
    """Class labels, most frequent first; classes of one frequency in order of their text.

    The driver holds one number per class, as the models do.
    """
    counted = rows.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    return [r[LABEL] for r in counted.orderBy(F.desc("n"), F.col(LABEL).cast("string")).collect()]


def with_indexed_label(rows: DataFrame, classes: list[float], out: str = INDEXED_LABEL) -> DataFrame:
    """Append the place of a row's label in the class order, looked up by hash in the list of the classes."""
    places = rows.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"_class double, {out} double")
    places = F.broadcast(places) if len(classes) <= BROADCAST_CLASSES else places
    return rows.join(places, F.col(LABEL) == F.col("_class"), "left").drop("_class")


def original_label(prediction: Column, classes: list[float]) -> Column:
    """The label at a place of the class order."""
    return F.element_at(F.lit(np.array(classes, dtype=np.float64)), prediction.cast("int") + 1)


def categorical_features(rows: DataFrame, max_categories: int, column: str, out: str) -> VectorIndexerModel:
    """Index features of at most ``max_categories`` values; unseen values get one more category."""
    indexer = VectorIndexer(inputCol=column, outputCol=out, maxCategories=max_categories, handleInvalid="keep")
    return indexer.fit(rows)
