"""Size of a prepared table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvote.operators.layout import LABEL


@dataclass(frozen=True)
class Profile:
    rows: int
    features: int
    classes: int


def profile_query(df: DataFrame, n_features: int) -> DataFrame:
    """``n_rows, n_features, n_classes``; classes run from 0 to the highest label."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_features).alias("n_features"),
        (F.max(LABEL).cast("int") + 1).alias("n_classes"),
    )


def profile(df: DataFrame, n_features: int) -> Profile:
    row = profile_query(df, n_features).first()
    return Profile(row["n_rows"], row["n_features"], row["n_classes"] or 0)
