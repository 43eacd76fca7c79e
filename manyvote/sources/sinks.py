"""Prediction tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_predictions(predictions: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write predictions as parquet, each task its own file."""
    predictions.write.mode(mode).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
