"""Headerless CSV or parquet tables, alone or as train/test pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed value: digits of the widest decimal type.
MOST_DIGITS = 38
FORMATS = ("csv", "parquet", "orc")


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    partitions: int | None = None,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """Load a table; CSV has no header and its last column is the label.

    Without a schema CSV types are inferred, which reads the files one more time: give the schema
    for large inputs, or lower ``sampling_ratio``. ``partitions`` shuffles the rows evenly over that
    many partitions; left out, the scan's own split sizes stand.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("sep", ",").option("header", "false")
        if schema is None:
            reader = reader.option("inferSchema", "true").option("samplingRatio", sampling_ratio)
    df = reader.format(fmt).load(paths)
    return df if partitions is None else df.repartition(partitions)


def fold_pairs(paths: Sequence[str]) -> list[tuple[str, str]]:
    """Alternating train and test paths as pairs."""
    if not paths or len(paths) % 2:
        raise ValueError(f"train and test paths must alternate, got {len(paths)} paths")
    return list(zip(paths[::2], paths[1::2]))


def read_fold(spark: SparkSession, pair: tuple[str, str], **options) -> tuple[DataFrame, DataFrame]:
    """The train and the test table of one pair, read with one schema that fits both."""
    train, test = (read_table(spark, path, **options) for path in pair)
    if train.dtypes == test.dtypes:
        return train, test
    shared = common_schema(train.schema, test.schema)
    train, test = (read_table(spark, path, **{**options, "schema": shared}) for path in pair)
    return train, test


def common_schema(left: T.StructType, right: T.StructType) -> T.StructType:
    """Column by column the type that holds the values of both sides."""
    if len(left) != len(right):
        raise ValueError(f"train has {len(left)} columns and test {len(right)}")
    return T.StructType([T.StructField(a.name, _wider(a.dataType, b.dataType)) for a, b in zip(left, right)])


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """Integers stay integers and decimals decimals, so that keys and codes keep every digit."""
    if a == b:
        return a
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    exact = (*whole, T.DecimalType)
    if isinstance(a, exact) and isinstance(b, exact):
        (p, s), (q, t) = (_digits(x) for x in (a, b))
        scale = max(s, t)
        if max(p - s, q - t) + scale <= MOST_DIGITS:
            return T.DecimalType(max(p - s, q - t) + scale, scale)
        return T.DoubleType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, moments) and isinstance(b, moments):
        return T.TimestampType()
    return T.StringType()


def _digits(kind: T.DataType) -> tuple[int, int]:
    """Digits in all and after the point."""
    return (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
