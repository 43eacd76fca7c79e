"""How each Spark type becomes a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_nominal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType))


def as_number(field: T.StructField) -> Column:
    """The column as a double: dates as days and timestamps as seconds since 1970-01-01."""
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # Field by field: a cast to a timestamp would depend on the session's time zone.
        whole = F.unix_date(column.cast("date")) * 86400.0 + F.hour(column) * 3600 + F.minute(column) * 60
        return whole + F.date_part(F.lit("SECOND"), column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column) / F.lit(1e6)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    raise TypeError(f"column {field.name!r} of type {kind.simpleString()} is neither nominal nor numeric")


def is_vector(field: T.StructField) -> bool:
    """An array of numbers counts as that many numeric features."""
    return isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType)


def is_finite(value: Column) -> Column:
    """Neither null, NaN nor infinite; false for null."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def refuse_invalid(column: Column, name: str, kind: str) -> Column:
    """The column itself, failing the job on the first null and, among numbers, on NaN and infinity."""
    known = F.coalesce(column, F.raise_error(F.lit(f"null in column {name!r}")).cast(kind))
    if kind != "double":
        return known
    # NaN compares above infinity.
    wrong = F.raise_error(F.lit(f"NaN or infinity in column {name!r}")).cast(kind)
    return F.when(F.abs(known) < F.lit(float("inf")), known).otherwise(wrong)


def refuse_invalid_cells(values: Column, names: Column) -> Column:
    """An array of doubles, failing the job on its first cell that is null, NaN or infinite; ``names`` per cell."""
    flaws = F.filter(
        F.zip_with(
            values,
            names,
            lambda x, n: F.when(x.isNull(), F.concat(F.lit("null in column '"), n, F.lit("'"))).when(
                ~is_finite(x), F.concat(F.lit("NaN or infinity in column '"), n, F.lit("'"))
            ),
        ),
        lambda flaw: flaw.isNotNull(),
    )
    known = F.coalesce(values, F.raise_error(F.lit("null in a vector column")).cast("array<double>"))
    return F.when(F.forall(known, is_finite), known).otherwise(F.raise_error(F.element_at(flaws, 1)).cast("array<double>"))
