"""Running a Python function over the texts of a table, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker turns into strings at a time; a single longer text goes alone.
BATCH_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(n)
    yield batch.slice(start)


def map_texts(docs: DataFrame, key: str, text: str, fields: str, make: Callable) -> DataFrame:
    """One row per row of ``docs``: ``key`` and the columns that a function computes from the texts.

    ``make()`` runs once per partition and returns a function from a list of texts (null: empty) to
    a dict of columns. Columns of ``docs`` other than the two named are not read.
    """
    source = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = StructType([source.schema[0], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = compute(texts)
                columns = [part.column(0).cast(arrow.field(0).type)]
                columns += [_array(found[f.name], f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on, for other stages

    return source.mapInArrow(run, schema)


def text_column(text: str, kind: str, make: Callable):
    """A column computed from a text column by ``make()``'s function from a list of texts to a list; null texts are empty."""

    @F.pandas_udf(kind)
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            part, size, out = [], 0, []
            for t in texts:
                t = t or ""
                if part and size + len(t) > BATCH_BYTES:
                    out.extend(run(part))
                    part, size = [], 0
                part.append(t)
                size += len(t)
            out.extend(run(part) if part else [])
            yield pd.Series(out)
        pa.default_memory_pool().release_unused()

    return compute(F.col(f"`{text}`").cast("string"))


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def struct_lists(per_row: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of tuples as an Arrow list of structs, built column by column."""
    offsets = np.zeros(len(per_row) + 1, np.int32)
    np.cumsum([len(x) for x in per_row], out=offsets[1:])
    flat = [x for row in per_row for x in row]
    inner = kind.value_type
    columns = [pa.array([x[i] for x in flat], type=inner.field(i).type) for i in range(inner.num_fields)]
    values = pa.StructArray.from_arrays(columns, fields=[inner.field(i) for i in range(inner.num_fields)])
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_fold(key, folds: int):
    """Remainder of crc32 of the key's text; null keys are in no fold."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
