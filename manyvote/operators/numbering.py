"""Row positions in a global order, without a single-task sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.workspace import Workspace

_PARTITION_BITS = 33


def number_rows(df: DataFrame, order: list[Column], workspace: Workspace, name: str = "position") -> DataFrame:
    """Append the 0-based rank of each row under ``order``, which must be a total order.

    Rows are range partitioned and sorted inside their partitions; a row's rank is its place in its
    partition plus the number of rows in the partitions before. Only one count per partition is
    gathered. The sorted table is written first, so that places cannot shift on a retry.
    """
    sorted_rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = workspace.save(sorted_rows, "numbered").withColumn(
        "_range", F.shiftright("_place", _PARTITION_BITS)
    )
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    before = accumulate((r["n"] for r in counts), initial=0)
    starts = df.sparkSession.createDataFrame(
        [(r["_range"], start) for r, start in zip(counts, before)], "_range bigint, _start bigint"
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(name, place + F.col("_start"))
        .drop("_place", "_range", "_start")
    )
