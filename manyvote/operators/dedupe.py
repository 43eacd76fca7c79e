"""One row per distinct feature combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.operators.layout import LABEL, NUMBERS, ROW_ID, Run

DIGEST = "_digest"


def distinct_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``row_id, features..., label, copies``: the row with the lowest key of every combination.

    With a ``row_id`` column (unique) that key and its label survive; without one the key becomes a
    hash of the features and the lowest label survives. An aggregation and not a ranking, so copies
    collapse before the shuffle and one frequent combination cannot fill a task.
    """
    quoted = [F.col(f"`{c}`") for c in features]
    kinds = dict(rows.dtypes)
    hashed = [q + F.lit(0.0) if kinds[c] in ("double", "float") else q for c, q in zip(features, quoted)]
    return _first_of_each(rows, quoted, F.array(*map(_measured, quoted)), hashed)


def distinct_wide(rows: DataFrame, nominal: Sequence[str], runs: Sequence[Run]) -> DataFrame:
    """The same for rows with their numeric features in one array, and with the same keys; zeros there have one sign."""
    keys = [F.col(f"`{c}`") for c in (*nominal, NUMBERS)]
    parts = [
        F.transform(F.slice(NUMBERS, r.start + 1, r.count), _measured) if r.nominal is None else F.array(_measured(F.col(f"`{r.nominal}`")))
        for r in runs
    ]
    return _first_of_each(rows, keys, F.concat(*parts), keys)


def _measured(value: Column) -> Column:
    """A value as text that cannot run into the next one."""
    return F.concat_ws("=", F.length(value.cast("string")), value.cast("string"))


def _first_of_each(rows: DataFrame, keys: list[Column], parts: Column, hashed: list[Column]) -> DataFrame:
    """Groups are ordered by a digest of their features first, so that sorting compares numbers; the features themselves
    are compared where digests are equal, so that features which share one stay apart.

    Rows of a partition come in the order of the digest, whatever the order they arrived in. ``hashed``: the keys with equal bits
    where they are equal.
    """
    copies = F.count(F.lit(1)).alias("copies")
    groups = rows.withColumn(DIGEST, F.xxhash64(*hashed)).groupBy(DIGEST, *keys)
    if ROW_ID in rows.columns:
        kept = groups.agg(F.min(ROW_ID).alias(ROW_ID), F.min_by(LABEL, ROW_ID).alias(LABEL), copies)
    else:
        kept = groups.agg(F.min(LABEL).alias(LABEL), copies).withColumn(ROW_ID, F.md5(F.array_join(parts, "|")))
    return kept.sortWithinPartitions(DIGEST).select(ROW_ID, *keys, LABEL, "copies")


def refuse_repeated_keys(unique: DataFrame, key: str) -> None:
    """Bags and predictions tell rows by their key, so a key that two rows share fails the run.

    A digest per row is counted; the keys are compared only where a digest occurs twice.
    """
    digest = F.xxhash64(ROW_ID).alias(DIGEST)
    twice = unique.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(DIGEST)
    if twice.isEmpty():
        return
    suspects = unique.select(ROW_ID, digest).join(twice, DIGEST, "left_semi")
    repeated = suspects.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if repeated is not None:
        raise ValueError(f"key column {key!r} is not unique: {repeated[ROW_ID]!r} stands in {repeated['n']} rows")
