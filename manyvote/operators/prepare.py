"""From a raw table to ``(row_id, features, label)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.config import CLASSIFICATION
from manyvote.operators.dedupe import distinct_wide, refuse_repeated_keys
from manyvote.operators.encode import Dictionary, build_dictionary, encode_columns, value_counts
from manyvote.operators.layout import (
    LABEL,
    NUMBERS,
    PART,
    ROW_ID,
    TableLayout,
    feature_runs,
    inspect_layout,
    wide_rows,
    with_vector_sizes,
)
from manyvote.operators.scale import array_ranges, scaled_array, scaled_code
from manyvote.workspace import Workspace

FEATURES = "features"


@dataclass(frozen=True)
class Distinct:
    """A typed table, before (``rows``) and after (``unique``, saved) keeping one row per features."""

    layout: TableLayout
    rows: DataFrame
    unique: DataFrame


def load_distinct(
    df: DataFrame,
    workspace: Workspace,
    label: str | None = None,
    key: str | None = None,
    handle_invalid: str = "error",
    part: Column | None = None,
) -> Distinct:
    """Type, check and deduplicate a table; a key column must be unique among the rows that stay. ``part``: written with them."""
    layout = with_vector_sizes(df, inspect_layout(df.schema, label, key))
    rows = wide_rows(df, layout, handle_invalid)
    unique = distinct_wide(rows, layout.nominal, feature_runs(layout))
    unique = unique if part is None else unique.withColumn(PART, part)
    table = Distinct(layout, rows, workspace.save(unique, "distinct"))
    if key is not None:
        refuse_repeated_keys(table.unique, key)
    return table


def negative_test(rows: DataFrame) -> DataFrame:
    """``has_negative``: whether any numeric label is below zero; one row."""
    return rows.agg((F.min(LABEL) < 0).alias("has_negative"))


def assemble(df: DataFrame, columns: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Append the double columns as one vector; a NaN fails the job."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def label_text(rows: DataFrame, layout: TableLayout) -> DataFrame:
    """The label as the text its index is looked up by."""
    return rows if layout.label_is_nominal else rows.withColumn(LABEL, F.col(LABEL).cast("string"))


@dataclass(frozen=True)
class Encoding:
    """What was learned from the fitted rows: indices, ranges and whether labels are renumbered."""

    layout: TableLayout
    dictionary: Dictionary | None
    lows: list[float]
    highs: list[float]
    label_indexed: bool

    def label_map(self) -> DataFrame | None:
        """``value, code`` of the label, or None when labels keep their own numbers."""
        return self.dictionary.of(LABEL) if self.label_indexed else None

    def coded(self, rows: DataFrame) -> DataFrame:
        """Nominal columns as indices, labels as numbers, the other features as they are."""
        out = label_text(rows, self.layout) if self.label_indexed else rows
        names = (*self.layout.nominal, *([LABEL] if self.label_indexed else []))
        if names:
            out = encode_columns(out, {name: name for name in names}, self.dictionary, ROW_ID)
        return out.select(ROW_ID, *[F.col(f"`{c}`") for c in self.layout.nominal], NUMBERS, LABEL)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``row_id, features, label``: features in [0, 1], but for unknown nominal values, which lie above."""
        numbers = scaled_array(F.col(NUMBERS), self.lows, self.highs)
        parts = [
            F.slice("_scaled", r.start + 1, r.count)
            if r.nominal is None
            else F.array(scaled_code(F.col(f"`{r.nominal}`"), self.dictionary.sizes[r.nominal]))
            for r in feature_runs(self.layout)
        ]
        coded = self.coded(rows).withColumn("_scaled", numbers)
        return coded.select(ROW_ID, array_to_vector(F.concat(*parts)).alias(FEATURES), LABEL)


def fit_encoding(
    rows: DataFrame,
    layout: TableLayout,
    task: str,
    workspace: Workspace,
    label_rows: DataFrame | None = None,
    weighted: bool = False,
) -> Encoding:
    """Learn indices and ranges from distinct rows.

    ``weighted`` counts every copy that was dropped; labels are then counted on ``label_rows``, the
    rows before that, because copies can differ in their label.
    """
    label_rows = rows if label_rows is None else label_rows
    indexed = layout.label_is_nominal or (
        task == CLASSIFICATION and bool(negative_test(label_rows).first()["has_negative"])
    )
    counts = None
    if layout.nominal:
        counts = value_counts(rows, layout.nominal, F.col("copies") if weighted else None)
    if indexed:
        labels = value_counts(label_text(label_rows.select(LABEL), layout), [LABEL])
        counts = labels if counts is None else counts.unionByName(labels)
    dictionary = None if counts is None else build_dictionary(counts, workspace)
    lows, highs = array_ranges(rows, NUMBERS) if layout.numeric else ([], [])
    if (layout.numeric and not lows) or (dictionary is not None and not dictionary.sizes):
        raise ValueError("cannot scale: the table has no rows")
    return Encoding(layout, dictionary, lows, highs, indexed)


def prepare(
    df: DataFrame,
    task: str,
    workspace: Workspace,
    label: str | None = None,
    key: str | None = None,
    handle_invalid: str = "error",
) -> tuple[DataFrame, Encoding]:
    """Prepare one table as a whole, counting nominal values before rows are dropped."""
    table = load_distinct(df, workspace, label, key, handle_invalid)
    encoding = fit_encoding(table.unique, table.layout, task, workspace, table.rows, weighted=True)
    return encoding.transform(table.unique), encoding
