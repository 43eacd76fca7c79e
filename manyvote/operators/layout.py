"""Which column is what, and every column as text or number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyvote.functions.typing import as_number, is_finite, is_nominal, is_vector, refuse_invalid, refuse_invalid_cells

ROW_ID = "row_id"
LABEL = "label"
NUMBERS = "numbers"
PART = "part"
# Up to so many numbers are handled as columns, which compile; more of them as arrays, whose plans do not grow with their number.
NARROW = 128
RESERVED = (ROW_ID, LABEL, NUMBERS, "features", "copies", "bag_bits", "preds", PART)


@dataclass(frozen=True)
class TableLayout:
    """The roles of a table's columns; features keep the table's column order. ``vectors`` are features that are
    arrays, ``sizes`` their numbers of elements."""

    features: tuple[str, ...]
    nominal: tuple[str, ...]
    label: str
    label_is_nominal: bool
    key: str | None = None
    vectors: tuple[str, ...] = ()
    sizes: tuple[int, ...] = ()

    @property
    def n_features(self) -> int:
        return len(self.features) - len(self.vectors) + sum(self.sizes)

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(c for c in self.features if c not in self.nominal)


def inspect_layout(schema: T.StructType, label: str | None = None, key: str | None = None) -> TableLayout:
    """Roles by name and type: the label is the last column unless named, text columns are nominal."""
    names = schema.fieldNames()
    label = names[-1] if label is None else label
    for name in filter(None, (label, key)):
        if name not in names:
            raise ValueError(f"no column {name!r} among {names}")
    features = tuple(n for n in names if n not in (label, key))
    if not features:
        raise ValueError("the table has no feature column")
    taken = [n for n in features if n in RESERVED]
    if taken:
        raise ValueError(f"rename feature columns {taken}: {RESERVED} are result columns")
    nominal = tuple(n for n in features if is_nominal(schema[n]))
    vectors = tuple(n for n in features if is_vector(schema[n]))
    return TableLayout(features, nominal, label, is_nominal(schema[label]), key, vectors)


def _label(df: DataFrame, layout: TableLayout) -> Column:
    return F.col(f"`{layout.label}`").cast("string") if layout.label_is_nominal else as_number(df.schema[layout.label])


def typed_rows(df: DataFrame, layout: TableLayout, handle_invalid: str = "error") -> DataFrame:
    """``[row_id,] features..., label`` with text or finite double columns and no nulls.

    ``handle_invalid`` says what a null, NaN or infinity does: fail the job, or drop its row.
    """
    columns = {}
    if layout.key is not None:
        columns[ROW_ID] = F.col(f"`{layout.key}`")
    for name in layout.features:
        columns[name] = F.col(f"`{name}`").cast("string") if name in layout.nominal else as_number(df.schema[name])
    columns[LABEL] = _label(df, layout)
    text = {ROW_ID, *layout.nominal, *([LABEL] if layout.label_is_nominal else [])}
    return _checked(df, columns, text, handle_invalid)


def _checked(df: DataFrame, columns: dict[str, Column], text: set[str], handle_invalid: str, ready: Sequence[str] = ()) -> DataFrame:
    """The columns, each refused or skipped by its kind; those in ``ready`` have been seen to."""
    if handle_invalid == "skip":
        usable = [c.isNotNull() if n in text else is_finite(c) for n, c in columns.items() if n not in ready]
        return df.filter(reduce(lambda a, b: a & b, usable)).select(*[c.alias(n) for n, c in columns.items()])
    return df.select(
        *[
            (c if n == ROW_ID or n in ready else refuse_invalid(c, n, "string" if n in text else "double")).alias(n)
            for n, c in columns.items()
        ]
    )


def wide_rows(df: DataFrame, layout: TableLayout, handle_invalid: str = "error") -> DataFrame:
    """``[row_id,] nominal features..., numbers, label``: all numeric features, in the table's order, in one array.

    So the plan does not grow with their number. Columns of arrays count as one feature per element.
    """
    narrow = len(layout.numeric) - len(layout.vectors) <= NARROW
    skips = handle_invalid == "skip"
    scalars, parts, names = [], [], []

    def scalar(name):
        # Zero has one sign from here on, so that equal numbers have equal bits.
        number = as_number(df.schema[name]) + F.lit(0.0)
        return refuse_invalid(number, name, "double") if narrow and not skips else number

    def close():
        if scalars:
            parts.append((F.array(*map(scalar, scalars)), None if narrow and not skips else F.array(*map(F.lit, scalars))))
            scalars.clear()

    for name in layout.numeric:
        if name in layout.vectors:
            close()
            value = F.transform(F.col(f"`{name}`").cast("array<double>"), lambda x: x + F.lit(0.0))
            parts.append((value, F.array_repeat(F.lit(name), F.coalesce(F.array_size(f"`{name}`"), F.lit(0)))))
        else:
            scalars.append(name)
    close()
    empty = F.array().cast("array<double>")
    if skips and parts:
        usable = [F.coalesce(F.forall(value, is_finite), F.lit(False)) for value, _ in parts] if not narrow else [
            *(is_finite(as_number(df.schema[n])) for n in layout.numeric if n not in layout.vectors),
            *(F.coalesce(F.forall(F.col(f"`{n}`").cast("array<double>"), is_finite), F.lit(False)) for n in layout.vectors),
        ]
        df = df.filter(reduce(lambda a, b: a & b, usable))
    # Parts with names are still to be checked, cell by cell.
    checked = [value if cells is None or skips else refuse_invalid_cells(value, cells) for value, cells in parts]
    numbers = checked[0] if len(checked) == 1 else F.concat(*checked) if checked else empty
    columns = {} if layout.key is None else {ROW_ID: F.col(f"`{layout.key}`")}
    columns |= {name: F.col(f"`{name}`").cast("string") for name in layout.nominal}
    columns[LABEL] = _label(df, layout)
    text = {ROW_ID, *layout.nominal, *([LABEL] if layout.label_is_nominal else [])}
    return _checked(df, {n: c for n, c in columns.items() if n != LABEL} | {NUMBERS: numbers, LABEL: columns[LABEL]}, text, handle_invalid, (NUMBERS,))


def with_vector_sizes(df: DataFrame, layout: TableLayout) -> TableLayout:
    """The layout with the size of each vector column; rows that differ in it are an error. Null vectors do not count."""
    if not layout.vectors:
        return layout
    sizes = [F.array_size(f"`{name}`") for name in layout.vectors]
    bounds = [b.alias(f"{w}{i}") for i, s in enumerate(sizes) for w, b in (("lo", F.min(s)), ("hi", F.max(s)))]
    row = df.agg(*bounds).first()
    for i, name in enumerate(layout.vectors):
        if row[f"lo{i}"] != row[f"hi{i}"]:
            raise ValueError(f"column {name!r} holds vectors of {row[f'lo{i}']} to {row[f'hi{i}']} elements")
    return replace(layout, sizes=tuple(row[f"hi{i}"] or 0 for i in range(len(sizes))))


@dataclass(frozen=True)
class Run:
    """Consecutive features: ``count`` elements of the numbers from ``start``, or one nominal column."""

    nominal: str | None
    start: int = 0
    count: int = 0


def feature_runs(layout: TableLayout) -> list[Run]:
    """The features in the table's order, numeric ones that stand together as one run."""
    sizes = dict(zip(layout.vectors, layout.sizes))
    runs: list[Run] = []
    at = 0
    for name in layout.features:
        if name in layout.nominal:
            runs.append(Run(name))
            continue
        n = sizes.get(name, 1)
        if runs and runs[-1].nominal is None:
            runs[-1] = Run(None, runs[-1].start, runs[-1].count + n)
        else:
            runs.append(Run(None, at, n))
        at += n
    return runs
