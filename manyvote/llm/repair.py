"""Conversation repair by weighted CYK parsing of intervals.

A repaired conversation spells, by its roles' initials, ``(s?(ua)+)?``. The grammar in Chomsky normal form has one symbol
N(p, q) per pair of places in that language such that q can follow p:

    N(p, q) -> N(p, r) N(r, q)                    a span is two adjacent spans
    N(p, q) -> row                                keep, rerole or delete one row
    S -> N(start, q) with q a place where a conversation may end

and insertions are closed over once, before each row and after the last one, so that no rule has an
empty right side. A cell of the chart holds for each symbol the least (cost, audit), the audit being the edits' initials.
Cells are combined bottom-up by span length, adjacent spans in pairs. One split of a span is enough: at any row a
derivation is in one of the places r, so every split gives the same cell. That lets segments of a conversation be parsed in
different tasks. Equal costs are never those of an audit and its own beginning, as an edit more costs more, so
that the least audit of a part is part of the least audit of the whole.

Rows are numbered in one global order, and a segment is the rows of a conversation within 256 numbers, so one that
holds most of all rows is parsed by many tasks. Its segments' cells are combined 64 at a time. Last, rows and cells of a conversation pass
sorted through one task, which keeps the audit (a letter per row) and a digest state and writes the result: the digest of the repaired text is
sequential.

Cases: a null text or role is one space; a null conversation id is a conversation, null turns come first; rows of one turn are in the order of role
and text; rows without an initial (an empty role) are kept by no edit; repeated rows are duplicates; a conversation
without rows after damage costs nothing and has the digest of the empty string; an empty table gives an empty table; very long texts
are held one at a time; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.numbering import number_rows
from ..workspace import Workspace
from .rows import slices

#: Places in the language: nothing yet, after s, after u, after a pair. Role initials lead from place to place.
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {(START, "s"): SYSTEM, **{(p, "u"): ASKED for p in (START, SYSTEM, ANSWERED)}, (ASKED, "a"): ANSWERED}
ENDS = (START, ANSWERED)
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
FAULTS = BLANK, DUPLICATE, CUT = ("blank", "duplicate", "truncated")

#: Numbers of rows to a segment, and segments combined at a time.
SEGMENT, GATHER = 256, 64

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, symbol: tuple[int, int], value: tuple[int, str]) -> None:
    if symbol not in cell or value < cell[symbol]:
        cell[symbol] = value


def combine(one: Cell, two: Cell) -> Cell:
    """The cell of two adjacent spans, by the rules N(p, q) -> N(p, r) N(r, q)."""
    out: Cell = {}
    for (p, r), (cost, audit) in one.items():
        for q in range(4):
            if (r, q) in two:
                more, rest = two[r, q]
                if (p, q) not in out or cost + more <= out[p, q][0]:
                    _least(out, (p, q), (cost + more, audit + rest))
    return out


def _insertions() -> Cell:
    """What insertions alone reach, the closure of single ones."""
    single = {(p, p): (0, "") for p in range(4)}
    for (p, initial), q in STEPS.items():
        if initial in NAMES:
            _least(single, (p, q), (INSERT, "I"))
    closed = single
    while (wider := combine(closed, single)) != closed:
        closed = wider
    return closed


INSERTED = _insertions()


def row_cell(initial: str, fault: str | None) -> Cell:
    """Insertions, then one row kept, reroled or deleted."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for (p, name), q in STEPS.items():
            if name == initial:
                _least(cell, (p, q), (more, "K"))
            if name in NAMES:
                _least(cell, (p, q), (REROLE + more, "R"))
    return combine(INSERTED, cell)


def chart(cells: list[Cell]) -> Cell:
    """The cell of the whole of some adjacent spans: spans of twice the length, until one is left."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell | None) -> tuple[int, str]:
    """Cost and audit of the start symbol; a conversation without rows needs no edit."""
    if cell is None:
        return 0, ""
    whole = combine(cell, INSERTED)
    return min(whole[START, q] for q in ENDS if (START, q) in whole)


class Repaired:
    """Applies an audit to the rows as they come and digests the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, START
        self.sha, self.any = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:".encode("utf-8", "surrogatepass"))
        self.sha.update(text.encode("utf-8", "surrogatepass"))
        self.any = True

    def _named(self) -> str:
        initial = "a" if self.place == ASKED else "u"
        self.place = STEPS[self.place, initial]
        return NAMES[initial]

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(self._named(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = STEPS[self.place, role[:1]]
            self._write(role, text)
        elif edit == "R":
            self._write(self._named(), text)

    def digest(self) -> str:
        self.insert()
        return self.sha.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) dropped, emptied, stripped of final signs, repeated or made the user's by the crc32 of ``conv:turn``."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv", "turn"))).cast("binary")) % 20
    told = rows.select("conv", "turn", *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return told.where("_kind <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def faults(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``at``, their number in the order of conversation and turn, and ``fault``, their first one or null.

    A row is a duplicate unless it is the first of its conversation, role and text; the first ones are joined by their number.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    numbered = workspace.save(number_rows(rows, order, workspace, "at"), "numbered")
    first = numbered.groupBy("conv", "role", F.md5("text").alias("_text")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = (
        F.when(solid == "", BLANK)
        .when(F.col("_first").isNull(), DUPLICATE)
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT)
    )
    return numbered.join(first, "at", "left").withColumn("fault", fault).drop("_first")


_CELL = "array<struct<p: int, q: int, cost: bigint, audit: string>>"


def _told(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _read(cell: list[dict]) -> Cell:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cell}


def _grouped(rows: DataFrame, keys: list[str], order: str, leaf: str, read) -> DataFrame:
    """(keys, cell): the chart over the rows of each group in order of ``order``; ``leaf``: the columns that ``read`` makes a cell of."""
    names = leaf.split(", ")
    sources = rows.select(*keys, order, *names).repartition(*keys).sortWithinPartitions(*keys, order)
    schema = StructType([*(sources.schema[k] for k in keys), *StructType.fromDDL(f"cell {_CELL}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
        out = []
        for key, group in groupby(every, key=lambda row: row[: len(keys)]):
            cell = chart([read(*row[len(keys) + 1 :]) for row in group])
            out.append(dict(zip(keys, key)) | {"cell": _told(cell)})
            if len(out) == 512:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return sources.mapInArrow(run, schema)


def cells(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """(conv, segment, cell): of each conversation of ``rows`` (conv, at, role, fault) at most 64 cells, of consecutive rows."""
    leaves = rows.select("conv", F.floor(F.col("at") / SEGMENT).alias("segment"), "at", F.substring("role", 1, 1).alias("initial"), "fault")
    made = workspace.save(_grouped(leaves, ["conv", "segment"], "at", "initial, fault", row_cell), "cells")
    while (made.groupBy("conv").count().agg(F.max("count")).head()[0] or 0) > GATHER:
        wider = made.select("conv", F.floor(F.col("segment") / GATHER).alias("segment"), F.col("segment").alias("at"), "cell")
        made = workspace.save(_grouped(wider, ["conv", "segment"], "at", "cell", _read), "cells")
    return made


_FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Conversation:
    """Counts of one conversation whose cells, then rows, come in order."""

    def __init__(self):
        self.cells, self.repaired = [], None
        self.counts = dict.fromkeys((*FAULTS, "illegal"), 0)
        self.turns, self.first, self.last, self.initial = 0, None, None, None

    def result(self) -> dict:
        done = self._begin()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": self.cost, "audit": done.audit, "repaired_sha256": done.digest()}

    def _begin(self) -> Repaired:
        if self.repaired is None:
            self.cost, audit = cheapest(chart(self.cells) if self.cells else None)
            self.cells, self.repaired = [], Repaired(audit)
        return self.repaired

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.turns += 1
        self._begin().row(role, text)


def repair(rows: DataFrame, names: DataFrame, workspace: Workspace) -> DataFrame:
    """Per conversation of ``names`` (conv): counts of faults, cost and audit of its cheapest repair, digest of the repaired rows.

    ``rows``: (conv, turn, role, text).
    """
    known = workspace.save(faults(rows, workspace), "faults")
    null = lambda kind: F.lit(None).cast(kind)
    blank_row = {"turn": "bigint", "role": "string", "text": "string", "fault": "string"}
    empty = [null(kind).alias(c) for c, kind in blank_row.items()]
    named = names.select("conv").distinct().select("conv", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), *empty, null(_CELL).alias("cell"))
    parsed = cells(known, workspace).select("conv", F.lit(1).alias("part"), F.col("segment").alias("at"), *empty, "cell")
    told = known.select("conv", F.lit(2).alias("part"), "at", F.col("turn").cast("bigint").alias("turn"), "role", "text", "fault", null(_CELL).alias("cell"))
    every = named.unionByName(parsed).unionByName(told).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "at")
    schema = StructType([named.schema["conv"], *StructType.fromDDL(_FIELDS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, out = None, None, []
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                for row in part.to_pylist():
                    if open_ is None or row["conv"] != conv:
                        if open_ is not None:
                            out.append({"conv": conv, **open_.result()})
                        open_, conv = _Conversation(), row["conv"]
                    if row["part"] == 1:
                        open_.cells.append(_read(row["cell"]))
                    elif row["part"] == 2:
                        open_.row(row["turn"], row["role"], row["text"], row["fault"])
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if open_ is not None:
            out.append({"conv": conv, **open_.result()})
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return every.mapInArrow(run, schema)
