"""Nominal values as indices, most frequent first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyvote.operators.numbering import number_rows
from manyvote.workspace import Workspace

# A column's values are ranked in one task up to this many; beyond, the ranking is range partitioned.
RANK_ROWS = 100_000
# Per column so many of its most frequent values are broadcast, and so many of all columns together: two digests
# and a code each, however long the values are.
HEAD_ROWS = 10_000
HEAD_TOTAL = 500_000
# Bits of the bitmap of the other values: some 64 per value, and at most 2**25, which are 2**20 rows of 32 bits.
SLOTS_PER_VALUE, MOST_SLOTS = 64, 1 << 25


@dataclass(frozen=True)
class Dictionary:
    """``entries(column, value, n, code, d1, d2)``, where the digests d1 and d2 stand for column and value, and, per column, how many
    values there are and how many of them are broadcast."""

    entries: DataFrame
    sizes: dict[str, int]
    heads: dict[str, int]

    def of(self, column: str) -> DataFrame:
        return self.entries.filter(F.col("column") == column).select("value", "code")


def value_counts(df: DataFrame, columns: Sequence[str], weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``[by...,] column, value, n`` of several text columns in one aggregation."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]
    weight = F.lit(1).cast("bigint") if weight is None else weight
    return (
        df.select(*by, weight.alias("n"), F.explode(F.array(*cells)).alias("cell"))
        .groupBy(*by, F.col("cell.column").alias("column"), F.col("cell.value").alias("value"))
        .agg(F.sum("n").alias("n"))
    )


def digests(column: Column, value: Column) -> list[Column]:
    """128 bits in two numbers that stand for a value of a column; null for null."""
    both = F.xxhash64(column, value), F.xxhash64(value, F.lit("of"), column)
    return [F.when(value.isNotNull(), d) for d in both]


def build_dictionary(
    counts: DataFrame, workspace: Workspace, rank_rows: int = RANK_ROWS, head_rows: int = HEAD_ROWS, head_total: int = HEAD_TOTAL
) -> Dictionary:
    """Index every column's values by falling frequency, equal frequencies by value."""
    counts = workspace.save(counts, "value_counts")
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    if max(sizes.values(), default=0) <= rank_rows:
        by_frequency = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
        coded = counts.withColumn("code", (F.row_number().over(by_frequency) - 1).cast("double"))
    else:
        numbered = number_rows(counts, [F.asc("column"), F.desc("n"), F.asc("value")], workspace)
        start, starts = 0, []
        for column in sorted(sizes):
            starts.append((column, start))
            start += sizes[column]
        first = counts.sparkSession.createDataFrame(starts, "column string, first bigint")
        coded = numbered.join(F.broadcast(first), "column").select(
            "column", "value", "n", (F.col("position") - F.col("first")).cast("double").alias("code")
        )
    d1, d2 = digests(F.col("column"), F.col("value"))
    entries = workspace.save(coded.select("column", "value", "n", "code", d1.alias("d1"), d2.alias("d2")), "dictionary")
    share = min(head_rows, head_total // max(1, len(sizes)))
    return Dictionary(entries, sizes, {c: min(n, share) for c, n in sizes.items()})


def encode_columns(df: DataFrame, columns: Mapping[str, str], dictionary: Dictionary, row: str) -> DataFrame:
    """Replace text columns by their indices; ``columns``: the index's name by column. Unknown values get one more index.

    The most frequent values are broadcast as digests. A bitmap of the others, of bounded size, tells most unknown values
    without a shuffle. What is left of all columns goes through one shuffle as (row, column, digest), meets
    the entries, and comes back by ``row``, which must be unique; rows without such a cell are not shuffled. A tail value is rare by
    its rank, so no digest of an entry is hot.
    """
    names, own = list(columns), df.columns
    for i, name in enumerate(names):
        d1, d2 = digests(F.lit(name), F.col(f"`{name}`"))
        df = df.withColumns({f"_d1_{i}": d1, f"_d2_{i}": d2})
        head = dictionary.entries.filter((F.col("column") == name) & (F.col("code") < dictionary.heads[name]))
        hits = F.broadcast(head.select(F.col("d1").alias("_h1"), F.col("d2").alias("_h2"), F.col("code").alias(f"_code_{i}")))
        df = df.join(hits, (F.col(f"_d1_{i}") == F.col("_h1")) & (F.col(f"_d2_{i}") == F.col("_h2")), "left").drop("_h1", "_h2")
    kept = [F.col(f"`{c}`") for c in own if c not in (*names, *columns.values())]
    tails = [i for i, name in enumerate(names) if dictionary.heads[name] < dictionary.sizes[name]]

    def finished(rows: DataFrame, found=lambda i: []) -> DataFrame:
        codes = [F.coalesce(f"_code_{i}", *found(i), F.lit(float(dictionary.sizes[name]))).alias(columns[name]) for i, name in enumerate(names)]
        return rows.select(*kept, *codes)

    if not tails:
        return finished(df)
    rare = [(F.col("column") == names[i]) & (F.col("code") >= dictionary.heads[names[i]]) for i in tails]
    entries = dictionary.entries.filter(reduce(lambda a, b: a | b, rare)).select("d1", "d2", "code")
    total = sum(dictionary.sizes[names[i]] - dictionary.heads[names[i]] for i in tails)
    slots = min(MOST_SLOTS, 1 << (total * SLOTS_PER_VALUE).bit_length())
    slot = lambda d: F.pmod(F.col(d), F.lit(slots))
    words = entries.groupBy(F.floor(slot("d1") / 32).alias("_word")).agg(F.bit_or(_bit(slot("d1"))).alias("_bits"))
    for i in tails:
        known = F.broadcast(words.withColumnsRenamed({"_word": f"_word_{i}", "_bits": f"_bits_{i}"}))
        df = df.join(known, F.floor(slot(f"_d1_{i}") / 32) == F.col(f"_word_{i}"), "left")
        maybe = F.col(f"_code_{i}").isNull() & (F.col(f"_bits_{i}").bitwiseAND(_bit(slot(f"_d1_{i}"))) != 0)
        df = df.withColumn(f"_open_{i}", F.coalesce(maybe, F.lit(False))).drop(f"_word_{i}", f"_bits_{i}")
    some = reduce(lambda a, b: a | b, [F.col(f"_open_{i}") for i in tails])
    cells = [F.when(F.col(f"_open_{i}"), F.struct(F.lit(i).alias("i"), F.col(f"_d1_{i}").alias("d1"), F.col(f"_d2_{i}").alias("d2"))) for i in tails]
    asked = df.filter(some).select(F.col(f"`{row}`").alias("_row"), F.inline(F.array_compact(F.array(*cells))))
    answers = asked.join(entries, ["d1", "d2"]).groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("i", "code"))).alias("_codes"))
    open_ = df.filter(some).join(answers, F.col(f"`{row}`") == F.col("_row"), "left")
    # The entries' codes by the number of the column; a value that none of them is stays unknown.
    return finished(df.filter(~some)).unionByName(finished(open_, lambda i: [F.col("_codes")[i]] if i in tails else []))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 32).cast("int"))
