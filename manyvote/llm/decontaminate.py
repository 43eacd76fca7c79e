"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items scans each
normalised document once; hits map back to words and characters of the original.

The automaton's letters are words: every word of the benchmark gets a character of its own and all other
words share one, so that a window of ten words is a string of ten characters. Beyond a million distinct words each has two
characters, a first one that is never a second.

Cases: null and empty texts have no words; an item without words gives no window; a null item id marks
words but is no listed item; items that share an id are one item; ties and repeated rows each give their
row; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices, text_column
from .words import alnum_spans, alnum_words

WINDOW = 10
#: Bytes of item texts in one automaton, and so in one broadcast. A larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 16 << 20
#: Characters that stand for words, the surrogates left out; the first of two is among the lowest.
LETTERS, FIRST = 0x10FFFF - 0x800, 1 << 12
_BUILT: dict = {}


class Windows:
    """Automaton over the windows of the items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        numbers: dict[bytes, int] = {}
        told = [(item_id, [numbers.setdefault(w, len(numbers) + 1) for w in alnum_words(text)]) for item_id, text in items]
        self.wide = wide = 1 if len(numbers) < LETTERS else 2
        self.letters = {w: _letters(n, wide) for w, n in numbers.items()}
        self.other = _letters(0, wide)
        patterns: dict[str, list[str]] = {}
        for item_id, places in told:
            coded = "".join(_letters(n, wide) for n in places)
            for at in range(max(1, len(places) - window + 1) if places else 0):
                ids = patterns.setdefault(coded[at * wide : (at + window) * wide], [])
                if item_id is not None and item_id not in ids[-1:]:
                    ids.append(item_id)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            self.automaton.add_word(pattern, (len(pattern) // wide, ids))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: str) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, merged ranges of hit words (end exclusive), ids of the items that occur."""
        words = alnum_words(text)
        ranges: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return len(words), ranges, items
        get = self.letters.get
        coded = "".join([get(w, self.other) for w in words])
        for end, (length, ids) in self.automaton.iter(coded):
            end //= self.wide
            start = end + 1 - length
            items.update(ids)
            while ranges and start < ranges[-1][0]:
                start = min(start, ranges.pop()[0])
            if ranges and start <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], end + 1)
            else:
                ranges.append([start, end + 1])
        return len(words), ranges, items


def _letters(n: int, wide: int) -> str:
    """The character, or the two, for the nth word; the number 0 is for words of no item."""
    if wide == 1:
        return _letter(n)
    return _letter(n % FIRST) + _letter(FIRST + n // FIRST)


def _letter(n: int) -> str:
    return chr(n if n < 0xD800 else n + 0x800)


def _windows(shared, window: int) -> Windows:
    """The automaton of a broadcast, built once per Python worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Windows(shared.items, window)
    return _BUILT[shared.id]


class _Block:
    def __init__(self, id: str, items: list):
        self.id, self.items = id, items


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """The items in as many parts as their bytes ask for; each part is small enough to collect."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    n = -(-int(total) // (most // 2)) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [items.where(part == i) for i in range(n)]


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``n_words``; ``ranges`` array of hit (start_word, end_word, start, end), merged,
    ends exclusive, start and end in characters; ``items`` array of the ids that occur."""
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    state = f"`{key}` {kind}, _text string, n_words bigint, ranges array<struct<start_word:bigint,end_word:bigint>>, items array<string>"
    at = docs.select(
        F.col(key),
        F.col(text).cast("string").alias("_text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start_word:bigint,end_word:bigint>>").alias("ranges"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    for number, block in enumerate(blocks):
        shared = _share(spark, block)
        last = number == len(blocks) - 1
        schema = state if not last else (
            f"`{key}` {kind}, n_words bigint, "
            "ranges array<struct<start_word:bigint,end_word:bigint,start:bigint,end:bigint>>, items array<string>"
        )
        at = at.mapInArrow(_scan(shared, window, last, key), schema)
    return at


def _scan(shared, window: int, last: bool, key: str):
    def run(batches):
        windows = _windows(shared.value, window)
        pair = [("start_word", pa.int64()), ("end_word", pa.int64())]
        full = pa.list_(pa.struct(pair + [("start", pa.int64()), ("end", pa.int64())] * last))
        for batch in batches:
            for part in slices(batch, 1):
                counts, ranges, items = [], [], []
                for text, before, ids in zip(*(part.column(i).to_pylist() for i in (1, 3, 4))):
                    n, hit, found = windows.scan(text or "")
                    if before:
                        hit = merge([[x["start_word"], x["end_word"]] for x in before] + hit)
                    spans = alnum_spans(text) if last and hit else None
                    counts.append(n)
                    ranges.append([{"start_word": a, "end_word": b} | ({"start": spans[a][0], "end": spans[b - 1][1]} if last else {}) for a, b in hit])
                    items.append(sorted(found.union(ids)))
                columns = [part.column(0)] + [part.column(1)] * (not last)
                columns += [pa.array(counts, pa.int64()), pa.array(ranges, full), pa.array(items, pa.list_(pa.string()))]
                names = [key] + ["_text"] * (not last) + ["n_words", "ranges", "items"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def merge(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges in order, overlapping and touching ones joined."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def n_hit() -> F.Column:
    """Number of hit words from ``ranges``."""
    return F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end_word"] - r["start_word"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, all columns kept."""
    kept = docs
    for block in _blocks(benchmark, "item_id", "text", BLOCK_BYTES):
        kept = kept.where(_is_clean(_share(docs.sparkSession, block), text))
    return kept


def _share(spark, block: DataFrame):
    rows = [(r["item"], r["text"]) for r in block.collect()]
    return spark.sparkContext.broadcast(_Block(uuid.uuid4().hex, rows))


def _is_clean(shared, text: str):
    def make():
        windows = _windows(shared.value, WINDOW)
        return lambda texts: [not windows.scan(t)[1] for t in texts]

    return text_column(text, "boolean", make)
