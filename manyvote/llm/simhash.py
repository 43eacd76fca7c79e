"""Document fingerprints: weighted hashes of terms vote on 128 signed bits; tables of permuted blocks find all
fingerprints within a Hamming radius. DataFrame functions only.

A term is a word as written (a run of characters other than ASCII white space) with the word after it; the last word is
a term of its own. Each occurrence of a term votes with a weight of its code points, 63 at most, for the bits that its
hash sets and against the others; a bit of the fingerprint is set where more than half of the weight is for it. So equal
texts have equal fingerprints, and a text without words has no bit set. The hash is the CRC-32 of the term's bytes times
four constants, of which each gives 32 bits.

Votes are summed where the row lies: rows are dealt by a key of id and text, and the join with
the next document's head and the sums keep that partitioning.

Cases: null and empty texts and texts of white space have no terms and the fingerprint zero; a null id comes
before all others; rows that share an id follow one another in the order of a hash of their text; rows that
repeat id and text have one place in the order and each its row in the result; the next of the only row is that row itself; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..workspace import Workspace

BITS = 128
HALF = BITS // 2
#: Terms whose votes are added in fields of 16 bits; of the greatest weight each, they stay below 2**15.
CHUNK, MOST = 512, 63
#: Odd factors below 2**31, so that a product with a CRC-32 fits 63 bits. Fixed values.
FACTORS = (1327217885, 1481765933, 1812433253, 1103515245)


@dataclass(frozen=True)
class Blocks:
    """Fingerprints within ``radius`` bits agree on ``blocks - radius`` of ``blocks`` blocks of bits; there is
    one table for each choice of these."""

    radius: int = 3
    blocks: int = 5

    def masks(self) -> list[tuple[int, int]]:
        """Bits of the high and the low half that each table compares, as signed 64-bit numbers."""
        edges = [BITS * i // self.blocks for i in range(self.blocks + 1)]
        single = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(self.blocks)]
        chosen = (sum(c) for c in combinations(single, self.blocks - self.radius))
        return [(_signed(m >> HALF), _signed(m & (1 << HALF) - 1)) for m in chosen]


def _signed(x: int) -> int:
    return x - (1 << HALF) if x >> HALF - 1 else x


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _hash(crc: Column) -> list[Column]:
    """High and low half of a term's hash: bits 16 to 47 of the product with each factor."""
    part = [F.shiftright(crc * F.lit(f).cast("bigint"), 16).bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")) for f in FACTORS]
    return [F.shiftleft(part[i], 32).bitwiseOR(part[i + 1]) for i in (0, 2)]


def vote(rows: DataFrame, keys: list[str], texts: str) -> DataFrame:
    """keys, hi, lo: the fingerprint of each row; ``keys`` tell rows apart, ``texts`` is the column of the text.

    Votes are first added in fields of 16 bits, four to a number, over runs of 512 terms, then in fields of 32 bits
    over the runs: few enough sums to compile as one loop over the terms, and no field overflows for a text of fewer
    than 2**30 code points.
    """
    big = lambda x: F.lit(x).cast("bigint")
    listed = rows.select(*keys, words(F.col(texts)).alias("_words"))
    paired = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("b"))
    spread = listed.select(*keys, F.posexplode_outer(paired).alias("_place", "_pair"))
    spread = spread.select(*keys, F.floor(F.col("_place") / CHUNK).alias("_run"), F.concat_ws(" ", "_pair.a", "_pair.b").alias("_term"))
    weighed = spread.select(*keys, "_run", F.least(F.char_length("_term"), F.lit(MOST)).cast("bigint").alias("_weight"), F.crc32(F.col("_term").cast("binary")).alias("_crc"))
    hashed = weighed.select(*keys, "_run", "_weight", *(h.alias(f"_{i}") for i, h in enumerate(_hash(F.col("_crc")))))

    four = big(sum(1 << 16 * f for f in range(4)))
    short = [F.sum(F.shiftright(f"_{at}", s).bitwiseAND(four) * F.col("_weight")).alias(f"_{at}_{s}") for at in (0, 1) for s in range(16)]
    runs = hashed.groupBy(*keys, "_run").agg(F.sum("_weight").alias("_all"), *short)
    two = big((0xFFFF << 32) + 0xFFFF)
    long = [F.sum(F.shiftright(f"_{at}_{s}", 16 * odd).bitwiseAND(two)).alias(f"_{at}_{s}_{odd}") for at in (0, 1) for s in range(16) for odd in (0, 1)]
    votes = runs.groupBy(*keys).agg(F.sum("_all").alias("_all"), *long)

    def bit(at: int, place: int) -> Column:
        field, s = divmod(place, 16)
        total = F.col(f"_{at}_{s}_{field % 2}")
        total = F.shiftright(total, 32) if field >= 2 else total.bitwiseAND(big((1 << 32) - 1))
        return F.when(total * 2 > F.col("_all"), big(_signed(1 << place))).otherwise(big(0))

    def half(at: int) -> Column:
        total = bit(at, 0)
        for place in range(1, HALF):
            total = total.bitwiseOR(bit(at, place))
        return total

    return votes.select(*keys, half(0).alias("hi"), half(1).alias("lo"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return (F.lit(BITS) - distance(a, b)) / F.lit(float(BITS))


def as_text(hi: Column, lo: Column) -> Column:
    """32 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (hi, lo))))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text and two 64-bit hashes of both, which stand for the row."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit("second"), "text", "id")})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hi, lo: one row per row of ``docs``."""
    rows = _keyed(docs, key, text)
    named = vote(rows.groupBy("k1", "k2").agg(F.any_value("text").alias("text")), ["k1", "k2"], "text")
    return rows.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "hi", "lo")


def neighbours(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """For each distinct key of ``rows`` (id, text, k1, k2): its code points and copies, and the key and the code points of the row before
    it, in ascending order of id; the first follows the last."""
    once = rows.groupBy("k1", "k2").agg(F.any_value("id").alias("id"), F.any_value(F.char_length("text")).alias("n"), F.count("*").alias("copies"))
    keys = workspace.save(once, "keys")
    numbered = workspace.save(number_rows(keys, [F.col("id").asc_nulls_first(), F.col("k1"), F.col("k2")], workspace, "position"), "numbered")
    total = max(numbered.count(), 1)
    before = numbered.select(((F.col("position") + 1) % total).alias("position"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n").alias("n_before"))
    return workspace.save(numbered.join(before, "position").drop("position"), "neighbours")


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, whose last quarter is replaced by as much of the next document's head.

    id, n_chars, edited_sha256, hi, lo, edited_hi, edited_lo, next_hi, next_lo: one row per row of ``docs``.
    Texts are dealt once, by their key; of the next text only the head that is needed moves.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    rows = _keyed(docs, key, text)
    beside = neighbours(rows, workspace)
    by_key = rows.select("k1", "k2", "text")
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = by_key.join(beside.select("k1", "k2", "p1", "p2", quarter(F.col("n_before")).alias("need")), ["k1", "k2"])
    heads = heads.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("substring(text, 1, need)").alias("head"))
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))")
    both = by_key.join(heads, ["k1", "k2"]).select("k1", "k2", "text", F.concat(kept, "head").alias("edited"))
    both = both.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.any_value("edited").alias("edited"))  # repeated rows vote once
    sides = both.select("k1", "k2", F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s"))
    sides = sides.select("k1", "k2", "s.side", F.col("s.text").alias("text"), F.when(F.col("s.side") == 1, F.sha2("s.text", 256)).alias("sha"))
    voted = vote(sides, ["k1", "k2", "side", "sha"], "text")
    own, edited = F.col("side") == 0, F.col("side") == 1
    printed = voted.groupBy("k1", "k2").agg(
        *(F.max(F.when(side, F.col(half))).alias(name + half) for side, name in ((own, ""), (edited, "edited_")) for half in ("hi", "lo")),
        F.max("sha").alias("edited_sha256"),
    )
    printed = workspace.save(printed, "fingerprints")
    of_next = beside.select("k1", "k2", "p1", "p2").join(printed.select("k1", "k2", F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo")), ["k1", "k2"])
    of_next = of_next.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "next_hi", "next_lo")
    found = beside.select("k1", "k2", "id", "copies", F.col("n").cast("bigint").alias("n_chars")).join(printed, ["k1", "k2"]).join(of_next, ["k1", "k2"])
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return found.select("id", "n_chars", "edited_sha256", "hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo")


def _in_tables(prints: DataFrame, blocks: Blocks) -> DataFrame:
    """One row per fingerprint and table, with the bits that the table compares hashed to ``bucket``."""
    tables = [
        F.struct(F.lit(i).alias("table"), F.xxhash64(F.lit(i), F.col("hi").bitwiseAND(F.lit(h).cast("bigint")), F.col("lo").bitwiseAND(F.lit(w).cast("bigint"))).alias("bucket"))
        for i, (h, w) in enumerate(blocks.masks())
    ]
    return prints.select("hi", "lo", F.explode(F.array(*tables)).alias("t")).select("hi", "lo", "t.table", "t.bucket")


def within_radius(queries: DataFrame, index: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """All pairs of a fingerprint of ``queries`` (hi, lo) and one of ``index`` (hi, lo) that differ in at most ``radius`` bits.

    (hi, lo, near_hi, near_lo, distance), each pair of fingerprints once, equal ones included: equal
    fingerprints of a table are one class, rows belong to it by their hi and lo. A pair that
    meets in several tables is taken from the first of them.
    """
    asked, kept = _in_tables(queries.select("hi", "lo").distinct(), blocks), _in_tables(index.select("hi", "lo").distinct(), blocks)
    met = asked.join(kept.select(F.col("hi").alias("near_hi"), F.col("lo").alias("near_lo"), "bucket", F.col("table").alias("near_table")), "bucket")
    differ = [F.col(a).bitwiseXOR(F.col(b)) for a, b in (("hi", "near_hi"), ("lo", "near_lo"))]

    def agrees(mask):
        return (differ[0].bitwiseAND(F.lit(mask[0]).cast("bigint")) == 0) & (differ[1].bitwiseAND(F.lit(mask[1]).cast("bigint")) == 0)

    first = F.coalesce(*(F.when(agrees(mask), F.lit(i)) for i, mask in enumerate(blocks.masks())))
    far = F.bit_count(differ[0]) + F.bit_count(differ[1])
    return met.where((far <= blocks.radius) & (first == F.col("table")) & (F.col("table") == F.col("near_table"))).select("hi", "lo", "near_hi", "near_lo", far.alias("distance"))


def near_counts(prints: DataFrame, asked: Column, blocks: Blocks = Blocks()) -> DataFrame:
    """hi, lo, n_near: for the fingerprints of the rows of ``prints`` (hi, lo) that ``asked`` names, the number of rows, that row included, whose
    fingerprint lies within the radius."""
    sizes = prints.groupBy("hi", "lo").agg(F.count("*").alias("size"))
    pairs = within_radius(prints.where(asked), prints, blocks)
    counted = pairs.join(sizes.toDF("near_hi", "near_lo", "size"), ["near_hi", "near_lo"])
    return counted.groupBy("hi", "lo").agg(F.sum("size").alias("n_near"))
