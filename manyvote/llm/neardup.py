"""Near-duplicate documents: MinHash signatures cut into bands give candidates, sequential Bayesian tests on
batches of the signatures prune them, and the full shingle sets confirm what is left.

Documents with equal sets are one class, so copies are compared once. Candidates come in two rounds. First
every class is paired with one other of each of its buckets, which joins large groups of near copies by
a number of pairs that grows with the documents. Where more than a block of a bucket's members stay outside its largest
component, rounds follow that pair one member of each component, another one each time, with one of the largest
component and one of a component drawn at random, until such a round joins few. Then, in buckets that still hold several
components, all pairs between different components are tested and confirmed in blocks of bounded size; only links leave the
task. So no pair of a bucket goes untested that could still join two components.

Cases: null and empty texts and texts of white space have an empty set and link with nothing; fewer than five words
are one shingle; equal texts, repeated rows and rows that share an id are linked through their sets, not
their ids; a null id counts as larger than any other, a group of null ids alone has a null component; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .components import stars
from .rows import slices
from .shingles import digest, minhashes, mix, overlap, shingle_sets


#: Pairs that a task holds at a time.
PAIRS = 20_000
#: A round that joins one of so many pairs, or fewer, is the last one before all pairs that are left are tested.
FEW = 1000


@dataclass(frozen=True)
class NearDup:
    """``percent``: least similarity in hundredths. ``bands`` of ``rows`` hashes each: a pair at 0.75 shares no band with
    probability (1 - 0.75^5)^40 = 2e-5. ``batch`` hashes are compared at a time; a pair goes when the posterior
    probability that its similarity reaches the threshold falls below ``miss``. ``block``: members of a bucket
    compared in one task at a time. ``slots``: bits of the filter that keeps unneeded texts out of shuffles."""

    percent: int = 75
    bands: int = 40
    rows: int = 5
    batch: int = 50
    miss: float = 1e-5
    block: int = 512
    slots: int = 1 << 24


def posterior_bounds(config: NearDup) -> list[tuple[int, int]]:
    """(hashes compared, least number of matches) per batch.

    With a uniform prior and m matches among n, similarity reaches t with probability
    P(Binomial(n + 1, t) <= m). Hashes are compared by one byte, so that t counts as t + (1 - t) / 256.
    """
    t = config.percent / 100
    t += (1 - t) / 256
    bounds = []
    total = config.bands * config.rows
    for n in range(config.batch, total + 1, config.batch):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= config.miss:
                break
            m += 1
        bounds.append((n, m))
    return bounds


def features(docs: DataFrame, key: str, text: str, config: NearDup) -> DataFrame:
    """Per row: id, row_key, n_shingles, digest of the set, band keys and one byte of each hash, eight to a word."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    size = config.bands * config.rows
    turn = np.random.default_rng(11).integers(0, 2**64, config.rows, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                sets = shingle_sets([t or "" for t in part.column(2).to_pylist()])
                signature = minhashes(sets, size)
                bands = (signature.reshape(len(sets), config.bands, config.rows).astype(np.uint64) * turn).sum(axis=2)
                bands = mix(mix(bands) + np.arange(config.bands, dtype=np.uint64)).view(np.int64)
                sketch = np.zeros((len(sets), -(-size // 8) * 8), np.uint8)
                sketch[:, :size] = mix(signature.astype(np.uint64)) & np.uint64(255)
                words = sketch.view("<i8")
                rows = np.arange(len(sets) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(rows * config.bands), pa.array(bands.reshape(-1))),
                        pa.ListArray.from_arrays(pa.array(rows * words.shape[1]), pa.array(words.reshape(-1))),
                    ],
                    names=["id", "row_key", "n_shingles", "digest", "bands", "sketch"],
                )
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, f"id {kind}, row_key bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def _passes(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]], p: np.ndarray | None = None, q: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows (``p`` of ``a``, ``q`` of ``b``; each with its like if not given) that no batch prunes, and their common hashes."""
    p, q = (np.arange(len(a)) if rows is None else rows for rows in (p, q))
    left, matches, at = np.arange(len(p)), np.zeros(len(p), np.int64), 0
    for n, least in bounds:
        matches += (a[p[left], at:n] == b[q[left], at:n]).sum(axis=1)
        keep = matches >= least
        left, matches, at = left[keep], matches[keep], n
    return left, matches


def _sketches(column) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint8).reshape(len(column), -1)


def _differing(n: int):
    """How many of the first ``n`` hashes differ between the columns sketch_a and sketch_b."""
    words, low = -(-n // 8), 0x0101010101010101  # the lowest bit of each byte
    masks = [low] * (n // 8) + [low & ((1 << 8 * (n % 8)) - 1)] * (words - n // 8)
    folded = F.zip_with(F.slice("sketch_a", 1, words), F.slice("sketch_b", 1, words), lambda a, b: a.bitwiseXOR(b))
    for half in (4, 2, 1):  # the lowest bit of a byte becomes 1 if any of its bits is
        folded = _folded(folded, half)
    ones = F.zip_with(folded, F.array(*(F.lit(m).cast("bigint") for m in masks)), lambda x, m: F.bit_count(x.bitwiseAND(m)))
    return F.aggregate(ones, F.lit(0), lambda total, x: total + x)


def _folded(words, half: int):
    return F.transform(words, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, half)))


def _pruned(pairs: DataFrame, classes: DataFrame, config: NearDup) -> DataFrame:
    """The pairs (a, b) of nodes that pass the sequential test, with their row keys and the number of hashes they have in common."""
    full = pairs
    for side in "ba":
        sketches = classes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("row_key").alias(f"key_{side}"))
        full = full.join(sketches, side)
    bounds = posterior_bounds(config)
    for n, least in bounds:
        full = full.where(_differing(n) <= n - least)
    n = bounds[-1][0]
    return full.select("a", "b", "key_a", "key_b", (n - _differing(n)).alias("matches"))


def _needed_texts(docs: DataFrame, key: str, text: str, wanted: DataFrame, config: NearDup) -> DataFrame:
    """(row_key, text) for the row keys in ``wanted`` and a few others.

    A bitmap of the row keys, of fixed size, keeps most other texts out of the shuffle; the callers' joins decide.
    """
    source = docs.select(F.xxhash64(key, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return maybe_among(source, "row_key", wanted, config.slots).groupBy("row_key").agg(F.first("text").alias("text"))


def maybe_among(rows: DataFrame, column: str, wanted: DataFrame, slots: int) -> DataFrame:
    """The rows whose 64-bit ``column`` shares its slot with a value of ``wanted``; a bitmap of ``slots`` bits is broadcast."""
    mapped = rows.join(F.broadcast(slot_bitmap(wanted, column, slots)), F.floor(_slot(column, slots) / 32) == F.col("_word"))
    return mapped.where(F.expr(f"(_bits >> cast({_slot_sql(column, slots)} % 32 as int)) & 1 = 1")).drop("_word", "_bits")


def slot_bitmap(wanted: DataFrame, column: str, slots: int) -> DataFrame:
    """(_word, _bits): the used slots, 32 to a row, so at most ``slots`` / 32 rows however many values there are."""
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast({_slot_sql(column, slots)} % 32 as int))")
    return wanted.groupBy(F.floor(_slot(column, slots) / 32).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _slot_sql(column: str, slots: int) -> str:
    return f"pmod(`{column}`, {slots})"


def _slot(column: str, slots: int):
    return F.expr(_slot_sql(column, slots))


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, config: NearDup) -> DataFrame:
    """Those of the pairs (a, b, key_a, key_b) whose full sets reach the threshold."""
    texts = _needed_texts(docs, key, text, pairs.select(F.explode(F.array("key_a", "key_b")).alias("row_key")), config)
    full = pairs.join(texts.select(F.col("row_key").alias("key_b"), F.col("text").alias("text_b")), "key_b")
    # by another form of the key: shuffled for this join, so that adaptive execution can split the many pairs of one text
    ends = texts.select(F.bitwise_not("row_key").alias("end"), F.col("text").alias("text_a"))
    full = full.withColumn("end", F.bitwise_not("key_a")).join(ends, "end")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                one, two = part.column(2).to_pylist(), part.column(3).to_pylist()
                distinct = list(dict.fromkeys(one + two))
                sets = dict(zip(distinct, shingle_sets([t or "" for t in distinct])))
                keep = []
                for i, (s, t) in enumerate(zip((sets[x] for x in one), (sets[x] for x in two))):
                    common = overlap(s, t)
                    if 100 * common >= config.percent * (len(s) + len(t) - common) > 0:
                        keep.append(i)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        pa.default_memory_pool().release_unused()

    return full.select("a", "b", "text_b", "text_a").mapInArrow(run, "a bigint, b bigint")


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node, a): the members of all buckets with several, and the bucket's smallest node."""
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return banded.join(shared, "bucket").select("bucket", "node", "a")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Every node of a shared bucket with the bucket's smallest node."""
    return members.where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open_buckets(banded: DataFrame) -> DataFrame:
    """The buckets that hold several components: the largest component of each, its size, the size of the bucket."""
    sizes = banded.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("parts")
    ).where("parts > 1")


def _round_pairs(members: DataFrame, number: int) -> DataFrame:
    """(a, b, root): of each component of each bucket of ``members`` (node, root, bucket) one member b, with a member a of the bucket's largest
    component and with one of another component; the round's ``number`` decides which. ``root``: the component of b."""
    turn = lambda c: F.xxhash64(F.col(c), F.lit(number))
    parts = members.groupBy("bucket", "root").agg(F.min_by("node", turn("node")).alias("b"), F.count("*").alias("n"))
    chosen = parts.groupBy("bucket").agg(F.max_by("b", F.struct("n", "root")).alias("main"), F.min_by("b", turn("root")).alias("other"))
    pairs = parts.join(chosen, "bucket").select("b", "root", F.explode(F.array("main", "other")).alias("a"))
    return pairs.where("a <> b").select("a", "b", "root").distinct()


def _join_crowds(
    links: DataFrame, roots: DataFrame, buckets: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str, classes: DataFrame, config: NearDup, workspace: Workspace
):
    """Links and roots after rounds of pairs in those of ``buckets`` where more than a block of members lie outside the largest component."""
    crowded = workspace.save(buckets.where(F.col("n") - F.col("n_main") > config.block).select("bucket"), "crowded")
    if crowded.isEmpty():
        return links, roots
    members = workspace.save(members.join(crowded, "bucket", "left_semi"), "crowds")
    number = 0
    while True:
        number += 1
        rooted = _rooted(members, roots)
        still = _open_buckets(rooted).where(F.col("n") - F.col("n_main") > config.block).select("bucket")
        pairs = workspace.save(_round_pairs(rooted.join(still, "bucket", "left_semi"), number), "round")
        passed = _pruned(pairs.select("a", "b"), classes, config).join(pairs, ["a", "b"])
        passed = passed.groupBy("root").agg(F.min(F.struct("a", "b", "key_a", "key_b")).alias("pair")).select("pair.*")
        more = workspace.save(_confirmed(workspace.save(passed, "pairs"), docs, key, text, config), "confirmed")
        joined = more.count()
        if joined:
            links, roots = links.unionByName(more), workspace.save(_wider(roots, more, workspace), "roots")
        if joined * FEW <= pairs.count():
            return links, roots


def _forest_roots(links: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, root) of every node b of ``links``, which link each b once, to a smaller a: a node's root becomes its root's until none has one."""
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        above = spread_join(roots, roots.toDF("root", "top"), "root", "left")
        above = workspace.save(above.select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        roots = above.drop("moved")
        if not above.agg(F.max("moved")).head()[0]:
            return roots


def _wider(roots: DataFrame, more: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, root) after more links: the roots so far are the nodes of the components' components."""
    renamed = more.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    renamed = renamed.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    upper = stars(workspace.save(renamed.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")), "upper"), workspace)
    raised = spread_join(roots, upper.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return raised.unionByName(upper)


#: Places to which rows of one key are dealt in joins with a table of one row per key.
SPREAD = 8


def spread_join(rows: DataFrame, single: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``single``, which has one row per ``key``; the rows of a key go to several tasks, by their ``node``."""
    dealt = rows.withColumn("_place", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
    copies = single.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copies, [key, "_place"], how).drop("_place")


def _units(classes: DataFrame, banded: DataFrame, buckets: DataFrame, config: NearDup) -> DataFrame:
    """(unit, bucket, node, root, row_key, sketch): the members of the open buckets, dealt to units of two blocks.

    The members of the bucket's largest component meet all others, and the others meet one another; members of
    one component do not meet. So a bucket's rows grow with its size as long as one component holds most of it.
    """
    blocks = lambda n: F.ceil(n / F.lit(config.block)).cast("int")
    buckets = buckets.select("bucket", "main", blocks(F.col("n_main")).alias("k_main"), blocks(F.col("n") - F.col("n_main")).alias("k_rest"))
    members = banded.join(buckets, "bucket").withColumn("is_main", F.col("root") == F.col("main"))
    own = F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("is_main"), F.col("k_main")).otherwise(F.col("k_rest"))).cast("int")
    members = members.withColumn("own", own)

    def unit(kind, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    rest = F.sequence(F.lit(0), F.col("k_rest") - 1)
    dealt = F.when(F.col("is_main"), F.transform(rest, lambda x: unit(0, F.col("own"), x))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("k_main") - 1), lambda x: unit(0, x, F.col("own"))),
            F.transform(rest, lambda x: unit(1, F.least(x, F.col("own")), F.greatest(x, F.col("own")))),
        )
    )
    units = members.select("node", "root", "bucket", F.explode(dealt).alias("unit"))
    units = units.select(F.xxhash64("bucket", "unit").alias("unit"), "bucket", "node", "root")
    return units.join(classes.select("node", "row_key", "sketch"), "node").select("unit", "bucket", "node", "root", "row_key", "sketch")


def _by_unit(rows: DataFrame, schema: str, compare) -> DataFrame:
    """``compare`` run on Arrow tables of whole units, small units many at a time."""

    def run(batches):
        held = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            unit = held.column("unit").to_numpy()
            whole = int(np.argmax(unit == unit[-1])) if len(unit) else 0
            if whole:
                yield from compare(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from compare(held)
        held = None
        pa.default_memory_pool().release_unused()

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def _cuts(unit: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _candidates(members: pa.Table, bounds: list[tuple[int, int]]):
    """Pairs of positions, of different components and within one unit, that pass the sequential test, by parts."""
    root = members.column("root").to_numpy()
    sketch = _sketches(members.column("sketch").combine_chunks())
    left, right, size = [], [], 0
    units = _cuts(members.column("unit").to_numpy())
    for a, b in units:
        i, j = np.triu_indices(b - a, 1)
        differ = root[a + i] != root[a + j]
        left.append(a + i[differ])
        right.append(a + j[differ])
        size += len(left[-1])
        if size > PAIRS or b == units[-1][1]:
            i, j = np.concatenate(left), np.concatenate(right)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                keep = _passes(sketch, sketch, bounds, p, q)[0]
                yield p[keep], q[keep]
            left, right, size = [], [], 0


def _second_links(
    docs: DataFrame, key: str, text: str, classes: DataFrame, units: DataFrame, config: NearDup, workspace: Workspace
) -> DataFrame:
    """Confirmed links between the components of the rounds before that no other link of the same task implies.

    A first pass over the units marks the members with a candidate that the sequential test leaves; only they get
    their texts. A second pass confirms the candidates on the full sets where they lie. Candidates never leave a
    task, so their number, which can grow with the square of a group, costs neither shuffle nor disk.
    """
    bounds = posterior_bounds(config)

    def mark(members: pa.Table):
        marked = np.zeros(members.num_rows, bool)
        for p, q in _candidates(members, bounds):
            marked[p] = marked[q] = True
        yield from members.select(["unit", "bucket", "node", "root", "row_key"]).filter(pa.array(marked)).combine_chunks().to_batches()

    def confirm(members: pa.Table):
        members = members.combine_chunks()
        bucket, node = members.column("bucket").to_numpy(), members.column("node").to_numpy()
        bands = members.column("bands").chunk(0).flatten().to_numpy().reshape(len(node), -1) if len(node) else None
        text_of, sets = members.column("text"), {}

        def shingles(row: int) -> np.ndarray:
            if node[row] not in sets:
                sets[node[row]] = shingle_sets([text_of[row].as_py() or ""])[0]
            return sets[node[row]]

        group = {}  # of each component or node: what it has been joined to here

        def find(x):
            while group.get(x, x) != x:
                x = group[x]
            return x

        root = members.column("root").to_numpy()
        links = []
        for p, q in _candidates(members, bounds):
            same = bands[p] == bands[q]
            first = np.take_along_axis(bands[p], same.argmax(axis=1)[:, None], 1)[:, 0]
            here = np.flatnonzero(same.any(axis=1) & (first == bucket[p]))  # elsewhere the pair is confirmed in another bucket
            for i, j in zip(p[here].tolist(), q[here].tolist()):
                a, b = find(root[i]), find(root[j])
                if a == b:
                    continue
                s, t = shingles(i), shingles(j)
                if min(len(s), len(t)) * 100 < config.percent * max(len(s), len(t)):
                    continue
                common = overlap(s, t)
                if 100 * common >= config.percent * (len(s) + len(t) - common) > 0:
                    group[max(a, b)] = min(a, b)
                    links.append((int(node[i]), int(node[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    marked = workspace.save(_by_unit(units, "unit bigint, bucket bigint, node bigint, root bigint, row_key bigint", mark), "marked")
    texts = _needed_texts(docs, key, text, marked, config)
    known = classes.select("node", "row_key", "sketch", "bands").join(texts, "row_key").drop("row_key")
    full = marked.join(known, "node")
    return _by_unit(full.select("unit", "bucket", "node", "root", "sketch", "bands", "text"), "a bigint, b bigint", confirm)


@dataclass(frozen=True)
class Groups:
    """``rows``: (id, row_key, n_shingles, component, winner), one per row of the input; ``winner`` is the row key of
    the document that stands for the component. ``links``: confirmed links between class representatives (row keys)."""

    rows: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDup = NearDup(), workspace: Workspace | None = None) -> Groups:
    """Components of documents whose shingle sets reach the similarity."""
    workspace = workspace or Workspace(docs.sparkSession)
    full = workspace.save(features(docs, key, text, config), "features")
    low = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")
    classes = full.where("n_shingles > 0").groupBy("digest").agg(
        F.min(low).alias("low"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
    )
    classes = workspace.save(
        classes.select(F.monotonically_increasing_id().alias("node"), "digest", "low", F.col("low.row_key").alias("row_key"), "bands", "sketch"), "classes"
    )
    rows = workspace.save(full.select("id", "row_key", "n_shingles", "digest"), "rows")
    workspace.drop(full)

    members = workspace.save(_shared_buckets(classes), "members")
    best = F.max_by(F.struct("a", "key_a", "key_b"), F.struct("matches", "a")).alias("best")
    passed = _pruned(_first_pairs(members), classes, config).groupBy("b").agg(best).select("b", "best.*")
    passed = workspace.save(passed, "pairs")
    links = workspace.save(_confirmed(passed, docs, key, text, config), "confirmed")
    roots = _forest_roots(links, workspace)
    members = members.select("node", "bucket")
    buckets = workspace.save(_open_buckets(_rooted(members, roots)), "buckets")
    joined, joined_roots = _join_crowds(links, roots, buckets, members, docs, key, text, classes, config, workspace)
    if joined is not links:
        links, roots = joined, joined_roots
        buckets = workspace.save(_open_buckets(_rooted(members, roots)), "buckets")
    units = _units(classes, _rooted(members, roots), buckets, config)
    more = workspace.save(_second_links(docs, key, text, classes, units, config, workspace), "confirmed")
    links, roots = links.unionByName(more), workspace.save(_wider(roots, more, workspace), "roots")

    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    alone = classes.select("node", "digest", "low").join(linked.select("node"), "node", "left_anti")
    alone = alone.select("digest", F.col("low.id").alias("component"), F.col("low.row_key").alias("winner"))
    tops = classes.select("node", "digest", "low").join(linked, "node")
    least = workspace.save(tops.groupBy("root").agg(F.min("low").alias("least")), "least")
    named = spread_join(tops, least, "root").select("digest", F.col("least.id").alias("component"), F.col("least.row_key").alias("winner")).unionByName(alone)
    found = rows.join(named, "digest", "left").select(
        "id",
        "row_key",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component"),
        F.when(F.col("n_shingles") > 0, F.col("winner")).alias("winner"),
    )
    return Groups(found, links)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDup = NearDup(), workspace: Workspace | None = None) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id, all columns kept; documents without words all stay.

    Only rows that go, or occur more than once, and those that share a slot of the bitmap with them are shuffled.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    rows = near_duplicates(docs, key, text, config, workspace).rows.where("n_shingles > 0")
    odd = rows.groupBy("row_key").agg(F.count("*").alias("_copies"), F.max(F.col("row_key") == F.col("winner")).alias("_stays"))
    odd = workspace.save(odd.where("_copies > 1 or not _stays"), "odd").withColumnRenamed("row_key", "_row_key")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.xxhash64(key, text).alias("_row_key"))
    bitmap = F.broadcast(slot_bitmap(odd, "_row_key", config.slots))
    flagged = keyed.join(bitmap, F.floor(_slot("_row_key", config.slots) / 32) == F.col("_word"), "left")
    maybe = F.coalesce(F.expr(f"(_bits >> cast({_slot_sql('_row_key', config.slots)} % 32 as int)) & 1 = 1"), F.lit(False))
    flagged = flagged.withColumn("_maybe", maybe)
    sure = flagged.where(~F.col("_maybe")).select("row")
    open_ = flagged.where("_maybe").join(odd, "_row_key", "left")
    single = open_.where("_copies is null").select("row")
    copies = open_.where("_stays").groupBy("_row_key").agg(F.any_value("row").alias("row")).select("row")
    return sure.unionByName(single).unionByName(copies).select("row.*")
