"""A Merkle manifest of a table as a content-addressed graph: records from a digest to its children's digests.

Each row is a leaf, each group has a tree over its leaves in order, and one more tree stands over the groups' roots.
A proof is found by descent: requests start at the root, follow the base-8 digits of their rank from record
to record, collect the children they pass by, and turn the collected segments around, so that the leaf's come first.
Requests descend together: on each level there is one row per node that any of them passes, so no
record is asked for more than once by a place, and texts are read for the leaves alone.

Trees are built level by level, an eighth of the rows each, written to the workspace; nothing but the number of levels and
one count per sorted partition reaches the driver.

Cases: a null field counts as ``-``, so that it differs from any text, the empty one included; a null group
is a group, before all others, and a null order comes before any other value; rows that share group and order follow one
another by their digest; repeated rows are leaves of their own with equal digests and equal records; an empty table has
no leaf, record or root; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..workspace import Workspace

#: Children of a node, and the bits of a digit of a rank.
FAN, BITS = 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENTS = "array<struct<digit: int, others: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*map(field, columns))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows given with ``tree`` (number of the group's tree) and ``rank``. ``records``: (digest, height, children).
    ``trees``: (tree, group, n, height, subroot). ``root``: (digest, height) of the tree over the trees, or no row."""

    leaves: DataFrame
    records: DataFrame
    trees: DataFrame
    root: DataFrame


def build(rows: DataFrame, group: str, order: str, workspace: Workspace) -> Manifest:
    """The manifest of ``rows``, whose column ``leaf`` holds their digests; better a saved table, as it is read several times."""
    placed = number_rows(rows, [F.col(c).asc_nulls_first() for c in (group, order, "leaf")], workspace, "_at")
    groups = workspace.save(placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("n")), "groups")
    numbered = workspace.save(number_rows(groups, [F.col(group).asc_nulls_first()], workspace, "tree"), "groups")
    known = numbered.select(F.col(group).alias("_group"), "_first", "n", "tree")
    leaves = placed.join(known, F.col(group).eqNullSafe(F.col("_group"))).withColumn("rank", F.col("_at") - F.col("_first"))
    leaves = workspace.save(leaves.drop("_at", "_group", "_first"), "leaves")

    records, tops = _grow(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), workspace)
    trees = workspace.save(numbered.select("tree", F.col(group).alias("group"), "n").join(tops, "tree"), "trees")
    number = F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(trees.count()).cast("bigint").alias("n")
    over, root = _grow(trees.select(*number, F.col("subroot").alias("digest")), workspace)
    once = records.unionByName(over).groupBy("digest", "height").agg(F.any_value("children").alias("children"))
    return Manifest(leaves.drop("n"), workspace.save(once, "records"), trees, workspace.save(root.select(F.col("subroot").alias("digest"), "height"), "root"))


def _grow(nodes: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """Records (digest, height, children) of the inner nodes over ``nodes`` (tree, rank, n, digest), and (tree, height, subroot); n: nodes of the tree
    on the level. The only node of a level is its tree's subroot."""
    most = nodes.agg(F.max("n")).head()[0] or 0
    height, records, tops = 0, None, None
    while True:
        found = nodes.where("n = 1").select("tree", F.lit(height).alias("height"), F.col("digest").alias("subroot"))
        tops = found if tops is None else tops.unionByName(found)
        if most <= 1:
            return nodes.sparkSession.createDataFrame([], "digest string, height int, children array<string>") if records is None else records, tops
        runs = nodes.where("n > 1").groupBy("tree", F.shiftright("rank", BITS).alias("rank"), F.shiftright(F.col("n") + (FAN - 1), BITS).alias("n"))
        made = runs.agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        made = made.select("tree", "rank", "n", F.transform("run", lambda x: x["digest"]).alias("children"))
        made = workspace.save(made.withColumn("digest", digest(F.array_join("children", ""))), "level")
        height, most, nodes = height + 1, (most + FAN - 1) // FAN, made.select("tree", "rank", "n", "digest")
        above = made.select("digest", F.lit(height).alias("height"), "children")
        records = above if records is None else records.unionByName(above)


def _passed_by(children: Column, digit: Column) -> Column:
    """The digit chosen and the other children, left to right, in one string."""
    others = F.concat(F.array_join(F.slice(children, F.lit(1), digit), ""), F.array_join(F.slice(children, digit + 2, F.lit(FAN)), ""))
    return F.struct(digit.cast("int").alias("digit"), others.alias("others"))


def _step(nodes: DataFrame, records: DataFrame, height: int, wanted: DataFrame) -> DataFrame:
    """From nodes (tree, rank, digest, root, segments) of a height to those children that are, or lead to, a place in ``wanted`` (tree, rank)."""
    below = nodes.join(records.where(F.col("height") == height).select("digest", "children"), "digest")
    below = below.select("tree", "rank", "root", "segments", "children", F.posexplode("children").alias("digit", "digest"))
    below = below.select(
        "tree",
        F.shiftleft("rank", BITS).bitwiseOR(F.col("digit")).alias("rank"),
        "digest",
        "root",
        F.concat("segments", F.array(_passed_by(F.col("children"), F.col("digit")))).alias("segments"),
    )
    return below.join(wanted.select("tree", F.shiftright("rank", BITS * (height - 1)).alias("rank")).distinct(), ["tree", "rank"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame, workspace: Workspace) -> DataFrame:
    """``requests`` (tree, rank and any others) with ``found`` (the leaf's digest), ``subroot``, ``root`` and ``segments`` (digit, others), the leaf's first.

    A request for a place that the manifest lacks gets no row.
    """
    heights = manifest.trees.agg(F.max("height")).head()[0], manifest.root.agg(F.max("height")).head()[0]
    highest, top = (h or 0 for h in heights)
    zero = F.lit(0).cast("bigint")
    at = manifest.root.select(zero.alias("tree"), zero.alias("rank"), "digest", F.col("digest").alias("root"), F.array().cast(SEGMENTS).alias("segments"))
    asked = requests.select(zero.alias("tree"), F.col("tree").alias("rank"))
    for height in range(top, 0, -1):
        at = _step(at, manifest.records, height, asked)
    starts = at.select(F.col("rank").alias("tree"), "root", "segments").join(manifest.trees.select("tree", "height", "subroot"), "tree")
    starts = workspace.save(starts, "starts")

    def starting(height: int) -> DataFrame:
        return starts.where(F.col("height") == height).select("tree", zero.alias("rank"), F.col("subroot").alias("digest"), "root", "segments")

    nodes = None
    for height in range(highest, 0, -1):
        nodes = starting(height) if nodes is None else starting(height).unionByName(nodes)
        if height > 1:
            nodes = _step(nodes, manifest.records, height, requests)
    alone = starting(0).select("tree", "rank", "root", "segments", F.array("digest").alias("children"), F.lit(False).alias("inner"))
    runs = alone
    if nodes is not None:
        lowest = nodes.join(manifest.records.where("height = 1").select("digest", "children"), "digest")
        runs = alone.unionByName(lowest.select("tree", "rank", "root", "segments", "children", F.lit(True).alias("inner")))
    runs = runs.select("tree", F.col("rank").alias("_run"), "root", "segments", "children", "inner").join(starts.select("tree", "subroot"), "tree")
    digit = F.col("rank").bitwiseAND(FAN - 1)
    met = requests.withColumn("_run", F.shiftright("rank", BITS)).join(workspace.save(runs, "runs"), ["tree", "_run"])
    met = met.withColumn("found", F.get("children", digit)).where("found is not null")
    last = F.when(F.col("inner"), F.array(_passed_by(F.col("children"), digit))).otherwise(F.array().cast(SEGMENTS))
    met = met.withColumn("segments", F.reverse(F.concat("segments", last)))
    return met.select(*requests.columns, "found", "subroot", "root", "segments")


def proof_digest(segments: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root's."""
    return digest(F.array_join(F.transform(segments, lambda s: s["others"]), ""))


def fold(start: Column, segments: Column) -> Column:
    """The root that a leaf's digest and the segments of a proof give."""

    def up(below: Column, s: Column) -> Column:
        left = s["digit"] * F.lit(64)
        return digest(s["others"].substr(F.lit(1), left), below, s["others"].substr(left + 1, F.lit(64 * FAN)))

    return F.aggregate(segments, start, up)
