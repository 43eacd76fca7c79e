"""Connected components of links, by alternating large and small stars; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def connected_components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the smallest node it reaches."""
    found = stars(workspace.save(_directed(links.select("a", "b").where("a <> b")).distinct(), "links"), workspace)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def stars(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, root) for every node of ``edges`` (high, low), a saved table, but the smallest of each component.

    Each round is written to the workspace. The joins are on nodes with one row on one side, so a node with
    very many links is split by adaptive execution. An empty table of links gives an empty table.
    """
    given = edges
    while not _flat(edges):
        after = workspace.save(_small_star(_large_star(edges)), "links")
        if edges is not given:
            workspace.drop(edges)
        edges = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour or itself: a row for each edge."""
    ends = F.array(F.struct(F.col("high").alias("u"), F.col("low").alias("v")), F.struct(F.col("low").alias("u"), F.col("high").alias("v")))
    least = edges.select(F.explode(ends).alias("end")).groupBy("end.u").agg(F.min("end.v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.select(F.col("low").alias("u"), F.col("high").alias("v")).join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    ends = F.array(F.struct("high", "m"), F.struct(F.col("low").alias("high"), "m"))
    moved = edges.join(least, "high").select(F.explode(ends).alias("end")).select("end.high", F.col("end.m").alias("low"))
    return moved.where("high <> low").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or none and then larger ones only: no further round changes that."""
    ends = F.array(F.struct(F.col("high").alias("node"), "low"), F.struct(F.col("low").alias("node"), F.lit(None).cast("bigint").alias("low")))
    nodes = edges.select(F.explode(ends).alias("end")).select("end.*").groupBy("node")
    nodes = nodes.agg(F.min("low").alias("least"), F.max("low").alias("most"), F.max(F.col("low").isNull()).alias("is_low"))
    return not nodes.agg(F.max(F.expr("least <> most or least is not null and is_low"))).head()[0]
