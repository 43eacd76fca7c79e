"""Best-fit packing by a grouping genetic algorithm, in islands.

Pieces as long as a sequence are sequences of their own. All others are dealt evenly to shards of bounded size; each shard is
evolved on several islands, which are rows of a table and so tasks of their own. A solution assigns items to
bins. Crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold an item twice, and best-fits the displaced items. After each epoch the best solution of each island moves to the
next island of its shard. Islands whose best solution has as few bins as the total length allows rest.

Cases: a piece longer than a sequence and a null length are errors; null in other columns is kept; equal lengths are ordered by row number; repeated rows are packed
each; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace


@dataclass(frozen=True)
class Packing:
    """``capacity`` of a sequence; ``shard``: pieces packed together; ``population`` per island.

    An epoch has ``brood`` children, or as many as make ``work`` placements of items: small shards get more of them for the same time.
    """

    capacity: int = 2048
    shard: int = 8192
    islands: int = 3
    epochs: int = 3
    population: int = 6
    brood: int = 24
    work: int = 60_000
    seed: int = 3


class FreeSpace:
    """Bins by their free space: the one with the least space that suffices is found by a bit mask."""

    def __init__(self, capacity: int):
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, number: int, free: int) -> None:
        self.bins[free].append(number)
        self.mask |= 1 << free

    def take(self, needed: int) -> tuple[int, int] | None:
        rest = self.mask >> needed
        if not rest:
            return None
        free = needed + (rest & -rest).bit_length() - 1
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.mask &= ~(1 << free)
        return number, free


def best_fit(lengths: list[int], items, solution: list[int], free: dict[int, int], capacity: int) -> None:
    """Put the items, in order, into the fullest bin that has room, or a new one; changes ``solution`` and ``free``."""
    space = FreeSpace(capacity)
    for number, f in free.items():
        space.add(number, f)
    fresh = max(free, default=-1) + 1
    for item in items:
        n = lengths[item]
        found = space.take(n)
        number, f = found if found else (fresh, capacity)
        fresh += not found
        solution[item], free[number] = number, f - n
        space.add(number, f - n)


def fills(solution: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(solution, weights=lengths)


def cost(solution: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Number of bins, then how evenly they are filled: full and empty bins are better than half full ones."""
    filled = fills(solution, lengths)
    used = filled[filled > 0]
    return len(used), -float(((used / capacity) ** 2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, random) -> np.ndarray:
    """Some of the fullest bins of ``b``, the bins of ``a`` without their items, and the displaced items best-fitted.

    Whole bins come from the better half of ``b``; bins of ``a`` with an item of theirs are dissolved.
    """
    filled = fills(b, lengths)
    good = np.argsort(-filled, kind="stable")[: max(1, int((filled > 0).sum()) // 2)]
    chosen = good[random.random(len(good)) < random.uniform(0.1, 0.6)]
    injected = np.isin(b, chosen)
    broken = np.unique(a[injected])
    kept = ~np.isin(a, broken) & ~injected
    # The worst of the remaining bins are dissolved as well, so that the displaced items meet open space.
    rest = fills(a[kept], lengths[kept]) if kept.any() else np.zeros(0)
    slack = np.flatnonzero((rest > 0) & (rest < capacity * random.uniform(0.9, 1.0)))
    kept &= ~np.isin(a, slack[random.random(len(slack)) < 0.5])
    child = np.full(len(a), -1, np.int64)
    child[injected] = b[injected]
    child[kept] = a[kept] + len(filled)
    names, numbers = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = numbers
    placed = np.flatnonzero(child >= 0)
    filled = np.bincount(child[placed], weights=lengths[placed], minlength=len(names)).astype(int)
    solution, free = child.tolist(), {i: capacity - int(f) for i, f in enumerate(filled)}
    displaced = np.flatnonzero(child < 0)
    order = displaced[np.argsort(-(lengths[displaced] * random.uniform(0.97, 1.0, len(displaced))), kind="stable")]
    best_fit(lengths.tolist(), order.tolist(), solution, free, capacity)
    return np.unique(np.array(solution), return_inverse=True)[1]


def evolve(lengths: np.ndarray, settled: list[np.ndarray], config: Packing, seed: int) -> np.ndarray:
    """The best solution after one epoch, from the given solutions and best-fit ones. ``lengths`` in falling order."""
    random, capacity = np.random.default_rng(seed), config.capacity
    least = -(-int(lengths.sum()) // capacity)
    population = [s for s in settled if s is not None]

    def seeded(order) -> np.ndarray:
        solution: list[int] = [0] * len(lengths)
        best_fit(lengths.tolist(), order.tolist(), solution, {}, capacity)
        return np.array(solution)

    if not population:
        population.append(seeded(np.arange(len(lengths))))
    ranked = sorted(((cost(s, lengths, capacity), i, s) for i, s in enumerate(population)), key=lambda x: x[:2])
    if ranked[0][0][0] <= least:
        return ranked[0][2]
    while len(population) < config.population:
        population.append(seeded(np.argsort(-lengths * random.uniform(0.8, 1.0, len(lengths)), kind="stable")))
    scored = sorted(((cost(s, lengths, capacity), i, s) for i, s in enumerate(population)), key=lambda x: x[:2])
    for child in range(max(config.brood, config.work // len(lengths))):
        one, two = sorted(random.integers(0, len(scored), 2))
        if one == two:
            two = (one + 1) % len(scored)
        born = crossover(scored[two][2], scored[one][2], lengths, capacity, random)
        scored = sorted(scored + [(cost(born, lengths, capacity), len(population) + child, born)], key=lambda x: x[:2])[: config.population]
        if scored[0][0][0] <= least:
            break
    return scored[0][2]


def _epoch(state: DataFrame, config: Packing, epoch: int) -> DataFrame:
    """Each island's best solution after one more epoch; ``own`` and ``guest`` are the solutions it starts from."""

    def run(batches):
        for rows in batches:
            for row in rows.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                start = [np.asarray(s, np.int64) for s in (row.own, row.guest) if s is not None]
                best = evolve(lengths, start, config, hash((config.seed, epoch, row.shard, row.island)) & 0x7FFFFFFF)
                bins, least = int(best.max()) + 1, -(-int(lengths.sum()) // config.capacity)
                yield pd.DataFrame({"shard": [row.shard], "island": [row.island], "lengths": [row.lengths], "own": [best], "bins": [bins], "least": [least]})

    schema = "shard int, island int, lengths array<bigint>, own array<bigint>, bins bigint, least bigint"
    return state.select("shard", "island", "lengths", "own", "guest").mapInPandas(run, schema)


def pack(pieces: DataFrame, config: Packing = Packing(), workspace: Workspace | None = None) -> DataFrame:
    """``pieces`` (with a column ``length``) plus ``sequence_id`` and ``offset``."""
    workspace = workspace or Workspace(pieces.sparkSession)
    own = [F.col(f"`{c}`") for c in pieces.columns]
    table = workspace.save(pieces.select(F.struct(*own).alias("row"), F.col("length").cast("bigint").alias("n"), F.monotonically_increasing_id().alias("number")), "pieces")
    longest, small, unknown = table.agg(F.max("n"), F.count_if(F.col("n") < config.capacity), F.count_if(F.col("n").isNull())).head()
    if unknown:
        raise ValueError(f"{unknown} pieces have no length")
    if longest is not None and longest > config.capacity:
        raise ValueError(f"a piece of {longest} is longer than a sequence of {config.capacity}")
    shards = max(1, -(-small // config.shard))
    part = table.where(F.col("n") < config.capacity).withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int"))
    items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "number")))
    dealt = workspace.save(part.groupBy("shard").agg(items.alias("items")), "shards")

    lengths = F.transform("items", lambda x: -x["minus"])
    none = F.lit(None).cast("array<bigint>")
    islands = F.explode(F.sequence(F.lit(0), F.lit(config.islands - 1))).alias("island")
    state = dealt.select("shard", lengths.alias("lengths"), islands).withColumns({"own": none, "guest": none})
    count = shards * config.islands
    for epoch in range(config.epochs):
        state = workspace.save(_epoch(state.repartition(count, "shard", "island"), config, epoch), "islands")
        if epoch + 1 == config.epochs or state.groupBy("shard").agg(F.min(F.col("bins") - F.col("least")).alias("over")).where("over > 0").isEmpty():
            break
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(config.islands)).alias("island"), F.col("own").alias("guest"))
        state = state.join(elite, ["shard", "island"])
    best = state.groupBy("shard").agg(F.min_by("own", F.struct("bins", "island")).alias("bins"))
    placed = dealt.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    placed = placed.select("shard", "x.items.number", (-F.col("x.items.minus")).alias("n"), F.col("x.bins").alias("bin"))
    # Bins hold few items each and shards are of bounded size: the window sorts small groups only.
    before = Window.partitionBy("shard", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "number",
        (F.col("shard").cast("bigint") * (1 << 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("offset"),
    )
    small_rows = table.where(F.col("n") < config.capacity).join(placed, "number").select("row.*", "sequence_id", "offset")
    whole = table.where(F.col("n") == config.capacity).select("row.*", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return small_rows.unionByName(whole)
