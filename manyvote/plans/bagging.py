"""Bagging runs: prepare, draw bags, fit, score, combine, evaluate."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvote.config import CLASSIFICATION, BaggingConfig
from manyvote.learners.registry import find_learner
from manyvote.operators.allocate import allocate_members
from manyvote.operators.bags import draw_bags
from manyvote.functions.voting import majority_vote, mean_of
from manyvote.operators.combine import combine
from manyvote.operators.dedupe import refuse_repeated_keys
from manyvote.operators.layout import LABEL, PART, ROW_ID
from manyvote.operators.member_store import MemberStore
from manyvote.operators.members import Member, fit_members, fit_tree_stages, score_members
from manyvote.operators.metrics import array_metrics
from manyvote.operators.parts import part_number, part_statistics
from manyvote.operators.prepare import FEATURES, fit_encoding, load_distinct
from manyvote.operators.profile import Profile, profile
from manyvote.operators.repeats import draw_repeats
from manyvote.operators.split import hash_split
from manyvote.sources.tabular import read_fold
from manyvote.workspace import Workspace

METRIC_SCHEMA = "fold int, scope string, method string, member int, metric string, value double"
TIMING_SCHEMA = "fold int, phase string, seconds double"
SINGLE_RUN = 0
ENSEMBLE_MEMBER = -1
TOTAL = "total"


@dataclass(frozen=True)
class BaggingResult:
    """``predictions(fold, row_id, label, baggingPrediction)``, ``member_predictions(fold, row_id,
    label, preds)``, ``metrics(fold, scope, method, member, metric, value)`` and ``timings(fold,
    phase, seconds)`` with a row for the total; ``members`` are the fitted models of the last run."""

    predictions: DataFrame
    member_predictions: DataFrame
    metrics: DataFrame
    timings: DataFrame
    members: list[Member]

    def fold_summary(self) -> DataFrame:
        """Mean and spread of every ensemble metric over the folds."""
        return (
            self.metrics.filter(F.col("scope") == "ensemble")
            .groupBy("metric")
            .agg(
                F.count(F.lit(1)).alias("folds"),
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("stddev"),
            )
        )


class _Clock:
    """Seconds per phase, and in all since the clock was made. Every phase ends in an action and takes in the building of
    the plans that the action runs."""

    def __init__(self):
        self.start = time.perf_counter()
        self.seconds: list[tuple[str, float]] = []

    @contextmanager
    def phase(self, name: str):
        start = time.perf_counter()
        yield
        self.seconds.append((name, time.perf_counter() - start))

    def rows(self, fold: int) -> list[tuple[int, str, float]]:
        return [(fold, n, s) for n, s in (*self.seconds, (TOTAL, time.perf_counter() - self.start))]


@dataclass(frozen=True)
class _Side:
    """Prepared rows, how many features they have, and, for a training side, the keys the bags are drawn from. Where the
    ``size`` is known, the rows are not written first."""

    rows: DataFrame
    features: int
    ids: DataFrame | None = None
    size: Profile | None = None


def _refuse(config: BaggingConfig, mode: str, **unused) -> None:
    """Settings that a run mode does not use are errors unless they have their default."""
    for name, default in unused.items():
        if getattr(config, name) != default:
            raise ValueError(f"{mode} does not use the setting {name}")


def run_bagging(
    train: DataFrame,
    test: DataFrame,
    config: BaggingConfig,
    *,
    workspace: Workspace | None = None,
    fold: int = SINGLE_RUN,
) -> BaggingResult:
    """Run the ensemble on prepared tables ``row_id, features, label`` with unique ``row_id``."""
    _refuse(config, "run_bagging", fit_scope="train", handle_invalid="error", input_partitions=None)
    workspace, clock = workspace or Workspace(train.sparkSession), _Clock()
    with clock.phase("prepare"):
        refuse_repeated_keys(train, ROW_ID)
        width = len(train.select(FEATURES).first()[FEATURES])
    return _ensemble(_Side(train, width, train.select(ROW_ID)), test, config, workspace, clock, fold)


def run_split(df: DataFrame, config: BaggingConfig, *, workspace: Workspace | None = None) -> BaggingResult:
    """Run the ensemble on one raw table, split at random into train and test."""
    workspace = workspace or Workspace(df.sparkSession)
    clock = _Clock()
    with clock.phase("prepare"):
        df = df if config.input_partitions is None else df.repartition(config.input_partitions)
        table = load_distinct(df, workspace, config.label, config.key, config.handle_invalid)
        train, test = hash_split(table.unique, config.split_weights, config.seed)
        everything = config.fit_scope == "all"
        encoding = fit_encoding(
            table.unique if everything else train,
            table.layout,
            config.task,
            workspace,
            label_rows=table.rows if everything else None,
            weighted=everything,
        )
        fitted = _Side(encoding.transform(train), table.layout.n_features, train.select(ROW_ID))
        scored = encoding.transform(test)
    return _ensemble(fitted, scored, config, workspace, clock, SINGLE_RUN, fit_on_test=everything)


def run_folds(
    pairs: Sequence[tuple[DataFrame, DataFrame]], config: BaggingConfig, *, workspace: Workspace | None = None
) -> BaggingResult:
    """Run one ensemble per pair of raw tables; indices and ranges come from each pair's train side.

    With ``fit_scope="all"`` nominal values and labels are counted on all train rows, before duplicates are dropped.
    Folds run several at a time; ``parallelism`` is shared among them.
    """
    if not pairs:
        raise ValueError("no train/test pair")
    _refuse(config, "run_folds", split_weights=BaggingConfig.split_weights)
    spark = pairs[0][0].sparkSession
    workspace = workspace or Workspace(spark)
    return _all_folds(spark, len(pairs), config, lambda i, shared: _run_fold(i + 1, *pairs[i], shared, workspace))


def run_kfold(df: DataFrame, config: BaggingConfig, folds: int, *, workspace: Workspace | None = None) -> BaggingResult:
    """Cross-validate on one raw table: one ensemble per part of it, tested on that part and trained on the others.

    Rows fall into parts by the hash of their key, after duplicates are dropped, so no combination of features stands on both sides.
    The table is typed, deduplicated and counted once; each fold's indices and ranges are merged from the statistics
    of its parts, and its training rows are written nowhere but in the cache of its fits. The result is that of ``run_folds`` on the pairs.
    """
    if folds < 2:
        raise ValueError(f"cross-validation needs at least two folds, got {folds}")
    _refuse(config, "run_kfold", split_weights=BaggingConfig.split_weights, fit_scope="train")
    spark = df.sparkSession
    workspace = workspace or Workspace(spark)
    clock = _Clock()
    with clock.phase("table"):
        df = df if config.input_partitions is None else df.repartition(config.input_partitions)
        part = part_number(folds, config.seed)
        table = load_distinct(df, workspace, config.label, config.key, config.handle_invalid, part)
        statistics = part_statistics(table.unique, table.layout, config.task, folds, workspace)

    def run(i: int, shared: BaggingConfig) -> BaggingResult:
        clock = _Clock()
        with clock.phase("prepare"):
            encoding, size = statistics.fold(i, workspace)
            train, test = table.unique.filter(F.col(PART) != i), table.unique.filter(F.col(PART) == i)
            side = _Side(encoding.transform(train), size.features, train.select(ROW_ID), size)
        return _ensemble(side, encoding.transform(test), shared, workspace, clock, i + 1)

    result = _all_folds(spark, folds, config, run)
    once = spark.createDataFrame([(SINGLE_RUN, name, seconds) for name, seconds in clock.seconds], TIMING_SCHEMA)
    return replace(result, timings=once.unionByName(result.timings))


def _all_folds(
    spark: SparkSession, folds: int, config: BaggingConfig, run_one: Callable[[int, BaggingConfig], BaggingResult]
) -> BaggingResult:
    """Several folds at a time, their results united."""
    at_once = min(config.parallelism, folds)
    shared = replace(config, parallelism=max(1, config.parallelism // at_once))

    def run(fold: int) -> BaggingResult:
        return run_one(fold, shared)

    if at_once == 1:
        runs = [run(fold) for fold in range(folds)]
    else:
        with ThreadPool(at_once) as pool:
            runs = pool.map(inheritable_thread_target(spark)(run), range(folds), chunksize=1)

    def union(part):
        return reduce(DataFrame.unionByName, (getattr(r, part) for r in runs))

    return BaggingResult(
        union("predictions"), union("member_predictions"), union("metrics"), union("timings"), runs[-1].members
    )


def _run_fold(fold: int, train: DataFrame, test: DataFrame, config: BaggingConfig, workspace: Workspace) -> BaggingResult:
    clock = _Clock()
    with clock.phase("prepare"):
        if config.input_partitions is not None:
            train, test = (side.repartition(config.input_partitions) for side in (train, test))
        fitted = load_distinct(train, workspace, config.label, config.key, config.handle_invalid)
        scored = load_distinct(test, workspace, config.label, config.key, config.handle_invalid)
        if scored.layout != fitted.layout:
            raise ValueError(f"fold {fold}: train and test differ in column names or kinds")
        copies = config.fit_scope == "all"
        encoding = fit_encoding(
            fitted.unique,
            fitted.layout,
            config.task,
            workspace,
            label_rows=fitted.rows if copies else None,
            weighted=copies,
        )
        side = _Side(encoding.transform(fitted.unique), fitted.layout.n_features, fitted.unique.select(ROW_ID))
        answers = encoding.transform(scored.unique)
    return _ensemble(side, answers, config, workspace, clock, fold)


def run_fold_paths(
    spark: SparkSession,
    pairs: Sequence[tuple[str, str]],
    config: BaggingConfig,
    *,
    workspace: Workspace | None = None,
    **read_options,
) -> BaggingResult:
    """As ``run_folds``, from train and test paths."""
    return run_folds([read_fold(spark, p, **read_options) for p in pairs], config, workspace=workspace)


def _ensemble(side: _Side, test, config, workspace, clock, fold, fit_on_test=False):
    spark, params = side.rows.sparkSession, config.learners
    methods = allocate_members(config.members, config.methods)
    learners = [find_learner(m, config.task) for m in methods]
    unfit = sorted({learner.name for learner in learners if config.replacement and not learner.weighs})
    if unfit:
        raise ValueError(f"{unfit} cannot weigh rows, so their bags cannot be drawn with replacement")
    with clock.phase("bags"):
        # Written first: the number of rows and of classes and the bags then come from what is already prepared.
        if side.size is None:
            prepared = workspace.save(side.rows, "prepared")
            size = profile(prepared, side.features) if config.task == CLASSIFICATION else Profile(prepared.count(), side.features, 0)
            ids = prepared.select(ROW_ID)
        else:
            prepared, size, ids = side.rows, side.size, side.ids
        draw = draw_repeats if config.replacement else draw_bags
        plan = draw(ids, config.members, config.subset_fraction, config.seed, rows=size.rows)
        if plan.size == 0:
            raise ValueError(f"{plan.rows} training rows leave the bags empty")
        train = plan.mark(prepared)
        test = workspace.save(test, "test") if fit_on_test else test
    with clock.phase("fit"):
        fitted = prepared.select(FEATURES, LABEL)
        fitted = fitted.unionByName(test.select(FEATURES, LABEL)) if fit_on_test else fitted
        stages = fit_tree_stages(fitted, learners, params)
        fit_rows = train
        if config.layout_partitions is not None:
            fit_rows = fit_rows.repartition(config.layout_partitions, ROW_ID).sortWithinPartitions(ROW_ID)
        fit_rows = fit_rows.select(FEATURES, LABEL, plan.column)
        if config.cache_train:
            fit_rows.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            fit_rows = workspace.save(fit_rows, "train")
        try:
            store = None
            if config.member_folder is not None:
                folder = f"{config.member_folder.rstrip('/')}/fold-{fold}"
                store = MemberStore.of(spark, folder, prepared, plan, params, size, config.seed, config.layout_partitions)
            members = fit_members(fit_rows, learners, stages, params, size, config.seed, config.parallelism, store)
        finally:
            if config.cache_train:
                fit_rows.unpersist()
    with clock.phase("score"):
        scored = score_members(test, members, stages, workspace, config.members_per_pass)
    with clock.phase("combine"):
        combined = workspace.save(combine(scored, config.task), "predictions")
    with clock.phase("metrics"):
        metrics = workspace.save(_report(scored, config, methods, fold), "metrics")
    timings = spark.createDataFrame(clock.rows(fold), TIMING_SCHEMA)
    tag = F.lit(fold).alias("fold")
    return BaggingResult(combined.select(tag, "*"), scored.select(tag, "*"), metrics, timings, members)


def _report(scored, config, methods, fold):
    """Metrics of every member and, as member -1, of the ensemble."""
    # The ensemble's answer comes from the same row, so that it counts as one more member, before the first.
    rule = majority_vote if config.task == CLASSIFICATION else mean_of
    answers = scored.select(LABEL, F.concat(F.array(rule(F.col("preds"))), "preds").alias("preds"))
    is_ensemble = F.col("member") == ENSEMBLE_MEMBER
    names = F.array(*map(F.lit, methods))
    return array_metrics(answers, config.task, ENSEMBLE_MEMBER).select(
        F.lit(fold).alias("fold"),
        F.when(is_ensemble, "ensemble").otherwise("member").alias("scope"),
        F.when(is_ensemble, "bagging").otherwise(F.get(names, F.col("member"))).alias("method"),
        "member",
        "metric",
        "value",
    )
