"""Fitting the members and scoring rows with all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvote.config import LearnerParams
from manyvote.learners.registry import FitContext, Learner
from manyvote.operators.bags import marked_in
from manyvote.operators.layout import LABEL, ROW_ID
from manyvote.operators.member_store import MemberStore
from manyvote.operators.prepare import FEATURES
from manyvote.operators.profile import Profile
from manyvote.operators.repeats import COUNTS, copies_in
from manyvote.operators.tree_stages import (
    INDEXED_LABEL,
    categorical_features,
    class_order,
    original_label,
    with_indexed_label,
)
from manyvote.workspace import Workspace

WEIGHT = "weight"


@dataclass(frozen=True)
class Member:
    """One fitted model, with the columns it reads and how its output becomes a label."""

    index: int
    learner: Learner
    model: Model
    features: str
    classes: list[float] | None

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Append the prediction; scores and probabilities are not computed."""
        model = self.model.copy()
        for unused in ("rawPredictionCol", "probabilityCol"):
            if model.hasParam(unused):
                model.set(model.getParam(unused), "")
        model.set(model.getParam("featuresCol"), self.features)
        model.set(model.getParam("predictionCol"), out)
        return model.transform(df)

    def as_label(self, prediction: Column) -> Column:
        return prediction if self.classes is None else original_label(prediction, self.classes)


@dataclass(frozen=True)
class TreeStages:
    """Fitted once per run: the class order and, per category limit, the feature index."""

    classes: list[float] | None
    indexers: dict[int, VectorIndexerModel]

    @staticmethod
    def column(categories: int) -> str:
        return f"indexed_{categories}"

    def add_features(self, df: DataFrame) -> DataFrame:
        for indexer in self.indexers.values():
            df = indexer.transform(df)
        return df


def fit_tree_stages(rows: DataFrame, learners: Sequence[Learner], params: LearnerParams) -> TreeStages:
    limits = sorted({learner.categories(params) for learner in learners if learner.on_indexed})
    indexers = {n: categorical_features(rows, n, FEATURES, TreeStages.column(n)) for n in limits}
    classes = class_order(rows) if any(learner.relabels for learner in learners) else None
    return TreeStages(classes, indexers)


def fit_members(
    train: DataFrame,
    learners: Sequence[Learner],
    stages: TreeStages,
    params: LearnerParams,
    size: Profile,
    seed: int,
    parallelism: int,
    store: MemberStore | None = None,
) -> list[Member]:
    """Fit one model per learner on its bag of the marked training table, several at a time.

    A bag is a filter on the bits of ``train``, or on its counts, which then are the rows' weights: no row is copied or moved before a fit. With a ``store`` members
    that it holds are read instead, and the others are put there one by one.
    """
    for learner in learners:
        if learner.most_classes is not None and size.classes > learner.most_classes:
            raise ValueError(f"{learner.name} handles {learner.most_classes} classes, the data has {size.classes}")
    repeated = COUNTS in train.columns
    context = FitContext(params, size.features, size.classes, seed)

    def fit(index: int) -> Member:
        learner = learners[index]
        weight = [copies_in(index).cast("double").alias(WEIGHT)] if repeated else []
        rows = train.filter(copies_in(index) > 0 if repeated else marked_in(index)).select(FEATURES, LABEL, *weight)
        features, label, classes = FEATURES, LABEL, None
        if learner.on_indexed:
            limit = learner.categories(params)
            rows, features = stages.indexers[limit].transform(rows), TreeStages.column(limit)
        if learner.relabels:
            classes, label = stages.classes, INDEXED_LABEL
            rows = with_indexed_label(rows, classes, label)
        estimator = learner.estimator(context)
        estimator.set(estimator.getParam("featuresCol"), features)
        estimator.set(estimator.getParam("labelCol"), label)
        if repeated:
            estimator.set(estimator.getParam("weightCol"), WEIGHT)

        def model() -> Model:
            return estimator.fit(rows.select(features, label, *([WEIGHT] if repeated else [])))

        return Member(index, learner, model() if store is None else store.fetch(index, learner, classes, model), features, classes)

    if parallelism == 1:
        return [fit(i) for i in range(len(learners))]
    with ThreadPool(min(parallelism, len(learners))) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(fit), range(len(learners)), chunksize=1)


def score_members(
    test: DataFrame, members: Sequence[Member], stages: TreeStages, workspace: Workspace, per_pass: int
) -> DataFrame:
    """``row_id, label, preds``: every model applied to the same row, without any join.

    Models are chained ``per_pass`` at a time; each pass is written, which keeps plans short and
    stops Spark from repeating predictions inside later expressions.
    """
    df = test.select(ROW_ID, LABEL, FEATURES)
    for start in range(0, len(members), per_pass):
        group = members[start : start + per_pass]
        out = stages.add_features(df) if any(m.learner.on_indexed for m in group) else df
        for m in group:
            out = m.predict(out, f"p{m.index}")
        new = F.array(*[m.as_label(F.col(f"p{m.index}")) for m in group])
        preds = new if start == 0 else F.concat("preds", new)
        kept = [ROW_ID, LABEL] + ([FEATURES] if start + per_pass < len(members) else [])
        before, df = df, workspace.save(out.select(*kept, preds.alias("preds")), "preds")
        if start:
            workspace.drop(before)
    return df
