"""Learner names, the task each one serves, and the Spark ML estimator behind it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    IsotonicRegression,
    RandomForestRegressor,
)

from manyvote.config import CLASSIFICATION, REGRESSION, LearnerParams


@dataclass(frozen=True)
class FitContext:
    """What an estimator may need to know about the data and the run."""

    params: LearnerParams
    features: int
    classes: int
    seed: int


@dataclass(frozen=True)
class Learner:
    """``categories`` is set for tree learners: the most values a categorical feature may have. ``weighs``: rows may have weights."""

    name: str
    task: str
    estimator: Callable[[FitContext], Estimator]
    categories: Callable[[LearnerParams], int] | None = None
    most_classes: int | None = None
    weighs: bool = True

    @property
    def on_indexed(self) -> bool:
        return self.categories is not None

    @property
    def relabels(self) -> bool:
        return self.on_indexed and self.task == CLASSIFICATION


def _perceptron(c: FitContext) -> Estimator:
    return MultilayerPerceptronClassifier(
        layers=[c.features, *c.params.mlp_hidden_layers, c.classes],
        blockSize=c.params.mlp_block_size,
        seed=c.params.mlp_seed,
        maxIter=c.params.mlp_max_iter,
    )


def _logistic(c: FitContext) -> Estimator:
    return LogisticRegression(
        maxIter=c.params.logistic_max_iter,
        regParam=c.params.logistic_reg_param,
        elasticNetParam=c.params.logistic_elastic_net,
    )


_ALL = (
    Learner(
        "SVM",
        CLASSIFICATION,
        lambda c: LinearSVC(maxIter=c.params.svm_max_iter, regParam=c.params.svm_reg_param),
        most_classes=2,
    ),
    Learner("MPC", CLASSIFICATION, _perceptron, weighs=False),
    Learner("LogisticRegression", CLASSIFICATION, _logistic),
    Learner("NaiveBayes", CLASSIFICATION, lambda c: NaiveBayes()),
    Learner(
        "DecisionTree",
        CLASSIFICATION,
        lambda c: DecisionTreeClassifier(seed=c.seed),
        categories=lambda p: p.tree_max_categories,
    ),
    Learner(
        "RandomForest",
        CLASSIFICATION,
        lambda c: RandomForestClassifier(numTrees=c.params.forest_class_trees, seed=c.seed),
        categories=lambda p: p.forest_max_categories,
    ),
    Learner(
        "DecisionTree",
        REGRESSION,
        lambda c: DecisionTreeRegressor(seed=c.seed),
        categories=lambda p: p.tree_max_categories,
    ),
    Learner(
        "RandomForest",
        REGRESSION,
        lambda c: RandomForestRegressor(numTrees=c.params.forest_value_trees, seed=c.seed),
        categories=lambda p: p.forest_max_categories,
    ),
    Learner(
        "GBT",
        REGRESSION,
        lambda c: GBTRegressor(maxIter=c.params.boost_rounds, maxDepth=c.params.boost_depth, seed=c.seed),
        categories=lambda p: p.boost_max_categories,
    ),
    Learner("Isotonic", REGRESSION, lambda c: IsotonicRegression()),
)

LEARNERS = {(learner.name, learner.task): learner for learner in _ALL}


def find_learner(name: str, task: str) -> Learner:
    if (name, task) in LEARNERS:
        return LEARNERS[name, task]
    other = [t for n, t in LEARNERS if n == name]
    if other:
        raise ValueError(f"{name} is a learner for {other[0]}, not for {task}")
    raise ValueError(f"unknown method {name!r}; known for {task}: {sorted(n for n, t in LEARNERS if t == task)}")
