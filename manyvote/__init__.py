"""Bagging ensembles of Spark ML learners over tables of any size."""

from manyvote.config import CLASSIFICATION, REGRESSION, BaggingConfig, LearnerParams
from manyvote.plans.bagging import BaggingResult, run_bagging, run_fold_paths, run_folds, run_kfold, run_split
from manyvote.workspace import Workspace

__all__ = [
    "CLASSIFICATION",
    "REGRESSION",
    "BaggingConfig",
    "BaggingResult",
    "LearnerParams",
    "Workspace",
    "run_bagging",
    "run_fold_paths",
    "run_folds",
    "run_kfold",
    "run_split",
]
