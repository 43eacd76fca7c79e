"""Whole runs: one table split at random, or train/test pairs."""

from manyvote.plans.bagging import BaggingResult, run_bagging, run_fold_paths, run_folds, run_kfold, run_split

__all__ = ["BaggingResult", "run_bagging", "run_fold_paths", "run_folds", "run_kfold", "run_split"]
