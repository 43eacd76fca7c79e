"""Typed settings of an ensemble run."""

from __future__ import annotations

from dataclasses import dataclass, field

CLASSIFICATION = "classification"
REGRESSION = "regression"
TASKS = (CLASSIFICATION, REGRESSION)
HANDLE_INVALID = ("error", "skip")
FIT_SCOPES = ("train", "all")


@dataclass(frozen=True)
class LearnerParams:
    """Settings of the base learners."""

    # The learner settings every run starts from.
    svm_max_iter: int = 10
    svm_reg_param: float = 0.1
    mlp_hidden_layers: tuple[int, ...] = (5, 4)
    mlp_block_size: int = 128
    mlp_seed: int = 1234
    mlp_max_iter: int = 100
    logistic_max_iter: int = 10
    logistic_reg_param: float = 0.3
    logistic_elastic_net: float = 0.8
    tree_max_categories: int = 4
    forest_max_categories: int = 4
    forest_class_trees: int = 10
    forest_value_trees: int = 20
    boost_max_categories: int = 4
    boost_rounds: int = 10
    boost_depth: int = 5


@dataclass(frozen=True)
class BaggingConfig:
    """One ensemble run: which learners, how many members, which rows each one sees.

    ``layout_partitions`` lays the training rows out by key in that many partitions before the fits: tree learners
    sample rows for their split candidates per partition, so with it they repeat on any cluster and input layout.
    ``replacement`` draws a member's rows with replacement: a row counts as often as it was drawn.
    ``member_folder``: where fitted members are kept; a run with the same settings and rows reads those that lie there.
    """

    task: str
    methods: tuple[str, ...]
    members: int = 50
    subset_fraction: float = 0.6
    replacement: bool = False
    split_weights: tuple[float, float] = (0.7, 0.3)
    seed: int = 7
    label: str | None = None
    key: str | None = None
    handle_invalid: str = "error"
    fit_scope: str = "train"
    input_partitions: int | None = None
    parallelism: int = 4
    cache_train: bool = True
    layout_partitions: int | None = None
    members_per_pass: int = 25
    member_folder: str | None = None
    learners: LearnerParams = field(default_factory=LearnerParams)

    def __post_init__(self):
        object.__setattr__(self, "methods", tuple(self.methods))
        if self.task not in TASKS:
            raise ValueError(f"task must be one of {TASKS}, got {self.task!r}")
        if self.handle_invalid not in HANDLE_INVALID:
            raise ValueError(f"handle_invalid must be one of {HANDLE_INVALID}, got {self.handle_invalid!r}")
        if self.fit_scope not in FIT_SCOPES:
            raise ValueError(f"fit_scope must be one of {FIT_SCOPES}, got {self.fit_scope!r}")
        if not self.methods:
            raise ValueError("name at least one method")
        if self.members < len(self.methods):
            raise ValueError(f"{self.members} members cannot cover {len(self.methods)} methods")
        if not 0 < self.subset_fraction <= 1:
            raise ValueError(f"subset_fraction must lie in (0, 1], got {self.subset_fraction}")
        if len(self.split_weights) != 2 or min(self.split_weights) < 0 or sum(self.split_weights) <= 0:
            raise ValueError(f"split_weights must be two shares, got {self.split_weights}")
        if self.layout_partitions is not None and self.layout_partitions < 1:
            raise ValueError("layout_partitions must be at least 1")
        if self.parallelism < 1 or self.members_per_pass < 1:
            raise ValueError("parallelism and members_per_pass must be at least 1")
