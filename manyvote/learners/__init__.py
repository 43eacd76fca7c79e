"""The base learners by name."""

from manyvote.learners.registry import LEARNERS, Learner, find_learner

__all__ = ["LEARNERS", "Learner", "find_learner"]
