"""Fitted members on shared storage, so that a run that broke off fits only those it had not come to."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvote.config import LearnerParams
from manyvote.learners.registry import Learner
from manyvote.operators.bags import BagPlan
from manyvote.operators.layout import LABEL, ROW_ID
from manyvote.operators.prepare import FEATURES
from manyvote.operators.profile import Profile
from manyvote.operators.repeats import RepeatPlan

_DONE = "_MEMBER"


def table_print(rows: DataFrame) -> str:
    """A digest of a prepared table's rows, whatever their order and partitions."""
    row = F.xxhash64(ROW_ID, FEATURES, LABEL)
    found = rows.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    return ":".join(map(str, found))


@dataclass(frozen=True)
class MemberStore:
    """Models below ``folder``, each in a folder named by its place in the run and a digest of all that it was fitted from:
    learner and its settings, seed, bag, classes, number of features, and the training rows.

    A member counts once its mark is written, which follows its model; a folder without the mark is written anew.
    """

    spark: SparkSession
    folder: str
    settings: str

    @staticmethod
    def of(
        spark: SparkSession, folder: str, rows: DataFrame, plan: BagPlan | RepeatPlan, params: LearnerParams, size: Profile, seed: int, layout: int | None
    ) -> MemberStore:
        settings = [table_print(rows), asdict(params), size.features, size.classes, seed, layout, asdict(plan)]
        return MemberStore(spark, folder.rstrip("/"), json.dumps(settings, sort_keys=True, default=str))

    def path(self, index: int, learner: Learner, classes: list[float] | None) -> str:
        told = json.dumps([self.settings, index, learner.name, learner.task, classes])
        return f"{self.folder}/member-{index}-{hashlib.sha256(told.encode()).hexdigest()[:24]}"

    def fetch(self, index: int, learner: Learner, classes: list[float] | None, fit: Callable[[], Model]) -> Model:
        """The member's model as it lies in the store, or else fitted and put there."""
        path = self.path(index, learner, classes)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_DONE}")
        system = mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if system.exists(mark):
            return DefaultParamsReader.loadParamsInstance(f"{path}/model", self.spark)
        model = fit()
        model.write().overwrite().save(f"{path}/model")
        system.create(mark, True).close()
        return model
