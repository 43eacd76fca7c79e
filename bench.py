"""Seconds per headline query on ``local[$BENCH_CPUS]``; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_MEMBERS`` the ensemble sizes. ``BENCH_PLAIN`` lists
the sizes also run the plain way, for comparison: nothing saved or cached, bags by a random sort
with a limit, members fitted one after another and joined on their feature vectors. Those seconds
are reported apart and are not part of the value.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import reduce

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvote import BaggingConfig, LearnerParams, run_split
from manyvote.config import CLASSIFICATION
from manyvote.learners import find_learner
from manyvote.learners.registry import FitContext
from manyvote.operators.allocate import allocate_members
from manyvote.operators.tree_stages import categorical_features
from manyvote.plans import tasks
from manyvote.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MEMBERS = [int(m) for m in os.environ.get("BENCH_MEMBERS", "10,50").split(",") if m]
PLAIN = [int(m) for m in os.environ.get("BENCH_PLAIN", "10").split(",") if m]
METHODS = ("NaiveBayes", "LogisticRegression", "MPC", "DecisionTree", "RandomForest")
OPERATORS = (
    "csv_scan",
    "nominal_index",
    "minmax_scale",
    "dedupe_features",
    "prepared_dataset",
    "bag_exact",
    "bag_bucketed",
    "vote_wide",
    "vote_by_group",
    "classifier_report",
    "regressor_report",
    "vector_index_categories",
    "bagged_tree_vote",
    "bagging_regression",
    "bagged_isotonic_mean",
    "bagged_nb_vote",
    "fold_runs",
)


def new_session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensemble(spark: SparkSession, members: int) -> dict[str, float]:
    """One run over the lines; seconds per phase and in all."""
    config = BaggingConfig(CLASSIFICATION, METHODS, members=members, label="l_returnflag", key="line_id")
    start = time.perf_counter()
    result = run_split(tasks.flag_class(spark, SF_DIR), config)
    result.metrics.collect()
    seconds = {"total": time.perf_counter() - start}
    return seconds | {r["phase"]: r["seconds"] for r in result.timings.collect()}


def plain_ensemble(spark: SparkSession, members: int) -> float:
    """The same ensemble without any of the measures this library takes."""
    start = time.perf_counter()
    lines = tasks.flag_class(spark, SF_DIR).drop("line_id")
    names = lines.columns[:-1]
    indexed = StringIndexer(inputCol=lines.columns[-1], outputCol="label").fit(lines).transform(lines)
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(indexed)
    scaled = MinMaxScaler(inputCol="raw", outputCol="features").fit(vectors).transform(vectors)
    data = scaled.select("features", "label").dropDuplicates(["features"])
    train, test = data.randomSplit([0.7, 0.3], seed=7)
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    context = FitContext(LearnerParams(), len(names), classes, 7)
    size = int(0.6 * train.count())
    indexer = categorical_features(data, 4, "features", "indexed")
    scored: list[DataFrame] = []
    for i, name in enumerate(allocate_members(members, METHODS)):
        learner = find_learner(name, CLASSIFICATION)
        bag = train.orderBy(F.rand(i)).limit(size).orderBy("label")
        answers, estimator = test, learner.estimator(context)
        if learner.on_indexed:
            bag, answers = indexer.transform(bag), indexer.transform(test)
            estimator.set(estimator.getParam("featuresCol"), "indexed")
        out = estimator.fit(bag).transform(answers).select("features", "label", "prediction")
        report(out, "prediction")
        scored.append(out.withColumnRenamed("prediction", f"p{i}"))
    joined = reduce(lambda a, b: a.join(b.drop("label"), "features"), scored)
    votes = F.array(*[f"p{i}" for i in range(members)])
    counts = F.array(*[F.size(F.filter(votes, lambda v: v == F.lit(float(c)))) for c in range(classes)])
    first = F.array_position(counts, F.array_max(counts)) - 1
    report(joined.select("label", first.cast("double").alias("vote")), "vote")
    return time.perf_counter() - start


def report(df: DataFrame, column: str) -> None:
    for metric in ("accuracy", "weightedPrecision"):
        MulticlassClassificationEvaluator(predictionCol=column, metricName=metric).evaluate(df)


def main() -> None:
    spark = new_session()
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    seconds, phases = {}, {}
    for name in OPERATORS:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - start
        print(f"{name}: {seconds[name]:.1f} s", file=sys.stderr)
    for members in MEMBERS:
        run = ensemble(spark, members)
        seconds[f"ensemble_{members}_members"] = run.pop("total")
        phases[f"ensemble_{members}_members"] = {k: round(v, 2) for k, v in run.items()}
        print(f"ensemble of {members}: {phases}", file=sys.stderr)
    plain = {}
    for members in PLAIN:
        plain[f"ensemble_{members}_members"] = round(plain_ensemble(spark, members), 2)
        print(f"plain: {plain}", file=sys.stderr)
    out = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 2),
        "unit": "sec",
        "queries": {k: round(v, 2) for k, v in seconds.items()},
        "phases": phases,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
    }
    print(json.dumps(out | ({"plain": plain} if plain else {})))
    spark.stop()


if __name__ == "__main__":
    main()
