import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from manyvote.operators.combine import combine, gather_members, mean_long, to_long, vote_long
from manyvote.operators.metrics import array_metrics, class_metrics, member_metrics, value_metrics, value_metrics_of_arrays

PREDS = "row_id long, label double, preds array<double>"


@pytest.fixture(scope="module")
def votes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 4), [float(x) for x in rng.integers(0, 4, 7)]) for i in range(200)]
    rows += [(200, 0.0, [1.0, 0.0, 1.0, 0.0]), (201, 0.0, [3.0, 2.0, 1.0]), (202, 1.0, [0.0]), (203, 2.0, [2.0, 2.0])]
    return spark.createDataFrame(rows, PREDS).cache()


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal()), [float(x) for x in rng.normal(size=5)]) for i in range(200)]
    return spark.createDataFrame(rows, PREDS).cache()


def test_vote_equals_bincount_and_ties_go_to_the_smallest_class(votes):
    got = {r["row_id"]: r["baggingPrediction"] for r in combine(votes, "classification").collect()}
    for r in votes.collect():
        assert got[r["row_id"]] == np.bincount(np.array(r["preds"], dtype=int)).argmax()
    assert got[200] == 0.0 and got[201] == 1.0


def test_long_vote_equals_wide_vote(votes):
    wide = sorted(map(tuple, combine(votes, "classification").collect()))
    assert sorted(map(tuple, vote_long(to_long(votes)).collect())) == wide


def test_means(values):
    wide = {r["row_id"]: r["baggingPrediction"] for r in combine(values, "regression").collect()}
    long = {r["row_id"]: r["baggingPrediction"] for r in mean_long(to_long(values)).collect()}
    for r in values.collect():
        assert wide[r["row_id"]] == pytest.approx(np.mean(r["preds"]), abs=1e-12)
        assert long[r["row_id"]] == pytest.approx(np.mean(r["preds"]), abs=1e-12)


def test_gathered_members_equal_the_array(votes, spark):
    seven = votes.filter(F.size("preds") == 7)
    frames = [seven.select("row_id", "label", F.col("preds")[i].alias("prediction")) for i in range(7)]
    assert sorted(map(tuple, gather_members(frames).collect())) == sorted(map(tuple, seven.collect()))
    frames[3] = frames[3].filter("row_id <> 5")
    assert gather_members(frames).count() == seven.count() - 1


def test_class_metrics_equal_the_evaluator(votes):
    long = to_long(votes.filter(F.size("preds") == 7)).withColumn(
        "prediction", F.when(F.col("member") == 2, 1.0).otherwise(F.col("prediction"))
    )
    got = {r["member"]: r for r in class_metrics(long).collect()}
    assert sorted(got) == list(range(7))
    for member in (0, 2, 6):
        one = long.filter(F.col("member") == member)
        for name in ("accuracy", "weightedPrecision"):
            expected = MulticlassClassificationEvaluator(metricName=name).evaluate(one)
            assert got[member][name] == pytest.approx(expected, abs=1e-12)


def test_value_metrics_equal_the_evaluator(values):
    long = to_long(values)
    got = {r["member"]: r for r in value_metrics(long).collect()}
    for member in (0, 4):
        one = long.filter(F.col("member") == member)
        for name in ("rmse", "mse", "r2", "mae"):
            assert got[member][name] == pytest.approx(RegressionEvaluator(metricName=name).evaluate(one), rel=1e-9)


def test_metrics_of_arrays_equal_those_of_rows(values, votes):
    for preds, task, names in ((values, "regression", ("rmse", "mse", "r2", "mae")), (votes, "classification", ("accuracy", "weightedPrecision"))):
        wanted = {(r["member"], r["metric"]): r["value"] for r in member_metrics(to_long(preds), task).collect()}
        got = {(r["member"], r["metric"]): r["value"] for r in array_metrics(preds, task).collect()}
        assert got.keys() == wanted.keys() and {n for _, n in got} == set(names)
        assert all(got[k] == pytest.approx(wanted[k], rel=1e-9) for k in got)
    shifted = array_metrics(values, "regression", -1).agg(F.min("member")).first()[0]
    assert shifted == -1


def test_array_metrics_make_no_row_per_member(values):
    text = value_metrics_of_arrays(values)._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate posexplode") < text.index("ObjectHashAggregate") and text.count("Generate") == 1


def test_array_metrics_of_no_rows_and_one_label(values, spark):
    assert value_metrics_of_arrays(values.limit(0)).collect() == []
    one = spark.createDataFrame([(2.0, [1.0, 2.0]), (2.0, [3.0, 2.0])], "label double, preds array<double>")
    got = {r["member"]: r for r in value_metrics_of_arrays(one).collect()}
    assert (got[0]["mse"], got[1]["mse"], got[0]["r2"]) == (1.0, 0.0, None)


def test_metrics_of_constant_labels_do_not_fail(spark):
    long = spark.createDataFrame([(0, 2.0, 1.0), (0, 2.0, 3.0)], "member int, label double, prediction double")
    got = {r["metric"]: r["value"] for r in member_metrics(long, "regression").collect()}
    assert got["mse"] == 1.0 and got["r2"] is None
