import pytest
from pyspark.sql import functions as F

from manyvote import BaggingConfig, Workspace, run_folds, run_kfold
from manyvote.operators import parts, prepare
from manyvote.operators.layout import PART


def mixed_rows(spark, n=600):
    """Numeric and nominal features, some values in one part only, a class of either kind."""
    return spark.range(n).select(
        "id",
        (F.col("id") % 97).cast("double").alias("x"),
        F.concat(F.lit("s"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.col("id") % 7)).alias("shade"),
        (F.xxhash64("id") % 1000 / 1000.0).alias("y"),
        (F.col("id") % 3 - 1).alias("sign"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
    )


def pairs_of(df, folds, seed):
    numbered = df.withColumn("row_id", F.col("id")).withColumn("_part", parts.part_number(folds, seed)).drop("row_id")
    return [(numbered.filter(F.col("_part") != i).drop("_part"), numbered.filter(F.col("_part") == i).drop("_part")) for i in range(folds)]


@pytest.mark.parametrize("task, label, methods", [
    ("classification", "kind", ("NaiveBayes", "DecisionTree")),
    ("classification", "sign", ("NaiveBayes", "LogisticRegression")),
    ("regression", "y", ("Isotonic", "DecisionTree")),
])
def test_kfold_equals_run_folds_on_the_pairs(spark, task, label, methods):
    df = mixed_rows(spark).select("id", "x", "shade", *({"y", label} if task == "classification" else {label}))
    config = BaggingConfig(task, methods, members=2, seed=3, key="id", label=label, layout_partitions=2)
    ours, theirs = run_kfold(df, config, 3), run_folds(pairs_of(df, 3, 3), config)

    def rows(result):
        return {(r["fold"], r["row_id"]): (r["label"], *r["preds"]) for r in result.member_predictions.collect()}

    got, expected = rows(ours), rows(theirs)
    assert set(got) == set(expected) and len(got) == df.dropDuplicates(df.columns[1:]).count()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    metrics = [{(r["fold"], r["member"], r["metric"]): r["value"] for r in x.metrics.collect()} for x in (ours, theirs)]
    assert metrics[0] == pytest.approx(metrics[1])


def test_copies_never_stand_on_both_sides(spark):
    df = spark.range(400).select("id", (F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 40 % 2).alias("kind"))
    config = BaggingConfig("classification", ("DecisionTree",), members=1, seed=3, key="id", label="kind")
    found = run_kfold(df, config, 4).predictions
    assert found.count() == 40 == found.select("row_id").distinct().count()


def test_the_table_is_prepared_once(spark, monkeypatch):
    calls, saved = [], []
    real, save = prepare.wide_rows, Workspace.save
    monkeypatch.setattr(prepare, "wide_rows", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    df = mixed_rows(spark).drop("sign")
    config = BaggingConfig("classification", ("NaiveBayes",), members=2, key="id")
    result = run_kfold(df, config, 3)
    assert calls == [1] and saved.count("distinct") == 1 and saved.count("part_counts") == 1
    assert "prepared" not in saved and result.timings.filter("fold = 0").first()["phase"] == "table"


def test_parts_cover_the_table_evenly(spark):
    counts = spark.range(9000).select(F.col("id").alias("row_id")).groupBy(parts.part_number(3, 1).alias(PART)).count().collect()
    assert sorted(r[PART] for r in counts) == [0, 1, 2] and all(2700 < r["count"] < 3300 for r in counts)


def test_wrong_settings_are_refused(spark):
    df = mixed_rows(spark, 4).select("id", "x", "kind")
    config = BaggingConfig("classification", ("NaiveBayes",), members=1, key="id")
    with pytest.raises(ValueError, match="at least two folds"):
        run_kfold(df, config, 1)
    with pytest.raises(ValueError, match="use fewer folds"):
        run_kfold(df, config, 40)
    with pytest.raises(ValueError, match="fit_scope"):
        run_kfold(df, BaggingConfig("classification", ("NaiveBayes",), members=1, key="id", fit_scope="all"), 2)
