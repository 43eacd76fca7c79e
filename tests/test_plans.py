"""The shape of the plans: what must not shuffle, what must not be broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from manyvote.operators.bags import draw_bags, marked_in
from manyvote.operators.combine import combine, gather_members, to_long, vote_long
from manyvote.operators.dedupe import distinct_features, distinct_wide
from manyvote.operators.encode import build_dictionary, encode_columns, value_counts
from manyvote.operators.layout import feature_runs, inspect_layout, wide_rows
from manyvote.operators.metrics import class_metrics
from manyvote.operators.split import hash_split
from manyvote.plans import tasks

PREDS = "row_id long, label double, preds array<double>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def ids(spark, workspace):
    return workspace.save(spark.range(100).select(F.col("id").alias("row_id")), "ids")


@pytest.fixture()
def preds(spark, workspace):
    return workspace.save(spark.createDataFrame([(1, 0.0, [0.0, 1.0])], PREDS), "preds")


def test_splits_and_bags_do_not_shuffle(ids):
    plan = draw_bags(ids, 6, 0.5, 1)
    marked = plan.mark(ids)
    for df in (*hash_split(ids, (0.7, 0.3), 1), marked, marked.filter(marked_in(5)), plan.members(ids), plan.bag(ids, 2)):
        assert "Exchange" not in plan_of(df) and "Join" not in plan_of(df)


def test_wide_vote_and_mean_do_not_shuffle(preds):
    for task in ("classification", "regression"):
        assert "Exchange" not in plan_of(combine(preds, task))


def test_long_forms_shuffle_once(preds):
    one = preds.select("row_id", "label", F.col("preds")[0].alias("prediction"))
    for df in (vote_long(to_long(preds)), gather_members([one, one])):
        assert plan_of(df).count("Exchange hashpartitioning") == 1


def test_metrics_count_before_they_shuffle(preds):
    text = plan_of(class_metrics(to_long(preds)))
    first = text[: text.rindex("Exchange hashpartitioning")]
    assert text.index("posexplode") > len(first) and "partial_count" in text[len(first) :]


def test_dedupe_combines_before_its_only_shuffle(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.0)], "row_id long, x double, label double")
    text = plan_of(distinct_features(rows, ["x"]))
    assert text.count("Exchange") == 1 and "partial_min" in text[text.index("Exchange") :]


def without_broadcasts(spark, build, **settings):
    """What ``build()`` makes while Spark broadcasts only what it is told to."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"} | settings
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return build()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("columns", [2, 12])
def test_rare_values_of_all_columns_share_one_shuffle(spark, workspace, columns):
    names = [f"v{i}" for i in range(columns)]
    df = spark.range(300).select("id", *[F.concat(F.lit("v"), (F.col("id") + i) % 50).alias(n) for i, n in enumerate(names)])
    dictionary = build_dictionary(value_counts(df, names), workspace, head_rows=10)
    coded = without_broadcasts(spark, lambda: plan_of(encode_columns(df, {n: n for n in names}, dictionary, "id")))
    # Digests meet the entries, the answers are gathered by row and meet their rows.
    assert coded.count("SortMergeJoin") == 2 and coded.count("Exchange hashpartitioning(id") == 1
    everything = build_dictionary(value_counts(df, names), workspace)
    assert "SortMergeJoin" not in plan_of(encode_columns(df, {n: n for n in names}, everything, "id"))


def test_dedupe_sorts_by_a_digest_first(spark, workspace):
    df = spark.range(5).select("id", (F.col("id") * 1.0).alias("x"), F.concat(F.lit("s"), "id").alias("s"), F.lit(1.0).alias("y"))
    layout = inspect_layout(df.schema, key="id")
    rows = wide_rows(df.withColumn("id", F.col("id").cast("string")), layout)
    text = plan_of(distinct_wide(rows, layout.nominal, feature_runs(layout)))
    sorts = re.findall(r"Sort \[([a-z_]+)#", text)
    assert sorts and set(sorts) == {"_digest"}


def test_scan_reads_only_the_columns_of_the_task(spark, sf_dir):
    text = plan_of(tasks.flag_class(spark, sf_dir))
    assert "l_shipdate" not in text and "l_suppkey" not in text


def test_grouping_keys_do_not_grow_with_the_numeric_features(spark, workspace):
    def keys(n):
        df = spark.range(5).select("id", *[(F.col("id") + i).cast("double").alias(f"x{i}") for i in range(n)], F.lit("s").alias("s"), F.lit(1.0).alias("y"))
        layout = inspect_layout(df.schema, key="id")
        text = plan_of(distinct_wide(wide_rows(df, layout), layout.nominal, feature_runs(layout)))
        found = re.search(r"Exchange hashpartitioning\(([^)]*)\)", text)
        return found[1].count("#")

    assert keys(3) == keys(60) == 3


def skewed(spark, hot):
    value = F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.concat(F.lit("v"), F.col("id") % 400))
    return spark.range(4000).select("id", value.alias("v"))


@pytest.mark.parametrize("case", ["unseen", "too long"])
def test_a_hot_value_outside_the_broadcasts_is_not_shuffled(spark, workspace, case):
    """Half of the rows hold one value that the dictionary lacks, or a very long one."""
    hot = "unseen" if case == "unseen" else "x" * 2000
    train = skewed(spark, "other" if case == "unseen" else hot)
    dictionary = build_dictionary(value_counts(train, ["v"]), workspace, head_rows=10)
    coded = without_broadcasts(spark, lambda: encode_columns(skewed(spark, hot), {"v": "code"}, dictionary, "id"))
    codes = {r["id"]: r["code"] for r in coded.collect()}
    expected = 201.0 if case == "unseen" else 0.0
    assert len(codes) == 4000 and {codes[i] for i in range(0, 4000, 2)} == {expected}
    assert all(codes[i] != expected for i in range(1, 4000, 2))
    shuffled = [n for n in counted_rows(coded, "SortMergeJoin") if n >= 1990]
    assert not shuffled


def counted_rows(df, node):
    """Rows that came out of the plan nodes of a name, after the rows were read."""
    plan = df._jdf.queryExecution().executedPlan()
    found, rest = [], [plan]
    while rest:
        at = rest.pop()
        if at.nodeName().startswith(node):
            metric = at.metrics().get("numOutputRows")
            found.append(metric.get().value() if metric.isDefined() else 0)
        children = at.children()
        rest += [children.apply(i) for i in range(children.size())]
    return found
