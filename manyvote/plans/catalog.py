"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvote.config import CLASSIFICATION, REGRESSION, BaggingConfig, LearnerParams
from manyvote.operators.allocate import allocate_members
from manyvote.operators.bags import approximate_bags, bag_by_label, draw_bags
from manyvote.operators.combine import combine, gather_members, mean_long, to_long, vote_long
from manyvote.operators.dedupe import distinct_features
from manyvote.operators.encode import build_dictionary, encode_columns, value_counts
from manyvote.operators.layout import LABEL, ROW_ID, inspect_layout, typed_rows, wide_rows, with_vector_sizes
from manyvote.operators.metrics import array_metrics, class_metrics, value_metrics_of_arrays
from manyvote.operators.prepare import (
    FEATURES,
    assemble,
    fit_encoding,
    load_distinct,
    negative_test,
    prepare,
)
from manyvote.operators.profile import profile_query
from manyvote.operators.repeats import draw_repeats
from manyvote.operators.scale import column_ranges, scaled
from manyvote.operators.split import hash_split, split_filters
from manyvote.operators.tree_stages import (
    INDEXED_LABEL,
    categorical_features,
    class_order,
    original_label,
    with_indexed_label,
)
from manyvote.plans import tasks
from manyvote.plans.bagging import BaggingResult, run_bagging, run_fold_paths, run_folds, run_kfold, run_split
from manyvote.sources.sinks import read_predictions, write_predictions
from manyvote.sources.tabular import fold_pairs, read_table
from manyvote.workspace import Workspace

SEED = 7
SPLIT = (0.7, 0.3)
FRACTION = 0.6
DIGITS = 6
MIXED_BAGS = 4
BOOST_ROUNDS, BOOST_DEPTH = 6, 2

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded_error(column: str) -> Column:
    """Six digits for r2, three for errors: sums in the millions are not exact beyond that."""
    return F.when(F.col("metric") == "r2", F.round(column, DIGITS)).otherwise(F.round(column, 3)).alias(column)


def exploded(df: DataFrame, *keys: str, digits: int = 9) -> DataFrame:
    """One row per vector element."""
    return df.select(
        *keys, F.posexplode(vector_to_array(FEATURES)).alias("position", "value")
    ).withColumn("value", F.round("value", digits))


# Sources, layout, preparation


@query
def csv_scan(spark, sf_dir):
    target = Workspace(spark).path("csv")
    tasks.table(spark, sf_dir, "part").write.csv(target)
    return read_table(spark, target)


@query
def input_repartition(spark, sf_dir):
    rows = read_table(spark, f"{sf_dir}/orders.parquet", fmt="parquet", partitions=16)
    return rows.select("o_orderkey", F.spark_partition_id().alias("p")).agg(
        F.count_distinct("p").alias("n_partitions"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("o_orderkey").alias("key_sum"),
    )


@query
def schema_inspection(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "customer")
    layout = inspect_layout(df.schema, key="c_custkey")
    cells = []
    for position, name in enumerate(df.columns):
        role = "key" if name == layout.key else "label" if name == layout.label else "feature"
        nominal = name in layout.nominal or (role == "label" and layout.label_is_nominal)
        cells.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(role).alias("column_role"),
                F.lit(nominal).alias("is_nominal"),
                F.col(f"n{position}").alias("n_values"),
            )
        )
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.inline(F.array(*cells)))


@query
def nominal_index(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    names = ["p_name", "p_brand", "p_type"]
    dictionary = build_dictionary(value_counts(df, names), Workspace(spark))
    return encode_columns(df, {name: name for name in names}, dictionary, "p_partkey")


@query
def label_index(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "lineitem").select(tasks.line_key().alias(ROW_ID), "l_returnflag")
    dictionary = build_dictionary(value_counts(df, ["l_returnflag"]), Workspace(spark))
    return encode_columns(df, {"l_returnflag": LABEL}, dictionary, ROW_ID)


@query
def numeric_label(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return typed_rows(df, inspect_layout(df.schema, label="p_size", key="p_partkey"))


@query
def negative_label_test(spark, sf_dir):
    df = tasks.cust_sign(spark, sf_dir)
    return negative_test(typed_rows(df, inspect_layout(df.schema, key="c_custkey")))


@query
def negative_label_reindex(spark, sf_dir):
    df = tasks.cust_sign(spark, sf_dir)
    layout = inspect_layout(df.schema, key="c_custkey")
    rows = wide_rows(df, layout)
    unique = rows.withColumn("copies", F.lit(1).cast("bigint"))
    encoding = fit_encoding(unique, layout, CLASSIFICATION, Workspace(spark), label_rows=rows)
    return encoding.coded(rows).select(ROW_ID, LABEL)


@query
def cast_features(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.to_date("ts").alias("day"),
        (F.col("user_id") % 2 == 0).alias("even_user"),
        "user_id",
        "value",
    )
    rows = typed_rows(df, inspect_layout(df.schema, key="event_id"))
    return rows.withColumn("ts", F.round("ts", DIGITS))


@query
def assemble_features(spark, sf_dir):
    df = tasks.flag_class(spark, sf_dir)
    layout = inspect_layout(df.schema, key="line_id")
    return exploded(assemble(typed_rows(df, layout), layout.features), ROW_ID)


@query
def minmax_scale(spark, sf_dir):
    df = tasks.flag_class(spark, sf_dir)
    layout = inspect_layout(df.schema, key="line_id")
    ranges = column_ranges(df, layout.features)
    return df.select(
        F.col("line_id").alias(ROW_ID),
        *[F.round(scaled(F.col(c), ranges[c]), 9).alias(c) for c in layout.features],
    )


@query
def dedupe_features(spark, sf_dir):
    df = tasks.cust_sign(spark, sf_dir)
    layout = inspect_layout(df.schema, key="c_custkey")
    return distinct_features(typed_rows(df, layout), layout.features)


@query
def dedupe_without_key(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "part").select("p_brand", "p_type", "p_retailprice")
    layout = inspect_layout(df.schema)
    return distinct_features(typed_rows(df, layout), layout.features)


@query
def prepared_dataset(spark, sf_dir):
    df, _ = prepare(tasks.part_price(spark, sf_dir), REGRESSION, Workspace(spark), key="part_id")
    return exploded(df, ROW_ID, LABEL)


@query
def doc_quality_features(spark, sf_dir):
    ratios = ("nonletter_ratio", "digit_ratio", "distinct_word_ratio")
    df = tasks.doc_quality(spark, sf_dir)
    return df.select(*[F.round(c, 9).alias(c) if c in ratios else F.col(c) for c in df.columns])


# Split, sample, allocate


@query
def hash_split_orders(spark, sf_dir):
    orders = tasks.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW_ID))
    train, test = hash_split(orders, SPLIT, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def bag_exact(spark, sf_dir):
    orders = tasks.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW_ID))
    return draw_bags(orders, 3, FRACTION, SEED).members(orders)


@query
def bag_bucketed(spark, sf_dir):
    lines = tasks.table(spark, sf_dir, "lineitem").select(tasks.line_key().alias(ROW_ID))
    return draw_bags(lines, 3, FRACTION, SEED).members(lines)


@query
def bag_with_replacement(spark, sf_dir):
    orders = tasks.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW_ID))
    return draw_repeats(orders, 3, FRACTION, SEED).members(orders)


@query
def bag_approximate(spark, sf_dir):
    orders = tasks.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW_ID))
    return approximate_bags(orders, 3, FRACTION, SEED)


@query
def bag_label_order(spark, sf_dir):
    rows = tasks.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(ROW_ID), F.col("c_nationkey").cast("double").alias(LABEL)
    )
    return bag_by_label(rows, draw_bags(rows.select(ROW_ID), 2, FRACTION, SEED), 1, Workspace(spark))


@query
def member_allocation(spark, sf_dir):
    orders = tasks.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW_ID))
    methods = allocate_members(10, ["NaiveBayes", "DecisionTree", "RandomForest"])
    bags = draw_bags(orders, len(methods), FRACTION, SEED).members(orders)
    return bags.groupBy(F.col("bag").alias("member")).agg(
        F.get(F.array(*map(F.lit, methods)), F.col("bag")).alias("method"), F.count(F.lit(1)).alias("n_rows")
    )


@query
def dataset_profile(spark, sf_dir):
    df = tasks.emb_class(spark, sf_dir)
    layout = with_vector_sizes(df, inspect_layout(df.schema, key="vec_id"))
    return profile_query(wide_rows(df, layout), layout.n_features)


# Combine


@query
def vote_wide(spark, sf_dir):
    return combine(tasks.flag_rules(spark, sf_dir), CLASSIFICATION)


@query
def vote_by_group(spark, sf_dir):
    return vote_long(to_long(tasks.flag_rules(spark, sf_dir)))


@query
def mean_combine(spark, sf_dir):
    return combine(tasks.price_rules(spark, sf_dir), REGRESSION).withColumn(
        "baggingPrediction", F.round("baggingPrediction", DIGITS)
    )


@query
def mean_by_group(spark, sf_dir):
    return mean_long(to_long(tasks.price_rules(spark, sf_dir))).withColumn(
        "baggingPrediction", F.round("baggingPrediction", DIGITS)
    )


@query
def members_join(spark, sf_dir):
    rules = tasks.flag_rules(spark, sf_dir)
    frames = [rules.select(ROW_ID, LABEL, F.col("preds")[i].alias("prediction")) for i in range(5)]
    return to_long(gather_members(frames))


@query
def row_vectorise(spark, sf_dir):
    rules = tasks.price_rules(spark, sf_dir)
    return to_long(rules).withColumn("prediction", F.round("prediction", DIGITS))


# Metrics


@query
def accuracy(spark, sf_dir):
    return class_metrics(to_long(tasks.flag_rules(spark, sf_dir))).select(
        "member", F.round("accuracy", DIGITS).alias("accuracy")
    )


@query
def weighted_precision(spark, sf_dir):
    return class_metrics(to_long(tasks.flag_rules(spark, sf_dir))).select(
        "member", F.round("weightedPrecision", DIGITS).alias("weightedPrecision")
    )


@query
def regression_metrics(spark, sf_dir):
    wide = value_metrics_of_arrays(tasks.price_rules(spark, sf_dir))
    return wide.select("member", *[F.round(c, DIGITS).alias(c) for c in ("rmse", "mse", "r2", "mae")])


@query
def classifier_report(spark, sf_dir):
    rules = tasks.flag_rules(spark, sf_dir)
    report = array_metrics(rules, CLASSIFICATION)
    return report.withColumn("value", F.round("value", DIGITS))


@query
def regressor_report(spark, sf_dir):
    report = array_metrics(tasks.price_rules(spark, sf_dir), REGRESSION)
    return report.withColumn("value", F.round("value", DIGITS))


# Stages of the tree learners


@query
def vector_index_categories(spark, sf_dir):
    df = tasks.table(spark, sf_dir, "lineitem").select(
        tasks.line_key().alias(ROW_ID),
        *[F.col(c).cast("double") for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")],
    )
    vectors = assemble(df, ["l_linenumber", "l_quantity", "l_discount", "l_tax"], "raw")
    indexed = categorical_features(vectors, 10, "raw", FEATURES).transform(vectors)
    return exploded(indexed, ROW_ID)


@query
def label_roundtrip(spark, sf_dir):
    rows = tasks.flag_rules(spark, sf_dir).select(ROW_ID, LABEL)
    classes = class_order(rows)
    indexed = with_indexed_label(rows, classes)
    return indexed.withColumn("restored", original_label(F.col(INDEXED_LABEL), classes))


# Learners: one member on the whole training part


def _single(task: str, method: str, label: str, key: str, df: DataFrame, **settings) -> DataFrame:
    config = BaggingConfig(
        task, (method,), members=1, subset_fraction=1.0, split_weights=SPLIT, seed=SEED, label=label, key=key, **settings
    )
    scored = run_split(df, config).member_predictions
    return scored.select(ROW_ID, LABEL, F.round(F.col("preds")[0], DIGITS).alias("prediction"))


@query
def fit_nb(spark, sf_dir):
    return _single(CLASSIFICATION, "NaiveBayes", "class", "vec_id", tasks.emb_class(spark, sf_dir))


@query
def fit_isotonic(spark, sf_dir):
    return _single(REGRESSION, "Isotonic", "c_acctbal", "cust_id", tasks.cust_balance(spark, sf_dir))


# Where every feature leaves a wide gap between the classes, any working learner answers the label.


def _gap_fit(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return _single(CLASSIFICATION, method, "l_linestatus", "line_id", tasks.line_gap(spark, sf_dir))


def _level_fit(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return _single(REGRESSION, method, "level", "line_id", tasks.line_level(spark, sf_dir))


@query
def fit_svm(spark, sf_dir):
    return _gap_fit(spark, sf_dir, "SVM")


@query
def fit_mlp(spark, sf_dir):
    return _gap_fit(spark, sf_dir, "MPC")


@query
def fit_logreg(spark, sf_dir):
    return _gap_fit(spark, sf_dir, "LogisticRegression")


@query
def fit_dt_cls(spark, sf_dir):
    return _gap_fit(spark, sf_dir, "DecisionTree")


@query
def fit_rf_cls(spark, sf_dir):
    return _gap_fit(spark, sf_dir, "RandomForest")


@query
def fit_dt_reg(spark, sf_dir):
    return _level_fit(spark, sf_dir, "DecisionTree")


@query
def fit_rf_reg(spark, sf_dir):
    return _level_fit(spark, sf_dir, "RandomForest")


@query
def fit_gbt_reg(spark, sf_dir):
    return _level_fit(spark, sf_dir, "GBT")


def document_fit(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """One classifier on document quality."""
    return _single(CLASSIFICATION, method, "quality", "doc_id", tasks.doc_quality(spark, sf_dir))


def embedding_fit(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """One classifier on the embeddings."""
    return _single(CLASSIFICATION, method, "class", "vec_id", tasks.emb_class(spark, sf_dir))


def price_fit(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """One regressor on part prices."""
    return _single(REGRESSION, method, "p_retailprice", "part_id", tasks.part_price(spark, sf_dir))


@query
def fit_dt_cls_few_values(spark, sf_dir):
    return _single(CLASSIFICATION, "DecisionTree", "l_linestatus", "line_id", tasks.line_status(spark, sf_dir))


@query
def fit_dt_reg_few_values(spark, sf_dir):
    return _single(REGRESSION, "DecisionTree", "l_quantity", "line_id", tasks.line_quantity(spark, sf_dir))


@query
def fit_gbt_reg_few_values(spark, sf_dir):
    # Flat trees leave much to the later ones, and no node is so small that two splits divide it alike.
    shallow = LearnerParams(boost_rounds=BOOST_ROUNDS, boost_depth=BOOST_DEPTH)
    return _single(REGRESSION, "GBT", "l_quantity", "line_id", tasks.line_quantity(spark, sf_dir), learners=shallow)


# Whole runs


def document_run(spark: SparkSession, sf_dir: str, members: int = 10) -> BaggingResult:
    """Ten members of five kinds on document quality."""
    config = BaggingConfig(
        CLASSIFICATION,
        ("NaiveBayes", "LogisticRegression", "SVM", "DecisionTree", "RandomForest"),
        members=members,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="quality",
        key="doc_id",
    )
    return run_split(tasks.doc_quality(spark, sf_dir), config)


def tree_run(spark: SparkSession, sf_dir: str) -> BaggingResult:
    """Five decision trees on document quality."""
    config = BaggingConfig(
        CLASSIFICATION,
        ("DecisionTree",),
        members=5,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="quality",
        key="doc_id",
    )
    return run_split(tasks.doc_quality(spark, sf_dir), config)


def price_run(spark: SparkSession, sf_dir: str) -> BaggingResult:
    """Eight members of four kinds on part prices."""
    config = BaggingConfig(
        REGRESSION,
        ("DecisionTree", "RandomForest", "GBT", "Isotonic"),
        members=8,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="p_retailprice",
        key="part_id",
    )
    return run_split(tasks.part_price(spark, sf_dir), config)


MIXED_METHODS = ("NaiveBayes", "LogisticRegression", "SVM", "DecisionTree", "RandomForest")
LEVEL_METHODS = ("DecisionTree", "RandomForest", "GBT", "Isotonic")


def gap_run(spark: SparkSession, sf_dir: str, members: int = 10) -> BaggingResult:
    """Ten classifiers of five kinds on the lines' status."""
    config = BaggingConfig(
        CLASSIFICATION,
        MIXED_METHODS,
        members=members,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="l_linestatus",
        key="line_id",
    )
    return run_split(tasks.line_gap(spark, sf_dir), config)


def level_run(spark: SparkSession, sf_dir: str, members: int = 8) -> BaggingResult:
    """Eight regressors of four kinds on the lines' level."""
    config = BaggingConfig(
        REGRESSION,
        LEVEL_METHODS,
        members=members,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="level",
        key="line_id",
    )
    return run_split(tasks.line_level(spark, sf_dir), config)


@query
def bagged_tree_vote(spark, sf_dir):
    metrics = _line_result(CLASSIFICATION, "l_linestatus", tasks.line_status(spark, sf_dir)).metrics
    return metrics.withColumn("value", F.round("value", DIGITS))


@query
def bagging_classification(spark, sf_dir):
    return gap_run(spark, sf_dir).metrics.withColumn("value", F.round("value", DIGITS))


@query
def bagging_mixed_vote(spark, sf_dir):
    return gap_run(spark, sf_dir).predictions.drop("fold")


@query
def bagging_regression(spark, sf_dir):
    return level_run(spark, sf_dir).metrics.withColumn("value", F.round("value", DIGITS))


def nb_run(spark: SparkSession, sf_dir: str, **settings) -> BaggingResult:
    config = BaggingConfig(
        CLASSIFICATION,
        ("NaiveBayes",),
        members=3,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="class",
        key="vec_id",
        **settings,
    )
    return run_split(tasks.emb_class(spark, sf_dir), config)


@query
def bagged_nb_vote(spark, sf_dir):
    return nb_run(spark, sf_dir).predictions.drop("fold")


@query
def bagged_nb_members(spark, sf_dir):
    return to_long(nb_run(spark, sf_dir).member_predictions)


@query
def bagged_nb_metrics(spark, sf_dir):
    metrics = nb_run(spark, sf_dir).metrics
    return metrics.withColumn("value", F.round("value", DIGITS))


@query
def bagged_nb_with_replacement(spark, sf_dir):
    return to_long(nb_run(spark, sf_dir, replacement=True).member_predictions)


@query
def bagged_nb_fit_on_all(spark, sf_dir):
    return nb_run(spark, sf_dir, fit_scope="all").predictions.drop("fold")


def _line_result(
    task: str, label: str, df: DataFrame, methods: tuple[str, ...] = ("DecisionTree",), members: int = 5
) -> BaggingResult:
    """Five decision trees on the lines, or members of other kinds."""
    config = BaggingConfig(
        task,
        methods,
        members=members,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label=label,
        key="line_id",
    )
    return run_split(df, config)


def line_run(spark: SparkSession, sf_dir: str, task: str, label: str, df: DataFrame) -> DataFrame:
    result = _line_result(task, label, df).predictions.drop("fold")
    return result.withColumn("baggingPrediction", F.round("baggingPrediction", DIGITS))


@query
def bagged_dt_vote(spark, sf_dir):
    return line_run(spark, sf_dir, CLASSIFICATION, "l_linestatus", tasks.line_status(spark, sf_dir))


@query
def bagged_dt_mean(spark, sf_dir):
    return line_run(spark, sf_dir, REGRESSION, "l_quantity", tasks.line_quantity(spark, sf_dir))


# Members of two kinds that disagree: each answers what its own bag taught it.


def bayes_and_trees(spark: SparkSession, sf_dir: str) -> BaggingResult:
    kinds = ("NaiveBayes", "DecisionTree")
    return _line_result(CLASSIFICATION, "l_linestatus", tasks.line_status(spark, sf_dir), kinds, MIXED_BAGS)


@query
def mixed_nb_dt_members(spark, sf_dir):
    return to_long(bayes_and_trees(spark, sf_dir).member_predictions)


@query
def mixed_nb_dt_vote(spark, sf_dir):
    return bayes_and_trees(spark, sf_dir).predictions.drop("fold")


@query
def mixed_nb_dt_metrics(spark, sf_dir):
    return bayes_and_trees(spark, sf_dir).metrics.withColumn("value", F.round("value", DIGITS))


@query
def mixed_dt_isotonic_mean(spark, sf_dir):
    kinds = ("DecisionTree", "Isotonic")
    result = _line_result(REGRESSION, "l_quantity", tasks.line_quantity(spark, sf_dir), kinds, MIXED_BAGS)
    return result.predictions.drop("fold").withColumn("baggingPrediction", F.round("baggingPrediction", DIGITS))


@query
def bagged_isotonic_mean(spark, sf_dir):
    config = BaggingConfig(
        REGRESSION,
        ("Isotonic",),
        members=3,
        subset_fraction=FRACTION,
        split_weights=SPLIT,
        seed=SEED,
        label="c_acctbal",
        key="cust_id",
    )
    result = run_split(tasks.cust_balance(spark, sf_dir), config).predictions.drop("fold")
    return result.withColumn("baggingPrediction", F.round("baggingPrediction", DIGITS))


@query
def bagging_prepared_tables(spark, sf_dir):
    workspace = Workspace(spark)
    table = load_distinct(tasks.emb_class(spark, sf_dir), workspace, "class", "vec_id")
    train, test = hash_split(table.unique, SPLIT, SEED)
    encoding = fit_encoding(train, table.layout, CLASSIFICATION, workspace)
    config = BaggingConfig(CLASSIFICATION, ("NaiveBayes",), members=3, subset_fraction=FRACTION, seed=SEED)
    result = run_bagging(encoding.transform(train), encoding.transform(test), config, workspace=workspace)
    return result.predictions.drop("fold")


FOLD_SEEDS = (1, 2, 3)


def write_folds(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Three train/test pairs of headerless CSV from the customers, split by different seeds."""
    workspace, rows, paths = Workspace(spark), tasks.cust_balance(spark, sf_dir), []
    for seed in FOLD_SEEDS:
        for name, part in zip(("train", "test"), split_filters(SPLIT, seed, F.col("cust_id"))):
            paths.append(workspace.path(f"{name}{seed}"))
            rows.filter(part).write.csv(paths[-1])
    return fold_pairs(paths)


def isotonic_folds(spark: SparkSession, sf_dir: str) -> BaggingResult:
    config = BaggingConfig(
        REGRESSION, ("Isotonic",), members=2, subset_fraction=FRACTION, seed=SEED, label="_c3", key="_c0"
    )
    return run_fold_paths(spark, write_folds(spark, sf_dir), config)


@query
def fold_runs(spark, sf_dir):
    return isotonic_folds(spark, sf_dir).metrics.withColumn("value", rounded_error("value"))


@query
def fold_summary(spark, sf_dir):
    summary = isotonic_folds(spark, sf_dir).fold_summary()
    return summary.select("metric", "folds", rounded_error("mean"), rounded_error("stddev"))


@query
def folds_fit_on_all(spark, sf_dir):
    rows = tasks.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    parts = [split_filters(SPLIT, seed, F.col("c_custkey")) for seed in FOLD_SEEDS]
    config = BaggingConfig(
        REGRESSION,
        ("Isotonic",),
        members=2,
        subset_fraction=FRACTION,
        seed=SEED,
        label="c_acctbal",
        key="c_custkey",
        fit_scope="all",
    )
    result = run_folds([(rows.filter(train), rows.filter(test)) for train, test in parts], config)
    return result.predictions.withColumn("baggingPrediction", F.round("baggingPrediction", DIGITS))


PARTS = 3


@query
def kfold_metrics(spark, sf_dir):
    config = BaggingConfig(
        REGRESSION, ("Isotonic",), members=2, subset_fraction=FRACTION, seed=SEED, label="c_acctbal", key="cust_id"
    )
    metrics = run_kfold(tasks.cust_balance(spark, sf_dir), config, PARTS).metrics
    return metrics.withColumn("value", rounded_error("value"))


@query
def kfold_nb_vote(spark, sf_dir):
    config = BaggingConfig(
        CLASSIFICATION, ("NaiveBayes",), members=3, subset_fraction=FRACTION, seed=SEED, label="class", key="vec_id"
    )
    return run_kfold(tasks.emb_class(spark, sf_dir), config, PARTS).predictions


@query
def prediction_sink(spark, sf_dir):
    target = Workspace(spark).path("sink")
    write_predictions(tasks.flag_rules(spark, sf_dir), target)
    return to_long(read_predictions(spark, target))


@query
def phase_timings(spark, sf_dir):
    return nb_run(spark, sf_dir).timings.select("fold", "phase", (F.col("seconds") > 0).alias("is_positive"))
