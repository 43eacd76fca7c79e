import datetime as dt

import pytest
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from manyvote.operators.dedupe import _first_of_each, distinct_features, distinct_wide
from manyvote.operators.encode import build_dictionary, encode_columns, value_counts
from manyvote.operators.layout import feature_runs, inspect_layout, typed_rows, wide_rows
from manyvote.operators.numbering import number_rows
from manyvote.operators.prepare import fit_encoding, load_distinct, prepare
from manyvote.operators.tree_stages import INDEXED_LABEL, class_order, original_label, with_indexed_label

MIXED = [
    (1, "red", 0.5, "yes"), (2, "blue", 1.5, "no"), (3, "red", 2.5, "yes"), (4, "?", 3.5, "no"),
    (5, "blue", 4.5, "maybe"), (6, "green", 5.5, "yes"), (7, "red", 6.5, "yes"), (8, "?", 7.5, "no"),
    (9, "blue", 8.5, "yes"), (10, "green", 9.5, "maybe"), (11, "red", 10.5, "no"), (12, "?", 11.5, "yes"),
]


def prepared(df, task, workspace, **options):
    rows, encoding = prepare(df, task, workspace, **options)
    return [
        (list(map(float, r["features"].toArray())), r["label"]) for r in rows.orderBy("row_id").collect()
    ], encoding


def test_layout_takes_last_column_as_label(spark):
    df = spark.createDataFrame(MIXED, "a int, b string, c double, d string")
    layout = inspect_layout(df.schema)
    assert layout.features == ("a", "b", "c")
    assert layout.nominal == ("b",) and layout.numeric == ("a", "c")
    assert layout.label == "d" and layout.label_is_nominal


def test_layout_refuses_unknown_and_reserved_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "features int, y double")
    with pytest.raises(ValueError, match="reserved|result"):
        inspect_layout(df.schema)
    with pytest.raises(ValueError, match="no column"):
        inspect_layout(df.schema, label="z")


def test_indices_equal_string_indexer(spark, workspace):
    df = spark.createDataFrame(MIXED, "a int, b string, c double, d string")
    model = StringIndexer(inputCols=["b", "d"], outputCols=["b2", "d2"]).fit(df)
    expected = {(r["a"], r["b2"], r["d2"]) for r in model.transform(df).collect()}
    dictionary = build_dictionary(value_counts(df, ["b", "d"]), workspace)
    coded = encode_columns(df, {"b": "b", "d": "d"}, dictionary, "a")
    assert {(r["a"], r["b"], r["d"]) for r in coded.collect()} == expected


@pytest.mark.parametrize("rank_rows, head_rows", [(100, 100), (0, 100), (100, 3), (0, 0)])
def test_all_ways_to_index_agree(spark, workspace, rank_rows, head_rows):
    # One value holds a third of the rows, the others are rare.
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 400))).alias("v")
    )
    model = StringIndexer(inputCol="v", outputCol="i").fit(df)
    dictionary = build_dictionary(value_counts(df, ["v"]), workspace, rank_rows=rank_rows, head_rows=head_rows)
    coded = encode_columns(df, {"v": "code"}, dictionary, "id")
    both = coded.join(model.transform(df).drop("v"), "id")
    assert both.count() == 3000
    assert both.filter(F.col("code") != F.col("i")).count() == 0


def test_broadcasts_share_a_bounded_number_of_entries(spark, workspace):
    df = spark.createDataFrame([(i, "x" * 3000 if i < 5 else f"s{i}", f"t{i % 2}") for i in range(9)], "id int, v string, w string")
    for head_total, heads in ((100, 5), (8, 4), (2, 1), (0, 0)):
        dictionary = build_dictionary(value_counts(df, ["v", "w"]), workspace, head_total=head_total)
        assert dictionary.heads == {"v": heads, "w": min(heads, 2)}
        codes = {r["id"]: (r["code"], r["w"]) for r in encode_columns(df, {"v": "code", "w": "w"}, dictionary, "id").collect()}
        assert [codes[i] for i in range(9)] == [(max(0, i - 4), i % 2) for i in range(9)]


@pytest.mark.parametrize("head_rows", [10, 1, 0])
def test_unknown_value_gets_one_more_index(spark, workspace, head_rows):
    fit = spark.createDataFrame([("a", "p"), ("b", "q"), ("a", "p")], "v string, w string")
    new = spark.createDataFrame([(1, "b", "zzz"), (2, "zzz", "q"), (3, "a", "p"), (4, "p", "a")], "id int, v string, w string")
    dictionary = build_dictionary(value_counts(fit, ["v", "w"]), workspace, head_rows=head_rows)
    coded = encode_columns(new, {"v": "v", "w": "w"}, dictionary, "id")
    assert coded.columns == ["id", "v", "w"]
    assert sorted(map(tuple, coded.collect())) == [(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 0.0, 0.0), (4, 2.0, 2.0)]


def test_number_rows_is_the_global_rank(spark, workspace):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("h"), "id")
    ranked = number_rows(df, [F.asc("h"), F.asc("id")], workspace).orderBy("position").collect()
    assert [r["position"] for r in ranked] == list(range(5000))
    assert [r["h"] for r in ranked] == sorted(r["h"] for r in ranked)


def test_scaled_vectors_equal_min_max_scaler(spark, workspace):
    df = spark.createDataFrame(MIXED, "a int, b string, c double, d string").select("a", "c", F.lit(4).alias("k"), "d")
    vectors = VectorAssembler(inputCols=["a", "c", "k"], outputCol="v").transform(
        df.select(*[F.col(x).cast("double") for x in ("a", "c", "k")])
    )
    scaler = MinMaxScaler(inputCol="v", outputCol="s").fit(vectors)
    expected = sorted(list(r["s"].toArray()) for r in scaler.transform(vectors).collect())
    rows, _ = prepare(df, "classification", workspace)
    got = sorted(r["f"] for r in rows.select(vector_to_array("features").alias("f")).collect())
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=1e-12)
    assert {f[2] for f in got} == {0.5}


def test_numeric_label_keeps_its_numbers(spark, workspace):
    df = spark.createDataFrame([(i / 7, i % 5, i % 3) for i in range(12)], "x double, y int, z int")
    rows, encoding = prepared(df, "classification", workspace)
    assert {label for _, label in rows} == {0.0, 1.0, 2.0} and encoding.label_map() is None


def test_negative_label_renumbers_all_classes_by_frequency(spark, workspace):
    data = [(i / 3, i / 7, [-1, 0, 1, 1][i % 4]) for i in range(12)]
    df = spark.createDataFrame(data, "x double, y double, z int")
    _, encoding = prepared(df, "classification", workspace)
    assert {r["value"]: r["code"] for r in encoding.label_map().collect()} == {"1.0": 0.0, "-1.0": 1.0, "0.0": 2.0}
    rows, encoding = prepared(df, "regression", workspace)
    assert {label for _, label in rows} == {-1.0, 0.0, 1.0} and encoding.label_map() is None


def test_duplicates_keep_the_lowest_key_or_label(spark, workspace):
    data = [(k, float(k // 3), 1.0, label) for k, label in zip(range(10), [2, 0, 1, 5, 4, 3, 0, 0, 9, 7])]
    df = spark.createDataFrame(data, "k int, x double, y double, z int")
    layout = inspect_layout(df.schema, key="k")
    kept = distinct_features(typed_rows(df, layout), layout.features).orderBy("row_id").collect()
    assert [(r["row_id"], r["label"], r["copies"]) for r in kept] == [(0, 2.0, 3), (3, 5.0, 3), (6, 0.0, 3), (9, 7.0, 1)]
    layout = inspect_layout(df.drop("k").schema)
    kept = distinct_features(typed_rows(df.drop("k"), layout), layout.features).orderBy("x").collect()
    assert [(r["label"], r["copies"]) for r in kept] == [(0.0, 3), (3.0, 3), (0.0, 3), (7.0, 1)]
    assert len({r["row_id"] for r in kept}) == 4


def test_copies_count_towards_frequencies_when_all_rows_are_fitted(spark, workspace):
    data = [("a", 1.0, 0)] * 5 + [("b", float(i), 1) for i in range(3)]
    df = spark.createDataFrame(data, "v string, x double, y int")
    _, encoding = prepare(df, "classification", workspace)
    assert {r["value"]: r["code"] for r in encoding.dictionary.of("v").collect()} == {"a": 0.0, "b": 1.0}
    table = load_distinct(df, workspace)
    encoding = fit_encoding(table.unique, table.layout, "classification", workspace)
    assert {r["value"]: r["code"] for r in encoding.dictionary.of("v").collect()} == {"b": 0.0, "a": 1.0}


def test_null_cells_fail_or_are_skipped(spark, workspace):
    data = [(1, 0.5, "a"), (2, None, "b"), (3, 1.5, "a"), (4, 2.5, None), (5, float("nan"), "b"), (6, 3.5, "b")]
    df = spark.createDataFrame(data, "x int, y double, z string")
    with pytest.raises(Exception, match="(null|NaN or infinity) in column"):
        prepare(df, "classification", workspace)
    rows, _ = prepared(df, "classification", workspace, handle_invalid="skip")
    assert len(rows) == 3


def test_every_type_becomes_a_number(spark):
    data = [(True, dt.date(1970, 1, 3), dt.datetime(1970, 1, 1, 0, 0, 1, 500000), dt.datetime(1970, 1, 2), 1.0)]
    df = spark.createDataFrame(data, "a boolean, b date, c timestamp, d timestamp_ntz, y double")
    row = typed_rows(df, inspect_layout(df.schema)).first()
    assert tuple(row) == (1.0, 2.0, 1.5, 86400.0, 1.0)
    with pytest.raises(TypeError, match="neither"):
        nested = df.select(F.array("y").alias("n"), "y")
        typed_rows(nested, inspect_layout(nested.schema))


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None])
@pytest.mark.parametrize("place", ["feature", "vector", "label"])
def test_cells_that_are_no_numbers_fail_or_are_skipped(spark, workspace, bad, place):
    def row(i):
        wrong = i == 5
        x = bad if wrong and place == "feature" else float(i)
        v = [0.5 * i, bad if wrong and place == "vector" else 1.0 / (i + 1)]
        return i, x, v, bad if wrong and place == "label" else float(i % 2)

    df = spark.createDataFrame([row(i) for i in range(8)], "k int, x double, v array<double>, y double")
    with pytest.raises(Exception, match="null in column|NaN or infinity in column"):
        prepare(df, "regression", workspace, key="k")
    rows, _ = prepared(df, "regression", workspace, key="k", handle_invalid="skip")
    assert [r[0][0] for r in rows] == pytest.approx([i / 7 for i in range(8) if i != 5])
    if place != "vector":
        named = df.drop("v")
        with pytest.raises(Exception, match="null in column|NaN or infinity in column"):
            typed_rows(named, inspect_layout(named.schema, key="k")).collect()
        assert typed_rows(named, inspect_layout(named.schema, key="k"), "skip").count() == 7


def test_vectors_are_read_whole(spark, workspace):
    data = [(i, [float((i * j) % 13) for j in range(100)], "ab"[i % 2], float(i), i % 2) for i in range(12)]
    df = spark.createDataFrame(data, "k int, v array<float>, s string, z double, y int")
    rows, encoding = prepared(df, "classification", workspace, key="k")
    assert encoding.layout.n_features == 102 and len(rows[0][0]) == 102
    columns = list(zip(*(d[1] for d in data)))
    for i, (features, _) in enumerate(rows):
        low, high = min(columns[99]), max(columns[99])
        assert features[99] == pytest.approx((columns[99][i] - low) / (high - low))
        assert features[100] == "ab".index(data[i][2]) and features[101] == pytest.approx(i / 11)
    uneven = df.union(spark.createDataFrame([(99, [1.0, 2.0], "a", 0.0, 1)], df.schema))
    with pytest.raises(ValueError, match="vectors of 2 to 100"):
        prepare(uneven, "classification", workspace, key="k")


def test_keys_of_duplicates_do_not_depend_on_the_layout(spark, workspace):
    data = [(float(i % 4), "uv"[i % 2], i % 3) for i in range(24)]
    df = spark.createDataFrame(data, "x double, s string, y int")
    layout = inspect_layout(df.schema)
    named = distinct_features(typed_rows(df, layout), layout.features)
    wide = load_distinct(df, workspace).unique
    assert {(r["row_id"], r["copies"]) for r in named.collect()} == {(r["row_id"], r["copies"]) for r in wide.collect()}


def test_a_thousand_features_are_prepared(spark, workspace):
    df = spark.range(40).select(
        "id", *[((F.col("id") * (i + 1)) % 17).cast("double").alias(f"x{i}") for i in range(1000)], (F.col("id") % 2).alias("y")
    )
    rows, encoding = prepare(df, "classification", workspace, key="id")
    features = [r["f"] for r in rows.select(vector_to_array("features").alias("f")).collect()]
    assert len(features) == 17 and all(len(f) == 1000 and 0 <= min(f) <= max(f) <= 1 for f in features)


def test_unknown_value_stays_apart_from_the_rarest(spark, workspace):
    fit = spark.createDataFrame([("a", "k", 1.0, 0.0), ("b", "k", 2.0, 1.0), ("a", "k", 3.0, 0.0)], "v string, w string, x double, y double")
    new = spark.createDataFrame([("b", "k", 1.0, 0.0), ("zzz", "m", 2.0, 0.0)], "v string, w string, x double, y double")
    table, other = load_distinct(fit, workspace), load_distinct(new, workspace)
    encoding = fit_encoding(table.unique, table.layout, "regression", workspace)
    known, unknown = (list(r["f"]) for r in encoding.transform(other.unique).select(vector_to_array("features").alias("f")).orderBy("f").collect())
    assert known[:2] == [1.0, 0.5] and unknown[0] > known[0] and unknown[1] != known[1]


def test_repeated_keys_are_refused(spark, workspace):
    df = spark.createDataFrame([(i % 10, float(i), i % 2) for i in range(100)], "k int, x double, y int")
    with pytest.raises(ValueError, match="'k' is not unique"):
        load_distinct(df, workspace, key="k")
    same = spark.createDataFrame([(i % 10, float(i % 10), 1) for i in range(100)], "k int, x double, y int")
    assert load_distinct(same, workspace, key="k").unique.count() == 10


def test_many_classes_round_trip(spark):
    rows = spark.range(20_002).select(F.col("id").alias("row_id"), (F.col("id") % 10_001).cast("double").alias("label"))
    classes = class_order(rows)
    assert len(classes) == 10_001
    there = with_indexed_label(rows, classes)
    back = there.withColumn("restored", original_label(F.col(INDEXED_LABEL), classes))
    assert back.filter("restored != label or indexed_label is null").count() == 0
    assert there.select(INDEXED_LABEL).distinct().count() == 10_001


def test_equal_features_are_one_row_whatever_their_digest(spark):
    rows = spark.createDataFrame([("b", [0.0, 1.0], 1.0), ("a", [-0.0, 1.0], 2.0), ("c", [0.0, 2.0], 3.0)], "row_id string, numbers array<double>, label double")
    for digest in (F.lit(1), F.col("numbers")[1]):  # all in one digest, and one that tells them apart
        got = _first_of_each(rows, [F.col("numbers")], F.lit(None), [digest]).collect()
        assert sorted((r["row_id"], r["label"], r["copies"]) for r in got) == [("a", 2.0, 2), ("c", 3.0, 1)]


def test_signs_of_zero_are_one_number(spark):
    df = spark.createDataFrame([(1, 0.0, [0.0], 1.0), (2, -0.0, [-0.0], 1.0), (3, 1.0, [0.0], 1.0)], "id int, x double, v array<double>, y double")
    layout = inspect_layout(df.schema, key="id")
    layout = layout.__class__(**{**layout.__dict__, "sizes": (1,)})
    got = distinct_wide(wide_rows(df, layout), layout.nominal, feature_runs(layout)).collect()
    assert sorted((r["row_id"], r["copies"]) for r in got) == [(1, 2), (3, 1)]
    narrow = distinct_features(df.select(F.col("id").alias("row_id"), "x", F.col("y").alias("label")), ["x"]).collect()
    assert sorted((r["row_id"], r["copies"]) for r in narrow) == [(1, 2), (3, 1)]
