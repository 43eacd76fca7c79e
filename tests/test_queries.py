import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from manyvote.plans import catalog, oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple(round(float(r[i]), 5) if isinstance(r[i], (int, float)) else r[i] for i in order) for r in rows
    )


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    sql = tables.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got, expected = normal(df.collect(), df.columns), normal(sql.fetchall(), sql.columns)
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a) else a == b


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


LEARNERS = [
    *((catalog.document_fit, m) for m in ("SVM", "LogisticRegression", "DecisionTree", "RandomForest")),
    (catalog.embedding_fit, "MPC"),
    *((catalog.price_fit, m) for m in ("DecisionTree", "RandomForest", "GBT")),
]


@pytest.mark.parametrize("run, method", LEARNERS)
def test_learners_answer_every_test_row(spark, run, method):
    rows = run(spark, SF_DIR, method).collect()
    assert rows and len({r["row_id"] for r in rows}) == len(rows)
    assert all(r["prediction"] is not None for r in rows)


@pytest.mark.parametrize("name", ["fit_svm", "fit_mlp", "fit_logreg", "fit_dt_cls", "fit_rf_cls", "fit_dt_reg", "fit_rf_reg", "fit_gbt_reg"])
def test_strict_learner_queries_answer_more_than_one_thing(spark, name):
    assert len({r["prediction"] for r in QUERIES[name](spark, SF_DIR).collect()}) == 2


@pytest.mark.parametrize("name", ["mixed_nb_dt_members", "mixed_nb_dt_metrics"])
def test_exchanged_bags_of_a_mixed_run_are_noticed(spark, tables, name):
    """Member 1 is a naive Bayes, member 2 a tree; with each other's bags they answer otherwise."""
    exchanged = ORACLES[name].replace("(bag % 4)", "([0, 2, 1, 3][bag % 4 + 1])")
    assert exchanged != ORACLES[name]
    df, sql = QUERIES[name](spark, SF_DIR), tables.sql(exchanged)
    got, other = normal(df.collect(), df.columns), normal(sql.fetchall(), sql.columns)
    assert len(got) == len(other) and got != other


def test_mixed_members_disagree(spark):
    rows = QUERIES["mixed_nb_dt_members"](spark, SF_DIR).groupBy("row_id").pivot("member").max("prediction").collect()
    assert len({tuple(r[str(m)] for r in rows) for m in range(catalog.MIXED_BAGS)}) == catalog.MIXED_BAGS


def test_boosting_answers_more_than_its_first_tree(spark, tables):
    first = tables.sql(f"WITH {oracles._boosted_members(1, catalog.BOOST_DEPTH, 1, 1.0)} SELECT row_id, prediction FROM long").fetchall()
    all_ = {r["row_id"]: r["prediction"] for r in QUERIES["fit_gbt_reg_few_values"](spark, SF_DIR).collect()}
    assert len({p for _, p in first}) <= 4 < len(set(all_.values()))
    assert sum(abs(all_[i] - p) > 1e-3 for i, p in first) > len(first) / 2


def test_every_base_query_has_a_twin():
    assert set(catalog.QUERIES) <= set(ORACLES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["fold", "scope", "method", "member", "metric", "value"]
    assert df.count() == 12
