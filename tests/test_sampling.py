import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyvote.operators.allocate import allocate_members
from manyvote.operators.bags import approximate_bags, bag_by_label, draw_bags, marked_in
from manyvote.operators.repeats import copies_in, draw_rate, draw_repeats, poisson_marks
from manyvote.operators.split import hash_split


def expected_bag(keys, seed, bag, size):
    def draw(key):
        digest = hashlib.md5(f"bag:{seed}:{bag // 4}:{key}".encode()).hexdigest()
        start = bag % 4 * 8
        return digest[start : start + 8], str(key)

    return set(sorted(keys, key=draw)[:size])


def ids(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("row_id"))


@pytest.mark.parametrize(
    "rows, options",
    [(500, {}), (500, {"rows": 500}), (5000, {"slack": 0.001}), (3, {}), (1, {})],
)
def test_bags_hold_the_smallest_draws(spark, rows, options):
    df = ids(spark, rows)
    plan = draw_bags(df, 6, 0.6, 11, **options)
    assert plan.size == int(0.6 * rows)
    members = plan.members(df).collect()
    for bag in range(6):
        got = [r["row_id"] for r in members if r["bag"] == bag]
        assert len(got) == len(set(got)) == plan.size
        assert set(got) == expected_bag(range(rows), 11, bag, plan.size)


def test_marks_say_the_same_as_members(spark):
    df = ids(spark, 400)
    plan = draw_bags(df, 70, 0.5, 3)
    marked = plan.mark(df).cache()
    assert len(marked.first()["bag_bits"]) == 2
    members = {}
    for r in plan.members(df).collect():
        members.setdefault(r["bag"], set()).add(r["row_id"])
    for bag in (0, 1, 59, 60, 61, 69):
        assert {r["row_id"] for r in marked.filter(marked_in(bag)).collect()} == members[bag]
        assert {r["row_id"] for r in plan.bag(df, bag).collect()} == members[bag]


def test_bags_do_not_depend_on_partitions_and_differ_by_seed(spark):
    a = draw_bags(ids(spark, 300, 1), 2, 0.4, 5).last
    assert a == draw_bags(ids(spark, 300, 9), 2, 0.4, 5).last
    assert a != draw_bags(ids(spark, 300, 1), 2, 0.4, 6).last
    assert a[0] != a[1]


@pytest.mark.parametrize("fraction, size", [(1.0, 50), (0.99, 49), (0.02, 1)])
@pytest.mark.parametrize("options", [{}, {"slack": 1.0}, {"slack": 0.01}])
def test_bags_of_almost_all_or_almost_no_rows(spark, fraction, size, options):
    df = ids(spark, 50)
    members = draw_bags(df, 9, fraction, 1, **options).members(df).collect()
    for bag in range(9):
        assert {r["row_id"] for r in members if r["bag"] == bag} == expected_bag(range(50), 1, bag, size)


def test_approximate_bags_are_near_the_fraction(spark):
    df = ids(spark, 4000)
    counts = {r["bag"]: r["count"] for r in approximate_bags(df, 3, 0.25, 1).groupBy("bag").count().collect()}
    assert sorted(counts) == [0, 1, 2]
    assert all(850 < n < 1150 for n in counts.values())


def test_bag_in_label_order(spark, workspace):
    df = ids(spark, 200).withColumn("label", (F.col("row_id") % 7).cast("double"))
    plan = draw_bags(df.select("row_id"), 2, 0.5, 1)
    rows = bag_by_label(df, plan, 1, workspace).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(100))
    assert [(r["label"], r["row_id"]) for r in rows] == sorted((r["label"], r["row_id"]) for r in rows)


def test_split_parts_are_disjoint_and_whole(spark):
    df = ids(spark, 3000)
    parts = [{r["row_id"] for r in p.collect()} for p in hash_split(df, (0.7, 0.2, 0.1), 4)]
    assert sum(map(len, parts)) == 3000 and set.union(*parts) == set(range(3000))
    assert [round(len(p) / 3000, 1) for p in parts] == [0.7, 0.2, 0.1]
    assert not [*hash_split(df, (1.0, 0.0), 4)][1].count()


def test_allocation_gives_the_last_method_the_remainder():
    assert allocate_members(10, ["a", "b", "c"]) == ["a"] * 3 + ["b"] * 3 + ["c"] * 4
    assert allocate_members(3, ["a", "b", "c"]) == ["a", "b", "c"]
    assert [allocate_members(50, list("abcde")).count(x) for x in "abcde"] == [10] * 5
    with pytest.raises(ValueError, match="cannot cover"):
        allocate_members(3, list("abcde"))


@given(st.integers(1, 12), st.integers(0, 40))
def test_allocation_covers_all_members(methods, extra):
    names = [str(i) for i in range(methods)]
    got = allocate_members(methods + extra, names)
    assert len(got) == methods + extra and set(got) == set(names)
    assert got == sorted(got, key=int)


def expected_copies(keys, seed, bag, size, slack=8.0):
    """Copies per key, drawn one by one."""
    marks = poisson_marks(draw_rate(len(keys), size, slack))
    draws = []
    for key in keys:
        start = bag % 2 * 13
        count = hashlib.md5(f"count:{seed}:{bag // 2}:{key}".encode()).hexdigest()[start : start + 13]
        for copy in range(1, sum(m <= count for m in marks) + 1):
            draws.append((hashlib.md5(f"copy:{seed}:{bag}:{copy}:{key}".encode()).hexdigest()[:8], str(key), copy))
    found = {}
    for _, key, _ in sorted(draws)[:size]:
        found[int(key)] = found.get(int(key), 0) + 1
    return found


@pytest.mark.parametrize("rows, fraction", [(500, 0.6), (2000, 1.0), (3, 0.7), (1, 1.0)])
def test_repeats_are_the_smallest_draws(spark, rows, fraction):
    df = ids(spark, rows)
    plan = draw_repeats(df, 5, fraction, 11)
    members = plan.members(df).collect()
    for bag in range(5):
        got = {r["row_id"]: r["copies"] for r in members if r["bag"] == bag}
        assert sum(got.values()) == plan.size == int(fraction * rows)
        assert got == expected_copies(range(rows), 11, bag, plan.size)


def test_repeats_do_not_depend_on_partitions_and_a_narrow_range_is_widened(spark):
    one, many = draw_repeats(ids(spark, 300, 1), 3, 0.5, 5), draw_repeats(ids(spark, 300, 9), 3, 0.5, 5)
    assert one == many != draw_repeats(ids(spark, 300, 1), 3, 0.5, 6)
    narrow = draw_repeats(ids(spark, 300), 3, 0.5, 5, slack=0.01)
    counts = narrow.members(ids(spark, 300)).groupBy("bag").agg(F.sum("copies").alias("n")).collect()
    assert {r["n"] for r in counts} == {150}


def test_repeats_follow_the_multinomial_distribution(spark):
    """Of n draws among n rows a share of 1/e is never drawn; the variance of a row's copies is 1 - 1/n."""
    n = 20_000
    plan = draw_repeats(ids(spark, n), 2, 1.0, 3)
    row = plan.mark(ids(spark, n)).agg(
        F.avg((copies_in(0) == 0).cast("int")).alias("none"),
        F.var_pop(copies_in(0)).alias("spread"),
        F.corr(copies_in(0), copies_in(1)).alias("together"),
    ).first()
    assert abs(row["none"] - 0.36788) < 0.012 and abs(row["spread"] - 1) < 0.05 and abs(row["together"]) < 0.03


def test_no_rows_give_no_repeats(spark):
    plan = draw_repeats(ids(spark, 0), 2, 0.6, 1)
    assert plan.size == 0 and plan.members(ids(spark, 0)).count() == 0
    assert draw_repeats(ids(spark, 1), 2, 0.6, 1).members(ids(spark, 1)).count() == 0


@pytest.mark.parametrize("rate", [0.01, 0.6, 1.3, 17.0, 120.0])
def test_poisson_marks_rise_to_the_end(rate):
    marks = poisson_marks(rate)
    assert marks == sorted(marks) and int(marks[-1], 16) >= 16**13 * (1 - 1e-12)
