import random

import pytest

from tideglass.llm.nearest_time import nearest_in_time, ring_widths

LEFT, RIGHT = "e string, t long, l long, r string", "e string, t long, r long, _best long"


def brute(left, right, tolerance):
    out = set()
    for e, t, l, _ in set(left):  # noqa: E741
        if e is None or t is None or l is None:
            continue
        near = [(abs(t - u), u, r) for f, u, r, _ in right if f == e and u is not None and r is not None and abs(t - u) <= tolerance]
        if near:
            d, _, r = min(near)
            out.add((l, r, d))
    return out


def run(spark, left, right, tolerance, fine, block=1000):
    got = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "e", "t", "l", "r", tolerance, fine, block)
    return [tuple(r) for r in got.withColumnsRenamed({"l": "a", "r": "b"}).select("a", "b", "distance_ms").collect()]


@pytest.mark.parametrize(("tolerance", "fine"), [(64, 4), (50, 7), (3, 10), (100, 100)])
def test_against_brute_force(spark, tolerance, fine):
    rng = random.Random(tolerance)
    left = [(rng.choice("ab"), rng.randrange(-500, 3000), k, "x") for k in range(300)] + [(None, 1, 900, "x"), ("a", None, 901, "x")]
    right = [(rng.choice("abc"), rng.randrange(-500, 3000), k, k) for k in range(120)] + [(None, 1, 900, 0), ("a", None, 901, 0)]
    left += left[:20]
    right += right[:20]
    got = run(spark, left, right, tolerance, fine)
    assert len(got) == len(set(got))
    assert set(got) == brute(left, right, tolerance)


def test_ties_take_the_earlier_then_the_smaller_id(spark):
    assert run(spark, [("a", 10, 1, "")], [("a", 8, 5, 0), ("a", 12, 4, 0), ("a", 8, 3, 0)], 10, 2) == [(1, 3, 2)]


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, 1, 0)], 10, 2) == []
    assert run(spark, [("a", 1, 1, "")], [], 10, 2) == []


def test_rings_double_up_to_the_tolerance():
    assert ring_widths(1875, 15_000) == [1875, 3750, 7500, 15_000]
    assert ring_widths(7, 50) == [7, 14, 28, 50]


def test_each_side_is_exchanged_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = nearest_in_time(spark.createDataFrame([("a", 10, 1, "")], LEFT), spark.createDataFrame([("a", 8, 5, 0)], RIGHT), "e", "t", "l", "r", 16, 2)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.split("\n")) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
