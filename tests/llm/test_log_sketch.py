import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideglass.llm.log_sketch import LogBuckets

AT = {"p0": 0.001, "p50": 0.5, "p99": 0.99}


def exact(x, p):
    x = sorted(x)
    return x[max(math.ceil(p * len(x)), 1) - 1]


@settings(max_examples=300)
@given(st.floats(1e-250, 1e250), st.sampled_from([0.5, 0.01, 0.005]))
def test_representative_is_within_the_error(v, error):
    b = LogBuckets(error)
    index = math.ceil(math.log(v) / b.log_gamma)
    rep = b.gamma**index * 2 / (b.gamma + 1)
    assert abs(rep - v) <= error * v * (1 + 1e-9)


def test_percentiles_within_error_and_joined_days_equal_the_whole(spark):
    rng = np.random.default_rng(0)
    b = LogBuckets(0.01)
    data = [("a", d, float(v)) for d in (1, 2, 3) for v in np.exp(rng.standard_normal(500) * 3)]
    data += [("a", 1, -float(v)) for v in np.exp(rng.standard_normal(300))] + [("a", 2, 0.0)] * 50
    data += [("b", 1, 5.0), (None, 1, 2.0), ("c", 1, None), ("c", 1, float("nan")), ("c", 1, float("inf"))]
    df = spark.createDataFrame(data, "k string, day int, v double").withColumn("n", F.lit(9)).withColumn("sign", F.lit(0))
    daily = b.sketch(df, ["k", "day"], ["v"])
    got = {r.k: r for r in b.percentiles(daily, ["k"], AT).collect()}
    at_once = {r.k: r for r in b.percentiles(b.sketch(df, ["k"], ["v"]), ["k"], AT).collect()}
    assert got == at_once and set(got) == {"a", "b", None}
    x = [v for k, _, v in data if k == "a"]
    for name, p in AT.items():
        want = exact(x, p)
        assert abs(got["a"][name] - want) <= 0.01 * abs(want) * (1 + 1e-9)
    assert got["a"].n == len(x) and got["b"].p50 == pytest.approx(5, rel=0.01)


def test_empty(spark):
    b = LogBuckets(0.01)
    df = spark.createDataFrame([], "k string, v double")
    assert b.percentiles(b.sketch(df, ["k"], ["v"]), ["k"], AT).count() == 0


def test_error_must_be_a_share():
    with pytest.raises(ValueError):
        LogBuckets(0)


def test_ranks_are_exact_where_products_of_doubles_are_not(spark):
    from pyspark.sql import functions as F

    from tideglass.llm.log_sketch import exact_rank

    ns = [1, 7, 10, 100, 1000, 3000, 10**12, 10**15]
    row = spark.range(1).select(*[exact_rank(F.lit(n), p).alias(f"{n}_{p}".replace(".", "_")) for n in ns for p in (0.5, 0.9, 0.99, 0.999)]).first()
    want = [-(-n * m // 1000) for n in ns for m in (500, 900, 990, 999)]
    assert list(row) == want
