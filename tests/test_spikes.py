import numpy as np
import pytest

from tideglass.operators.spikes import DAY_MS, WEEK_MS, Field, esd_limits, esd_outliers, implausible_readings, in_runs

SCHEMA = "symbol string, event_ms long, rec_id long, v double, note string"
FIELD = [Field("v", positive=True, runs=True, spikes="both", margin=5.0)]


def found(spark, data, fields=FIELD, **how):
    df = spark.createDataFrame([(*r, "n") for r in data], SCHEMA)
    return {(r.rec_id, r.reason) for r in implausible_readings(df, "symbol", fields, **how).collect()}


def walk(n, seed=0, step=60_000, start=0):
    rng = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(rng.standard_normal(n) * 1e-3))
    return [("a", start + k * step, k, float(v)) for k, v in enumerate(x)]


def put(data, at, value):
    for k in at:
        data[k] = (*data[k][:3], value if not callable(value) else value(data[k][3]))
    return data


def test_limits_match_published_values():
    # Rosner's table for n = 54, alpha = 0.05: 3.158, 3.151, 3.143 for the first three.
    assert esd_limits(54, 3, 0.05) == pytest.approx([3.158, 3.151, 3.143], abs=0.02)


def test_outliers_do_not_mask_each_other():
    x = np.concatenate([np.random.default_rng(0).standard_normal(100), [50, 51, 52, 53]])
    assert set(np.flatnonzero(esd_outliers(x, 1.0))) >= {100, 101, 102, 103}
    assert not esd_outliers(np.ones(50), 1.0).any()


def test_spikes_levels_and_impossible(spark):
    data = put(put(walk(3000), [500, 501, 502], lambda v: v * 1.5), range(2000, 3000), lambda v: v * 1.3)
    data = put(data, [700], -5.0)
    data = put(data, [900], None)
    assert found(spark, data) == {(500, "spike"), (501, "spike"), (502, "spike"), (700, "impossible")}


def test_spike_and_run_across_a_block_border(spark):
    data = walk(400, step=60_000, start=DAY_MS - 200 * 60_000)
    data = put(data, [199, 200], lambda v: v * 2)
    data = put(data, range(120, 126), 101.5)
    data = put(data, range(20, 30), 99.0)
    got = found(spark, data, block_ms=DAY_MS)
    assert got == {(199, "spike"), (200, "spike")} | {(k, "stuck") for k in range(20, 30)}
    across = put(walk(400, step=60_000, start=DAY_MS - 200 * 60_000), range(195, 205), 100.0)
    assert {(k, "stuck") for k in range(195, 205)} == {x for x in found(spark, across, block_ms=DAY_MS) if x[1] == "stuck"}
    nine = put(walk(400, step=60_000, start=DAY_MS - 200 * 60_000), range(195, 204), 100.0)
    assert not {x for x in found(spark, nine, block_ms=DAY_MS) if x[1] == "stuck"}


def test_run_over_a_short_block_between_two(spark):
    ts = [DAY_MS - 60_000 * k for k in range(40, 0, -1)] + [DAY_MS + 1, DAY_MS + 2] + [2 * DAY_MS + 60_000 * k for k in range(40)]
    rng = np.random.default_rng(4)
    x = 100 + rng.standard_normal(len(ts))
    x[36:46] = 77.0
    data = [("a", t, k, float(v)) for k, (t, v) in enumerate(zip(ts, x))]
    assert {k for k, why in found(spark, data, block_ms=DAY_MS) if why == "stuck"} == set(range(36, 46))


def test_high_only_against_the_day(spark):
    rng = np.random.default_rng(1)
    data = [("a", k * 1000, k, float(v)) for k, v in enumerate(np.exp(rng.uniform(0, 2, 4000)))]
    data = put(data, [10, 3000], 5000.0)
    data = put(data, [20], 0.0)
    fields = [Field("v", positive=True, runs=False, spikes="high", margin=1.0)]
    assert found(spark, data + data[5:15], fields) == {(10, "spike"), (3000, "spike"), (20, "impossible")}


def test_bad_rows_and_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, 1, 2.0), ("a", None, 2, 2.0), ("a", 3, 3, float("nan")), ("a", 4, 4, 1.0)]) == {(3, "impossible")}


def test_runs():
    assert in_runs(np.array([1.0, 1, 2, 2, 2]), 3).tolist() == [False, False, True, True, True]
    assert WEEK_MS == 7 * DAY_MS
