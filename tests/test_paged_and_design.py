import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions import design
from tideglass.sources import paged


def page(items, cursor=None):
    return {"retCode": 0, "result": {"list": items, "nextPageCursor": cursor}}


def test_pages_follow_cursors_and_fail_loudly():
    assert list(paged.pages(paged.canned([page([1, 2], "c"), page([3])]), {})) == [1, 2, 3]
    with pytest.raises(OSError):
        list(paged.pages(paged.canned([{"retCode": 10006}]), {}))
    with pytest.raises(ValueError):
        list(paged.pages(paged.canned([{"result": {"rows": []}}]), {}))


def test_requests_are_fetched_where_they_lie(spark, rows):
    requests = spark.createDataFrame([("A",), ("B",)], "symbol string")
    out = paged.paged(requests, lambda r: {"result": {"list": [["1", "2.5"], ["2", "3.5"]] if r["symbol"] == "A" else []}}, "symbol string, ts long, px double", lambda r, e: (r["symbol"], int(e[0]), float(e[1])))
    assert rows(out, "symbol", "ts", "px") == [("A", 1, 2.5), ("A", 2, 3.5)]


def test_guards(spark, rows):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-02-01", None)], "symbol string, day string, v double")
    assert paged.required(df.where("v IS NOT NULL"), ["v"]).count() == 1
    with pytest.raises(Exception, match="v is missing"):
        paged.required(df, ["v"]).collect()
    with pytest.raises(Exception, match="a row lies after"):
        paged.not_after(df, "day", "2024-01-15").collect()
    assert rows(paged.mapped(df, "symbol", {"a": "x"}), "symbol") == [("b",), ("x",)]
    u = spark.createDataFrame([("ABCUSDT",), ("BTC-1USDT",), ("ABC",)], "s string")
    assert u.where(paged.linear_universe(F.col("s"))).count() == 1
    assert paged.first_wins(df.union(df), ["symbol"], [F.col("day")]).count() == 2


def test_panel_of_two_trees(spark, rows):
    p = lambda d: spark.createDataFrame(d, "symbol string, day int, close double")
    got = paged.panel_union(p([("a", 1, 1.0), ("a", 2, 2.0)]), p([("a", 2, 2.0), ("b", 1, 5.0)]))
    assert rows(got, "symbol", "day", "close") == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)]
    with pytest.raises(Exception, match="two values"):
        paged.panel_union(p([("a", 1, 1.0)]), p([("a", 1, 2.0)])).collect()
    assert rows(paged.renamed_relistings(p([("a", 9, 1.0)]), p([("a", 1, 1.0), ("b", 1, 1.0)])), "symbol") == [("a#delisted",), ("b",)]


def test_payload_shapes_and_snapshots(spark, rows):
    df = spark.createDataFrame([("s", '["5","1.5","2","1","1.7"]'), ("s", '{"start":6,"open":"2","close":"3"}'), ("s", "broken"), ("s", None)], "symbol string, payload string")
    assert rows(paged.delisted_rows(df), "start_ms", "open", "close")[:2] == [(5, 1.5, 1.7), (6, 2.0, 3.0)]
    e = spark.createDataFrame([("k", 10, 1.0), ("k", 12, 2.0), ("j", 90, 3.0)], "k string, ts long, v double")
    assert [tuple(r) for r in paged.nearest_snapshot(e, 11, 5, "k").collect()] == [("k", 12, 2.0, False)]
    assert [tuple(r) for r in paged.nearest_snapshot(e, 70, 5, "k").collect()] == [("j", 90, 3.0, True)]
    assert paged.lead_lag_pair(spark, 50, 3, 0.9, 1).count() == 50


def test_design():
    assert design.power(0.1, 0.1, 0.05) == 0.5
    assert design.detectable(1.96, 0.1, 0.1) == pytest.approx(0.2802, abs=1e-3)
    assert design.permutation_floor([1, 5, 17]) == pytest.approx((0.5 + 0.25) / 2)
    assert design.bartlett_factor(np.ones(5), 2) == 1
    x = np.cumsum(np.random.default_rng(0).standard_normal(500))
    assert design.bartlett_factor(x, 10) > 5
    assert design.break_even_fee(1.0, 4, 8.0) == 2


def test_gate(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(design.gate({"a": F.col("a") > 0, "b": F.col("b") > 0})).collect()] == [True, False]


def test_busy_sources_are_asked_again_after_growing_pauses():
    slept = []
    busy = {"retCode": 10_006}
    assert list(paged.pages(paged.canned([busy, busy, page([1], "c"), page([2])]), {}, pause_s=0.5, tries=3, sleep=slept.append)) == [1, 2]
    assert slept == [1.0, 2.0, 0.5]
    with pytest.raises(OSError):
        list(paged.pages(paged.canned([busy] * 2), {}, tries=2, sleep=slept.append))


def test_pages_backwards_cover_the_range_once():
    def fetch(request):
        times = [t for t in range(100, 0, -10) if t < request["end"]][:3]
        return {"retCode": 0, "result": {"list": [{"start": t} for t in times]}}

    assert [e["start"] for e in paged.pages_back(fetch, {}, 35, 95)] == [90, 80, 70, 60, 50, 40]
    assert list(paged.pages_back(lambda r: {"retCode": 0, "result": {"list": []}}, {}, 0, 10)) == []
