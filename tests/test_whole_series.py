"""Queries that once took chosen series or days run over all of them."""

import datetime as dt

from tideglass.plans.events_queries import calendar_left_join
from tideglass.plans.feature_queries import shared_grid_join
from tideglass.plans.market_queries import panel_synchronised


def test_panels_and_pairs_of_all_series(spark, rows, tmp_path):
    data = [(i, 1_800_000 * b, s, float(i), 1.0, "buy") for i, (s, b) in enumerate([("x", 0), ("y", 0), ("z", 0), ("x", 1), ("z", 1)])]
    spark.createDataFrame(data, "trade_id long, ts long, symbol string, price double, volume double, side string").selectExpr("*", "price + 1 AS p").drop("price").withColumnRenamed("p", "price").write.parquet(f"{tmp_path}/trades.parquet")
    assert rows(panel_synchronised(spark, str(tmp_path)), "symbol", "bucket", "px") == [("x", 0, 1.0), ("y", 0, 2.0), ("z", 0, 3.0)]
    want = [("x", "y", 0, 1.0, 2.0), ("x", "z", 0, 1.0, 3.0), ("x", "z", 1, 4.0, 5.0), ("y", "z", 0, 2.0, 3.0)]
    assert rows(shared_grid_join(spark, str(tmp_path)), "left_symbol", "right_symbol", "b", "left_px", "right_px") == want


def test_calendar_runs_from_the_first_to_the_last_day(spark, rows, tmp_path):
    days = [dt.datetime(1996, 2, 27), dt.datetime(1996, 3, 1)]
    spark.createDataFrame([(d, 2.0) for d in days], "o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(str(d), n) for d, n in rows(calendar_left_join(spark, str(tmp_path)), "day", "n")]
    assert got == [("1996-02-27", 1), ("1996-02-28", None), ("1996-02-29", None), ("1996-03-01", 1)]
