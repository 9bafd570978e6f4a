import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import align, bars, normalize
from tideglass.operators import backtest as bt
from tideglass.operators import orderbook as ob
from tideglass.operators import resampling as rs
from tideglass.operators.grouped import per_series
from tideglass.operators.ranks import average_rank, exact_percentiles, floor_bucket, rejected, spearman

FRAME = "symbol string, ts_exchange_ms long, payload_json string"


def test_trade_dialects(spark, rows):
    t0 = 1_700_000_000_000
    envelope = {"topic": "publicTrade.X", "ts": t0, "data": [{"T": t0 - 5, "S": "Sell", "v": "0.010", "p": "64085.60", "i": "id1"}, {"S": "Buy", "v": "bad", "p": "2", "i": "id2"}]}
    texts = [
        {"side": "Buy", "price": "100.5", "size": "0.10", "trdMatchID": "id1"},
        {"id": "7", "price": "3", "qty": "2", "time": "1", "is_buyer_maker": "true"},
        {"trade_id": "8", "timestamp": 123, "price": 74192.0, "direction": "buy", "amount": 10.0},
        envelope,
        {"jsonrpc": "2.0", "params": {"channel": "c", "data": [{"trade_id": "9", "price": "1", "amount": "1", "direction": "sell"}]}},
        {"data": []},
    ]
    df = spark.createDataFrame([("X", t0, json.dumps(t)) for t in texts] + [("X", t0, None), ("X", t0, "{broken")], FRAME)
    out = normalize.trade_rows(df)
    got = {r.trade_key: r for r in out.where("trade_key IS NOT NULL AND NOT (trade_key = 'id1' AND is_envelope)").collect()}
    assert (got["id1"].side, got["id1"].price, float(got["id1"].size), got["id1"].ts) == ("buy", 100.5, 0.1, t0)
    assert (got["7"].side, got["8"].ts, got["8"].side, got["9"].side) == ("sell", 123, "buy", "sell")
    assert got["id2"].size is None and got["id2"].ts == t0
    assert out.where("is_envelope AND trade_key = 'id1'").first().ts == t0 - 5
    assert out.count() == 8
    kept = normalize.without_cross_form_repeats(out)
    assert kept.where("trade_key = 'id1'").count() == 1 and kept.where("trade_key IS NULL").count() == 2
    assert normalize.plausible(out).where("price IS NULL").count() == 0


def test_cross_form_repeats_stay_inside_their_symbol(spark, rows):
    data = [("A", False, "1", 1.0), ("B", True, "1", 2.0), ("A", True, "1", 3.0), ("A", True, None, 4.0), ("A", True, None, 4.0), (None, False, "2", 5.0), (None, True, "2", 6.0), ("A", True, "2", 7.0)]
    out = normalize.without_cross_form_repeats(spark.createDataFrame(data, "symbol string, is_envelope boolean, trade_key string, price double"), ("symbol",))
    assert [r[0] for r in rows(out, "price")] == [1.0, 2.0, 4.0, 4.0, 5.0, 7.0]
    empty = spark.createDataFrame([], "symbol string, is_envelope boolean, trade_key string, price double")
    assert normalize.without_cross_form_repeats(empty, ("symbol",)).count() == 0


def test_elements_of_other_kinds_do_not_lose_their_neighbours(spark):
    body = json.dumps({"data": [1, "x", {"p": "2", "v": 1e-7, "i": "k"}, None]})
    got = normalize.trade_rows(spark.createDataFrame([("S", 1, body), ("S", 2, json.dumps({"data": {"p": 3.5, "i": "m"}}))], FRAME)).collect()
    assert {(r.trade_key, r.price, None if r.size is None else float(r.size)) for r in got if r.trade_key} == {("k", 2.0, 1e-7), ("m", 3.5, None)}


def test_dropped_trades_are_counted(spark, rows):
    data = [("a", 1.0, 1.0), ("a", 0.0, None), ("a", None, 2.0), ("a", float("nan"), 2.0), ("a", float("inf"), 2.0)]
    out = normalize.counted_drops(spark.createDataFrame(data, "symbol string, price double, size double"), ["symbol"])
    assert rows(out, "n", "kept", "no_price", "bad_price", "no_size") == [(5, 1, 1, 3, 1)]


def test_instrument_names_and_symbols(spark):
    names = ["BTC-27JUN26-70000-C", "XRP_USDC-1JAN27-0d6535-P", "BTC-25AUG26-76500-C-USDT", "BTC-31FEB26-1-C", "BTC-1XXX26-1-P", "BTC", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(*[c.alias(k) for k, c in normalize.parsed_instrument(F.col("n")).items()])
    got = [tuple(r) for r in df.collect()]
    assert got[:3] == [("BTC", "2026-06-27", 70000.0, "C"), ("XRP_USDC", "2027-01-01", 0.6535, "P"), ("BTC", "2026-08-25", 76500.0, "C")]
    assert all(r == (None,) * 4 for r in got[3:])
    s = spark.createDataFrame([("VLTUSDT的 and ABCPERP, VLTUSDT",)], "t string").select(normalize.extracted_symbols(F.col("t")))
    assert s.first()[0] == ["VLTUSDT", "ABCPERP"]


def test_bars_do_not_depend_on_row_order(spark, rows):
    data = [("a", 5, 2.0, 1.0, "buy"), ("a", 5, 1.0, None, "sell"), ("a", 70_000, 3.0, 0.1, None), ("a", 70_000, 9.0, 0.2, "sell"), (None, 1, 1.0, 1.0, "buy")]
    schema = "symbol string, ts long, price double, size double, side string"
    a, b = (bars.ohlcv(spark.createDataFrame(d, schema), ["symbol"]) for d in (data, data[::-1]))
    assert rows(a, *a.columns) == rows(b, *a.columns)
    one = a.where("symbol = 'a' AND minute_idx = 0").first()
    assert (one.px_first, one.px_last, one.n_trades, one.n_size_unparsed, one.vol_total) == (1.0, 2.0, 2, 1, 1.0)
    two = a.where("minute_idx = 1").first()
    assert two.vol_total == 0.1 + 0.2 - 5.551115123125783e-17 or two.vol_total == pytest.approx(0.3, abs=1e-15)
    assert bars.ohlcv(spark.createDataFrame([], schema), ["symbol"]).count() == 0


def test_capped_fill(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, None, 2.0])], "s string, i int, v double")
    got = [r.filled for r in bars.filled_forward(df, ["s"], "i", "v", most=2).orderBy("i").collect()]
    assert got == [None, 1.0, 1.0, 1.0, None, 2.0]


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_brute_force(spark, direction):
    rng = np.random.default_rng(8)
    day = 86_400_000
    reads = [("a" if rng.random() < 0.8 else "b", int(t), float(i), i) for i, t in enumerate(rng.integers(0, 6 * day, 40) // 1000 * 1000)] + [("a", None, 1.0, 99), (None, 5, 1.0, 98), ("a", 7, None, 97)]
    asks = [(i, str(rng.choice(["a", "b", "c"])), int(t)) for i, t in enumerate(rng.integers(0, 6 * day, 60) // 1000 * 1000)] + [(100, None, 5), (101, "a", reads[0][1] if reads[0][0] == "a" else 5)]
    out = align.asof(spark.createDataFrame(asks, "id int, s string, ts long"), spark.createDataFrame(reads, "s string, ts long, v double, k int"), ["s"], "v", direction, tie="k")
    got = {r.id: (r.value, r.value_ts) for r in out.collect()}
    for i, s, t in asks:
        ok = [(u, k, v) for a, u, v, k in reads if a == s and s is not None and u is not None and v is not None and (u <= t if direction == "backward" else u >= t)]
        want = (None, None)
        if ok:
            u = (max if direction == "backward" else min)(x[0] for x in ok)
            want = (max((x for x in ok if x[0] == u), key=lambda x: x[1])[2], u)
        assert got[i] == want, (i, s, t)
    assert len(got) == len(asks)


def test_intervals_and_complete_rows(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "s string, w int")
    gaps = spark.createDataFrame([("a", 1, 9), ("a", 4, 6)], "s string, lo int, hi int")
    assert rows(align.outside_intervals(df, gaps, ["s"], "w"), "s", "w") == [("a", 1), ("a", 9), ("b", 5)]
    assert rows(align.complete_rows(df, "w", "s", 2), "s", "w") == [("a", 5), ("b", 5)]


def test_ranks(spark):
    df = spark.createDataFrame([("g", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, v double")
    assert sorted(r[0] for r in df.select(average_rank("v", ["g"])).collect()) == [1, 2, 3.5, 3.5]
    for n in (1, 7, 10, 23):
        got = [r.b for r in spark.range(n).withColumn("g", F.lit(1)).select("id", floor_bucket(["g"], [F.col("id")], 5).alias("b")).orderBy("id").collect()]
        want = [d for d in range(5) for _ in range(n * d // 5, n * (d + 1) // 5)]
        assert got == want
    flat = spark.createDataFrame([("g", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert spearman(flat, ["g"], "x", "y").first().ic == 0.0


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.005), ("b", 0.04), ("c", 0.03), ("d", 0.2), ("e", None)], "k string, p double")
    assert {r.k for r in rejected(df, "p", 0.1).where("rejected").collect()} == {"a", "b", "c"}
    assert {r.k for r in rejected(df, "p", 0.1, dependent=True).where("rejected").collect()} == {"a"}


def test_book_replay():
    b = ob.Book()
    b.apply("snapshot", 1, [["100", "1"], ["99.5", "2"]], [["101", "4"]])
    b.apply("delta", 2, [["100", "0"]], [["100.5", "1"]])
    assert b.best() == (99.5, 100.5) and b.breaks == 0
    b.apply("delta", 5, [], [])
    b.apply("snapshot", 6, [["1", "1"]], [])
    assert b.breaks == 2 and np.isnan(b.tilt(50))
    b.apply("snapshot", 7, [["99", "3"]], [["101", "1"]])
    assert b.tilt(200) == pytest.approx(0.5)


def test_sampled_books(spark):
    f = lambda ts, u, kind, b, a: ("s", ts, json.dumps({"type": kind, "data": {"u": u, "b": b, "a": a}}))
    data = [f(1000, 1, "snapshot", [["99", "3"]], [["101", "1"]]), f(30_000, 2, "delta", [["99", "1"]], []), f(30_000, 2, "delta", [["99", "1"]], []), f(130_000, 4, "delta", [], [["101", "9"]]), ("s", 131_000, "no json"), (None, 1, "{}")]
    got = [(r.minute_ms, r.tilt, r.breaks) for r in ob.sampled_books(spark.createDataFrame(data, FRAME), 200.0).orderBy("minute_ms").collect()]
    assert got == [(60_000, 0.0, 0), (120_000, 0.0, 0)]
    wide = spark.createDataFrame([("s", 1, [2.0, 1.0], [5.0, 6.0], [3.0], [7.0])], "symbol string, ts long, bid_prices array<double>, bid_sizes array<double>, ask_prices array<double>, ask_sizes array<double>")
    assert ob.exploded_snapshots(wide).count() == 3


def test_queue_bounds():
    times, touch, level = np.array([0.0, 10, 20]), np.array([100.0, 100, 100]), np.array([5.0, 3, 3])
    trades = np.array([[5.0, 100, 1], [15, 100, 4], [18, 99, 9], [30, 100, 2]])
    got = ob.quote_fill(level, touch, times, trades, 0.0, 100.0, 1.0, 60.0, True)
    assert got["fifo_s"] == 30 and got["prorata_s"] == 15 and not got["censored"]
    assert ob.quote_fill(level, touch, times, trades, 0.0, 99.0, 1.0, 60.0, True)["censored"]
    assert ob.icebergs(np.array([5.0, 5, 5, 5, 1]), np.array([1.0, 1, 1, 1, 0])) == 1


def test_backtest(spark):
    data = [("s", t, p, s) for t, p, s in [(0, 100.0, 1.0), (1, 101.0, 0.0), (2, 102.0, -1.0), (3, 103.0, -1.0), (4, 90.0, 0.0)]]
    df = spark.createDataFrame(data, "k string, ts long, price double, signal double")
    got = bt.backtest(df, ["k"], 100, fee=0.0, slip=0.0).orderBy("entry_ts").collect()
    assert [(r.entry_ts, r.exit_ts, r.direction, r.pnl, r.forced) for r in got] == [(0, 2, 1, 2.0, False), (3, 4, -1, 13.0, True)]
    m = bt.measures(bt.backtest(df, ["k"], 100, fee=0.01, slip=0.0), ["k"]).first()
    assert m.trades == 2 and m.total == pytest.approx(15 - 0.01 * (202 + 193))
    assert bt.backtest(df.limit(0), ["k"], 100).count() == 0


def test_lead_lag(spark):
    own = spark.createDataFrame([(t, 100.0 + t / 1000) for t in range(0, 10_000, 100)], "ts long, price double")
    other = spark.createDataFrame([(t, 50.0 + t / 1000) for t in range(0, 10_000, 100)], "ts long, price double")
    got = bt.lead_lag_trips(spark.createDataFrame([(1, 3000)], "id int, ts long"), own, other, 1000, 200, 1000).first()
    assert got.direction == 1 and got.captured_bps == pytest.approx(np.log(104.2 / 103.2) * 1e4)


def test_replicates_are_the_same_whatever_the_partitions(spark, rows):
    x = np.arange(20.0)
    a, b = (rs.replicates(spark, 50, 7, rs.block_bootstrap_mean(x, 3), parts) for parts in (1, 5))
    assert rows(a, "replicate", "statistic") == rows(b, "replicate", "statistic")
    p = rs.p_value(a, 1e9).first()
    assert p.p == pytest.approx(1 / 51)
    rng = np.random.default_rng(0)
    for f in (lambda: rs.circular_blocks(10, 3, rng), lambda: rs.moving_blocks(10, 3, rng), lambda: rs.stationary_blocks(10, 3, rng)):
        i = f()
        assert len(i) == 10 and i.min() >= 0 and i.max() < 10


def test_per_series_edges(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, None), (None, 1, 1.0)], "k string, t int, v double")
    got = per_series(df, ["k"], ["t"], ["v"], lambda t, v: {"n": len(v), "last": v[-1], "gap": int(np.isnan(v).sum())}, "n int, last double, gap int").collect()
    assert [tuple(r) for r in got] == [("a", 2, 5.0, 1)]
    assert per_series(df, ["k"], ["t"], ["v"], lambda t, v: None, "n int").count() == 0


def test_block_windows_equal_plain_ones(spark, rows):
    from pyspark.sql import Window

    from tideglass.operators.blocks import with_last_known, with_previous, with_trailing

    rng = np.random.default_rng(5)
    data = [(str(rng.choice(["a", "b"])) if i % 9 else None, int(t), i, float(i) if i % 3 else None) for i, t in enumerate(rng.integers(0, 1000, 200))]
    df = spark.createDataFrame(data, "k string, ts long, id long, v double").withColumn("_x", F.lit(1))
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = with_previous(df, ["k"], ["ts", "id"], ["id", "v"], block_ms=50).select("id", F.col("prev.id").alias("p"))
    assert rows(got, "id", "p") == rows(df.select("id", F.lag("id").over(w).alias("p")), "id", "p")
    known = F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("z")
    assert rows(with_last_known(df, ["k"], ["ts", "id"], "v", "z", 50), "id", "z") == rows(df.select("id", known), "id", "z")
    for back, ahead in ((30, 0), (120, -1), (10, 20)):
        plain = df.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("ts").rangeBetween(-back, ahead)).alias("z"))
        assert rows(with_trailing(df, ["k"], "ts", back, ahead, {"z": F.sum("v")}, 50), "id", "z") == rows(plain, "id", "z")


def test_books_carry_over_days_from_the_last_snapshot(spark):
    day = 86_400_000
    f = lambda ts, kind, b, a: ("s", ts, json.dumps({"type": kind, "data": {"b": b, "a": a}}))
    data = [f(day - 90_000, "snapshot", [["99", "5"]], [["101", "5"]]), f(day - 30_000, "delta", [["99", "3"]], [["101", "1"]]), f(day + 70_000, "delta", [], [["101", "3"]]), f(3 * day + 10, "delta", [["99", "9"]], []), f(3 * day + 60_010, "snapshot", [["98", "1"]], [["102", "1"]])]
    got = {r.minute_ms: r.tilt for r in ob.sampled_books(spark.createDataFrame(data, FRAME), 200.0).collect()}
    assert got[day - 60_000] == 0.0 and got[day] == pytest.approx(0.5) and got[day + 60_000] == pytest.approx(0.5) and got[2 * day] == 0.0 and got[3 * day + 60_000] == pytest.approx(0.5)
    assert len(got) == (3 * day + 60_010) // 60_000 - (day - 90_000) // 60_000


def test_quotes_and_icebergs_over_frames(spark, rows):
    quotes = spark.createDataFrame([("s", t, 99.0, 5.0 - (t >= 70_000), 101.0, 4.0) for t in range(0, 400_000, 10_000)], "symbol string, ts long, bid1_price double, bid1_size double, ask1_price double, ask1_size double")
    trades = spark.createDataFrame([("s", 65_000, "sell", 99.0, 5.5), ("s", 66_000, "buy", 100.0, 50.0), ("s", 67_000, None, 99.0, 50.0)], "symbol string, ts long, side string, price double, size double")
    got = {(r.side, r.placed_ms): (r.fifo_s, r.prorata_s) for r in ob.quote_fills(quotes, trades, 0.1, 120_000, 300_000).collect()}
    assert got["bid", 60_000] == (5.0, 5.0) and got["ask", 60_000] == (None, None) and got["bid", 120_000] == (None, None)
    assert set(got) == {(s, t) for s in ("bid", "ask") for t in range(0, 390_001, 60_000)}
    levels = spark.createDataFrame([("s", t, "bid", 99.0, 5.0 if t < 50 else 1.0) for t in range(0, 60, 10)], "symbol string, ts long, side string, price double, size double")
    hits = spark.createDataFrame([("s", t, "sell", 99.0) for t in range(5, 60, 10)], "symbol string, ts long, side string, price double")
    assert rows(ob.refilled_levels(levels, hits), "symbol", "side", "price", "hits", "found") == [("s", "bid", 99.0, 5, 2)]
    assert ob.refilled_levels(levels.limit(0), hits).count() == 0 and ob.quote_fills(quotes.limit(0), trades, 0.1, 1000, 1000).count() == 0


def test_percentiles_without_buffers(spark):
    rng = np.random.default_rng(8)
    data = [("a", float(v)) for v in rng.integers(0, 40, 301)] + [("b", 2.5), ("b", None), ("c", None), (None, 1.0), (None, 2.0)]
    at = [0.0, 0.125, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in exact_percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", at, "q").collect()}
    assert set(got) == {"a", "b", None} and got["b"] == [2.5] * 5 and got[None][2] == 1.5
    assert np.allclose(got["a"], np.quantile([v for k, v in data if k == "a"], at))
