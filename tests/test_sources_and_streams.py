import json

import pytest
from pyspark.sql import functions as F

from tideglass.sources import frames, sinks
from tideglass.streaming import streams

CONTAINER = "ts_local_ns long, ts_exchange_ms long, topic string, stream string, symbol string, payload_json string"


def frame(ts, topic, symbol, payload, local=None):
    return ((local or ts) * 1_000_000, ts, topic, topic.split(".")[0], symbol, json.dumps(payload))


def test_raw_tree_prunes_and_tolerates_missing_columns(spark, tmp_path):
    base = f"{tmp_path}/raw/x/trades"
    for s in ("A", "B"):
        for d in ("2024-01-01", "2024-01-02"):
            spark.createDataFrame([(1, "{}")], "ts_exchange_ms long, payload_json string").write.parquet(f"{base}/symbol={s}/date={d}")
    df = frames.raw_frames(spark, str(tmp_path), "x", "trades", ["A"], "2024-01-02", "2024-01-02")
    assert df.count() == 1 and {"topic", "stream", "ts_local_ns"} <= set(df.columns)
    assert frames.existing(spark, [f"{base}/symbol=A/date=2024-01-01", f"{base}/none"]).count() == 1
    with pytest.raises(FileNotFoundError):
        frames.existing(spark, [f"{base}/none"])


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ts,price\n1,2.5\n")
    assert frames.tabular(spark, str(tmp_path / "t.csv"), "ts long, price double").first().price == 2.5
    spark.createDataFrame([(1,)], "ts long").write.parquet(f"{tmp_path}/p.parquet")
    with pytest.raises(ValueError):
        frames.tabular(spark, f"{tmp_path}/p.parquet", "ts long, price double")
    (tmp_path / "o.json").write_text("﻿" + json.dumps({"result": {"list": [{"symbol": "S1"}, {"symbol": "S2"}]}}), encoding="utf-8")
    assert frames.listed_json(spark, str(tmp_path / "o.json")).count() == 2


def test_immutable_partitions_and_versions(spark, tmp_path, rows):
    bars = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "date string, px double")
    folder, manifest = f"{tmp_path}/bars", f"{tmp_path}/manifest"
    sinks.write_immutable(bars, folder, ["date"], manifest, 1)
    sinks.write_immutable(bars.withColumn("px", F.lit(9.0)).union(spark.createDataFrame([("2024-01-03", 3.0)], "date string, px double")), folder, ["date"], manifest, 2)
    assert sorted(r.px for r in spark.read.parquet(folder).collect()) == [1.0, 2.0, 3.0]
    m = spark.read.parquet(manifest)
    assert frames.cached_bars(spark, folder, m, 1, "2024-01-01", "2024-01-02").count() == 2
    with pytest.raises(Exception, match="another version"):
        frames.cached_bars(spark, folder, m, 1, "2024-01-01", "2024-01-03").collect()
    a, b = sinks.fingerprint(bars, ["date"]), sinks.fingerprint(bars.orderBy(F.desc("px")), ["date"])
    assert rows(a, *a.columns) == rows(b, *a.columns)


def test_manifest_status_archive_merge_usage(spark, tmp_path, rows):
    m = spark.createDataFrame([("x", "t", "S", "d1", "PARTIAL", 1), ("x", "t", "S", "d1", "DONE", 2), ("x", "t", "S", "d2", "DONE", 1), ("x", "t", "S", "d2", "FAILED", 3)], "exchange string, stream string, symbol string, date string, status string, updated_at int")
    assert rows(frames.done_days(m, "x", "t", "S"), "date") == [("d1",)]
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("c", 1)], "s string, start_ms int")
    assert rows(sinks.panel_status(p, ["s"], 2), "s", "status") == [("a", "DONE"), ("b", "EMPTY"), ("c", "PARTIAL")]
    hot = spark.createDataFrame([(1,), (86_400_000,), (None,)], "ts long")
    sinks.archive(hot, 1000, f"{tmp_path}/raw/x/cold", f"{tmp_path}/rest")
    assert spark.read.parquet(f"{tmp_path}/raw/x/cold").count() == 1 and spark.read.parquet(f"{tmp_path}/rest").count() == 2
    assert sinks.disk_usage(spark, f"{tmp_path}/raw").where("stream = 'cold'").first().files == 1
    assert sinks.beyond_cap(spark, f"{tmp_path}/raw", 0).count() == 1 and sinks.beyond_cap(spark, f"{tmp_path}/raw", 1 << 30).count() == 0
    r = spark.createDataFrame([("k", "p1", 1)], "key string, parameters string, v int")
    assert sinks.merged(r, r, ["key"]).count() == 1
    with pytest.raises(Exception, match="different parameters"):
        sinks.merged(r, r.withColumn("parameters", F.lit("p2")), ["key"]).collect()


def test_synthetic_klines_are_repeatable(spark, rows):
    a, b = (frames.garch_klines(spark, 2, 50, 1) for _ in range(2))
    assert rows(a, "series", "ts", "close") == rows(b, "series", "ts", "close") and a.where("high < low").count() == 0


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streaming_bars_drop_repeats(spark, tmp_path):
    t = 1_700_000_000_000 // 60_000 * 60_000
    trade = lambda ts, i, px: frame(ts, "publicTrade.S", "S", {"data": [{"T": ts, "S": "Buy", "v": "1", "p": str(px), "i": i}]})
    data = [trade(t + 1000, "a", 10), trade(t + 2000, "b", 12), trade(t + 2000, "b", 12), trade(t + 200_000, "c", 9)]
    spark.createDataFrame(data, CONTAINER).write.parquet(f"{tmp_path}/in")
    rows = streams.routed(streams.frames(spark, f"{tmp_path}/in"))
    assert set(rows) == {"trades", "tickers"}
    got = drained(streams.streaming_bars(rows["trades"]), "bars", "append").where(F.col("start_ms") == t).first()
    assert (got.px_first, got.px_last, got.n_trades) == (10.0, 12.0, 2)
    again = streams.routed(streams.frames(spark, f"{tmp_path}/in"))["trades"]
    assert drained(streams.streaming_sessions(again), "sessions").where(f"start_ms = {t + 1000}").first().n == 3


def test_streaming_bars_keep_trades_without_key_and_equal_keys_of_two_symbols(spark, tmp_path):
    t = 1_700_000_000_000 // 60_000 * 60_000
    trade = lambda s, ts, i: frame(ts, f"publicTrade.{s}", s, {"data": [{"T": ts, "S": "Buy", "v": "1", "p": "10", **({"i": i} if i else {})}]})
    data = [trade("B", t + 1, None)] * 5 + [trade("B", t + 2, "k"), trade("C", t + 3, "k"), trade("C", t + 3, "k"), trade("B", t + 200_000, "z")]
    spark.createDataFrame(data, CONTAINER).write.parquet(f"{tmp_path}/in")
    rows = streams.routed(streams.frames(spark, f"{tmp_path}/in"))["trades"]
    got = drained(streams.streaming_bars(rows), "bars_of_keys").where(F.col("start_ms") == t).collect()
    assert {r.symbol: r.n_trades for r in got} == {"B": 6, "C": 1}


def test_latest_and_throttled_streams(spark, tmp_path):
    spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("a", 3, 3.0), ("b", 1, None)], "symbol string, ts long, last_price double").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("symbol string, ts long, last_price double").parquet(f"{tmp_path}/in")
    last = drained(streams.latest_per_key(stream(), "symbol", "last_price"), "latest", "update")
    assert [tuple(r) for r in last.collect()] == [("a", 9, 2.0)]
    kept = drained(streams.throttled_stream(stream(), "symbol", 5), "throttled")
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 3), ("a", 9), ("b", 1)]


def test_replay_source_and_segments(spark, tmp_path):
    lines = [{"ts_exchange_ms": 86_400_000 * k, "topic": "tickers.S", "symbol": "S", "payload_json": json.dumps({"data": {"lastPrice": str(k)}})} for k in range(5)]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    spark.dataSource.register(frames.ReplaySource)
    src = spark.readStream.format("frame_replay").option("path", str(tmp_path / "f.jsonl")).option("rows", 2).load()
    q = streams.segments(streams.routed(src)["tickers"], f"{tmp_path}/out", f"{tmp_path}/cp", "0 seconds")
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 5 and out.select("date").distinct().count() == 5 and sorted(r.last_price for r in out.collect()) == [0, 1, 2, 3, 4]


def test_raw_tree_keeps_text_of_symbols_and_dates(spark, tmp_path):
    base = f"{tmp_path}/raw/x/trades"
    spark.createDataFrame([(1, "{}", 5)], "ts_exchange_ms long, payload_json string, more int").write.parquet(f"{base}/symbol=007/date=2024-01-01")
    spark.createDataFrame([(2, "t")], "ts_exchange_ms long, topic string").write.parquet(f"{base}/symbol=A/date=2024-01-02")
    df = frames.raw_frames(spark, str(tmp_path), "x", "trades")
    assert [tuple(r) for r in df.orderBy("ts_exchange_ms").select("symbol", "date", "topic", "payload_json").collect()] == [("007", "2024-01-01", None, "{}"), ("A", "2024-01-02", "t", None)]
    assert ", ".join(f"{n} {k.replace('bigint', 'long')}" for n, k in df.dtypes) == frames.CONTAINER
    assert frames.raw_frames(spark, str(tmp_path), "x", "none").count() == 0


def test_a_failed_write_leaves_no_second_copy(spark, tmp_path, monkeypatch):
    bars = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "date string, px double")
    folder, manifest = f"{tmp_path}/bars", f"{tmp_path}/manifest"
    whole = sinks._published

    def lost(*a):
        whole(*a)
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(sinks, "_published", lost)
    with pytest.raises(RuntimeError):
        sinks.write_immutable(bars, folder, ["date"], manifest, 1)
    monkeypatch.setattr(sinks, "_published", whole)
    sinks.write_immutable(bars, folder, ["date"], manifest, 1)
    assert spark.read.parquet(folder).count() == 2 and spark.read.parquet(manifest).count() == 2
    hot = spark.createDataFrame([(1,), (86_400_000,)], "ts long")
    for _ in range(2):
        sinks.archive(hot, 1000, f"{tmp_path}/cold", f"{tmp_path}/rest")
    assert spark.read.parquet(f"{tmp_path}/cold").count() == 1


def test_unfinished_panel_years_are_refused_and_frozen_ones_stay(spark, tmp_path):
    rows = lambda n, v: spark.createDataFrame([("A", 2020, k, v) for k in range(n)], "symbol string, year int, start_ms long, close double")
    folder, manifest = f"{tmp_path}/panel", f"{tmp_path}/m"
    sinks.write_panel(rows(1, 1.0), folder, manifest, 2)
    with pytest.raises(Exception, match="not a whole partition"):
        sinks.read_panel(spark, folder, manifest).collect()
    sinks.write_panel(rows(2, 2.0), folder, manifest, 2, frozen=True)
    sinks.write_panel(rows(2, 3.0), folder, manifest, 2)
    assert {r.close for r in sinks.read_panel(spark, folder, manifest).collect()} == {2.0}
