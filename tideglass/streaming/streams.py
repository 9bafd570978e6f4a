"""Structured Streaming: declared streams, event-time bars with lateness, sessions, latest values, throttled evaluation."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.functions.events import event_ms
from tideglass.operators.normalize import plausible, ticker_field, trade_rows
from tideglass.sources.sinks import projected

FRAME = "ts_local_ns long, ts_exchange_ms long, topic string, stream string, symbol string, payload_json string"


@dataclass(frozen=True)
class StreamDef:
    """A stream: the topics it takes, how frames become rows; one that is not ``active`` is declared only."""

    name: str
    topic_prefix: str
    rows: Callable[[DataFrame], DataFrame]
    active: bool = True


def ticker_rows(frames: DataFrame) -> DataFrame:
    body = F.col("payload_json")
    fields = {"last_price": "lastPrice", "mark_price": "markPrice", "index_price": "indexPrice", "funding_rate": "fundingRate"}
    return frames.select("symbol", F.col("ts_exchange_ms").alias("ts"), (F.col("ts_local_ns") / 1e9).alias("recv_ts"), *[ticker_field(body, f).alias(c) for c, f in fields.items()])


STREAMS = (
    StreamDef("trades", "publicTrade.", lambda f: plausible(trade_rows(f, keep=("symbol",)))),
    StreamDef("tickers", "tickers.", ticker_rows),
    StreamDef("liquidations", "liquidation.", lambda f: trade_rows(f, keep=("symbol",)), active=False),
)


def frames(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Raw frames as they appear in a folder of parquet files."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def routed(source: DataFrame, streams: tuple[StreamDef, ...] = STREAMS) -> dict[str, DataFrame]:
    """One DataFrame of rows per active stream, by topic."""
    return {s.name: s.rows(source.where(F.col("topic").startswith(s.topic_prefix))) for s in streams if s.active}


def with_event_time(rows: DataFrame, lateness: str) -> DataFrame:
    """``event_time`` from ts (receive time where ts is 0) and its watermark."""
    recv = F.col("recv_ts") if "recv_ts" in rows.columns else F.lit(None).cast("double")
    return rows.withColumn("event_time", F.timestamp_millis(event_ms(F.col("ts"), recv))).withWatermark("event_time", lateness)


def streaming_bars(trades: DataFrame, width: str = "1 minute", lateness: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Bars by event time; a record delivered again within the lateness counts once, one beyond it is dropped.

    A record is (symbol, trade_key): symbols may share keys. Trades without a key can't be told apart
    and all count: each gets a key of its own, so one watermark holds for all of them.
    """
    own = F.coalesce("trade_key", F.concat(F.lit("\0"), F.uuid()))
    timed = with_event_time(trades.withColumn("_key", own), lateness).dropDuplicatesWithinWatermark(["symbol", "_key"])
    at = F.struct("ts", "price")
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return timed.groupBy(w, "symbol").agg(
        F.min_by("price", at).alias("px_first"), F.max_by("price", at).alias("px_last"), F.max("price").alias("px_high"), F.min("price").alias("px_low"), F.sum("size").alias("vol_total"), F.count(F.lit(1)).alias("n_trades")
    ).select(F.unix_millis("window.start").alias("start_ms"), "symbol", "px_first", "px_last", "px_high", "px_low", "vol_total", "n_trades")


def streaming_sessions(rows: DataFrame, gap: str = "30 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Runs of activity of a symbol without a pause of ``gap``."""
    timed = with_event_time(rows, lateness)
    return timed.groupBy(F.session_window("event_time", gap), "symbol").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis("session_window.end").alias("end_ms"), "symbol", "n")


def latest_per_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value with the greatest ts of each key, kept over batches (update mode); null times and values are none.

    An aggregate on the JVM: state is one row per key, combined before the exchange.
    """
    known = rows.where(F.col("ts").isNotNull() & F.col(value).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(key).agg(F.max(F.struct("ts", value)).alias("_last")).select(key, "_last.ts", f"_last.{value}")


def throttled_stream(rows: DataFrame, key: str, least_ms: int) -> DataFrame:
    """Rows of each key at most one per ``least_ms`` of event time, greedily in order within a batch."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(1 << 60)
        for p in parts:
            keep = []
            for t in sorted(p["ts"].dropna().astype("int64")):
                if t - last >= least_ms:
                    keep.append(t)
                    last = t
            if keep:
                yield pd.DataFrame({key: k[0], "ts": keep})
        state.update((last,))

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, ts long", "last long", "append", GroupStateTimeout.NoTimeout)


def recent(rows: DataFrame, key: str, ts: str, value: str, span_ms: int, most: int) -> DataFrame:
    """Fixed-capacity buffers: per key and batch, count, sum and last of the newest ``most`` values within ``span_ms`` (update mode).

    State holds at most ``most`` (time, value) pairs per key. A record older than the span against the
    newest of its key is passed over; null times, values and keys are none. Records of one key and
    batch are taken in together, in order of time.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame({ts: state.get[0], value: state.get[1]})] if state.exists else []
        every = pd.concat([*held, *[p[[ts, value]] for p in parts]]).sort_values([ts, value], kind="stable")
        kept = every[every[ts] > every[ts].max() - span_ms].tail(most)
        state.update((kept[ts].astype("int64").tolist(), kept[value].astype(float).tolist()))
        yield pd.DataFrame({key: [k[0]], "ts": [int(kept[ts].iloc[-1])], "n": [len(kept)], "total": [float(kept[value].sum())], "last": [float(kept[value].iloc[-1])]})

    known = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).select(key, ts, value)
    return known.groupBy(key).applyInPandasWithState(step, f"{key} string, ts long, n long, total double, last double", "times array<long>, values array<double>", "update", GroupStateTimeout.NoTimeout)


def next_settlement(rows: DataFrame, ts: str, every_ms: int = 28_800_000) -> DataFrame:
    """``rows`` with the settlement each falls before and how long until then: what a scheduler's timers would fire on."""
    due = (F.floor(F.col(ts) / every_ms) + 1) * every_ms
    return rows.withColumn("settles_ms", due).withColumn("left_ms", due - F.col(ts))


class Heartbeat(StreamingQueryListener):
    """The last progress of every query as a small JSON file that other programs may read; replaced as a whole by rename."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._write({"id": str(event.id), "state": "started"})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._write({"id": str(p.id), "state": "running", "batch": p.batchId, "rows": p.numInputRows, "at": p.timestamp})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._write({"id": str(event.id), "state": "idle"})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write({"id": str(event.id), "state": "stopped", "error": event.exception})

    def _write(self, what: dict) -> None:
        with open(f"{self.path}.tmp", "w", encoding="utf-8") as f:
            json.dump(what, f)
        os.replace(f"{self.path}.tmp", self.path)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now and return the rows it gave, as a table in ``folder``.

    In update mode every batch's rows are kept with its number (``_batch``): the newest row of a key is
    that of its last batch.
    """
    w = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{folder}/rows").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/part={n}")).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = stream.schema if mode == "append" else stream.schema.add("_batch", "long")
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def segments(rows: DataFrame, folder: str, checkpoint: str, every: str = "10 seconds", schema: str | None = None, version: int | None = None):
    """Write rows as date-partitioned parquet segments, exactly once over restarts; returns the started query.

    Segments close by time, or sooner where the source bounds the rows of a batch. With ``schema`` the
    rows have exactly its columns, with ``version`` they say under which version they were written.
    Rows of a failed batch stay with the source and are taken again after a restart.
    """
    if schema is not None:
        rows = projected(rows, schema)
    if version is not None:
        rows = rows.withColumn("schema_version", F.lit(version))
    dated = rows.withColumn("date", F.to_date(F.timestamp_millis("ts")))
    return dated.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("date").trigger(processingTime=every).start()
