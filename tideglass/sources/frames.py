"""Readers of raw frame trees, files, manifests and bar caches, and a replaying streaming source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

CONTAINER = "ts_local_ns long, ts_exchange_ms long, topic string, stream string, symbol string, payload_json string, date string"


def _children(spark: SparkSession, folder: str, key: str) -> list[tuple[str, str]]:
    """(value, path) of the partition folders ``key=value`` directly below ``folder``; files are not looked at."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted((n.partition("=")[2], f"{folder}/{n}") for n in names if n.startswith(f"{key}="))


def raw_frames(spark: SparkSession, root: str, exchange: str, stream: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Frames of ``root/raw/exchange/stream/symbol=*/date=*`` with the columns of ``CONTAINER``.

    The schema is given, so no footer is opened to find it: columns a file lacks are null, further
    ones are not read, and symbols and dates stay text. Symbols and days are chosen by folder name
    before anything below them is listed. No folder at all gives no rows.
    """
    base = f"{root}/raw/{exchange}/{stream}"
    kept = [p for s, p in _children(spark, base, "symbol") if symbols is None or s in symbols]
    if first is not None or last is not None:
        kept = [p for k in kept for d, p in _children(spark, k, "date") if (first is None or d >= first) and (last is None or d <= last)]
    if not kept:
        return spark.createDataFrame([], CONTAINER)
    return spark.read.schema(CONTAINER).option("basePath", base).parquet(*kept).select(*[c.split()[0] for c in CONTAINER.split(", ")])


def existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The parquet paths that exist; an error if none does."""
    jvm = spark._jvm
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found.append(p)
    if not found:
        raise FileNotFoundError(f"none of {len(paths)} paths exists, the first is {paths[0] if paths else None}")
    return spark.read.option("mergeSchema", True).parquet(*found)


def latest_ticks(trades: DataFrame, start_ms: int, end_ms: int, most: int) -> DataFrame:
    """The first ``most`` trades of each symbol in [start, end) by (ts, trade_key): the bounded window scan."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts", "trade_key")
    return trades.where((F.col("ts") >= start_ms) & (F.col("ts") < end_ms)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def tabular(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV (with header, strict) or parquet file by its suffix, with exactly the columns of ``schema``."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    df = spark.read.parquet(path)
    wanted = [c.strip().split()[0] for c in schema.split(",")]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*wanted)


def listed_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file that is a bare list or wraps one in ``result.list``; one JSON text per row."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    inner = F.when(F.ltrim("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.result.list"))
    return whole.select(F.explode(F.from_json(inner, "array<string>")).alias("entry"))


def done_days(manifest: DataFrame, exchange: str, stream: str, symbol: str) -> DataFrame:
    """Days of a manifest whose latest row says DONE."""
    own = manifest.where((F.col("exchange") == exchange) & (F.col("stream") == stream) & (F.col("symbol") == symbol))
    latest = own.groupBy("date").agg(F.max_by("status", "updated_at").alias("status"))
    return latest.where("status = 'DONE'").select("date")


def cached_bars(spark: SparkSession, folder: str, manifest: DataFrame, version: int, first: str, last: str) -> DataFrame:
    """Bars of the days from ``first`` to ``last``; a day without manifest entry or of another version is an error, absent days are absent."""
    bars = spark.read.parquet(folder).where(F.col("date").between(first, last))
    good = manifest.where(F.col("version") == version).select(F.col("date").cast(bars.schema["date"].dataType).alias("date")).distinct().withColumn("_ok", F.lit(True))
    checked = bars.join(good, "date", "left")
    return checked.where(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("bars of another version or without manifest: "), F.col("date").cast("string"))).cast("boolean"))).drop("_ok")


class ReplaySource(DataSource):
    """Frames from JSON-lines files as a stream, ``rows`` per trigger: the venue's socket without a network.

    Option ``path`` is a file of lines with the container's fields, ``rows`` how many each trigger takes.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_replay"

    def schema(self) -> str:
        return CONTAINER

    def simpleStreamReader(self, schema):  # noqa: N802
        return ReplayReader(self.options)


class ReplayReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", "1000"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def _lines(self, lo: int, hi: int) -> Iterator[tuple]:
        names = [c.strip().split()[0] for c in CONTAINER.split(",")]
        with open(self.path, encoding="utf-8") as f:
            for k, line in enumerate(f):
                if k >= hi:
                    break
                if k >= lo:
                    frame = json.loads(line)
                    yield tuple(frame.get(n) for n in names)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got = list(self._lines(start["line"], start["line"] + self.rows))
        return iter(got), {"line": start["line"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._lines(start["line"], end["line"])


def garch_klines(spark: SparkSession, series: int, bars: int, seed: int, alpha: float = 0.08, beta: float = 0.9) -> DataFrame:
    """Synthetic one-minute klines with GARCH(1,1) returns, one series per row of spark.range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for k in b.column("id").to_pylist():
                rng = np.random.default_rng([seed, k])
                z, var, r = rng.standard_normal(bars), 1e-7, np.empty(bars)
                for i in range(bars):
                    r[i] = z[i] * var**0.5
                    var = 1e-7 * (1 - alpha - beta) + alpha * r[i] ** 2 + beta * var
                close = 100 * np.exp(np.cumsum(r))
                open_ = np.concatenate([[100.0], close[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(bars, k)), pa.array(np.arange(bars) * 60_000), pa.array(open_), pa.array(np.maximum(open_, close)), pa.array(np.minimum(open_, close)), pa.array(close), pa.array(rng.exponential(10, bars))],
                    names=["series", "ts", "open", "high", "low", "close", "volume"],
                )

    return spark.range(series).mapInArrow(run, "series long, ts long, open double, high double, low double, close double, volume double")
