"""Paged sources behind an injected fetcher, row validators and panels of two trees."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fetcher = Callable[[dict], dict]


def pages(fetch: Fetcher, request: dict, most: int = 10_000, pause_s: float = 0.0, tries: int = 1, busy: int = 10_006, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Entries of all pages, following ``result.nextPageCursor``; a layout without ``result.list`` is an error.

    ``pause_s`` lies between requests. An answer with the code ``busy`` (rate limit) or a lost
    connection is tried again after 1, 2, 4, ... seconds, ``tries`` times in all.
    """
    cursor: str | None = ""
    for k in range(most):
        if k and pause_s:
            sleep(pause_s)
        for attempt in range(tries):
            try:
                page = fetch(request | ({"cursor": cursor} if cursor else {}))
            except ConnectionError:
                if attempt + 1 == tries:
                    raise
                sleep(2.0**attempt)
                continue
            if page.get("retCode", 0) != busy or attempt + 1 == tries:
                break
            sleep(2.0**attempt)
        if page.get("retCode", 0) != 0:
            raise OSError(f"the source answered {page.get('retCode')}: {page.get('retMsg')}")
        if not isinstance(page.get("result", {}).get("list"), list):
            raise ValueError(f"unknown layout: {str(page)[:200]}")
        yield from page["result"]["list"]
        cursor = page["result"].get("nextPageCursor")
        if not cursor:
            return
    raise OSError(f"more than {most} pages")


def pages_back(fetch: Fetcher, request: dict, start_ms: int, end_ms: int, key: str = "start", most: int = 10_000) -> Iterator[dict]:
    """Entries of [start, end) of a source that gives the newest first: each request ends where the last page began."""
    end = end_ms
    for _ in range(most):
        page = list(pages(fetch, request | {"end": end}))
        kept = [e for e in page if start_ms <= int(e[key]) < end]
        yield from kept
        if not kept or min(int(e[key]) for e in page) <= start_ms:
            return
        end = min(int(e[key]) for e in kept)
    raise OSError(f"more than {most} pages")


def still_to_fetch(requests: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Requests of a history whose key the manifest does not have as DONE: what makes a backfill safe to repeat."""
    return requests.join(done.where("status = 'DONE'").select(*key).distinct(), key, "leftanti")


def canned(responses: list[dict]) -> Fetcher:
    """A fetcher that gives these responses in turn, for tests without a network."""
    left = list(responses)
    return lambda request: left.pop(0)


def paged(requests: DataFrame, fetch: Fetcher, schema: str, row: Callable[[dict, dict], tuple], walk: Callable[[Fetcher, dict], Iterator[dict]] = pages) -> DataFrame:
    """One request per row of ``requests``, fetched where the row lies; ``row(request, entry)`` gives a tuple of ``schema``.

    ``walk`` goes through the pages of a request: ``pages`` (cursors) or ``pages_back`` (newest first).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for request in b.to_pylist():
                rows = [row(request, e) for e in walk(fetch, request)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return requests.mapInArrow(run, schema)


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    from pyspark.sql import Window

    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; reading one in which a column is null is an error that shows it."""
    out = rows
    for c in columns:
        shown = F.concat(F.lit(f"{c} is missing in "), F.to_json(F.struct(*rows.columns)))
        out = out.where(F.when(F.col(c).isNotNull(), True).otherwise(F.raise_error(shown).cast("boolean")))
    return out


def not_after(rows: DataFrame, day: str, cut: str) -> DataFrame:
    """The rows; one past the cut day is an error."""
    late = F.concat(F.lit(f"a row lies after {cut}: "), F.col(day).cast("string"))
    return rows.where(F.when(F.col(day) <= F.lit(cut), True).otherwise(F.raise_error(late).cast("boolean")))


def linear_universe(symbol: Column) -> Column:
    """Symbols quoted in USDT that are no dated contract."""
    return symbol.endswith("USDT") & ~symbol.contains("-")


def mapped(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Names replaced by a small map; others stay."""
    if not names:
        return rows
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def panel_union(alive: DataFrame, ended: DataFrame, value: str = "close") -> DataFrame:
    """Two panels (symbol, day, value) as one: a day in both counts once if equal and is an error if not."""
    a, b = alive.select("symbol", "day", F.col(value).alias("_a")), ended.select("symbol", "day", F.col(value).alias("_b"))
    both = a.join(b, ["symbol", "day"], "full")
    clash = F.concat(F.lit("two values for "), F.col("symbol").cast("string"), F.lit(" on "), F.col("day").cast("string"))
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") == F.col("_b")), True).otherwise(F.raise_error(clash).cast("boolean"))
    return both.where(ok).select("symbol", "day", F.coalesce("_a", "_b").alias(value))


def renamed_relistings(alive: DataFrame, ended: DataFrame) -> DataFrame:
    """``ended`` with symbols that live again called ``symbol#delisted``; one join on the symbols."""
    again = alive.select("symbol").distinct().withColumn("_again", F.lit(True))
    return ended.join(again, "symbol", "left").withColumn("symbol", F.when(F.col("_again"), F.concat("symbol", F.lit("#delisted"))).otherwise(F.col("symbol"))).drop("_again")


def delisted_rows(payloads: DataFrame) -> DataFrame:
    """Klines given as objects or as positional lists, as typed rows (symbol, start_ms, open, close); broken ones are null."""
    p = F.col("payload")
    listed = F.from_json(p, "array<string>")
    pick = lambda name, k: F.when(F.ltrim(p).startswith("["), F.try_element_at(listed, F.lit(k + 1))).otherwise(F.get_json_object(p, f"$.{name}"))
    return payloads.select("symbol", pick("start", 0).try_cast("bigint").alias("start_ms"), pick("open", 1).try_cast("double").alias("open"), pick("close", 4).try_cast("double").alias("close"))


def nearest_snapshot(entries: DataFrame, target_ms: int, window_ms: int, key: str, ts: str = "ts") -> DataFrame:
    """Each key's last entry within ``window_ms`` of the target; where there is none at all, that of the closest time (``fallback``)."""
    away = F.abs(F.col(ts) - target_ms)
    inside = entries.where(away <= window_ms)
    fallback = inside.isEmpty()
    if fallback:
        at = entries.agg(F.min_by(ts, F.struct(away, ts))).first()[0]
        inside = entries.where(F.col(ts) == at)
    cols = [c for c in entries.columns if c != key]
    last = inside.groupBy(key).agg(F.max_by(F.struct(*cols), ts).alias("_e"))
    return last.select(key, *[F.col(f"_e.{c}").alias(c) for c in cols], F.lit(fallback).alias("fallback"))


def lead_lag_pair(spark: SparkSession, bars: int, lag: int, alpha: float, seed: int) -> DataFrame:
    """Two synthetic series, the second following the first after ``lag`` bars with weight ``alpha``."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a = rng.standard_normal(bars)
    b = rng.standard_normal(bars)
    b[lag:] = alpha * a[:-lag] + (1 - alpha) * b[lag:]
    return spark.createDataFrame(list(zip(range(bars), np.cumsum(a).tolist(), np.cumsum(b).tolist(), strict=True)), "bar long, leader double, follower double")
