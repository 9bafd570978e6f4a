"""Order books from snapshot and delta frames: replay, breaks, tilt, spread, queue fills, icebergs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS
from tideglass.operators.grouped import per_series
from tideglass.operators.snapshot_diff import snapshot_changes

MINUTE_MS = 60_000


class Book:
    """Price levels per side, keyed by the exact text of the price; size 0 deletes a level.

    ``apply`` takes (kind, update id, bids, asks). An update id that doesn't follow the last one is
    a break; a snapshot that differs from the replayed book is a break too and resets it.
    """

    def __init__(self):
        self.sides: tuple[dict[str, float], dict[str, float]] = ({}, {})
        self.last: int | None = None
        self.breaks = 0

    def apply(self, kind: str, update: int | None, bids: list, asks: list) -> None:
        if kind == "snapshot":
            fresh = tuple({p: float(s) for p, s in side if float(s) > 0} for side in (bids, asks))
            if self.last is not None and fresh != self.sides:
                self.breaks += 1
            self.sides = fresh
        else:
            if self.last is not None and update is not None and update != self.last + 1:
                self.breaks += 1
            for side, changes in zip(self.sides, (bids, asks), strict=True):
                for price, size in changes:
                    if float(size) == 0:
                        side.pop(price, None)
                    else:
                        side[price] = float(size)
        self.last = update if update is not None else self.last

    def best(self) -> tuple[float, float]:
        """Best bid and ask; NaN for an empty side."""
        bids, asks = self.sides
        return max(map(float, bids), default=np.nan), min(map(float, asks), default=np.nan)

    def tilt(self, band_bp: float) -> float:
        """(bid size - ask size) / (their sum) within ``band_bp`` of the mid; NaN if there is none."""
        bid, ask = self.best()
        mid = (bid + ask) / 2
        if not np.isfinite(mid):
            return np.nan
        low, high = mid * (1 - band_bp / 1e4), mid * (1 + band_bp / 1e4)
        b = sum(s for p, s in self.sides[0].items() if float(p) >= low)
        a = sum(s for p, s in self.sides[1].items() if float(p) <= high)
        return (b - a) / (b + a) if a + b > 0 else np.nan


def frame_parts(payload: str) -> tuple[str, int | None, list, list]:
    """(kind, update id, bids, asks) of an order book frame."""
    record = json.loads(payload)
    data = record.get("data", record)
    return record.get("type", "delta"), data.get("u"), data.get("b", []), data.get("a", [])


def _with_warm_up(rows: DataFrame) -> DataFrame:
    """Each frame with the day it is replayed for (``_for``): its own, and later ones that need it to know their book.

    A day's book is what the frames since the last snapshot before it make; so the frames from a
    day's last snapshot on also go to the following days up to the next that has a snapshot. One row
    per symbol and day goes into the window.
    """
    day = F.floor(F.col("ts_exchange_ms") / DAY_MS)
    kind = F.get_json_object("payload_json", "$.type") == "snapshot"
    marked = rows.withColumn("_day", day)
    days = marked.groupBy("symbol", "_day").agg(F.max(F.when(kind, F.col("ts_exchange_ms"))).alias("_reset"))
    w = Window.partitionBy("symbol").orderBy("_day")
    following = w.rowsBetween(1, Window.unboundedFollowing)
    reach = days.select("symbol", "_day", "_reset", F.coalesce(F.min(F.when(F.col("_reset").isNotNull(), F.col("_day"))).over(following), F.max("_day").over(Window.partitionBy("symbol"))).alias("_until"))
    joined = marked.join(reach, ["symbol", "_day"])
    last = F.when(F.col("_reset").isNull() | (F.col("ts_exchange_ms") >= F.col("_reset")), F.col("_until")).otherwise(F.col("_day"))
    return joined.withColumn("_for", F.explode(F.sequence("_day", F.greatest("_day", last)))).drop("_reset", "_until")


def sampled_books(frames: DataFrame, band_bp: float = 10.0) -> DataFrame:
    """Tilt and spread at each minute boundary, sampled before the frames of that minute, with the breaks of the day so far.

    Frames (symbol, ts_exchange_ms, payload_json) are cleared of exact repeats and replayed in order
    of (time, update id), per symbol and UTC day. The book carries over from day to day: a day's
    replay begins with the frames since the last snapshot before it. A task streams one symbol's day
    frame by frame and never holds it. Frames that are no JSON are passed over and count as a break.
    Null symbols and times are left out; an empty table gives no rows.
    """
    update = F.coalesce(F.get_json_object("payload_json", "$.data.u"), F.get_json_object("payload_json", "$.u")).try_cast("bigint")
    rows = frames.where("symbol IS NOT NULL AND ts_exchange_ms IS NOT NULL").select("symbol", "ts_exchange_ms", "payload_json", update.alias("_u")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, book, minute = None, Book(), None
        for b in batches:
            out = []
            for s, d, own, t, text in zip(*[b.column(c).to_pylist() for c in ("symbol", "_for", "_day", "ts_exchange_ms", "payload_json")], strict=True):
                if (s, d) != key:
                    key, book, minute = (s, d), Book(), None
                m = t // MINUTE_MS
                if own == d and minute is not None and m > minute:
                    bid, ask = book.best()
                    spread = (ask - bid) / ((ask + bid) / 2) * 1e4
                    out += [(s, k * MINUTE_MS, book.tilt(band_bp), spread, book.breaks) for k in range(minute + 1, m + 1)]
                minute = m if minute is None else max(m, minute)
                try:
                    book.apply(*frame_parts(text))
                except (ValueError, TypeError, AttributeError):
                    book.breaks += 1
                if own < d:
                    book.breaks = 0
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64(), from_pandas=True), pa.array(cols[3], pa.float64(), from_pandas=True), pa.array(cols[4], pa.int64())],
                    names=["symbol", "minute_ms", "tilt", "spread_bp", "breaks"],
                )

    ordered = _with_warm_up(rows).repartition("symbol", "_for").sortWithinPartitions("symbol", "_for", "ts_exchange_ms", "_u", "payload_json")
    return ordered.mapInArrow(run, "symbol string, minute_ms long, tilt double, spread_bp double, breaks long")


def snapshot_minutes(levels: DataFrame, band_bp: float) -> DataFrame:
    """The same samples where every book is a whole snapshot: plain aggregates, no replay.

    ``levels`` has symbol, ts, side (bid, ask), price and size; levels without price or size above 0
    make their snapshot exist but hold nothing. A minute boundary shows the last snapshot before it,
    from the first to the last minute with one. One-sided books have nulls.
    """
    at = Window.partitionBy("symbol", "ts")
    good = F.col("price").isNotNull() & (F.col("size") > 0)
    side = lambda s: good & (F.col("side") == s)
    best = levels.withColumn("_b", F.max(F.when(side("bid"), F.col("price"))).over(at)).withColumn("_a", F.min(F.when(side("ask"), F.col("price"))).over(at)).withColumn("_m", (F.col("_b") + F.col("_a")) / 2)
    exact = F.col("size").cast("decimal(38,12)")
    near = {"bid": side("bid") & (F.col("price") >= F.col("_m") * (1 - band_bp / 1e4)), "ask": side("ask") & (F.col("price") <= F.col("_m") * (1 + band_bp / 1e4))}
    book = best.groupBy("symbol", "ts").agg(F.sum(F.when(near["bid"], exact)).cast("double").alias("b"), F.sum(F.when(near["ask"], exact)).cast("double").alias("a"), ((F.first("_a") - F.first("_b")) / F.first("_m") * 1e4).alias("spread_bp"))
    total = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    tilt = F.when(F.col("spread_bp").isNotNull() & (total > 0), (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))) / total)
    per = book.withColumn("tilt", tilt).groupBy("symbol", F.floor(F.col("ts") / MINUTE_MS).alias("_k")).agg(F.max_by(F.struct("tilt", "spread_bp"), "ts").alias("_s"))
    until = F.lead("_k").over(Window.partitionBy("symbol").orderBy("_k"))
    shown = per.withColumn("_until", until).where("_until IS NOT NULL")
    each = shown.select("symbol", F.explode(F.sequence(F.col("_k") + 1, "_until")).alias("_at"), "_s.tilt", "_s.spread_bp")
    return each.select("symbol", (F.col("_at") * MINUTE_MS).alias("minute_ms"), "tilt", "spread_bp")


def delta_frames(levels: DataFrame) -> DataFrame:
    """Frames as a venue sends them: the first snapshot of a symbol's UTC day whole, the others as what changed (nothing, maybe).

    ``levels`` has symbol, ts, side, price and size, as ``snapshot_minutes``; prices and sizes go out as text.
    """
    good = levels.where("price IS NOT NULL AND size > 0").select("symbol", "ts", "side", F.col("price").cast("string").alias("p"), F.col("size").cast("string").alias("s"))
    day = F.floor(F.col("ts") / DAY_MS)
    every = levels.select("symbol", "ts", "side", F.when(F.col("size") > 0, F.col("price")).cast("string").alias("p"), F.when(F.col("price").isNotNull() & (F.col("size") > 0), F.col("size")).cast("string").alias("s"))
    hour = F.floor(F.col("ts") / 3_600_000)
    changed = snapshot_changes(every, ["symbol"], "ts", day, ["side", "p"], ["s"], F.col("p").isNotNull(), block=hour)
    now = changed.join(good, ["symbol", "ts", "side", "p"], "left").select("symbol", "ts", "side", "p", F.when(F.col("change_kind") == "removed", "0").otherwise(F.col("s")).alias("s"))
    heads = levels.groupBy("symbol", day.alias("_day")).agg(F.min("ts").alias("ts")).select("symbol", "ts")
    first = heads.join(good, ["symbol", "ts"], "left").select("symbol", "ts", "side", "p", "s", F.lit("snapshot").alias("_kind"))
    none = [F.lit(None).cast("string").alias(c) for c in ("side", "p", "s")]
    unchanged = levels.select("symbol", "ts").distinct().join(heads, ["symbol", "ts"], "leftanti").select("symbol", "ts", *none)
    rows = first.unionByName(now.unionByName(unchanged).withColumn("_kind", F.lit("delta")))
    pick = lambda s: F.collect_list(F.when(F.col("side") == s, F.array("p", "s")))
    g = rows.groupBy("symbol", "ts", "_kind").agg(pick("bid").alias("b"), pick("ask").alias("a"))
    return g.select("symbol", F.col("ts").alias("ts_exchange_ms"), F.to_json(F.struct(F.col("_kind").alias("type"), F.struct("b", "a").alias("data"))).alias("payload_json"))


def frames_of(snapshots: DataFrame) -> DataFrame:
    """Snapshot frames as a venue would send them, from rows of levels (prices and sizes as text)."""
    levels = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when((F.lower("side") == s) & F.col("price").isNotNull() & F.col("size").isNotNull(), F.struct("level", "price", "size")))),
        lambda x: F.array(x["price"].cast("string"), x["size"].cast("string")),
    )
    g = snapshots.groupBy("symbol", "ts").agg(levels("bid").alias("b"), levels("ask").alias("a"))
    return g.select("symbol", F.col("ts").alias("ts_exchange_ms"), F.to_json(F.struct(F.lit("snapshot").alias("type"), F.struct(F.col("symbol").alias("s"), "b", "a").alias("data"))).alias("payload_json"))


def exploded_snapshots(wide: DataFrame) -> DataFrame:
    """Rows per side and level from rows with arrays bid_prices, bid_sizes, ask_prices, ask_sizes (the snapshot writer)."""
    def side(name):
        z = F.posexplode(F.arrays_zip(F.col(f"{name}_prices").alias("price"), F.col(f"{name}_sizes").alias("size"))).alias("level", "_z")
        return wide.select("symbol", "ts", F.lit(name).alias("side"), z).select("symbol", "ts", "side", "level", "_z.price", "_z.size")

    return side("bid").unionByName(side("ask"))


def quote_fill(levels: np.ndarray, touches: np.ndarray, times: np.ndarray, trades: np.ndarray, t0: float, price: float, own: float, horizon: float, buy: bool) -> dict[str, float]:
    """When a quote at the touch would fill, by two bounds of queue position.

    ``times``, ``touches``, ``levels``: touch price and its visible size over time. ``trades``: rows
    (time, price, size) of the opposite aggressor. First-in-first-out needs trades at exactly the
    price to eat the visible size at placement plus the own size; the pro-rata bound also counts
    decreases of the level that trades don't explain. Censored where the touch leaves the price.
    """
    at = np.searchsorted(times, t0, side="right") - 1
    out = {"fifo_s": np.nan, "prorata_s": np.nan, "censored": False}
    if at < 0 or touches[at] != price:
        return out | {"censored": True}
    target = levels[at] + own
    done = extra = 0.0
    size, previous = levels[at], t0
    for i in range(at + 1, len(times) + 1):
        end = times[i] if i < len(times) else t0 + horizon
        part = trades[(trades[:, 0] > previous) & (trades[:, 0] <= min(end, t0 + horizon)) & (trades[:, 1] == price)]
        for t, _, q in part:
            done += q
            if np.isnan(out["fifo_s"]) and done >= target:
                out["fifo_s"] = t - t0
            if np.isnan(out["prorata_s"]) and done + extra >= target:
                out["prorata_s"] = t - t0
        if end >= t0 + horizon or i >= len(times):
            break
        if touches[i] != price:
            return out | {"censored": np.isnan(out["fifo_s"])}
        extra += max(size - levels[i] - part[:, 2].sum(), 0.0)
        if np.isnan(out["prorata_s"]) and done + extra >= target:
            out["prorata_s"] = end - t0
        size, previous = levels[i], end
    return out


def icebergs(sizes: np.ndarray, hits: np.ndarray, refill: float = 0.8, least: int = 3) -> int:
    """Times a level came back to ``refill`` of its size after trades hit it, once it did so ``least`` times in a row."""
    run = found = 0
    for i in range(1, len(sizes)):
        if hits[i - 1] > 0:
            run = run + 1 if sizes[i] >= refill * sizes[i - 1] else 0
            found += run >= least
    return found


def quote_fills(quotes: DataFrame, trades: DataFrame, own: float, horizon_ms: int, block_ms: int) -> DataFrame:
    """Fill times of a bid and an ask placed at the touch at every minute boundary, by both bounds of queue position.

    ``quotes`` has symbol, ts, bid and ask price and size of the touch; ``trades`` has symbol, ts, side
    (of the aggressor), price and size. ``own`` is the quote's size as a share of the visible one.
    Result: symbol, side, placed_ms, fifo_s, prorata_s, censored. Series are a symbol's blocks of time;
    what lies within the horizon after a block goes to it too, so no quote is cut short at its end.
    """
    block = lambda c: F.floor(F.col(c) / block_ms)
    reach = F.explode(F.sequence(F.floor((F.col("ts") - horizon_ms) / block_ms), block("ts"))).alias("_block")
    q = quotes.where("bid1_price > 0 AND ask1_price > 0 AND bid1_size > 0 AND ask1_size > 0").select("symbol", reach, "ts", F.lit(0.0).alias("kind"), F.col("bid1_price").alias("p"), F.col("bid1_size").alias("s"), F.col("ask1_price").alias("p2"), F.col("ask1_size").alias("s2"))
    t = trades.where("side IN ('buy', 'sell') AND price > 0 AND size > 0").select("symbol", reach, "ts", F.when(F.col("side") == "sell", 1.0).otherwise(2.0).alias("kind"), F.col("price").alias("p"), F.col("size").alias("s"), F.lit(0.0).alias("p2"), F.lit(0.0).alias("s2"))

    def evaluate(block_no, ts, kind, p, s, p2, s2):
        start = block_no[0] * block_ms
        touch = kind == 0
        times, out = ts[touch], []
        if not len(times):
            return None
        hits = {side: np.stack([ts[kind == k], p[kind == k], s[kind == k]], 1) for side, k in (("bid", 1), ("ask", 2))}
        for placed in np.arange(start, start + block_ms, MINUTE_MS):
            at = np.searchsorted(times, placed, side="right") - 1
            if at < 0 or placed > times[-1]:
                continue
            for side, price, level in (("bid", p[touch], s[touch]), ("ask", p2[touch], s2[touch])):
                lo, hi = np.searchsorted(hits[side][:, 0], [placed, placed + horizon_ms], side="right")
                until = np.searchsorted(times, placed + horizon_ms, side="right")
                near = hits[side][lo:hi].copy()
                near[:, 0] /= 1000
                got = quote_fill(level[at : until + 1], price[at : until + 1], times[at : until + 1] / 1000, near, placed / 1000, price[at], own * level[at], horizon_ms / 1000, side == "bid")
                out.append((side, placed, got["fifo_s"], got["prorata_s"], bool(got["censored"])))
        names = ("side", "placed_ms", "fifo_s", "prorata_s", "censored")
        return dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else None

    rows = q.unionByName(t).withColumn("_no", F.col("_block").cast("double"))
    got = per_series(rows, ["symbol", "_block"], ["_no", "ts", "kind"], ["p", "s", "p2", "s2"], lambda no, ts, kind, p, s, p2, s2: evaluate(no, ts, kind, p, s, p2, s2), "side string, placed_ms double, fifo_s double, prorata_s double, censored boolean")
    return got.drop("_block").withColumn("placed_ms", F.col("placed_ms").cast("long"))


def refilled_levels(levels: DataFrame, trades: DataFrame, refill: float = 0.8, least: int = 3) -> DataFrame:
    """Icebergs: levels that came back to ``refill`` of their size after being hit, ``least`` times in a row or more.

    ``levels`` has symbol, ts, side, price and size of the best level of each snapshot; ``trades``
    symbol, ts, side and price. Runs are counted per symbol, side and price within an hour; a hit is
    an aggressor's trade at the price between a snapshot and the next. Result: symbol, hour, side,
    price, hits, found.
    """
    hour = F.floor(F.col("ts") / 3_600_000).alias("hour")
    own = levels.where("price IS NOT NULL AND size > 0").select("symbol", hour, "side", "price", "ts", F.col("size").alias("s"), F.lit(0).alias("hit"))
    took = F.when(F.col("side") == "sell", "bid").when(F.col("side") == "buy", "ask")
    hits = trades.where("side IN ('buy', 'sell')").select("symbol", hour, took.alias("side"), "price", "ts", F.lit(None).cast("double").alias("s"), F.lit(1).alias("hit"))
    key = ["symbol", "hour", "side", "price"]
    w = Window.partitionBy(*key).orderBy("ts", "hit")
    both = own.unionByName(hits).withColumn("_n", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("s IS NOT NULL")
    v = Window.partitionBy(*key).orderBy("ts")
    step = both.withColumn("_hits", F.col("_n") - F.lag("_n").over(v)).withColumn("_kept", F.col("s") >= refill * F.lag("s").over(v)).where("_hits > 0")
    runs = step.withColumn("_run", F.sum(F.when(F.col("_kept"), 0).otherwise(1)).over(v)).withColumn("_len", F.sum(F.col("_kept").cast("int")).over(Window.partitionBy(*key, "_run").orderBy("ts")))
    return runs.groupBy(*key).agg(F.sum("_hits").alias("hits"), F.count_if(F.col("_kept") & (F.col("_len") >= least)).alias("found"))
