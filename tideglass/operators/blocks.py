"""Windows over the whole history of a source, computed per source and block of time.

A window by source alone puts a busy source into one task. Here the window runs inside blocks
(hours), and what a block needs from before it comes from a table of one row per source and block,
or from the rows that lie near enough before its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.events import HOUR_MS


def _block(ts: str, block_ms: int) -> Column:
    return F.floor(F.col(ts) / block_ms)


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], name: str = "prev", block_ms: int = HOUR_MS, block: str | None = None) -> DataFrame:
    """``df`` with struct ``name``: ``columns`` of the row before in order of ``order`` (its first is the time in ms); null for the first.

    Rows with a null key form a group of their own; rows with a null time come before all others.
    ``block`` names a column that already has the block, by which and ``by`` the rows may already be
    partitioned; keys must not be null then.
    """
    keyed = df.withColumn("_block", _block(order[0], block_ms) if block is None else F.col(block))
    row = F.struct(*columns)
    last = keyed.groupBy(*by, "_block").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    past = last.select(*by, "_block", F.lag("_last").over(Window.partitionBy(*by).orderBy("_block")).alias("_past"))
    inside = keyed.withColumn("_lag", F.lag(row).over(Window.partitionBy(*by, "_block").orderBy(*order)))
    return _joined(inside, past, by, block is None).withColumn(name, F.coalesce("_lag", "_past")).drop("_block", "_lag", "_past")


def with_last_known(df: DataFrame, by: list[str], order: list[str], value: str, name: str, block_ms: int = HOUR_MS, block: str | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` up to and including each row; null before the first."""
    keyed = df.withColumn("_block", _block(order[0], block_ms) if block is None else F.col(block))
    last = keyed.groupBy(*by, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    past = last.select(*by, "_block", F.last("_last", ignorenulls=True).over(before).alias("_past"))
    run = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.withColumn("_own", F.last(value, ignorenulls=True).over(run))
    return _joined(inside, past, by, block is None).withColumn(name, F.coalesce("_own", "_past")).drop("_block", "_own", "_past")


def _joined(inside: DataFrame, past: DataFrame, by: list[str], nulls: bool) -> DataFrame:
    """``inside`` with the carried column of its block, null keys joined too."""
    keys = [*by, "_block"]
    p = past.select(*[F.col(c).alias(f"_p_{c}") for c in keys], "_past")
    on = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) if nulls else F.col(c) == F.col(f"_p_{c}") for c in keys]
    return inside.join(p, on, "left").drop(*[f"_p_{c}" for c in keys])


def with_trailing(df: DataFrame, by: list[str], ts: str, back_ms: int, ahead_ms: int, aggregates: dict[str, Column], block_ms: int | None = None) -> DataFrame:
    """``df`` with aggregates over rows of the same key with time in [ts - back_ms, ts + ahead_ms].

    Each row also goes to the blocks it can still reach (none but its own for most rows while the
    reach is short against the block), is counted there and dropped again. Rows with a null time
    have no block and are left out. Blocks are as long as the reach by default, an hour at least, so
    a row goes to two of them at most and a busy source is cut as finely as its reach allows.
    """
    block_ms = block_ms or max(HOUR_MS, max(back_ms, 0) + max(ahead_ms, 0))
    own = _block(ts, block_ms)
    first, last = F.floor((F.col(ts) - max(ahead_ms, 0)) / block_ms), F.floor((F.col(ts) + back_ms) / block_ms)
    spread = df.where(F.col(ts).isNotNull()).withColumn("_own", own).withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*by, "_block").orderBy(ts).rangeBetween(-back_ms, ahead_ms)
    return spread.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()]).where("_own = _block").drop("_own", "_block")
