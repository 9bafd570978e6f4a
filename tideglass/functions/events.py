"""Event time, periods and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
PERIOD_MS = 300_000


def event_ms(ts: Column, recv_ts: Column) -> Column:
    """Event time in epoch ms: ``ts``, or the receive time where ``ts`` is 0; null where neither is known."""
    return F.when(ts != 0, ts).when(ts == 0, F.floor(recv_ts * 1000).cast("long"))


def floor_to(ms: Column, step: int) -> Column:
    """Start of the step that holds ``ms`` (floors below zero too)."""
    return ms - F.pmod(ms, F.lit(step).cast("long"))


def steps(value: Column, step: Column) -> Column:
    """``round(value / step)`` as long, half away from zero; null where it has no such number."""
    ratio = value / F.nullif(step, F.lit(0.0))
    return F.when(F.abs(ratio) < 9e15, (F.signum(ratio) * F.floor(F.abs(ratio) + 0.5)).cast("long"))


def timed_records(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` and ``event_ms`` of each record, the event time taken from its first delivery.

    Only records without an own ``ts`` need their deliveries brought together (their event time is
    the earliest receive time), so only that small part is shuffled by key. A record with an own
    ``ts`` may still come out once per delivery, with equal values: callers that need single
    records drop repeats where they partition anyway.
    """
    own = df.where(F.col("ts") != 0).select(*columns, F.col("ts").alias("event_ms"))
    cols = list(dict.fromkeys([key, *columns]))
    borrowed = (
        df.where((F.col("ts") == 0) & F.col("recv_ts").isNotNull())
        .groupBy(*cols)
        .agg(F.min("recv_ts").alias("recv_ts"))
        .select(*columns, F.floor(F.col("recv_ts") * 1000).cast("long").alias("event_ms"))
    )
    return own.unionByName(borrowed)
