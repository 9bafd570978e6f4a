"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.session import tasks_for

#: At most this many heavy keys are told apart, so that their table can be broadcast whatever the volume.
MOST_HEAVY = 100_000


def salt_parts(df: DataFrame) -> int:
    """Pieces the table should come in, by its volume: as many as keep each below a task's share of rows.

    The count reads row counts of parquet footers where ``df`` is a bare table.
    """
    return min(tasks_for(df.sparkSession, df.count()), MOST_HEAVY)


def heavy_keys(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Keys that hold more than one ``parts``-th of all rows, and how many salts each gets: one per such share.

    ``parts`` follows the volume (``salt_parts``), so a salt holds a task's worth of rows at any size.
    Fewer than ``parts`` keys can hold that much, so the result has fewer than ``parts`` rows (at most
    ``MOST_HEAVY``) whatever the data. The count combines on the map side: each task sends one row per key.
    """
    rows = df.count()
    share = max(rows // (parts or min(tasks_for(df.sparkSession, rows), MOST_HEAVY)), 1)
    return (
        df.groupBy(F.col(key).alias("_key"))
        .count()
        .where(F.col("count") > share)
        .select("_key", F.ceil(F.col("count") / share).cast("int").alias("_salts"))
    )


def salted(df: DataFrame, key: str, spread: Column, parts: int | None = None) -> DataFrame:
    """``df`` with ``_salt``: 0 for light keys, a pseudo-random number below the key's salt count for heavy ones.

    ``spread`` is hashed for the salt, so a task that runs again after a lost executor draws the
    same salt, and rows that must meet (deliveries of one record) do meet. The broadcast table has
    fewer than ``MOST_HEAVY`` rows by construction.
    """
    heavy = F.broadcast(heavy_keys(df, key, parts))
    draw = F.pmod(F.xxhash64(spread), F.col("_salts").cast("long")).cast("int")
    return (
        df.join(heavy, df[key].eqNullSafe(heavy["_key"]), "left")
        .withColumn("_salt", F.coalesce(draw, F.lit(0)))
        .drop("_key", "_salts")
    )


def two_stage(
    df: DataFrame,
    key: str,
    spread: Column,
    record: list[str],
    partials: dict[str, Column],
    merges: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Two-stage salted aggregation: partial results per (key, salt), then merged per key.

    ``record`` are the columns that make one record with its values; a record delivered several
    times counts once (stage one drops repeats inside its salt, where all deliveries lie, as
    ``spread`` is part of the record). ``partials`` aggregates records per (key, salt); ``merges``
    aggregates partials per key and must be exact for them: sums, counts, extremes by order.

    The one exchange of rows is by (key, salt), into as many tasks as the volume asks for; the merge
    moves one row per key and salt. Before it stand a count of the table and one of its keys (one
    column read, combined on the map side). A null key is a group of its own, as is an empty one. An
    empty table gives no rows.
    """
    cols = list(dict.fromkeys([key, *record]))
    pieces = parts or salt_parts(df)
    rows = salted(df.select(*cols), key, spread, pieces).repartition(pieces, key, "_salt")
    single = rows.groupBy("_salt", *cols).agg(F.lit(1).alias("_one")).drop("_one")
    partial = single.groupBy(key, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return partial.groupBy(key).agg(*[c.alias(n) for n, c in merges.items()])
