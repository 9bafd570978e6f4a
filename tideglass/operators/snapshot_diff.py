"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(
    rows: DataFrame,
    source: list[str],
    version: str,
    period: Column,
    key: list[str],
    value: list[str],
    is_record: Column | None = None,
    record: list[str] | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Records added, removed or changed from each snapshot to the next of the same source.

    A snapshot is all rows of one (``source``, ``version``); snapshots follow each other by
    ``version`` inside one ``period``, and the first of a period has no predecessor.

    Every row is offered twice: to its own snapshot as the later side, to the following snapshot
    as the earlier side. Grouping both on all columns and counting the sides is EXCEPT ALL in both
    directions at once: as many rows cancel as both sides have, and what one side has more of is
    its residue. The residues are then fully joined on the key: a key on both sides is
    ``changed``, on the later side alone ``added``, on the earlier alone ``removed``. A second
    copy of a record that already was there is a residue of the later side, so it is ``added``.

    ``record`` names the columns that tell records apart: rows that agree in them and all others
    are deliveries of one record and count once, equal rows of different records count each.
    Without it, rows that agree in all columns count once.

    One exchange of rows, by (source, period), or, with ``block``, by (source, block): a block is a
    shorter stretch of ``version`` (an hour of a day's snapshots) that splits a source holding most
    rows. Snapshots inside a block are compared where they lie; the last snapshot of a block meets
    the first of the next in a second, small exchange (two snapshots a block), placed by a table
    with one row per source and block. Blocks are sorted with spill, never held in memory.

    Nulls: a null source or version has no snapshots (dropped); null values compare equal to null
    and unlike everything else; null parts of a key are equal to each other. Rows where
    ``is_record`` is not true still make their snapshot exist, so a snapshot of only such rows
    removes everything. An empty table gives an empty result.
    """
    valid = F.lit(True) if is_record is None else F.coalesce(is_record, F.lit(False))
    base = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*source, version])).select(
        *source,
        F.col(version).alias("_version"),
        period.alias("_period"),
        (F.lit(0) if block is None else block).alias("_block"),
        valid.alias("_valid"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)],
        *[F.col(c).alias(f"_v{i}") for i, c in enumerate(value)],
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(record or [])],
    )
    keys, values = [f"_k{i}" for i in range(len(key))], [f"_v{i}" for i in range(len(value))]
    group = [*source, "_period", "_block"] if block is not None else [*source, "_period"]
    for c in group:
        base = base.where(F.col(c).isNotNull())
    placed = base.repartition(*group)

    cells = [f"_r{i}" for i in range(len(record or []))] + keys + values
    back = Window.partitionBy(*group).orderBy(F.col("_version").desc(), *cells, "_valid")
    before, whole = F.lag("_version").over(back), F.struct("_version", *cells, "_valid")
    linked = (
        placed.withColumn("_jump", F.when(before != F.col("_version"), before))
        .withColumn("_again", F.coalesce(F.lag(whole).over(back) == whole, F.lit(False)))
        .withColumn("_next", F.last("_jump", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_first", F.min("_version").over(Window.partitionBy(*group)))
        .where("_valid AND NOT _again")
    )
    later = F.struct(F.when(F.col("_version") > F.col("_first"), F.col("_version")).alias("at"), F.lit(True).alias("later"))
    earlier = F.struct(F.col("_next").alias("at"), F.lit(False).alias("later"))
    inside = _changes(_sides(linked, F.array(later, earlier), [*group, *keys, *values]), group, keys, values)
    if block is not None:
        inside = inside.select(*source, "_version", *keys, "_later", "_earlier").unionByName(_across(base, placed, source, group, cells, keys, values))
    kind = F.when(~F.col("_earlier"), "added").when(~F.col("_later"), "removed").otherwise("changed")
    return inside.select(
        *source,
        F.col("_version").alias(version),
        *[F.col(k).alias(c) for k, c in zip(keys, key, strict=True)],
        kind.alias("change_kind"),
    )


def _sides(rows: DataFrame, offers: Column, columns: list[str]) -> DataFrame:
    """A row per offer (``at``, ``later``) to a snapshot there is."""
    each = rows.select(*columns, F.explode(offers).alias("_o")).where("_o.at IS NOT NULL")
    return each.select(*columns, F.col("_o.at").alias("_version"), F.col("_o.later").alias("_later"))


def _changes(sides: DataFrame, group: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Residues of the offers joined by key: which sides have some."""
    more = F.sum(F.when(F.col("_later"), 1).otherwise(-1))
    residues = sides.groupBy(*group, "_version", *keys, *values).agg(more.alias("_more")).where("_more <> 0")
    return residues.groupBy(*group, "_version", *keys).agg(F.max(F.col("_more") > 0).alias("_later"), F.max(F.col("_more") < 0).alias("_earlier"))


def _across(base: DataFrame, placed: DataFrame, source: list[str], group: list[str], cells: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Changes from the last snapshot of each block to the first of the next block with any, in the same period."""
    span = base.groupBy(*group).agg(F.min("_version").alias("_head"), F.max("_version").alias("_tail"))
    in_turn = Window.partitionBy(*source, "_period").orderBy("_block")
    ends = span.select(
        *[F.col(c).alias(f"_e{c}") for c in group],
        "_tail",
        F.when(F.lag("_head").over(in_turn).isNotNull(), F.col("_head")).alias("_head"),
        F.lead("_head").over(in_turn).alias("_after"),
    )
    rows = placed.join(ends.hint("shuffle_hash"), [F.col(c) == F.col(f"_e{c}") for c in group])
    offers = F.array(
        F.struct(F.when(F.col("_version") == F.col("_head"), F.col("_version")).alias("at"), F.lit(True).alias("later")),
        F.struct(F.when(F.col("_version") == F.col("_tail"), F.col("_after")).alias("at"), F.lit(False).alias("later")),
    )
    # _valid inside the offers: as a filter it would go below the exchange, which could not be shared then
    sides = _sides(rows.where("_version = _head OR (_version = _tail AND _after IS NOT NULL)"), F.when(F.col("_valid"), offers), [*source, *cells])
    return _changes(sides.repartition(*source, "_version").distinct(), source, keys, values).select(*source, "_version", *keys, "_later", "_earlier")
