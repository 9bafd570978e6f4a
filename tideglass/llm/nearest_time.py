"""Each left record with the nearest right record of its entity in time, within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.session import planned_with

BLOCK_MS = 3_600_000


def ring_widths(fine_ms: int, tolerance_ms: int) -> list[int]:
    """Bucket widths: ``fine_ms`` doubled until a bucket is as wide as the tolerance."""
    widths = [min(fine_ms, tolerance_ms)]
    while widths[-1] < tolerance_ms:
        widths.append(min(2 * widths[-1], tolerance_ms))
    return widths


def _fine_cells(right: DataFrame, width: int) -> DataFrame:
    """Per bucket that can be reached: its own records (one per time, so at most ``width``), the last before it and the first after it."""
    cell = F.floor(F.col("_t") / width)
    near = right.withColumn("_own", cell).withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    at = F.struct("_t", "_r")
    return near.groupBy("_cell", "_entity", "_block").agg(
        F.collect_list(F.when(F.col("_own") == F.col("_cell"), at)).alias("_in"),
        F.max(F.when(F.col("_own") < F.col("_cell"), at)).alias("_before"),
        F.min(F.when(F.col("_own") > F.col("_cell"), at)).alias("_after"),
    )


def _shell_cells(right: DataFrame, width: int) -> DataFrame:
    """Per bucket of a width in which nothing lies that near: the last record of the two buckets before it, the first of the two after it."""
    at = F.struct("_t", "_r")
    ends = right.groupBy(F.floor(F.col("_t") / width).alias("_own"), "_entity", "_block").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    reach = F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)]))
    near = ends.withColumn("_step", reach).withColumn("_cell", F.col("_own") + F.col("_step"))
    return near.groupBy("_cell", "_entity", "_block").agg(
        F.max(F.when(F.col("_step") > 0, F.col("_last"))).alias("_before"), F.min(F.when(F.col("_step") < 0, F.col("_first"))).alias("_after")
    )


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    time: str,
    left_id: str,
    right_id: str,
    tolerance_ms: int,
    fine_ms: int,
    block_ms: int = BLOCK_MS,
) -> DataFrame:
    """Pairs (``left_id``, ``right_id``, ``distance_ms``) of each left record with its nearest right record.

    Expanding rings: a left record looks into its own time bucket and the two adjacent ones. What it
    finds at most one bucket width away is provably the nearest, for everything that near lies in
    those three buckets; it is accepted. The others go on to buckets of twice the reach, up to the
    tolerance: as nothing lies within the width w already searched, what lies within 2w is the last
    record of the two buckets of width w before, or the first of the two after. Of two equally near
    the earlier counts, then the smaller id. Left records without a right record within
    ``tolerance_ms`` are not in the result.

    The rings are equi-joins on (entity, block, bucket) against one row per bucket, so no pairs are
    formed that need to be thinned out again. A bucket's row is bounded whatever the density: one
    record per distinct time, at most ``fine_ms`` of them, in the first ring, and two records in the
    later ones. Both sides are exchanged once, by (entity, block of an hour), right records near a
    block's border going to both blocks; every ring joins where the rows already lie, by merge: what
    it sorts goes to disk when memory is short, while a hash table of the buckets could not, so a
    partition may be larger than the memory of its task. An accepted row has no bucket any more:
    later rings pass it through without a look-up. Entities that hold most rows are spread over
    their hours.

    A join on more columns than the partitioning stays in place only under a planner option, which is
    set for this plan alone: the result belongs to a session of its own beside the caller's.

    Nulls: records with null entity, time or id take no part. Repeated deliveries give one pair.
    Empty tables give an empty result. Other columns are not looked at.
    """
    left, right = planned_with([left, right], {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    block = lambda t: F.floor(t / block_ms)
    known = "_entity IS NOT NULL AND _t IS NOT NULL AND _r IS NOT NULL"
    rights = (
        right.select(F.col(entity).alias("_entity"), F.col(time).cast("long").alias("_t"), F.col(right_id).alias("_r"))
        .where(known)
        .withColumn("_block", F.explode(F.sequence(block(F.col("_t") - tolerance_ms), block(F.col("_t") + tolerance_ms))))
        .repartition("_entity", "_block")
        .groupBy("_entity", "_block", "_t")
        .agg(F.min("_r").alias("_r"))
    )
    rows = (
        left.select(F.col(entity).alias("_entity"), F.col(time).cast("long").alias("_t"), F.col(left_id).alias("_l"))
        .where(known.replace("_r", "_l"))
        .withColumn("_block", block(F.col("_t")))
        .repartition("_entity", "_block")
        .groupBy("_entity", "_block", "_t", "_l")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_best", F.lit(None).cast("struct<d:bigint,t:bigint,r:bigint>"))
        .drop("_n")
    )

    def offer(at):
        return F.struct(F.abs(at["_t"] - F.col("_t")).alias("d"), at["_t"].alias("t"), at["_r"].alias("r"))

    widths = ring_widths(fine_ms, tolerance_ms)
    for searched, width in zip([None, *widths], widths):
        cells = _fine_cells(rights, width) if searched is None else _shell_cells(rights, searched)
        bucket = F.when(F.col("_best").isNull(), F.floor(F.col("_t") / (searched or width)))
        seen = rows.withColumn("_cell", bucket).join(cells.hint("merge"), ["_cell", "_entity", "_block"], "left")
        ends = F.array(F.when(F.col("_before").isNotNull(), offer(F.col("_before"))), F.when(F.col("_after").isNotNull(), offer(F.col("_after"))))
        offers = ends if searched is not None else F.concat(F.transform(F.coalesce("_in", F.array()), offer), ends)
        best = F.array_min(F.filter(offers, lambda o: o["d"] <= width))
        rows = seen.select("_entity", "_block", "_t", "_l", F.coalesce("_best", best).alias("_best"))
    return rows.where("_best IS NOT NULL").select(
        F.col("_l").alias(left_id), F.col("_best.r").alias(right_id), F.col("_best.d").alias("distance_ms")
    )
