"""Percentiles of any number of values with guaranteed relative error, from mergeable counts."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_rank(n: Column, p: float) -> Column:
    """ceil(p * n) in whole numbers: a product of doubles may land just above a whole number and give the next rank."""
    millionths = round(p * 1_000_000)
    return F.ceil(n.cast("decimal(20,0)") * F.lit(Decimal(millionths)).cast("decimal(7,0)") / F.lit(Decimal(1_000_000)).cast("decimal(7,0)")).cast("long")


class LogBuckets:
    """Signed logarithmic buckets: values of one bucket lie within ``error`` of its representative.

    Bucket ``i`` of a sign holds magnitudes in (g^(i-1), g^i] with g = (1 + error) / (1 - error);
    its representative 2 g^i / (g + 1) is at most ``error`` away, relative to the value. Zero has a
    bucket of its own and is exact.
    """

    def __init__(self, error: float):
        if not 0 < error < 1:
            raise ValueError("error must lie between 0 and 1")
        self.error = error
        self.gamma = (1 + error) / (1 - error)
        self.log_gamma = math.log(self.gamma)

    def index(self, value: Column) -> Column:
        """Bucket within the sign; 0 for zero."""
        return F.when(value == 0, 0).otherwise(F.ceil(F.log(F.abs(value)) / self.log_gamma)).cast("int")

    def representative(self, sign: Column, index: Column) -> Column:
        return sign * F.pow(F.lit(self.gamma), index.cast("double")) * (2 / (self.gamma + 1))

    def sketch(self, df: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
        """Counts per ``group``, ``field``, ``sign`` and ``bucket``.

        Sketches of any parts of the data are combined by adding counts (``merge``), with no loss.
        Counting combines on the map side, so a task sends at most one row per group and bucket,
        however many rows it reads. Null, NaN and infinite values are not counted; null groups are
        groups.
        """
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields]))
        values = df.select(*group, each.alias("_e")).select(*group, "_e.field", "_e.v").where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf')")
        return (
            values.select(*group, "field", F.signum("v").cast("int").alias("sign"), self.index(F.col("v")).alias("bucket"))
            .groupBy(*group, "field", "sign", "bucket")
            .agg(F.count(F.lit(1)).alias("n"))
        )

    @staticmethod
    def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
        """Sketches joined over everything that is not in ``group``: counts of equal buckets add up."""
        return sketches.groupBy(*group, "field", "sign", "bucket").agg(F.sum("n").alias("n"))

    def percentiles(self, sketches: DataFrame, group: list[str], at: dict[str, float]) -> DataFrame:
        """Per ``group`` and ``field``: count ``n``, a column per entry of ``at``, and ``rel_error``.

        The value for p is that of rank ceil(p * n) in rising order (p to six decimals, exactly), at most ``rel_error`` away
        relative to itself. The window runs over the buckets of a group, whose number is bounded by
        the range of a double and not by the rows. A group without values has no row.
        """
        by = [*group, "field"]
        order = F.struct("sign", F.col("sign") * F.col("bucket"))
        upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ranked = (
            self.merge(sketches, group)
            .withColumn("_upto", F.sum("n").over(upto))
            .withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
            .withColumn("_value", self.representative(F.col("sign"), F.col("bucket")))
            .withColumn("_order", order)
        )
        picks = [
            F.min_by("_value", F.when(F.col("_upto") >= exact_rank(F.col("_total"), p), F.col("_order"))).alias(name) for name, p in at.items()
        ]
        return ranked.groupBy(*by).agg(F.sum("n").alias("n"), *picks).withColumn("rel_error", F.lit(self.error))
