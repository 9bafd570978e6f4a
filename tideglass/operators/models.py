"""Models fitted on expanding parts of the past and judged on what follows, and plans of many fits that can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators.resampling import shuffled_blocks


def expanding_folds(lo: int, hi: int, folds: int, embargo: int) -> list[tuple[int, int, int, int]]:
    """(fold, end of training, start of test, end of test) of ``folds`` parts of [lo, hi); training ends ``embargo`` before the test."""
    cut = [lo + (hi - lo) * k // (folds + 1) for k in range(folds + 2)]
    return [(k, cut[k] - embargo, cut[k], cut[k + 1]) for k in range(1, folds + 1)]


def walk_forward(rows: DataFrame, at: str, label: str, folds: list[tuple[int, int, int, int]], fit: Callable[[DataFrame], object]) -> DataFrame:
    """Rows of every fold's test part with ``fold`` and ``prediction``; the model of a fold has seen its training rows only.

    ``fit`` takes rows with a label and returns a fitted MLlib transformer. A fold without training rows has no predictions.
    """
    out = None
    for fold, end, start, stop in folds:
        train = rows.where((F.col(at) < end) & F.col(label).isNotNull())
        if train.isEmpty():
            continue
        test = fit(train).transform(rows.where((F.col(at) >= start) & (F.col(at) < stop))).withColumn("fold", F.lit(fold))
        out = test if out is None else out.unionByName(test)
    return out if out is not None else rows.where("false").withColumn("prediction", F.lit(None).cast("double")).withColumn("fold", F.lit(None).cast("int"))


def permutation_importance(rows: DataFrame, model, features: list[str], assemble: Callable[[DataFrame], DataFrame], label: str, key: list[str], seed: int, buckets: int = 64) -> DataFrame:
    """How much a model's squared error grows when one feature's values are dealt out anew: ``feature``, ``mse``, ``increase``.

    Values change places within buckets of rows by hash of their key, so no task shuffles them all.
    """
    known = rows.where(F.col(label).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)))
    error = lambda df: model.transform(assemble(df)).agg(F.avg((F.col("prediction") - F.col(label)) ** 2).alias("mse"))
    base = error(known).first()["mse"]
    out = None
    for k, f in enumerate(features):
        dealt = shuffled_blocks(known, ["_bucket"], key, f, 1, seed + k + 1).drop(f).withColumnRenamed("surrogate", f)
        one = error(dealt).select(F.lit(f).alias("feature"), "mse", (F.col("mse") - F.lit(base)).alias("increase"))
        out = one if out is None else out.unionByName(one)
    return out


def resumed(spark: SparkSession, tasks: DataFrame, key: list[str], folder: str, fingerprint: str, run: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
    """Results of all ``tasks``: those in ``folder`` under the same fingerprint, and what ``run`` gives for the rest.

    A batch that is run again replaces itself; results of other fingerprints are left alone and not read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    done = spark.read.parquet(folder).where(F.col("fingerprint") == fingerprint) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    rest = tasks if done is None else tasks.join(done.select(*key).distinct(), key, "leftanti")
    fresh = run(rest).withColumn("fingerprint", F.lit(fingerprint)).withColumn("batch", F.lit(batch))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint", "batch").parquet(folder)
    return spark.read.parquet(folder).where(F.col("fingerprint") == fingerprint).drop("fingerprint", "batch")
