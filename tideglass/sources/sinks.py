"""Writers: immutable partitions with fingerprints, panels with a manifest, archival, merges, usage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free fingerprint of the exact values of each partition: row count and two sums of 64-bit hashes."""
    cols = [c for c in df.columns if c not in by]
    h = F.xxhash64(*cols)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)")).cast("string").alias("hash_sum2"))


def _published(df: DataFrame, folder: str, by: list[str]) -> DataFrame:
    """Write ``df`` once beside its place, move each partition in by rename and return the fingerprints of what was written.

    A partition that is there already is replaced: only callers that know it to be unfinished come here.
    """
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    staged = f"{folder}/_staging-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(staged)
    system = fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = StructType([f for f in df.schema if f.name not in by] + [df.schema[c] for c in by])
    prints = fingerprint(spark.read.schema(schema).parquet(staged), by).collect()
    pattern = "/".join(f"{c}=*" for c in by)
    for s in system.globStatus(fs.Path(f"{staged}/{pattern}")) or []:
        place = fs.Path(folder + s.getPath().toString().partition(staged.rpartition("/")[2])[2])
        system.mkdirs(place.getParent())
        if system.exists(place):
            system.delete(place, True)
        if not system.rename(s.getPath(), place):
            raise OSError(f"could not move {s.getPath()} to {place}")
    system.delete(fs.Path(staged), True)
    return spark.createDataFrame(prints, fingerprint(df, by).schema)


def _known(spark: SparkSession, manifest: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    return spark.read.parquet(manifest) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def write_immutable(df: DataFrame, folder: str, by: list[str], manifest: str, version: int) -> None:
    """Write only partitions the manifest doesn't have, then append their rows and fingerprints to it.

    The frame is computed once. A partition counts as written only when the manifest names it: what a
    failed run left behind is replaced by the next. One row per new partition goes through the driver.
    """
    done = _known(df.sparkSession, manifest)
    if done is not None:
        df = df.join(F.broadcast(done.select(*by).distinct()), by, "leftanti")
    prints = _published(df, folder, by)
    prints.withColumn("version", F.lit(version)).withColumn("status", F.lit("DONE")).withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(manifest)


def panel_status(rows: DataFrame, by: list[str], expected: int) -> DataFrame:
    """EMPTY, PARTIAL or DONE per partition by the days it should have."""
    n = F.count("start_ms")
    return rows.groupBy(*by).agg(n.alias("n_rows")).withColumn("status", F.when(F.col("n_rows") == 0, "EMPTY").when(F.col("n_rows") >= expected, "DONE").otherwise("PARTIAL"))


def write_panel(rows: DataFrame, folder: str, manifest: str, expected: int, frozen: bool = False) -> None:
    """Panel rows (symbol, year, start_ms, ...) as partitions by symbol and year with their status in the manifest.

    A partition the manifest has as frozen stays as it is; others are rewritten as a whole. ``expected``
    is the number of days of a full year's partition.
    """
    by = ["symbol", "year"]
    done = panel_manifest(rows.sparkSession, manifest)
    if done is not None:
        rows = rows.join(F.broadcast(done.where("frozen").select(*by)), by, "leftanti")
    prints = _published(rows, folder, by).withColumnRenamed("rows", "n_rows")
    status = F.when(F.col("n_rows") == 0, "EMPTY").when(F.col("n_rows") >= expected, "DONE").otherwise("PARTIAL")
    prints.withColumn("status", status).withColumn("frozen", F.lit(frozen) & (status == "DONE")).withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(manifest)


def panel_manifest(spark: SparkSession, manifest: str) -> DataFrame | None:
    """The newest row of each partition; none where there is no manifest yet."""
    known = _known(spark, manifest)
    if known is None:
        return None
    cols = [c for c in known.columns if c not in ("symbol", "year")]
    return known.groupBy("symbol", "year").agg(F.max_by(F.struct(*cols), F.struct("updated_at", "n_rows")).alias("_m")).select("symbol", "year", *[f"_m.{c}" for c in cols])


def read_panel(spark: SparkSession, folder: str, manifest: str, partial: bool = False) -> DataFrame:
    """The panel's rows; reading a partition that is not DONE is an error unless ``partial``."""
    rows = spark.read.parquet(folder)
    known = panel_manifest(spark, manifest).select("symbol", "year", F.col("status").alias("_status"))
    checked = rows.join(F.broadcast(known), ["symbol", "year"], "left")
    said = F.concat(F.lit("not a whole partition: "), F.col("symbol").cast("string"), F.lit(" "), F.col("year").cast("string"))
    ok = F.lit(True) if partial else F.when(F.col("_status") == "DONE", True).otherwise(F.raise_error(said).cast("boolean"))
    return checked.where(ok).drop("_status")


def write_days(samples: DataFrame, by: list[str], folder: str, manifest: str, bad: Column, most_bad: int) -> None:
    """Samples by symbol and day, each day once: ``ok`` days are written, days with more than ``most_bad`` bad samples are only noted as ``discarded``.

    Days the manifest has are left alone, so a run that is repeated takes up where the last one ended.
    """
    done = _known(samples.sparkSession, manifest)
    if done is not None:
        samples = samples.join(F.broadcast(done.select(*by).distinct()), by, "leftanti")
    days = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad")).withColumn("status", F.when(F.col("n_bad") > most_bad, "discarded").otherwise("ok"))
    # one row per day; kept as a table, so that what is written and what is noted agree
    noted = days.sparkSession.createDataFrame(days.collect(), days.schema)
    _published(samples.join(F.broadcast(noted.where("status = 'ok'").select(*by)), by, "leftsemi"), folder, by)
    noted.withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(manifest)


def archive(hot: DataFrame, cutoff_ms: int, cold: str, remainder: str) -> None:
    """Rows before the cut-off to compressed partitions by day, the rest to ``remainder``; nothing is deleted in place.

    The cut-off is a partition too, so a run that is repeated replaces what it wrote before.
    """
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    old = hot.where(F.col("ts") < cutoff_ms).withColumn("date", day).withColumn("cutoff_ms", F.lit(cutoff_ms))
    old.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date", "cutoff_ms").parquet(cold)
    hot.where((F.col("ts") >= cutoff_ms) | F.col("ts").isNull()).write.mode("overwrite").parquet(remainder)


def projected(rows: DataFrame, schema: str) -> DataFrame:
    """The rows with exactly the columns of ``schema``: missing ones null, unknown ones dropped, types cast (null where that fails)."""
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(schema)])


def append_typed(rows: DataFrame, folder: str, schema: str, batch: str) -> None:
    """A batch of typed rows into a table; a batch that is written again replaces itself."""
    typed = projected(rows, schema).withColumn("batch", F.lit(batch))
    typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def append_csv(rows: DataFrame, folder: str) -> None:
    """Rows to a CSV journal with header; doubles are written so that they read back equal."""
    rows.write.mode("append").option("header", True).csv(folder)


def write_report(figures: DataFrame, folder: str, title: str) -> None:
    """The same small table as JSON lines (NaN as null) and as a Markdown table."""
    plain = figures.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in figures.schema])
    plain.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/json")
    head = f"# {title}\n\n| {' | '.join(figures.columns)} |\n|{'-|' * len(figures.columns)}"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain.columns]), F.lit(" |"))
    body = plain.agg(F.concat_ws("\n", F.lit(head), F.array_sort(F.collect_list(line))).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")


def merged(old: DataFrame, new: DataFrame, key: list[str], parameters: str = "parameters") -> DataFrame:
    """Union of two result sets; an error where both have a key under different parameters."""
    both = old.unionByName(new).distinct()
    clash = both.groupBy(*key).agg(F.count_distinct(parameters).alias("_n"))
    return both.join(clash, key).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("a key has results of different parameters")).cast("boolean"))).drop("_n")


def disk_usage(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per stream folder below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"/raw/[^/]+/([^/]+)/", 1).alias("stream")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def beyond_cap(spark: SparkSession, root: str, cap_bytes: int) -> DataFrame:
    """The oldest files that must go for the rest to fit under the cap (the caller deletes them).

    One row per file; sizes are added up from the newest by day first, then inside the day that
    crosses the cap, so no window spans all files.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime").withColumn("_day", F.to_date("modificationTime"))
    days = files.groupBy("_day").agg(F.sum("length").alias("_bytes"))
    newer = Window.partitionBy(F.lit(0)).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_newer", F.coalesce(F.sum("_bytes").over(newer), F.lit(0))).select("_day", "_newer")
    own = Window.partitionBy("_day").orderBy(F.col("modificationTime").desc(), "path")
    return files.join(days, "_day").withColumn("_upto", F.col("_newer") + F.sum("length").over(own)).where(F.col("_upto") > cap_bytes).select("path", "length", "modificationTime")
