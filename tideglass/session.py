"""Session settings the engine relies on, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a task should hold at most where an operator chooses the number of tasks itself.
ROWS_PER_TASK = 2_000_000
#: Fewer rows than this are not worth a task of their own.
LEAST_PER_TASK = 20_000
_FOLDERS: list[str] = []

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the engine's runtime options on a session (UTC clock, adaptive plans). Idempotent."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks ``rows`` should make: none larger than ``rows_per_task``, and enough to keep all cores busy."""
    busy = min(4 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_PER_TASK))
    return max(1, busy, -(-rows // rows_per_task))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach, deleted by ``clear_shared`` or when the driver ends.

    It lies under ``spark.checkpoint.dir``; only where that is unset and driver and executors are one
    process (tests) a temporary folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tideglass")
    folder = f"{root.rstrip('/')}/tg-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    _FOLDERS.append(folder)
    return folder


def clear_shared(spark: SparkSession) -> int:
    """Delete the shared folders made so far; call it when no result that reads from them is needed any more."""
    gone = 0
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def planned_with(frames: list[DataFrame], options: dict[str, str]) -> list[DataFrame]:
    """The frames in a session of their own: the caller's options and ``options`` on top.

    What is built on them is planned with ``options``; the caller's session and its other plans keep
    theirs. The data, caches and executors are shared.
    """
    spark = frames[0].sparkSession
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **options}.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    place = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    return [DataFrame(place(own._jsparkSession, f._jdf.logicalPlan()), own) for f in frames]


def written(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet in ``folder`` and return the table read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder) if not partition_by else df.sparkSession.read.parquet(folder)
