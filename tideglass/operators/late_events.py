"""Aggregates by event time that are corrected as late records arrive, up to a cut-off."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS, PERIOD_MS, floor_to
from tideglass.session import ROWS_PER_TASK, shared_folder, tasks_for

RECORD = ["src_table", "rec_id", "symbol", "event_ms", "price", "size"]
NO_BLOCK = "none"


class PeriodStore:
    """Retained raw events and, per event-time partition, the records and aggregates derived from them.

    ``ingest(batch)`` appends the batch to the raw events, finds the partitions (UTC days of event
    time) that hold the periods it touches, recomputes those partitions entirely from the raw
    events of all batches so far and publishes them together by one atomic rename of a new
    manifest. A reader sees all of a batch's corrections or none. A failed ingest leaves files that
    no manifest names and is simply run again. Of two writers that take in the same batch number
    only one can publish: the other's rename fails, and it is told to run again. ``ingest_all``
    takes in a backlog: the feed is read and routed to its batches in one pass.

    A record is (src_table, rec_id); it may be delivered several times and arrives with its first
    delivery. Against the end of its period a record is ``on_time`` up to ``late_ms``, ``late`` up
    to ``cutoff_ms`` (its period is corrected) and ``too_late`` beyond (kept and reported, not
    aggregated). A record without arrival time is ``unknown`` and is aggregated. Records without
    event time cannot be placed: they stay in the raw events with a null partition and have no
    outcome. Null symbols form a group of their own.

    Batches must come in order of arrival, as only then the first delivery is known; a batch may
    have any size. Tasks follow the volume: raw events are written in pieces that the planner sizes
    by bytes, and a partition is recomputed in as many slots (by record id) as its row count needs,
    so a busy day is never one task, and each slot writes one file. A batch costs one exchange of
    its own rows and one of the touched partitions.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str | None = None,
        period_ms: int = PERIOD_MS,
        late_ms: int = 10_000,
        cutoff_ms: int = 600_000,
        block_ms: int = DAY_MS,
        rows_per_slot: int = ROWS_PER_TASK,
    ):
        self.spark, self.folder = spark, folder or shared_folder(spark)
        self.period_ms, self.late_ms, self.cutoff_ms, self.block_ms, self.rows_per_slot = period_ms, late_ms, cutoff_ms, block_ms, rows_per_slot
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: self._hadoop.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    # -- manifest ---------------------------------------------------------------------------
    def _manifest(self) -> dict:
        """The newest manifest: ``batches``, the raw folder of each, and per block its version folder and raw row count."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        numbers = [int(n[9:-5]) for n in names if n.startswith("manifest.") and n.endswith(".json")]
        if not numbers:
            return {"batches": 0, "raw": [], "blocks": {}, "rows": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifest.{max(numbers):09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The rename does not overwrite: who comes second for a batch number fails."""
        fresh, at = self._path(f"{self.folder}/{uuid.uuid4().hex}.tmp"), self._path(f"{self.folder}/manifest.{manifest['batches']:09d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        modes = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fresh, at, modes)
        except Exception as e:
            if self._fs.exists(at):
                raise RuntimeError(f"another writer has published batch {manifest['batches'] - 1}: run the ingest again") from e
            raise

    # -- writing ----------------------------------------------------------------------------
    def _placed(self, events: DataFrame, known: list[str], untimed: str) -> DataFrame:
        """The events with event time and block; ``ts`` 0 takes the first delivery's receive time, over all batches."""
        rows = events.select("src_table", "rec_id", "symbol", "ts", "price", "size", "recv_ts", *[c for c in events.columns if c == "_batch"])
        own = rows.where("ts IS NULL OR ts <> 0").withColumn("event_ms", F.col("ts"))
        bare = rows.where("ts = 0")
        bare.groupBy("src_table", "rec_id").agg(F.min("recv_ts").alias("_first")).write.mode("overwrite").parquet(untimed)
        firsts = self.spark.read.schema("src_table string, rec_id long, _first double").parquet(*known, untimed).groupBy("src_table", "rec_id").agg(F.min("_first").alias("_first"))
        bare = bare.join(firsts, ["src_table", "rec_id"]).withColumn("event_ms", F.floor(F.col("_first") * 1000).cast("long"))
        placed = own.unionByName(bare.drop("_first")).drop("ts")
        block = floor_to(F.col("event_ms"), self.block_ms)
        return placed.withColumn("block", F.coalesce(block.cast("string"), F.lit(NO_BLOCK)))

    def ingest(self, batch: DataFrame) -> list[int]:
        """Take in one batch (src_table, rec_id, symbol, ts, price, size, recv_ts); returns the blocks recomputed."""
        manifest = self._manifest()
        raw = f"{self.folder}/raw/{uuid.uuid4().hex}"
        self._placed(batch, self._untimed(manifest), f"{raw}/untimed").hint("rebalance", "block").write.partitionBy("block").parquet(f"{raw}/rows")
        return self._taken_in(manifest, f"{raw}/rows")

    def ingest_all(self, events: DataFrame, batches: int) -> list[list[int]]:
        """Take in ``events`` as ``batches`` slices of arrival time, one after the other; returns the blocks recomputed by each.

        The feed is read twice whatever the number of batches: for the range of arrival times (one
        column) and to route its rows to (batch, block). Rows without arrival time go with the first.
        """
        low, high = events.agg(F.min("recv_ts"), F.max("recv_ts")).first()
        if low is None or batches < 2 or high <= low:
            return [self.ingest(events)]
        number = F.floor((F.col("recv_ts") - low) / F.lit((high - low) / batches)).cast("int")
        routed = events.withColumn("_batch", F.coalesce(F.least(number, F.lit(batches - 1)), F.lit(0)))
        manifest = self._manifest()
        raw = f"{self.folder}/raw/{uuid.uuid4().hex}"
        self._placed(routed, self._untimed(manifest), f"{raw}/untimed").hint("rebalance", "_batch", "block").write.partitionBy("_batch", "block").parquet(f"{raw}/rows")
        return [self._taken_in(self._manifest(), f"{raw}/rows/_batch={n}") for n in range(batches)]

    @staticmethod
    def _untimed(manifest: dict) -> list[str]:
        """Where the first receive times of records without own time lie, of all batches so far."""
        return list(dict.fromkeys(f"{r.rpartition('/rows')[0]}/untimed" for r in manifest["raw"]))

    def _taken_in(self, manifest: dict, raw: str) -> list[int]:
        """Recompute what the raw rows of a batch touch, and publish."""
        manifest["raw"].append(raw)
        touched = [b for b in self._blocks_of(raw) if b is not None]
        if touched:
            # footers only: the count reads no column
            fresh = self._read([raw], touched).groupBy("block").count().collect()
            for r in fresh:
                manifest["rows"][r["block"]] = manifest["rows"].get(r["block"], 0) + r["count"]
            version = f"{self.folder}/records/{uuid.uuid4().hex}"
            self._recomputed(manifest, touched).write.partitionBy("block").parquet(version)
            manifest["blocks"] |= {str(b): version for b in touched}
        manifest["batches"] += 1
        self._publish(manifest)
        return touched

    def _blocks_of(self, folder: str) -> list[int | None]:
        at = self._path(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        values = [n.partition("=")[2] for n in names if n.startswith("block=")]
        return sorted((None if v == NO_BLOCK else int(v) for v in values), key=lambda v: (v is not None, v))

    def _read(self, folders: list[str], blocks: list[int]) -> DataFrame:
        """Raw events of the blocks from every folder that has some; other partitions are never listed."""
        reads = []
        for base in folders:
            have = set(self._blocks_of(base))
            paths = [f"{base}/block={b}" for b in blocks if b in have]
            if paths:
                reads.append(self.spark.read.option("basePath", base).schema(self._raw_schema).parquet(*paths))
        out = reads[0]
        for r in reads[1:]:
            out = out.unionByName(r)
        return out

    _raw_schema = "src_table string, rec_id long, symbol string, price double, size double, recv_ts double, event_ms long, block string"

    def _recomputed(self, manifest: dict, blocks: list[int]) -> DataFrame:
        """Single records of the blocks with arrival, period and outcome, each slot of a block in a task of its own."""
        counts = {b: manifest["rows"][str(b)] for b in blocks}
        total = sum(counts.values())
        least = max(1, min(self.rows_per_slot, -(-total // tasks_for(self.spark, total))))
        slots, places = 0, []
        for b, n in counts.items():
            own = -(-n // least)
            places.append((str(b), slots, own))
            slots += own
        # one row per touched block: days of the recording, not rows of it
        where = F.broadcast(self.spark.createDataFrame(places, "block string, _from int, _slots int"))
        rows = self._read(manifest["raw"], blocks).join(where, "block")
        task = F.col("_from") + F.pmod(F.xxhash64("src_table", "rec_id"), F.col("_slots").cast("long")).cast("int")
        own = rows.withColumn("_task", task).drop("_from", "_slots").repartitionById(slots, F.col("_task"))
        single = own.groupBy("_task", "block", *RECORD).agg(F.min("recv_ts").alias("recv_ts"))
        end = floor_to(F.col("event_ms"), self.period_ms) + self.period_ms
        delay = F.col("recv_ts") * 1000 - end
        outcome = (
            F.when(F.col("recv_ts").isNull(), "unknown")
            .when(delay > self.cutoff_ms, "too_late")
            .when(delay > self.late_ms, "late")
            .otherwise("on_time")
        )
        return single.select(*RECORD, (end - self.period_ms).alias("period_ms"), "recv_ts", outcome.alias("outcome"), "block")

    # -- reading ----------------------------------------------------------------------------
    def records(self) -> DataFrame:
        """Every placed record once, with its outcome, as of the last published batch."""
        manifest = self._manifest()
        schema = "src_table string, rec_id long, symbol string, event_ms long, price double, size double, period_ms long, recv_ts double, outcome string, block long"
        by: dict[str, list[str]] = {}
        for block, version in manifest["blocks"].items():
            by.setdefault(version, []).append(f"{version}/block={block}")
        out = self.spark.createDataFrame([], schema)
        for k, (version, paths) in enumerate(by.items()):
            part = self.spark.read.option("basePath", version).schema(schema).parquet(*paths)
            out = part if k == 0 else out.unionByName(part)
        return out

    def compact(self) -> int:
        """Delete versions of partitions that the newest manifest no longer names; returns how many folders went. Not while old readers run."""
        named = set(self._manifest()["blocks"].values())
        root, gone = self._path(f"{self.folder}/records"), 0
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if f"{self.folder}/records/{s.getPath().getName()}" not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone

    def aggregates(self) -> DataFrame:
        """Per source table, symbol and period: records taken in, how many late or too late, size, prices."""
        kept = F.col("outcome") != "too_late"
        price = F.when(kept, F.col("price"))
        order = F.when(kept & F.col("price").isNotNull(), F.struct("event_ms", "rec_id"))
        return (
            self.records()
            .groupBy("src_table", "symbol", "period_ms")
            .agg(
                F.count_if(kept).alias("records"),
                F.count_if(F.col("outcome") == "late").alias("late_records"),
                F.count_if(F.col("outcome") == "too_late").alias("too_late_records"),
                F.round(F.sum(F.when(kept, F.col("size"))), 6).alias("total_size"),
                F.min(price).alias("low"),
                F.max(price).alias("high"),
                F.max_by("price", order).alias("last"),
            )
        )


def arrival_batches(events: DataFrame, batches: int) -> list[DataFrame]:
    """``events`` cut into ``batches`` slices of arrival time; rows without arrival time are in the first."""
    low, high = events.agg(F.min("recv_ts"), F.max("recv_ts")).first()
    if low is None or batches < 2 or high <= low:
        return [events]
    cuts = [low + (high - low) * k / batches for k in range(1, batches)]
    at = F.col("recv_ts")
    out = [events.where(at.isNull() | (at < cuts[0]))]
    out += [events.where((at >= a) & (at < b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [*out, events.where(at >= cuts[-1])]
