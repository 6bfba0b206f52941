"""Report each secret once while files keep arriving."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from keysift import schemas
from keysift.catalog import Pattern
from keysift.operators.dedup import deduplicate
from keysift.options import ScanOptions
from keysift.plans.scan import detect
from keysift.session import delete_folder

# Leading hex digits of a hash that name its folder.
PREFIX = 2
_ROWS = schemas.FINDINGS + ", run STRING, batch_id BIGINT"
_TABLE = _ROWS + ", part STRING, prefix STRING"
_MERGES = "merged STRING, replaced ARRAY<STRING>"
# The run of findings that were there before any stream.
_BEFORE = "before"
_MERGED = "merged-"


def _prefix(secret_hash: Column) -> Column:
    return F.substring(secret_hash, 1, PREFIX)


def _write_part(rows: DataFrame, table: str, part: str) -> None:
    """One file for each hash prefix, sorted by hash; the part is replaced if it is there."""
    rows.select("*", _prefix(F.col("secret_hash")).alias("prefix")).repartition(
        "prefix").sortWithinPartitions("prefix", "secret_hash").write.mode("overwrite").partitionBy(
        "prefix").parquet(f"{table}/findings/part={part}")


def _live(spark: SparkSession, table: str) -> DataFrame:
    """All rows with their part and prefix, without parts that a merge has replaced or left undone."""
    merges = spark.read.schema(_MERGES).json(f"{table}/merges").collect()  # a row for each merge
    replaced = {x for r in merges for x in r["replaced"]}
    done = [r["merged"] for r in merges if r["merged"] not in replaced]
    rows = spark.read.schema(_TABLE).parquet(f"{table}/findings")
    rows = rows.where(~F.col("part").startswith(_MERGED) | F.col("part").isin(done))
    return rows.where(~F.col("part").isin(sorted(replaced))) if replaced else rows


def read_findings_table(
    spark: SparkSession, table: str, prefixes: Sequence[str] | None = None
) -> DataFrame:
    """The findings with their run and batch; with ``prefixes``, only those folders are read."""
    rows = _live(spark, table)
    if prefixes is not None:
        rows = rows.where(F.col("prefix").isin(list(prefixes)))
    return rows.drop("part", "prefix")


def create_findings_table(spark: SparkSession, table: str, known: DataFrame | None = None) -> None:
    """An empty findings table, or one holding the findings of an earlier scan (batch -1).

    Rows lie in ``findings/part=<run and batch>/prefix=<start of the hash>``; ``merges`` lists
    which parts were merged into which.
    """
    columns = [f.name for f in spark.createDataFrame([], schemas.FINDINGS).schema]
    rows = spark.createDataFrame([], schemas.FINDINGS) if known is None else known.select(*columns)
    _write_part(rows.select("*", F.lit(_BEFORE).alias("run"), F.lit(-1).cast("long").alias("batch_id")),
                table, f"{_BEFORE}-0")
    spark.createDataFrame([], _MERGES).write.mode("overwrite").json(f"{table}/merges")


def earlier_hashes(
    spark: SparkSession, table: str, batch: DataFrame, run: str, batch_id: int
) -> DataFrame:
    """(secret_hash) of ``batch`` (secret_hash) that other batches of the table hold.

    Only folders of the prefixes in the batch are read (at most 16^PREFIX names come to the
    driver), and of them only the hash, run and batch; what is read is never shuffled for a
    small batch, as only its hashes are kept.
    """
    prefixes = [r[0] for r in batch.select(_prefix(F.col("secret_hash"))).distinct().collect()]
    earlier = read_findings_table(spark, table, [p for p in prefixes if p is not None]).where(
        (F.col("run") != run) | (F.col("batch_id") != batch_id))
    return earlier.select("secret_hash").join(
        batch.select("secret_hash"), "secret_hash", "left_semi").distinct()


def scan_new(
    files: DataFrame,
    table: str,
    checkpoint: str,
    options: ScanOptions | None = None,
    custom: Iterable[Pattern] = (),
) -> StreamingQuery:
    """Scan what has arrived, append findings with unseen hashes to ``table``, and stop.

    Each batch owns a part named by its checkpoint and number and replaces it, so streams with
    checkpoints of their own can share a table.  It compares itself with all other batches, so a
    batch that is run again after a failure leaves the same rows.  What a batch reads of the table
    follows from its own hashes (``earlier_hashes``); ``merge_parts`` keeps the files few.
    """
    options = options or ScanOptions()
    custom = list(custom)
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = deduplicate(detect(batch, options, custom)).persist()
        try:
            seen = earlier_hashes(spark, table, found, run, batch_id)
            fresh = found.join(seen, "secret_hash", "left_anti").select(*found.columns)
            _write_part(fresh.select("*", F.lit(run).alias("run"),
                                     F.lit(batch_id).cast("long").alias("batch_id")),
                        table, f"{run}-{batch_id}")
        finally:
            found.unpersist()

    return (
        files.writeStream.foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_parts(spark: SparkSession, table: str, keep: bool = False) -> int:
    """Merge the parts of finished batches into one; returns how many were merged.

    The last batch of each run may still be run again and stays as it is; all earlier ones are
    finished, and so are earlier merges.  The merged part counts only once ``merges`` names it,
    and from then on the replaced ones don't, so a merge that is cut off has no effect.  The
    replaced parts are then deleted, unless ``keep`` is set for readers that are still at work.
    Only one merge may run at a time; streams may go on meanwhile.
    """
    live = _live(spark, table)
    # A row for each part and run.
    held = live.groupBy("part", "run").agg(F.max("batch_id").alias("batch_id")).collect()
    last: dict[str, int] = {}
    for r in held:
        last[r["run"]] = max(last.get(r["run"], -1), r["batch_id"])
    open_ = {r["part"] for r in held if not r["part"].startswith(_MERGED)
             and r["run"] != _BEFORE and r["batch_id"] == last[r["run"]]}
    replaced = sorted({r["part"] for r in held} - open_)
    if len(replaced) < 2:
        return 0
    merged = f"{_MERGED}{uuid.uuid4().hex}"
    _write_part(live.where(F.col("part").isin(replaced)).drop("part", "prefix"), table, merged)
    spark.createDataFrame([(merged, replaced)], _MERGES).coalesce(1).write.mode("append").json(
        f"{table}/merges")
    if not keep:
        for part in replaced:
            delete_folder(spark, f"{table}/findings/part={part}")
    return len(replaced)


def distinct_secrets(
    findings: DataFrame, ingest_time: str | None = None, horizon: str = "7 days"
) -> DataFrame:
    """A findings stream without repeated hashes.

    Without a time column the state keeps every hash ever seen.  With one, hashes
    are forgotten after ``horizon`` and a later repeat is reported again; for
    complete history use ``scan_new``.
    """
    if ingest_time is None:
        return findings.dropDuplicates(["secret_hash"])
    return findings.withWatermark(ingest_time, horizon).dropDuplicatesWithinWatermark(
        ["secret_hash"])


# The class is nested, so it travels to the workers whole and this package need not be installed there.


def _sightings(time: str, order: list[str], horizon_ms: int) -> StatefulProcessor:
    class Sightings(StatefulProcessor):
        """Remembers when a hash was seen last, until it has not been seen for the horizon."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "seen BIGINT")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows)).sort_values([time, *order], kind="stable")
            seen = frame[time].astype("datetime64[ms]").astype("int64").to_numpy()
            never = -horizon_ms - 1 + seen[0]
            before = self.last.get()[0] if self.last.exists() else never
            # The latest sighting ahead of each row, in time.
            ahead = np.maximum.accumulate(np.concatenate([[before], seen[:-1]]))
            latest = max(before, int(seen[-1]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + horizon_ms)
            self.last.update((latest,))
            yield frame[seen - ahead >= horizon_ms]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Sightings()


def recurring_secrets(
    findings: DataFrame, time: str, horizon: timedelta = timedelta(days=7),
    lateness: timedelta = timedelta(hours=1),
) -> DataFrame:
    """The findings of a stream whose hash was not seen in the ``horizon`` before them, by event time.

    A secret that stays in sight is reported once; one that comes back after the horizon is reported
    again.  The state holds a time for each hash seen in the last horizon: a timer at the end of it
    removes the hash, so the state follows the traffic of one horizon and not the history.  Findings
    later than ``lateness`` are dropped; a null hash or time is no sighting.  The rows of one hash in
    one batch are sorted by one task.  The session needs the RocksDB state store
    (``ROCKSDB``).
    """
    order = [c for c in ("repo", "path", "line", "pattern", "occurrence") if c in findings.columns]
    timed = findings.where(F.col("secret_hash").isNotNull() & F.col(time).isNotNull())
    return timed.withWatermark(time, f"{int(lateness.total_seconds() * 1000)} milliseconds").groupBy(
        "secret_hash").transformWithStateInPandas(
        statefulProcessor=_sightings(time, order, int(horizon.total_seconds() * 1000)),
        outputStructType=findings.schema, outputMode="Append", timeMode="EventTime")


#: Settings for streams with timers.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
