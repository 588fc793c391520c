"""Folding an event stream into keyed last-write state.

The aggregation (``max_by(value, order)`` per key) runs in Structured
Streaming's state store in update mode; each micro-batch appends only the keys
it changed to an update log partitioned by batch id (overwritten on replay).
With ``compact_every`` the stream folds the log into a snapshot every so many
micro-batches: the last snapshot and the batches after it, one row per key.  A pointer
file, published at once, names the snapshot and the batch it reaches, so a
reader folds one snapshot and at most the batches after it, however long the log.

Retention (optional): with ``event_time``/``watermark``/``state_window`` the
aggregation is per (key, event-time window) under a watermark, so the state of
a window is dropped once the watermark passes its end; the log still holds
every window's last write, and the compaction picks the latest across them.
"""

from __future__ import annotations

import json
import uuid
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import path_exists
from gleaner.sources.commits import publish


def start_state_stream(events: DataFrame, key: Sequence[str], value: str, order: Sequence[str],
                       log_path: str, checkpoint: str, available_now: bool = True,
                       event_time: Optional[str] = None, watermark: str = "1 hour",
                       state_window: str = "1 day", compact_every: Optional[int] = None):
    ordc = F.struct(*[F.col(c) for c in order])
    aggs = [F.max_by(F.col(value), ordc).alias("last_value"), F.max(ordc).alias("last_order")]
    if event_time is None:
        agg = events.groupBy(*key).agg(*aggs)
    else:
        # watermarks need a zoned timestamp; TIMESTAMP_NTZ is read in the session zone
        agg = (events.withColumn("_et", F.col(event_time).cast("timestamp"))
               .withWatermark("_et", watermark)
               .groupBy(*key, F.window("_et", state_window).alias("w"))
               .agg(*aggs)
               .select(*key, F.col("w.start").alias("window_start"), "last_value", "last_order"))

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").parquet(log_path))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, log_path, key, batch_id)

    w = (agg.writeStream.outputMode("update").foreachBatch(each_batch)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _snapshots(log_path: str) -> str:
    return f"{log_path.rstrip('/')}-snapshots"


def last_snapshot(spark: SparkSession, log_path: str) -> Optional[tuple[int, str]]:
    """(last batch, path) of the newest snapshot."""
    folder = _snapshots(log_path)
    if not path_exists(spark, folder):
        return None
    row = (spark.read.schema("upto long, path string").option("pathGlobFilter", "v-*.json").json(folder)
           .agg(F.max(F.struct("upto", "path")).alias("s")).first())
    return None if row["s"] is None else (int(row["s"]["upto"]), row["s"]["path"])


def state_rows(spark: SparkSession, log_path: str, key: Sequence[str], upto: Optional[int] = None) -> DataFrame:
    """key, last_value, last_order, batch_id: the latest write per key of the snapshot and of the
    log's batches behind it (to ``upto``)."""
    newest = last_snapshot(spark, log_path)
    log = spark.read.parquet(log_path)
    cols = [*key, "last_value", "last_order", "batch_id"]
    if newest is not None:
        log = log.where(F.col("batch_id") > newest[0])                # partitions before it aren't read
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    rows = log.select(*cols)
    if newest is not None:
        rows = rows.unionByName(spark.read.parquet(newest[1]).select(*cols))
    latest = F.max_by(F.struct("last_value", "last_order", "batch_id"), F.struct("last_order", "batch_id"))
    return rows.groupBy(*key).agg(latest.alias("s")).select(*key, "s.*")


def compact(spark: SparkSession, log_path: str, key: Sequence[str], upto: int) -> bool:
    """Fold everything to batch ``upto`` into a new snapshot; False if there is one already
    (a replayed batch)."""
    newest = last_snapshot(spark, log_path)
    if newest is not None and newest[0] >= upto:
        return False
    path = f"{_snapshots(log_path)}/upto-{upto}-{uuid.uuid4().hex[:12]}"
    state_rows(spark, log_path, key, upto).write.parquet(path)
    return publish(spark, f"{_snapshots(log_path)}/v-{upto:012d}.json", json.dumps({"upto": upto, "path": path}))


def read_state(spark: SparkSession, log_path: str, key: Sequence[str]) -> DataFrame:
    """Compacted state: per key, the value of the latest write (by event order,
    then by batch for repeated updates of one session)."""
    return state_rows(spark, log_path, key).select(*key, "last_value")
