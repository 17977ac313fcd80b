"""Structured Streaming pipelines.

* S2/T1: a file stream with a checkpoint is the resume token; the first
  run is the full catch-up, later runs continue where the checkpoint left
  off; ``trigger(availableNow=True)`` is the one-last-sync on shutdown.
* T3: settings commands are parsed per micro-batch and appended to a change
  log, which is compacted to the latest value per key.
* T4: usage totals are kept as additive deltas, one row per key and batch, and compacted by
  adding them up.
* T5: re-delivered events are dropped by an anti-join with an index of the keys on
  shared storage, so nothing is held in streaming state and lateness has no limit; or
  with ``dropDuplicatesWithinWatermark`` where lateness is known.
* T2: events in any order; a batch recomputes the affected end of the rooms that
  it touches and emits what has changed.

T2 to T5 keep their data in ``logstore.LogStore``: a reduced base, a bounded tail, a manifest.

All sinks and checkpoints live under the session's ``spark.checkpoint.dir``
(a shared folder on a cluster), so a lost executor or driver restart
resumes from the last committed batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settings import latest_per_key
from ..operators.spaces import abandoned_increment
from ..session import checkpoint_path
from .logstore import LogStore, hashed_part


def file_stream(spark: SparkSession, folder: str, glob: str = "*.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream over the files of ``folder`` matching ``glob``,
    with the schema of the files already there (read from the footers, no
    inference of data).  New files that land in the folder are picked up by
    later triggers; the checkpoint records which files were consumed."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    r = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a parquet table at ``path``, be it one file or a folder of
    files of any names, as ``spark.read.parquet(path)`` takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return file_stream(spark, path, "*")
    return file_stream(spark, p.getParent().toString(), p.getName())


def new_run_dir(spark: SparkSession, name: str) -> str:
    return checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def run_available_now(df: DataFrame, out_dir: str, output_mode: str = "append",
                      foreach_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available, then stop (S2's final catch-up)."""
    w = (df.writeStream.outputMode(output_mode)
         .option("checkpointLocation", f"{out_dir}/_checkpoint")
         .trigger(availableNow=True))
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").option("path", f"{out_dir}/data").start()
    q.awaitTermination()


def run_continuously(df: DataFrame, out_dir: str, interval: str = "30 seconds", output_mode: str = "append",
                     foreach_batch: Callable[[DataFrame, int], None] | None = None):
    """S2's sync loop: a micro-batch every ``interval`` from the checkpointed
    position; returns the running query (stop it, then call
    ``run_available_now`` with the same ``out_dir`` for the final catch-up)."""
    w = (df.writeStream.outputMode(output_mode)
         .option("checkpointLocation", f"{out_dir}/_checkpoint")
         .trigger(processingTime=interval))
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start()
    return w.format("parquet").option("path", f"{out_dir}/data").start()


# --------------------------------------------------------------------- T3

SETTINGS = "room_id string, setting string, value string, ts timestamp, event_id bigint"


def settings_store(spark: SparkSession, out_dir: str, every: int = 8) -> LogStore:
    return LogStore(spark, f"{out_dir}/log", SETTINGS, lambda d: latest_per_key(d, ["room_id", "setting"], ["value"]), hashed_part("room_id"), every)


def change_log_sink(out_dir: str, every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for T3: append the batch's settings writes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        settings_store(batch.sparkSession, out_dir, every).appended(batch.withColumn("ts", F.col("ts").cast("timestamp")), batch_id)

    return write


def read_settings(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest value per ``(room_id, setting)``."""
    return settings_store(spark, out_dir).current()


# --------------------------------------------------------------------- T4

TOTALS = "api string, units bigint, requests bigint"


def _added_up(d: DataFrame) -> DataFrame:
    return d.groupBy("api").agg(F.sum("units").alias("units"), F.sum("requests").alias("requests"))


def totals_store(spark: SparkSession, out_dir: str, every: int = 8) -> LogStore:
    return LogStore(spark, f"{out_dir}/totals", TOTALS, _added_up, None, every)


def totals_sink(out_dir: str, every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for T4 on usage records (``api``, ``tokens``): the batch's totals are added to the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        deltas = batch.groupBy("api").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("units"), F.count("*").alias("requests"))
        totals_store(batch.sparkSession, out_dir, every).appended(deltas, batch_id)

    return write


def read_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    return totals_store(spark, out_dir).current()


# --------------------------------------------------------------------- T2

MEMBERS = "room_id string, user_id string, membership string, ts timestamp, event_id bigint"
ABANDONED = "room_id string, user_id string, event_id bigint, ts timestamp, members_after bigint, sign int"


def member_store(spark: SparkSession, out_dir: str, every: int = 8) -> LogStore:
    return LogStore(spark, f"{out_dir}/members", MEMBERS, None, hashed_part("room_id"), every)


def _net(d: DataFrame) -> DataFrame:
    """Changes that cancel out are gone; what remains holds."""
    keys = ["room_id", "user_id", "event_id", "ts", "members_after"]
    return d.groupBy(*keys).agg(F.sum("sign").cast("int").alias("sign")).where("sign != 0")


def abandoned_store(spark: SparkSession, out_dir: str, every: int = 8) -> LogStore:
    return LogStore(spark, f"{out_dir}/abandoned", ABANDONED, _net, hashed_part("room_id"), every)


def abandoned_sink(out_dir: str, every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for T2, for events in any order.

    An event changes the member counts of its room from its own time on.  For each room of the
    batch the stored events before the batch's first one are reduced to the membership that they leave
    (one aggregation); the events after it, without and with the batch, give the abandoned
    events before and now, and the differences are appended with a sign.  What is written
    for a batch is the batch and its differences, whatever the history; what is read
    are the parts of the rooms it touches.  For events that arrive in order there is nothing after it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events, results = member_store(spark, out_dir, every), abandoned_store(spark, out_dir, every)
        cols = events.columns
        batch = batch.select(*cols).withColumn("ts", F.col("ts").cast("timestamp")).persist()
        try:
            parts = [r[0] for r in batch.select(events.part.alias("p")).distinct().collect()]       # at most PARTS
            first = batch.groupBy(F.col("room_id").alias("_room")).agg(F.min(F.struct("ts", "event_id")).alias("_first"))
            stored = events.read(before=batch_id, parts=parts).join(first, F.col("room_id") == F.col("_room"))
            early = F.struct("ts", "event_id") < F.col("_first")
            state = latest_per_key(stored.where(early).select(*cols), ["room_id", "user_id"], ["membership"])
            later = stored.where(~early).select(*cols)
            then, _ = abandoned_increment(later, state)
            now, _ = abandoned_increment(later.unionByName(batch), state)
            changes = _net(now.withColumn("sign", F.lit(1)).unionByName(then.withColumn("sign", F.lit(-1))))
            results.append(changes, batch_id)
            events.append(batch, batch_id)
            for store in (results, events):
                if len(store.batches()) >= every:
                    store.compact()
        finally:
            batch.unpersist()

    return run


def read_abandoned(spark: SparkSession, out_dir: str) -> DataFrame:
    """Leave events after which one member was left, by all events so far."""
    return abandoned_store(spark, out_dir).current().drop("sign")


# --------------------------------------------------------------------- T5


def dedup_redelivered(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """T5 where lateness is known: keys within the watermark are remembered, and a row later than
    that, first delivery or not, is dropped.  ``dedup_sink`` has no such limit."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def key_index(spark: SparkSession, out_dir: str, key_type: str = "bigint", every: int = 8) -> LogStore:
    """The keys seen so far.  Parts follow the event's day, which a re-delivery shares, so
    a live stream consults the parts of its recent days only."""
    return LogStore(spark, f"{out_dir}/keys", f"key {key_type}, ts timestamp", None, hashed_part(F.to_date("ts")), every)


def dedup_sink(out_dir: str, key: str = "event_id", ts: str = "ts", every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for T5: each event comes out exactly once, however late its first delivery is, and
    nothing is kept in streaming state.  A re-delivered event has its key and its timestamp."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = key_index(spark, out_dir, batch.schema[key].dataType.simpleString(), every)
        batch = batch.dropDuplicates([key, ts]).persist()
        try:
            keys = batch.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ts}`").cast("timestamp").alias("ts"))
            parts = [r[0] for r in keys.select(index.part.alias("p")).distinct().collect()]
            seen = index.read(before=batch_id, parts=parts).select(F.col("key").alias("_key"), F.col("ts").alias("_ts"))
            same = F.col(f"`{key}`").eqNullSafe(F.col("_key")) & F.col(f"`{ts}`").cast("timestamp").eqNullSafe(F.col("_ts"))
            if batch_id <= index.manifest()["upto"]:
                return                                             # a replay; its rows were written before its keys
            batch.join(seen, same, "left_anti").write.mode("overwrite").parquet(f"{out_dir}/data/batch_id={batch_id}")
            index.appended(keys, batch_id)
        finally:
            batch.unpersist()

    return run


def read_deduped(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.option("basePath", f"{out_dir}/data").parquet(f"{out_dir}/data").drop("batch_id")


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the fixtures store TIMESTAMP_NTZ (read as
    UTC, the session zone)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))
