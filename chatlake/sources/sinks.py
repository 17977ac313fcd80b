"""Batch sinks for the stored tables.

The reference keeps small SQLite tables; here every store is a Parquet (or
JSON-lines) folder written by Spark: append-only where the reference
inserts, latest-per-key views where it upserts, and whole-table rewrites
into a new folder where it updates in place.  Paths are folders on shared
storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settings import latest_per_key

SETTINGS_COLUMNS = ["room_id", "setting", "value", "ts", "event_id"]


def append_settings(changes: DataFrame, path: str) -> None:
    """S5 write side: append setting writes to the change log (partitioned
    by day)."""
    (changes.select(*SETTINGS_COLUMNS).withColumn("day", F.to_date("ts"))
     .write.mode("append").partitionBy("day").parquet(path))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """S5 read side: the latest value per (room, setting) — last write wins."""
    return latest_per_key(spark.read.parquet(path).select(*SETTINGS_COLUMNS), ["room_id", "setting"], ["value"])


def write_outbox(envelopes: DataFrame, path: str, ts: str = "ts") -> None:
    """S10/S11 sink: outgoing envelopes ``(room_id, event_type, content)``
    as JSON lines, appended and partitioned by day; a sender process reads
    them in order of ``ts``."""
    (envelopes.select("room_id", "event_type", "content", ts).withColumn("day", F.to_date(ts))
     .write.mode("append").partitionBy("day").json(path))


def write_spaces(spaces: DataFrame, path: str) -> None:
    """The spaces table after inserts or deactivation, written as a
    new version (overwrite of its own folder; readers switch folders)."""
    spaces.select("space_id", "user_id", "active").write.mode("overwrite").parquet(path)
