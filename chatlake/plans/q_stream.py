"""Registered queries: streaming pipelines run to completion with
``availableNow`` and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators import routing as R
from ..operators import settings as S
from ..operators import usage as U
from ..sources import views as V
from ..sources.tables import table
from ..streaming import streams as ST
from .q_routing import ORACLE as ROUTING_ORACLE
from .q_spaces import ORACLE as SPACES_ORACLE
from .q_usage import ORACLE as USAGE_ORACLE
from .q_settings import SETTINGS_STEPS
from .oracle_views import with_ctes

CFG = DEFAULT_CONFIG


#: Files that a table is split into, out of time order, and files of a micro-batch.
FILES, PER_BATCH = 6, 2


def _src(spark, sf, name):
    return ST.table_stream(spark, f"{sf.rstrip('/')}/{name}.parquet")


def _split(spark, sf, name, out, key, *columns):
    """A stream of the table as it may arrive: several files, out of time order, several micro-batches."""
    rows = table(spark, sf, name).select(*columns) if columns else table(spark, sf, name)
    rows.repartition(FILES, key).write.parquet(f"{out}/arriving")
    return ST.file_stream(spark, f"{out}/arriving", max_files_per_trigger=PER_BATCH)


def q_stream_route(spark, sf):
    out = ST.new_run_dir(spark, "route")
    m = R.dispatch(V.messages_of(_src(spark, sf, "conversations")))
    routed = m.select("room_id", "event_id", "handler",
                      F.when(F.col("handler") == "message", R.route(cfg=CFG)).alias("route"))
    ST.run_available_now(routed, out)
    return spark.read.parquet(f"{out}/data")


def q_stream_settings(spark, sf):
    out = ST.new_run_dir(spark, "settings")
    cmds = S.validate_commands(V.settings_commands_of(_split(spark, sf, "events", out, "event_id")), cfg=CFG)
    writes = cmds.where(F.col("status") == "store").select("room_id", "setting", "value", "ts", "event_id")
    ST.run_available_now(writes, out, foreach_batch=ST.change_log_sink(out, every=2))
    return ST.read_settings(spark, out).select("room_id", "setting", "value")


def q_stream_usage(spark, sf):
    out = ST.new_run_dir(spark, "usage")
    u = V.usage_log_of(_split(spark, sf, "events", out, "event_id"))
    ST.run_available_now(u, out, foreach_batch=ST.totals_sink(out, every=2))
    return ST.read_totals(spark, out).withColumn("unit", U.unit_of("api"))


def q_stream_dedup(spark, sf):
    """Each event is delivered twice, mostly in different micro-batches."""
    out = ST.new_run_dir(spark, "dedup")
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    twice = e.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1))))
    twice.repartition(FILES, "event_id", "_n").drop("_n").write.parquet(f"{out}/arriving")
    ST.run_available_now(ST.file_stream(spark, f"{out}/arriving", max_files_per_trigger=PER_BATCH), out, foreach_batch=ST.dedup_sink(out, every=2))
    return ST.read_deduped(spark, out).select("event_id", "user_id", "event_type")


def q_stream_abandoned(spark, sf):
    out = ST.new_run_dir(spark, "abandoned")
    members = V.member_events_of(_split(spark, sf, "events", out, "event_id"))
    ST.run_available_now(members, out, foreach_batch=ST.abandoned_sink(out, every=2))
    return ST.read_abandoned(spark, out).select("room_id", "user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "members_after")


_SETTINGS_STORE = with_ctes(["settings_commands"], SETTINGS_STEPS, """
SELECT room_id, setting, stored AS value FROM st WHERE status = 'store'
QUALIFY row_number() OVER (PARTITION BY room_id, setting ORDER BY ts DESC, event_id DESC) = 1""")

ORACLE = {
    "stream_route": ROUTING_ORACLE["message_route"],
    "stream_settings": _SETTINGS_STORE,
    "stream_usage": USAGE_ORACLE["usage_by_api"],
    "stream_dedup": "SELECT event_id, user_id, event_type FROM events",
    "stream_abandoned": SPACES_ORACLE["abandoned_rooms"],
}

QUERIES = {
    "stream_route": q_stream_route,
    "stream_settings": q_stream_settings,
    "stream_usage": q_stream_usage,
    "stream_dedup": q_stream_dedup,
    "stream_abandoned": q_stream_abandoned,
}
