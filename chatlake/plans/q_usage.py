"""Registered queries: usage, request tokens, logs, timing, schema
evolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evolve as E
from ..operators import usage as U
from ..session import checkpoint_path
from ..sources import views as V
from ..sources.tables import table
from .oracle_views import with_ctes

MIN_LEVEL = "warning"
STAMP = "2024-01-01 00:00:00"


def rounds(spark, sf):
    """Model-call rounds: one request per user; a view has no usage record,
    an error ends the request with ``stop``, a signup with ``handover``."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    return e.select(F.col("user_id").alias("request_id"),
                    F.when(et == "view", F.lit(None)).otherwise(F.floor(F.col("value") * 10)).cast("bigint").alias("tokens"),
                    F.col("ts"), F.col("event_id").alias("seq"),
                    F.when(et == "error", "stop").when(et == "signup", "handover").otherwise("ok").alias("outcome"))


def timings(spark, sf):
    """Message timing inputs: server time in ms, receive and processed times."""
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id",
                    (F.unix_millis(ts) - F.col("event_id") % 5000).alias("sent_ms"),
                    ts.alias("received"),
                    F.timestamp_micros(F.unix_micros(ts) + (F.col("value") * 1000).cast("bigint")).alias("processed"))


def system_messages(spark, sf):
    """The retired system-message table, rebuilt from settings writes (day
    precision, so ties occur)."""
    s = V.settings_log(spark, sf).where(F.col("setting") == "system_message")
    return s.select("room_id", F.concat(F.lit("$"), F.col("event_id").cast("string")).alias("message_id"),
                    F.concat(F.lit("@u"), (F.col("event_id") % 17).cast("string"), F.lit(":alpha.example")).alias("user_id"),
                    F.col("value").alias("body"),
                    (F.unix_date(F.to_date("ts")).cast("bigint") * 86400000).alias("timestamp"))


def q_usage_by_room(spark, sf):
    return U.tokens_by_room(V.usage_log(spark, sf))


def q_usage_by_api(spark, sf):
    return U.usage_by_api(V.usage_log(spark, sf))


def q_request_tokens(spark, sf):
    return U.request_tokens(rounds(spark, sf))


def q_log_level_filter(spark, sf):
    return U.level_filter(V.log_records(spark, sf), MIN_LEVEL)


def q_log_render(spark, sf):
    return V.log_records(spark, sf).select(U.render_log().alias("line"))


def q_log_parse(spark, sf):
    """Rendered lines, some of them broken: no level, no time, or a month 13."""
    line, n = F.col("line"), F.length("line") + F.ascii(F.substring("line", -2, 1))
    broken = (F.when(n % 7 == 0, F.replace(line, F.lit("] - "), F.lit("] "))).when(n % 7 == 1, F.concat(F.lit("[] - "), F.substr(line, F.lit(33))))
              .when(n % 7 == 2, F.concat(F.substring("line", 1, 6), F.lit("13"), F.substr(line, F.lit(9)))).otherwise(line))
    return U.parse_log(q_log_render(spark, sf).select(broken.alias("line")))


def q_message_timing(spark, sf):
    t = timings(spark, sf)
    lat, proc = U.timing("sent_ms", "received", "processed")
    return t.select("event_id", lat.alias("latency_s"), proc.alias("processing_s"))


def q_format_ts(spark, sf):
    return V.usage_log(spark, sf).select("message_id", U.format_ts("ts").alias("ts_text"))


def q_latest_by_join(spark, sf):
    sm = E.system_messages_to_settings(system_messages(spark, sf))
    return sm.select("room_id", "setting", "value", "message_id", "timestamp")


def q_usage_schema_v6(spark, sf):
    u = V.usage_log(spark, sf).withColumn("n", F.substring("message_id", 2, 20).cast("bigint"))
    old = u.where(F.col("n") % 2 == 0).select("message_id", "room_id", "tokens", F.col("ts").alias("timestamp"))
    new = u.where(F.col("n") % 2 == 1).select("message_id", "room_id", "api", "tokens", F.col("ts").alias("timestamp"))
    return E.merge_versions(E.migrate(old, 0, 8), new)


def q_catalogue_v8(spark, sf):
    """A store at version 4 brought to version 8, all tables as rows."""
    start = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("bigint") for v in (1, 3, 4)])).alias("id"), F.lit(STAMP).cast("timestamp_ntz").alias("timestamp"))
    own = V.settings_log(spark, sf).where("setting = 'model'").groupBy("room_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    usage = V.usage_log(spark, sf)
    tables = {"token_usage": usage.select("message_id", "room_id", "tokens", F.col("ts").alias("timestamp"), "api"), "system_messages": system_messages(spark, sf),
              "room_settings": own.select("room_id", F.lit("model").alias("setting"), "value"), "migrations": start}
    done = E.migrate_catalogue(spark, tables, now=STAMP)
    shape = {"token_usage": ("message_id", "room_id", "api", "tokens"), "room_settings": ("room_id", "setting", "value", None), "migrations": (None, None, None, "id"),
             "user_spaces": ("space_id", "user_id", None, None), "settings": ("setting", None, "value", None)}
    out = None
    for name, cols in shape.items():
        rows = done[name].select(F.lit(name).alias("tbl"), *[(F.col(c) if c else F.lit(None)).cast("bigint" if k == 3 else "string").alias(a)
                                                            for k, (c, a) in enumerate(zip(cols, ("key1", "key2", "value", "n")))])
        out = rows if out is None else out.unionByName(rows)
    return out


def q_usage_records(spark, sf):
    """S3: records of model calls as the sink stores them, written and read back."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    r = U.usage_record(F.concat(F.lit("$"), F.col("event_id").cast("string")), F.concat(F.lit("!r"), (F.col("user_id") % 10).cast("string")),
                       F.lit("openai"), "event_type", F.floor(F.col("value") * 10), F.col("ts").cast("timestamp"))
    path = checkpoint_path(spark, f"usage-{uuid.uuid4().hex}")
    U.append_usage(e.select(r.alias("r")).select("r.*"), path)
    return spark.read.parquet(path).select("message_id", "room_id", "api", "tokens", F.col("ts").cast("timestamp_ntz").alias("ts"))


def q_schema_version(spark, sf):
    """A3 over a ledger written by a migration run per event day (the
    ledger grows with the data; version = highest applied)."""
    e = table(spark, sf, "events").select("event_id")
    ledger = e.select((F.col("event_id") % 9).cast("bigint").alias("id")).where(F.col("id") != 2)
    return E.schema_version(ledger)


ORACLE = {
    "usage_by_room": with_ctes(["usage_log"], [], """
SELECT room_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens FROM usage_log GROUP BY room_id"""),
    "usage_by_api": with_ctes(["usage_log"], [], """
SELECT api, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS units, count(*) AS requests,
       CASE WHEN contains(api, '-dall-e') THEN 'images' WHEN starts_with(api, 'parcel-') THEN 'lookups'
            ELSE 'tokens' END AS unit
FROM usage_log GROUP BY api"""),
    "request_tokens": with_ctes([], [("r", """
SELECT user_id AS request_id, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS tokens,
       ts, event_id AS seq,
       CASE event_type WHEN 'error' THEN 'stop' WHEN 'signup' THEN 'handover' ELSE 'ok' END AS outcome
FROM events""")], """
SELECT request_id, count(*) AS rounds, arg_max(outcome, (ts, seq)) AS outcome,
       CAST(coalesce(sum(tokens) FILTER (WHERE outcome = 'ok'), 0) AS BIGINT) AS tokens
FROM r GROUP BY request_id"""),
    "log_level_filter": with_ctes(["log_records"], [], f"""
SELECT * FROM log_records
WHERE list_position(['trace', 'debug', 'info', 'warning', 'error', 'critical'], level)
      >= list_position(['trace', 'debug', 'info', 'warning', 'error', 'critical'], '{MIN_LEVEL}')"""),
    "log_render": with_ctes(["log_records"], [], """
SELECT concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S:%f'), '] - ', caller, ' - [', upper(level), '] ', message) AS line
FROM log_records"""),
    "log_parse": with_ctes(["log_records"], [("l", """
SELECT *, concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S:%f'), '] - ', caller, ' - [', upper(level), '] ', message) AS line FROM log_records"""),
        ("b", "SELECT *, (length(line) + ascii(substr(line, -2, 1))) % 7 > 2 AS ok FROM l")], """
SELECT CASE WHEN ok THEN ts END AS ts, CASE WHEN ok THEN caller END AS caller, CASE WHEN ok THEN level END AS level,
       CASE WHEN ok THEN message END AS message, CASE WHEN ok THEN 'ok' ELSE 'malformed' END AS status FROM b"""),
    "message_timing": """
SELECT event_id,
       (epoch_us(ts) - (epoch_us(ts) // 1000 - event_id % 5000) * 1000) / 1e6 AS latency_s,
       CAST(CAST(trunc(value * 1000) AS BIGINT) AS DOUBLE) / 1e6 AS processing_s
FROM events""",
    "format_ts": with_ctes(["usage_log"], [], "SELECT message_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM usage_log"),
    "latest_by_join": with_ctes(["settings_log"], [("sm", """
SELECT room_id, concat('$', event_id) AS message_id, value AS body,
       epoch_ms(date_trunc('day', ts)) AS timestamp
FROM settings_log WHERE setting = 'system_message'""")], """
SELECT s.room_id, 'system_message' AS setting, s.body AS value, s.message_id, s.timestamp
FROM sm s JOIN (SELECT room_id, max(timestamp) AS m FROM sm GROUP BY room_id) x
  ON s.room_id = x.room_id AND s.timestamp = x.m"""),
    "usage_schema_v6": with_ctes(["usage_log"], [], """
SELECT message_id, room_id, CASE WHEN CAST(substr(message_id, 2) AS BIGINT) % 2 = 0 THEN 'openai' ELSE api END AS api,
       tokens, ts AS timestamp
FROM usage_log"""),
    "catalogue_v8": with_ctes(["usage_log", "settings_log"], [("sm", """
SELECT room_id, arg_max(value, (date_trunc('day', ts), concat('$', event_id))) AS value FROM settings_log WHERE setting = 'system_message' GROUP BY room_id"""), ("own", """
SELECT room_id, arg_max(value, (ts, event_id)) AS value FROM settings_log WHERE setting = 'model' GROUP BY room_id""")], """
SELECT 'token_usage' AS tbl, message_id AS key1, room_id AS key2, api AS value, tokens AS n FROM usage_log
UNION ALL SELECT 'room_settings', room_id, 'system_message', value, NULL FROM sm
UNION ALL SELECT 'room_settings', room_id, 'model', value, NULL FROM own
UNION ALL SELECT 'migrations', NULL, NULL, NULL, unnest([1, 3, 4, 5, 6, 7, 8])::BIGINT"""),
    "usage_records": with_ctes(["usage_log"], [], "SELECT message_id, room_id, api, tokens, ts FROM usage_log"),
    "schema_version": """
SELECT CAST(coalesce(max(event_id % 9), 0) AS BIGINT) AS version FROM events WHERE event_id % 9 <> 2""",
}

QUERIES = {
    "usage_by_room": q_usage_by_room,
    "usage_by_api": q_usage_by_api,
    "request_tokens": q_request_tokens,
    "log_level_filter": q_log_level_filter,
    "log_render": q_log_render,
    "log_parse": q_log_parse,
    "message_timing": q_message_timing,
    "format_ts": q_format_ts,
    "latest_by_join": q_latest_by_join,
    "usage_schema_v6": q_usage_schema_v6,
    "catalogue_v8": q_catalogue_v8,
    "usage_records": q_usage_records,
    "schema_version": q_schema_version,
}
