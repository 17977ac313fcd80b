"""Usage accounting, logs and timing.

Every aggregate here runs with partial aggregation before the shuffle, so a
hot room, api or request is pre-reduced to one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOG_LEVELS, LOG_LINE, LOG_TS_FORMAT, PARCEL_API_CODE
from ..functions import text as T
from . import windows as W

USAGE_COLUMNS = ["message_id", "room_id", "api", "tokens", "ts"]


def usage_record(message_id, room_id, api_code, api, tokens, ts: Column | None = None) -> Column:
    """S3: one usage row; ``api`` is ``"{api_code}-{api}"``."""
    return F.struct(T.col(message_id).alias("message_id"), T.col(room_id).alias("room_id"),
                    F.concat_ws("-", T.col(api_code), T.col(api)).alias("api"),
                    T.col(tokens).cast("bigint").alias("tokens"),
                    (ts if ts is not None else F.current_timestamp()).alias("ts"))


def append_usage(records: DataFrame, path: str | None) -> None:
    """S3 sink: append usage rows to a parquet table partitioned by day; a
    no-op without a store."""
    if not path:
        return
    (records.select(*USAGE_COLUMNS).withColumn("day", F.to_date("ts"))
     .write.mode("append").partitionBy("day").parquet(path))


def tokens_by_room(usage: DataFrame) -> DataFrame:
    """A1: total tokens per room (NULL → 0)."""
    return usage.groupBy("room_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))


def unit_of(api) -> Column:
    """What a usage row counts — the image api logs images, the parcel
    api logs one lookup per call, every other api logs tokens."""
    a = T.col(api)
    return (F.when(F.contains(a, F.lit("-dall-e")), F.lit("images"))
            .when(F.startswith(a, F.lit(PARCEL_API_CODE + "-")), F.lit("lookups"))
            .otherwise(F.lit("tokens")))


def usage_by_api(usage: DataFrame) -> DataFrame:
    """Units (NULL → 0) and request count per api."""
    return usage.groupBy("api").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("units"),
                                    F.count("*").alias("requests")) \
        .withColumn("unit", unit_of("api"))


OUTCOMES = ["ok", "stop", "handover"]


def request_tokens(rounds: DataFrame, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """Tokens per request.  A round that itself ends in ``stop`` or
    ``handover`` adds nothing; every other round, before or after it, adds
    its own usage (missing → 0).  ``rounds(request_id, tokens, ts, seq,
    outcome)``; ``outcome`` of the request is that of the last by ``(ts, seq)``.

    The outcome travels as its index in ``outcomes`` and the order as a
    packed key, so every buffer is fixed-width and the aggregation is a
    hash aggregate; an outcome outside the list comes back as NULL."""
    order = W.ordering(rounds, ["ts", "seq"])
    codes = F.array(*[F.lit(o) for o in outcomes])
    counted = F.when(F.col("outcome").isin("stop", "handover"), F.lit(0)).otherwise(F.coalesce(F.col("tokens"), F.lit(0)))
    agg = rounds.groupBy("request_id").agg(
        F.sum(counted).alias("_all"),
        F.max_by(F.array_position(codes, F.col("outcome")).cast("int"), order).alias("_code"),
        F.count("*").alias("rounds"))
    outcome = F.when(F.col("_code") > 0, F.element_at(codes, F.col("_code")))
    return agg.select("request_id", "rounds", outcome.alias("outcome"), F.col("_all").cast("bigint").alias("tokens"))


def level_filter(logs: DataFrame, min_level: str = "info", levels: list[str] = LOG_LEVELS) -> DataFrame:
    """Keep records at or above ``min_level``.  Records of an unknown or
    missing level are not dropped in silence: see ``unknown_levels``."""
    if min_level not in levels:
        raise ValueError(f"{min_level!r} is no log level; the levels are {levels}")
    arr = F.array(*[F.lit(x) for x in levels])
    return logs.where(F.array_position(arr, F.col("level")) >= levels.index(min_level) + 1)


def unknown_levels(logs: DataFrame, levels: list[str] = LOG_LEVELS) -> DataFrame:
    """The reject side, records whose level is unknown or missing."""
    return logs.where(~F.coalesce(F.col("level").isin(levels), F.lit(False)))


LOG_PARSE = r"(?s)^\[([^\]]*)\] - (.*?) - \[([A-Z]+)\] (.*)$"


def render_log(ts="ts", caller="caller", level="level", message="message") -> Column:
    """F16: ``[ts] - caller - [LEVEL] message`` with microseconds after a colon."""
    return T.fill(LOG_LINE, ts=F.date_format(T.col(ts), LOG_TS_FORMAT), caller=T.col(caller),
                  level=F.upper(T.col(level)), message=T.col(message))


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """F16 reversed: split rendered log lines back into columns; ``status`` is ``ok`` or, for a
    line of another form or with an impossible time, ``malformed`` (all
    other columns NULL).  The pattern is matched once for each line."""
    c = F.col(line)
    parts = F.split(F.regexp_replace(c, LOG_PARSE, "$1\u0000$2\u0000$3\u0000$4"), "\u0000", 4)
    d = lines.select(F.when(~F.contains(c, F.lit("\u0000")) | c.rlike(LOG_PARSE), parts).alias("_p"))
    stamp = F.get("_p", F.lit(0))
    n = lambda start, size: F.expr("try_cast(substr(_p[0], %d, %d) AS INT)" % (start, size))
    second = (n(18, 2) + F.expr("try_cast(substr(_p[0], 21, 6) AS INT)") / 1000000).cast("decimal(8,6)")
    ts = F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d:\d{6}$"),
                F.try_make_timestamp_ntz(n(1, 4), n(6, 2), n(9, 2), n(12, 2), n(15, 2), second))
    d = d.withColumn("_ts", F.when(F.size("_p") == 4, ts))
    ok = F.col("_ts").isNotNull()
    part = lambda k: F.when(ok, F.get("_p", F.lit(k)))
    return d.select(F.col("_ts").alias("ts"), part(1).alias("caller"), F.lower(part(2)).alias("level"), part(3).alias("message"),
                    F.when(ok, "ok").otherwise("malformed").alias("status"))


def timing(sent_ms, received, processed) -> tuple[Column, Column]:
    """(latency, processing) in seconds: received − sent, processed −
    received."""
    rec = F.unix_micros(T.col(received).cast("timestamp"))
    pro = F.unix_micros(T.col(processed).cast("timestamp"))
    latency = (rec - T.col(sent_ms) * 1000) / F.lit(1e6)
    processing = (pro - rec) / F.lit(1e6)
    return latency, processing


def format_ts(ts) -> Column:
    """``%Y-%m-%d %H:%M:%S``."""
    return F.date_format(T.col(ts), "yyyy-MM-dd HH:mm:ss")
