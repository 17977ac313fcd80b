"""Schema evolution of the stored tables.

Versions are ordered ``DataFrame → DataFrame`` transforms; applying
versions ``from+1 .. to`` is a fold (S13).  Each step is a projection, so a
whole chain stays one narrow stage; ``unionByName(allowMissingColumns)``
merges stores written at different versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE_V1 = ["message_id", "room_id", "tokens", "timestamp"]
USAGE_V6 = ["message_id", "room_id", "api", "tokens", "timestamp"]
DEFAULT_API = "openai"


def usage_v4(df: DataFrame) -> DataFrame:
    """Add ``api`` with default ``openai``."""
    if "api" in df.columns:
        return df.withColumn("api", F.coalesce(F.col("api"), F.lit(DEFAULT_API)))
    return df.withColumn("api", F.lit(DEFAULT_API))


def usage_v6(df: DataFrame) -> DataFrame:
    """Rebuild with the final column order (no key)."""
    return df.select(*USAGE_V6)


USAGE_MIGRATIONS: dict[int, Callable[[DataFrame], DataFrame]] = {
    1: lambda df: df.select(*[c for c in USAGE_V1 + ["api"] if c in df.columns]),
    2: lambda df: df,          # no-op version, records no ledger row
    3: lambda df: df,
    4: usage_v4,
    5: lambda df: df,
    6: usage_v6,
    7: lambda df: df,
    8: lambda df: df,
}
LEDGER_SKIPS = {2}


def migrate(df: DataFrame, from_version: int, to_version: int,
            steps: dict[int, Callable[[DataFrame], DataFrame]] = USAGE_MIGRATIONS) -> DataFrame:
    """Apply versions ``from+1 .. to``; ``from > to`` is an error."""
    if from_version > to_version:
        raise ValueError(f"cannot migrate down from {from_version} to {to_version}")
    for v in range(from_version + 1, to_version + 1):
        df = steps[v](df)
    return df


def ledger_rows(from_version: int, to_version: int) -> list[int]:
    """Versions recorded in the ledger for a migration run."""
    return [v for v in range(from_version + 1, to_version + 1) if v not in LEDGER_SKIPS]


# A catalogue: all tables of a store by name, the ledger (``migrations``) among them.
Catalogue = dict[str, DataFrame]
TABLES = {
    "token_usage": "message_id string, room_id string, tokens bigint, timestamp timestamp_ntz",
    "migrations": "id bigint, timestamp timestamp_ntz",
    "system_messages": "room_id string, message_id string, user_id string, body string, timestamp bigint",
    "room_settings": "room_id string, setting string, value string",
    "user_spaces": "space_id string, user_id string, active boolean",
    "settings": "setting string, value string",
}


def _empty(spark, name: str) -> DataFrame:
    fields = T.StructType.fromDDL(TABLES[name]).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def _with(spark, tables: Catalogue, *names: str) -> Catalogue:
    """Tables that are missing are created empty."""
    return tables | {n: _empty(spark, n) for n in names if n not in tables}


def _settings_from_messages(spark, tables: Catalogue) -> Catalogue:
    """Version 5: each room's latest system message becomes its setting, unless it has one, and the
    table of system messages goes.  ``(room_id, setting)`` is a key, so of messages with the latest time the one with the
    greatest id counts."""
    tables = _with(spark, tables, "system_messages", "room_settings")
    latest = tables["system_messages"].groupBy("room_id").agg(F.max_by("body", F.struct("timestamp", "message_id")).alias("value"))
    new = latest.select("room_id", F.lit("system_message").alias("setting"), "value")
    new = new.join(tables["room_settings"].select("room_id", "setting"), ["room_id", "setting"], "left_anti")
    rest = {k: v for k, v in tables.items() if k != "system_messages"}
    return rest | {"room_settings": tables["room_settings"].select("room_id", "setting", "value").unionByName(new)}


CATALOGUE_STEPS: dict[int, Callable[..., Catalogue]] = {
    1: lambda spark, t: _with(spark, t, "token_usage", "migrations"),
    2: lambda spark, t: t,
    3: lambda spark, t: _with(spark, t, "system_messages"),
    4: lambda spark, t: t | {"token_usage": usage_v4(t["token_usage"])},
    5: _settings_from_messages,
    6: lambda spark, t: t | {"token_usage": usage_v6(t["token_usage"])},
    7: lambda spark, t: _with(spark, t, "user_spaces"),
    8: lambda spark, t: _with(spark, t, "settings"),
}


def migrate_catalogue(spark, tables: Catalogue, to_version: int = 8, now=None) -> Catalogue:
    """S12 + S13: fold the versions after the ledger's maximum (0 without a ledger) over the whole
    catalogue, and add a ledger row for each but those that record none.  Steps are projections, one
    aggregation for version 5, and nothing is written: the caller writes the tables that come back."""
    found = schema_version(tables["migrations"]).first()["version"] if "migrations" in tables else 0
    if found > to_version:
        raise ValueError(f"cannot migrate down from {found} to {to_version}")
    for v in range(found + 1, to_version + 1):
        tables = CATALOGUE_STEPS[v](spark, tables)
    if done := ledger_rows(found, to_version):
        stamp = F.current_timestamp() if now is None else F.lit(now)
        rows = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("bigint") for v in done])).alias("id"), stamp.cast("timestamp_ntz").alias("timestamp"))
        tables = tables | {"migrations": tables["migrations"].select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")).unionByName(rows)}
    return tables


def merge_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union stores written at different versions; missing ``api`` gets
    the default."""
    return usage_v6(usage_v4(old.unionByName(new, allowMissingColumns=True)))


def schema_version(ledger: DataFrame) -> DataFrame:
    """A3: ``MAX(id)``, empty → 0."""
    return ledger.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("version"))


def max_ts_per_room(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """A2: ``MAX(timestamp) GROUP BY room_id``."""
    return df.groupBy("room_id").agg(F.max(ts).alias("max_ts"))


def latest_by_join(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """J1 (faithful): self join to ``(room_id, MAX(timestamp))``; every tied
    row is returned.  The engine path is ``settings.latest_per_key`` (one
    aggregate, no self join)."""
    m = max_ts_per_room(df, ts)
    return df.join(m, (df.room_id == m.room_id) & (df[ts] == m.max_ts), "inner").drop(m.room_id).drop("max_ts")


def system_messages_to_settings(sysmsgs: DataFrame) -> DataFrame:
    """Migration of the dropped ``system_messages`` table into settings: the
    latest message body per room (all ties) as ``system_message``."""
    latest = latest_by_join(sysmsgs)
    return latest.select("room_id", F.lit("system_message").alias("setting"), F.col("body").alias("value"),
                         "message_id", "timestamp")
