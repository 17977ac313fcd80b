"""Room settings: change log, latest value per key, typed per-room view,
validation of settings commands, system message resolution, state lookup
(S5, W4, J2, F12, F13, F18, P20, P24, L3).

Settings are an append-only change log ``(room_id, setting, value, ts,
event_id)``.  "Last write wins" is a ``max_by`` aggregation keyed by
``(room_id, setting)`` ordered by ``(ts, event_id)``, with partial
aggregation on the map side, so a room that writes a third of all changes
is pre-reduced to one row per map task before the shuffle.  (String values
make it a sort-based aggregate; see ``windows.ordering`` for the hash path
when the value is fixed-width.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOOLEAN_SETTINGS, DEFAULT_CONFIG, ROOM_INFO, SETTING_ALIASES, BotConfig
from ..functions import decode as D
from ..functions import text as T
from .routing import parse_command

SETTING_COLUMNS = list(BOOLEAN_SETTINGS) + ["model", "system_message"]


def latest_per_key(log: DataFrame, keys: list[str], value_cols: list[str],
                   order: list[str] = ("ts", "event_id")) -> DataFrame:
    """The value columns of the newest row per key (ties broken by the
    later ``event_id``; deterministic, L3)."""
    ordering = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in list(value_cols) + list(order)])
    agg = log.groupBy(*keys).agg(F.max_by(payload, ordering).alias("_v"))
    return agg.select(*keys, *[F.col("_v")[c].alias(c) for c in list(value_cols) + list(order)])


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply an upsert batch to a settings snapshot; last write wins on
    ``(room_id, setting)``.  Both sides are change logs of the same schema,
    so the merge is a union followed by W4."""
    cols = ["room_id", "setting", "value", "ts", "event_id"]
    return latest_per_key(current.select(*cols).unionByName(changes.select(*cols)),
                          ["room_id", "setting"], ["value"])


def text_bool(value) -> Column:
    """text-encoded boolean ``bool(int(v))``; NULL when not an integer (``decode.flag`` names the reject)."""
    return D.flag(value)["value"]


def settings_wide(log: DataFrame) -> DataFrame:
    """W4 + F13 pivot in one aggregation keyed by room: for each known
    setting, the value of its newest write (``max_by`` skips rows whose
    ordering is NULL, i.e. other settings).  Works on the raw change log or
    on its W4 result alike; partial aggregation runs before the shuffle."""
    order = F.struct(F.col("ts"), F.col("event_id"))
    return log.groupBy("room_id").agg(*[
        F.max_by(F.col("value"), F.when(F.col("setting") == s, order)).alias(f"raw_{s}") for s in SETTING_COLUMNS])


def resolve_system_message(raw, cfg: BotConfig = DEFAULT_CONFIG) -> Column:
    """default when the room has none (or the default is forced),
    followed by the room's own message after a blank line, stripped."""
    r = T.col(raw)
    default = F.when(r.isNull() | F.lit(cfg.force_system_message), F.lit(cfg.default_system_message)).otherwise(F.lit(""))
    own = F.when(r.isNotNull(), F.concat(F.lit("\n\n"), r)).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(default, own), r"^\s+|\s+$", "")


def room_profile(rooms: DataFrame, log: DataFrame, cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """J2 + F13 + F18 + F12: every room with typed settings and defaults.

    ``log`` is the settings change log (or its latest-per-key view).  The
    wide settings table has one row per room; it is joined on ``room_id``
    and left for AQE to broadcast when its measured size is under the
    threshold (it grows with the number of rooms, so no unconditional
    broadcast hint).

    A flag that is no integer is neither its default nor true: it is NULL (see ``settings_rejects``)."""
    wide = settings_wide(log)
    j = rooms.join(wide, "room_id", "left")
    cols = [F.col("room_id")]
    for s, default in BOOLEAN_SETTINGS.items():
        cols.append(F.when(F.col(f"raw_{s}").isNull(), F.lit(default)).otherwise(text_bool(f"raw_{s}")).alias(s))
    cols.append(F.coalesce(F.col("raw_model"), F.lit(cfg.chat_model)).alias("model"))
    cols.append(resolve_system_message("raw_system_message", cfg).alias("system_message"))
    cols.append(F.lit(cfg.max_tokens).alias("max_tokens"))
    cols.append(F.lit(cfg.max_messages).alias("max_messages"))
    return j.select(*cols)


def checked_flags(log: DataFrame) -> DataFrame:
    """for each room its flags (NULL: not set, or no integer) and ``rejects``, from one aggregation."""
    wide = settings_wide(log).select("room_id", *[F.col(f"raw_{s}").alias(s) for s in BOOLEAN_SETTINGS])
    return D.decoded(wide, {s: D.flag for s in BOOLEAN_SETTINGS})


def settings_rejects(log: DataFrame) -> DataFrame:
    """the flags in force that are no integers: ``room_id``, ``setting``, ``value``, ``reason``."""
    return checked_flags(log).select("room_id", F.explode("rejects").alias("r")).select(
        "room_id", F.col("r.field").alias("setting"), F.col("r.raw").alias("value"), F.col("r.reason").alias("reason"))


def room_info(profile: DataFrame, cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """the room info report of each room (model, limits, ids, system
    message), one blank line between fields."""
    text = T.fill(ROOM_INFO, model=F.col("model"), max_tokens=F.col("max_tokens"),
                  max_messages=F.col("max_messages"), bot_id=cfg.bot_id, room_id=F.col("room_id"),
                  system_message=F.col("system_message"))
    return profile.select("room_id", text.alias("info"))


def validate_commands(cmds: DataFrame, body: str = "body", cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """Settings command → ``(setting, value, status)``.

    Reads ``roomsettings <name> <value…>`` and ``systemmessage <text…>``, plain or
    edited (``"* "`` in front).  ``status``: ``store`` (``value`` normalised: booleans
    become ``1``/``0``), ``read`` (no value given), ``invalid_boolean``, ``unknown`` (no such
    setting) or ``other_command`` (not a settings command; setting and value NULL)."""
    d = parse_command(cmds, body)
    d = d.withColumns({"_tokens": F.col("tokens"), "_command": F.col("command")})
    d = d.select(*cmds.columns, "_tokens", "_command")
    message = F.col("_command") == "systemmessage"
    ours = F.coalesce(F.startswith(F.get("_tokens", F.lit(0)), F.lit(cfg.prefix)) & F.col("_command").isin("roomsettings", "systemmessage"), F.lit(False))
    raw_setting = F.when(message, F.lit("system_message")).otherwise(F.try_element_at(F.col("_tokens"), F.lit(3)))
    alias = F.create_map(*[F.lit(x) for kv in SETTING_ALIASES.items() for x in kv])
    d = d.withColumn("_setting", F.when(ours, F.coalesce(F.try_element_at(alias, raw_setting), raw_setting)))
    setting = F.col("_setting")
    d = d.withColumn("_value", F.array_join(F.when(message, T.tail("_tokens", 3)).otherwise(T.tail("_tokens", 4)), " "))
    value = F.col("_value")
    has_value = value.isNotNull() & (value != "")
    is_bool = setting.isin(list(BOOLEAN_SETTINGS))
    lv = F.lower(value)
    status = (F.when(~ours, "other_command")
              .when(setting == "system_message", F.when(has_value, "store").otherwise("read"))
              .when(is_bool, F.when(~has_value, "read")
                    .when(lv.isin("true", "false"), "store").otherwise("invalid_boolean"))
              .when(F.lit(cfg.allow_model_override) & (setting == "model"),
                    F.when(has_value, "store").otherwise("read"))
              .otherwise("unknown"))
    norm = (F.when(F.col("status") != "store", F.lit(None).cast("string"))
            .when(is_bool, F.when(lv == "true", "1").otherwise("0"))
            .otherwise(value))
    return (d.withColumns({"setting": setting, "status": status}).withColumn("value", norm)
            .drop("_tokens", "_command", "_setting", "_value"))


def state_lookup(state: DataFrame, event_type: str, state_key: str | None = None) -> DataFrame:
    """P20: per room, the newest state event of a type (and state key)."""
    s = state.where(F.col("type") == event_type)
    if state_key is not None:
        s = s.where(F.col("state_key") == state_key)
    return latest_per_key(s, ["room_id"], ["type", "state_key", "content"])
