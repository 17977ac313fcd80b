"""Registered queries: allow lists, deny notices, settings, reply gate,
system message, state lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BOOLEAN_SETTINGS, DEFAULT_CONFIG, DENY_NOTICE
from ..operators import access as A
from ..operators import routing as R
from ..operators import settings as S
from ..sources import views as V
from ..sources.tables import table
from .oracle_views import with_ctes

CFG = DEFAULT_CONFIG
# Allow list of the access queries: one exact user, one server wildcard,
# one room.
ALLOW = ["@u1:beta.example", "*:gamma.example", "!r4:beta.example"]


def q_allowed_messages(spark, sf):
    ok, _ = A.split_allowed(V.messages(spark, sf), ALLOW, CFG)
    return ok.select("room_id", "event_id", "sender")


def q_allowed_by_table(spark, sf):
    """J8 with the allow list in a table that grows with the data: users
    who have an active space."""
    allow = V.user_spaces(spark, sf).where(F.col("active")).select("user_id")
    ok, _ = A.split_allowed(V.messages(spark, sf), allow, CFG)
    return ok.select("room_id", "event_id", "sender")


def room_senders(msgs):
    """Member count per room from the distinct senders seen in it."""
    return msgs.groupBy("room_id").agg(F.count_distinct("sender").alias("members"))


def q_denied_notices(spark, sf):
    msgs = V.messages(spark, sf)
    _, denied = A.split_allowed(msgs, ALLOW, CFG)
    out = A.deny_notices(denied, room_senders(msgs), CFG)
    return out.select("room_id", "event_id", "members", "notice", "notice_body")


def q_settings_latest(spark, sf):
    return S.latest_per_key(V.settings_log(spark, sf), ["room_id", "setting"], ["value"]) \
        .select("room_id", "setting", "value", "ts")


FLAGS = list(BOOLEAN_SETTINGS)


def q_settings_checked(spark, sf):
    """flags of rooms whose log holds values that are no integers, and what was rejected."""
    c = S.checked_flags(V.broken_settings_log(spark, sf))
    shown = F.array_join(F.array_sort(F.transform("rejects", lambda r: F.concat(r["field"], F.lit("="), r["raw"]))), ";")
    return c.select("room_id", *FLAGS, shown.alias("rejected"))


def q_allow_list_parse(spark, sf):
    """P5: the texts of conversations as allow lists: JSON arrays of strings, other JSON and no JSON at all."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    k = (F.col("conv_id") + F.col("turn")) % 6
    listed = F.to_json(F.array("role", "text"))
    raw = F.when(k == 0, listed).when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("["), F.to_json(F.struct("text")), F.lit("]"))) \
        .when(k == 3, F.lit("[]")).when(k == 4, F.concat(listed, F.lit(" ]"))).otherwise(F.lit(None))
    return c.select("conv_id", "turn", F.array_join(A.parse_allow_list(raw), "|").alias("open_list"), F.array_join(A.parse_allow_list(raw, fail_open=False), "|").alias("closed_list"))


def _profile(spark, sf):
    rooms = V.messages(spark, sf).select("room_id").distinct()
    return S.room_profile(rooms, V.settings_log(spark, sf), CFG)


def q_settings_profile(spark, sf):
    return _profile(spark, sf)


def q_room_info(spark, sf):
    return S.room_info(_profile(spark, sf), CFG)


def q_system_message_resolve(spark, sf):
    return _profile(spark, sf).select("room_id", "system_message")


def q_settings_validate(spark, sf):
    v = S.validate_commands(V.settings_commands(spark, sf), cfg=CFG)
    return v.select("room_id", "event_id", "setting", "value", "status")


def q_reply_gate(spark, sf):
    msgs = R.drop_own(V.messages(spark, sf), CFG).where(F.col("kind") == "m.text")
    q = msgs.where(R.route(cfg=CFG) == "query")
    prof = _profile(spark, sf).select("room_id", "always_reply")
    j = q.join(prof, "room_id", "left")
    return j.select("room_id", "event_id", "always_reply", R.reply_gate(j, cfg=CFG).alias("reply"))


def q_state_lookup(spark, sf):
    s = S.state_lookup(V.room_state(spark, sf), "m.room.avatar", "")
    return s.select("room_id", "content", "ts")


_LATEST = ("latest", """
SELECT room_id, setting, value, ts FROM settings_log
QUALIFY row_number() OVER (PARTITION BY room_id, setting ORDER BY ts DESC, event_id DESC) = 1""")
_SETTINGS = list(BOOLEAN_SETTINGS) + ["model", "system_message"]
_WIDE = ("wide", "SELECT room_id, " + ", ".join(
    f"max(CASE WHEN setting = '{s}' THEN value END) AS raw_{s}" for s in _SETTINGS) + " FROM latest GROUP BY room_id")
_PROFILE = ("profile", "SELECT r.room_id, " + ", ".join(
    f"coalesce(TRY_CAST(raw_{s} AS INT) <> 0, {str(d).lower()}) AS {s}" for s, d in BOOLEAN_SETTINGS.items()) + f""",
       coalesce(raw_model, '{CFG.chat_model}') AS model,
       regexp_replace(concat(CASE WHEN raw_system_message IS NULL THEN '{CFG.default_system_message}' ELSE '' END,
                             CASE WHEN raw_system_message IS NOT NULL THEN concat(chr(10), chr(10), raw_system_message) ELSE '' END),
                      '^\\s+|\\s+$', '', 'g') AS system_message,
       {CFG.max_tokens} AS max_tokens, {CFG.max_messages} AS max_messages
FROM (SELECT DISTINCT room_id FROM messages) r LEFT JOIN wide w ON r.room_id = w.room_id""")

_ALLOW_SQL = ", ".join(f"'{a}'" for a in ALLOW)


def _id_ok(c: str) -> str:
    srv = f"CASE WHEN contains({c}, ':') THEN split_part({c}, ':', 2) END"
    return (f"({c} IN ({_ALLOW_SQL}) OR (NOT starts_with({c}, '!') AND {srv} IS NOT NULL AND "
            f"(concat('*:', {srv}) IN ({_ALLOW_SQL}) OR concat('@*:', {srv}) IN ({_ALLOW_SQL}))))")


_ACCESS = ("acc", f"""
SELECT *, coalesce({_id_ok('sender')} OR {_id_ok('room_id')}, false) AS ok
FROM messages WHERE sender <> '{CFG.bot_id}'""")
_NOTICE = DENY_NOTICE.format(operator=CFG.operator)

def _id_ok_table(c: str) -> str:
    srv = f"CASE WHEN contains({c}, ':') THEN split_part({c}, ':', 2) END"
    return (f"({c} IN (SELECT user_id FROM al) OR (NOT starts_with({c}, '!') AND {srv} IS NOT NULL AND "
            f"(concat('*:', {srv}) IN (SELECT user_id FROM al) OR concat('@*:', {srv}) IN (SELECT user_id FROM al))))")


_BOOLS = ", ".join(f"'{x}'" for x in BOOLEAN_SETTINGS)
# P24 from the command's words: an edit marker goes first; only two commands write settings
SETTINGS_STEPS = [("t", """
SELECT *, list_filter(string_split_regex(CASE WHEN starts_with(body, '* ') THEN substr(body, 3) ELSE body END, '\\s+'),
                      lambda x: x <> '') AS toks FROM settings_commands"""), ("u", """
SELECT *, starts_with(toks[1], '!bot') AND toks[2] IN ('roomsettings', 'systemmessage') AS ours, toks[2] = 'systemmessage' AS msg FROM t"""),
    ("w", """
SELECT *, CASE WHEN NOT ours THEN NULL WHEN msg THEN 'system_message'
               ELSE CASE toks[3] WHEN 'classification' THEN 'use_classification' WHEN 'timing' THEN 'use_timing'
                                 WHEN 'systemmessage' THEN 'system_message' ELSE toks[3] END END AS setting,
       coalesce(array_to_string(CASE WHEN msg THEN toks[3:] ELSE toks[4:] END, ' '), '') AS v FROM u"""), ("st", f"""
SELECT *, CASE WHEN NOT ours THEN 'other_command'
               WHEN setting IN ({_BOOLS}) THEN CASE WHEN v = '' THEN 'read' WHEN lower(v) IN ('true', 'false') THEN 'store' ELSE 'invalid_boolean' END
               WHEN setting = 'system_message' {"OR setting = 'model'" if CFG.allow_model_override else ""} THEN CASE WHEN v = '' THEN 'read' ELSE 'store' END
               ELSE 'unknown' END AS status,
       CASE WHEN setting IN ({_BOOLS}) THEN CASE lower(v) WHEN 'true' THEN '1' ELSE '0' END ELSE v END AS stored FROM w""")]

def _flag_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL OR NOT regexp_matches({name}, '^\\s*[+-]?[0-9]+(?:_[0-9]+)*\\s*$') THEN NULL ELSE regexp_matches({name}, '[1-9]') END"


_BROKEN = ("broken", """
SELECT concat(room_id, '/', event_id % 50) AS room_id, setting, ts, event_id,
  CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN concat(' ', value, ' ') WHEN 2 THEN concat(value, 'x') WHEN 3 THEN ''
       WHEN 4 THEN concat('0000000000000000000000000', value) ELSE value END AS value
FROM settings_log JOIN (SELECT event_id, props FROM events) USING (event_id)""")
_BROKEN_WIDE = ("wide", "SELECT room_id, " + ", ".join(
    f"arg_max(value, (ts, event_id)) FILTER (setting = '{s}') AS {s}" for s in FLAGS) + " FROM broken GROUP BY room_id")

ORACLE = {
    "settings_checked": with_ctes(["settings_log"], [_BROKEN, _BROKEN_WIDE], "SELECT room_id, " + ", ".join(f"{_flag_sql(s)} AS {s}" for s in FLAGS)
        + ", array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {s} IS NOT NULL AND {_flag_sql(s)} IS NULL THEN concat('{s}=', {s}) END" for s in FLAGS)
        + "], lambda x: x IS NOT NULL)), ';') AS rejected FROM wide"),
    "allow_list_parse": """
SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN concat(role, '|', text) ELSE '' END AS open_list,
  CASE (conv_id + turn) % 6 WHEN 0 THEN concat(role, '|', text) WHEN 3 THEN '' END AS closed_list
FROM conversations""",
    "allowed_messages": with_ctes(["messages"], [_ACCESS], "SELECT room_id, event_id, sender FROM acc WHERE ok"),
    "allowed_by_table": with_ctes(["messages", "user_spaces"], [("al", "SELECT user_id FROM user_spaces WHERE active")], f"""
SELECT room_id, event_id, sender FROM messages
WHERE sender <> '{CFG.bot_id}'
  AND ((SELECT count(*) FROM al) = 0 OR coalesce({_id_ok_table('sender')} OR {_id_ok_table('room_id')}, false))"""),
    "denied_notices": with_ctes(["messages"], [_ACCESS, ("mem", """
SELECT room_id, count(DISTINCT sender) AS members FROM messages GROUP BY room_id""")], f"""
SELECT a.room_id, a.event_id, coalesce(m.members, 0) AS members, coalesce(m.members, 0) = 2 AS notice,
       CASE WHEN coalesce(m.members, 0) = 2 THEN '{_NOTICE}' END AS notice_body
FROM acc a LEFT JOIN mem m ON a.room_id = m.room_id WHERE NOT a.ok"""),
    "settings_latest": with_ctes(["settings_log"], [_LATEST], "SELECT room_id, setting, value, ts FROM latest"),
    "settings_profile": with_ctes(["messages", "settings_log"], [_LATEST, _WIDE, _PROFILE], "SELECT * FROM profile"),
    "system_message_resolve": with_ctes(["messages", "settings_log"], [_LATEST, _WIDE, _PROFILE],
                                        "SELECT room_id, system_message FROM profile"),
    "room_info": with_ctes(["messages", "settings_log"], [_LATEST, _WIDE, _PROFILE], f"""
SELECT room_id, concat('GPT Room info:', chr(10), chr(10), 'Model: ', model, chr(10), chr(10),
                       'Maximum context tokens: ', max_tokens, chr(10), chr(10),
                       'Maximum context messages: ', max_messages, chr(10), chr(10),
                       'Bot user ID: {CFG.bot_id}', chr(10), chr(10), 'Current room ID: ', room_id, chr(10), chr(10),
                       'System message: ', system_message, chr(10)) AS info
FROM profile"""),
    "settings_validate": with_ctes(["settings_commands"], SETTINGS_STEPS, """
SELECT room_id, event_id, setting, CASE WHEN status = 'store' THEN stored END AS value, status FROM st"""),
    "reply_gate": with_ctes(["messages", "settings_log"], [_LATEST, _WIDE, _PROFILE], f"""
SELECT m.room_id, m.event_id, p.always_reply, p.always_reply OR coalesce(contains(m.body, '{CFG.bot_id}'), false) AS reply
FROM messages m LEFT JOIN profile p ON m.room_id = p.room_id
WHERE m.sender <> '{CFG.bot_id}' AND m.kind = 'm.text' AND NOT starts_with(m.body, '!bot')
  AND NOT starts_with(m.body, '* !bot') AND NOT starts_with(m.body, '!')"""),
    "state_lookup": with_ctes(["room_state"], [], """
SELECT room_id, content, ts FROM room_state WHERE type = 'm.room.avatar' AND state_key = ''
QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, event_id DESC) = 1"""),
}

QUERIES = {
    "settings_checked": q_settings_checked,
    "allow_list_parse": q_allow_list_parse,
    "allowed_messages": q_allowed_messages,
    "allowed_by_table": q_allowed_by_table,
    "denied_notices": q_denied_notices,
    "settings_latest": q_settings_latest,
    "settings_profile": q_settings_profile,
    "system_message_resolve": q_system_message_resolve,
    "room_info": q_room_info,
    "settings_validate": q_settings_validate,
    "reply_gate": q_reply_gate,
    "state_lookup": q_state_lookup,
}
