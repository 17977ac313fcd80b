"""Registered queries: dispatch, routing, command parsing, flags, trigger
dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COMMANDS, DEFAULT_CONFIG, SPACE_SUBCOMMANDS
from ..operators import context as C
from ..operators import routing as R
from ..sources import views as V
from .oracle_views import with_ctes
from .q_context import _w1_sql

CFG = DEFAULT_CONFIG


def q_message_route(spark, sf):
    m = R.dispatch(V.messages(spark, sf))
    return m.select("room_id", "event_id", "handler",
                    F.when(F.col("handler") == "message", R.route(cfg=CFG)).alias("route"))


def commands(spark, sf):
    """Text messages from others that route to this bot's commands."""
    m = R.drop_own(V.messages(spark, sf), CFG).where(F.col("kind") == "m.text")
    return R.parse_command(m.where(R.route(cfg=CFG) == "command"))


def q_command_parse(spark, sf):
    c = R.lookup_command(commands(spark, sf))
    return c.select("room_id", "event_id", "command", "args", "handler",
                    F.when(F.col("command") == "space", R.space_request("tokens")).alias("space_request"))


def q_command_flags(spark, sf):
    c = commands(spark, sf).where(F.col("command").isin("calculate", "imagine"))
    calc = R.calculate_flags(c.withColumn("_b", R.strip_edit_marker("body")), body="_b")
    img = R.image_flags(calc.withColumn("_args", F.coalesce(F.col("args"), F.lit(""))), prompt="_args", cfg=CFG)
    is_calc = F.col("command") == "calculate"
    return img.select(
        "room_id", "event_id", "command",
        F.when(is_calc, F.col("prompt")).otherwise(F.col("image_prompt")).alias("prompt"),
        F.when(is_calc, F.col("text")).alias("text"),
        F.when(is_calc, F.col("results_only")).alias("results_only"),
        F.when(~is_calc, F.col("size")).alias("size"),
        F.when(~is_calc, F.col("quality")).alias("quality"),
        F.when(is_calc, F.col("status")).otherwise(
            F.when(F.col("image_prompt") == "", F.lit("need_prompt")).otherwise(F.lit("ok"))).alias("status"))


def q_trigger_dedup(spark, sf):
    out = C.context_with_trigger(V.messages(spark, sf), CFG)
    return out.select("room_id", "event_id", "seq", "is_trigger", "pos")


_TOKS = "list_filter(string_split_regex(CASE WHEN starts_with(body, '* ') THEN substr(body, 3) ELSE body END, '\\s+'), lambda t: t <> '')"
_CMDS = ", ".join(f"'{c}'" for c in COMMANDS)
_SUBS = ", ".join(f"'{c}'" for c in SPACE_SUBCOMMANDS)
_CMD_CTE = ("cmd", f"""
SELECT *, toks[2] AS command, CASE WHEN len(toks) > 2 THEN array_to_string(toks[3:], ' ') END AS args
FROM (SELECT *, {_TOKS} AS toks FROM messages
      WHERE sender <> '{CFG.bot_id}' AND kind = 'm.text'
        AND (starts_with(body, '!bot') OR starts_with(body, '* !bot'))) m""")

ORACLE = {
    "message_route": with_ctes(["messages"], [], f"""
SELECT room_id, event_id, handler,
       CASE WHEN handler = 'message' THEN
         CASE WHEN sender = '{CFG.bot_id}' THEN 'ignore'
              WHEN starts_with(body, '!bot') OR starts_with(body, '* !bot') THEN 'command'
              WHEN starts_with(body, '!') THEN 'foreign' ELSE 'query' END END AS route
FROM (SELECT *, CASE kind WHEN 'm.text' THEN 'message' WHEN 'm.member' THEN 'membership'
                          WHEN 'm.invite' THEN 'invite' END AS handler FROM messages) x
WHERE handler IS NOT NULL"""),
    "command_parse": with_ctes(["messages"], [_CMD_CTE], f"""
SELECT room_id, event_id, command, args,
       CASE WHEN command IN ({_CMDS}) THEN command ELSE 'unknown' END AS handler,
       CASE WHEN command = 'space' AND len(toks) = 3 AND lower(toks[3]) IN ({_SUBS}) THEN lower(toks[3]) END AS space_request
FROM cmd"""),
    "command_flags": with_ctes(["messages"], [_CMD_CTE, ("f", """
SELECT *, toks[3:] AS p0 FROM cmd WHERE command IN ('calculate', 'imagine')"""), ("g", """
SELECT *, list_contains(p0, '--text') AS has_text,
       CASE WHEN list_contains(p0, '--text')
            THEN list_filter(p0, lambda x, i: i <> list_position(p0, '--text')) ELSE p0 END AS p1
FROM f"""), ("h", """
SELECT *, list_contains(p1, '--details') AS has_details,
       CASE WHEN list_contains(p1, '--details')
            THEN list_filter(p1, lambda x, i: i <> list_position(p1, '--details')) ELSE p1 END AS p2,
       coalesce(args, '') AS a,
       list_filter(string_split_regex(coalesce(args, ''), '\\s+'), lambda t: t <> '') AS atoks
FROM g"""), ("i", """
SELECT *, atoks[1] = '--portrait' AS pf, atoks[1] = '--landscape' AS lf FROM h""")], """
SELECT room_id, event_id, command,
       CASE WHEN command = 'calculate' THEN array_to_string(p2, ' ')
            WHEN coalesce(pf, false) OR coalesce(lf, false) THEN array_to_string(atoks[2:], ' ') ELSE a END AS prompt,
       CASE WHEN command = 'calculate' THEN has_text END AS text,
       CASE WHEN command = 'calculate' THEN NOT has_details END AS results_only,
       CASE WHEN command <> 'calculate' THEN
            CASE WHEN coalesce(pf, false) THEN '1024x1792' WHEN coalesce(lf, false) THEN '1792x1024' ELSE '1024x1024' END END AS size,
       CASE WHEN command <> 'calculate' THEN 'hd' END AS quality,
       CASE WHEN command = 'calculate' THEN CASE WHEN array_to_string(p2, ' ') = '' THEN 'need_prompt' ELSE 'ok' END
            ELSE CASE WHEN (CASE WHEN coalesce(pf, false) OR coalesce(lf, false) THEN array_to_string(atoks[2:], ' ') ELSE a END) = ''
                      THEN 'need_prompt' ELSE 'ok' END END AS status
FROM i"""),
    "trigger_dedup": with_ctes(["messages"], [
        ("ctx", _w1_sql(CFG.max_messages)),
        ("trig", "SELECT room_id, event_id, seq FROM messages QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY seq DESC) = 1"),
        ("u", """
SELECT c.room_id, c.event_id, c.seq, false AS is_trigger FROM ctx c JOIN trig t ON c.room_id = t.room_id
WHERE c.event_id <> t.event_id
UNION ALL SELECT room_id, event_id, seq, true AS is_trigger FROM trig""")], """
SELECT room_id, event_id, seq, is_trigger,
       CAST(row_number() OVER (PARTITION BY room_id ORDER BY is_trigger, seq) AS INT) AS pos FROM u"""),
}

QUERIES = {
    "message_route": q_message_route,
    "command_parse": q_command_parse,
    "command_flags": q_command_flags,
    "trigger_dedup": q_trigger_dedup,
}
