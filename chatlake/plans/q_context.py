"""Registered queries: context window, token budget, media merge, prompt
assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..functions import text as T
from ..operators import context as C
from ..operators import prompt as P
from ..sources import views as V
from .oracle_views import with_ctes

CFG = DEFAULT_CONFIG
BUDGET = 1000
SMALL_N = 8


def q_kind_resolution(spark, sf):
    return C.resolve_kind(V.raw_events(spark, sf)).select("event_id", "kind", F.col("kind_status").alias("status"))


def q_context_last_n(spark, sf, n=None):
    ctx = C.last_n_messages(V.messages(spark, sf), CFG, n=n)
    return ctx.select("room_id", "event_id", "seq", "kind", "sender", "ctx_rank")


def q_context_last_small(spark, sf):
    return q_context_last_n(spark, sf, n=SMALL_N)


def q_context_token_budget(spark, sf, budget=BUDGET):
    ctx = C.last_n_messages(V.messages(spark, sf), CFG)
    out = C.truncate_to_budget(ctx.withColumn("cost", T.message_cost("body")), budget,
                               system_cost=T.system_cost(F.lit(CFG.default_system_message)))
    return out.select("room_id", "seq", C.role_of("sender", CFG).alias("role"), "cost", "cum", "pinned")


def q_context_default_budget(spark, sf):
    """W2 at the default limit."""
    return q_context_token_budget(spark, sf, CFG.max_tokens - 1)


#: The default limit, and some that the system message or the pinned message may not fit.
LIMITS = [CFG.max_tokens - 1, 60, 20, 3]


def _full(spark, sf):
    files = V.attachments(spark, sf)
    return P.budgeted_messages(V.room_events(spark, sf), files, V.settings_log(spark, sf), CFG), files


def q_prompt_full(spark, sf):
    """The main path with attachments, trigger, the rooms' own system messages and the default limit."""
    msgs, files = _full(spark, sf)
    return P.prompt_parts(msgs, files, CFG.max_tokens - 1)


def q_prompt_status(spark, sf):
    return P.prompt_status(_full(spark, sf)[0], LIMITS)


def _w1_sql(n: int) -> str:
    return f"""
SELECT * FROM (
  SELECT *, sum(marker) OVER w AS markers_seen, CAST(sum(keep) OVER w AS BIGINT) AS ctx_rank
  FROM (
    SELECT *,
      CASE WHEN kind = 'm.text' AND regexp_matches(body, '^\\s*!bot\\s+ignoreolder\\s*$') THEN 1 ELSE 0 END AS marker,
      CASE WHEN starts_with(kind, 'bot') THEN 1
           WHEN kind = 'm.text' THEN CASE WHEN NOT starts_with(body, '!')
                OR coalesce(list_filter(string_split_regex(body, '\\s+'), lambda t: t <> '')[2] = 'custom', false) THEN 1 ELSE 0 END
           WHEN kind = 'm.notice' THEN 0
           WHEN kind IN ('m.image', 'm.audio', 'm.file', 'm.video') THEN 1 ELSE 0 END AS keep
    FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY seq DESC) AS raw_rank
          FROM messages) r
    WHERE raw_rank <= {2 * n}) f
  WINDOW w AS (PARTITION BY room_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x
WHERE markers_seen = 0 AND keep = 1 AND ctx_rank <= {n}"""


def _ctx_sql(n: int) -> str:
    return with_ctes(["messages"], [("ctx", _w1_sql(n))],
                     "SELECT room_id, event_id, seq, kind, sender, ctx_rank FROM ctx")


SYS_COST = -(-len(CFG.default_system_message) // 4) + 1

def _budget_sql(budget: int) -> str:
    return with_ctes(["messages"], [
        ("ctx", _w1_sql(CFG.max_messages)),
        ("c", """SELECT room_id, seq, sender, CAST(ceil(length(body) / 4) AS BIGINT) + 1 AS cost,
                        seq = min(seq) OVER (PARTITION BY room_id) AS pinned FROM ctx"""),
        ("r", f"""SELECT *, CAST({SYS_COST} + sum(cost) OVER (PARTITION BY room_id ORDER BY pinned DESC, seq DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum FROM c"""),
    ], f"""SELECT room_id, seq, CASE WHEN sender = '{CFG.bot_id}' THEN 'assistant' ELSE 'user' END AS role,
               cost, cum, pinned FROM r WHERE cum <= {budget}""")


_N = CFG.max_messages
_FULL = [
    ("ev", """
SELECT * REPLACE (CASE WHEN (seq // 8 * 3 + seq % 8) % 19 <> 0 THEN kind END AS kind), seq // 8 AS conv, seq % 8 AS turn FROM messages"""),
    ("raw", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY seq DESC) AS raw_rank FROM ev) WHERE raw_rank <= {2 * _N}"""),
    ("flags", """
SELECT *, coalesce(kind = 'm.text' AND regexp_matches(body, '^\\s*!bot\\s+ignoreolder\\s*$'), false)::INT AS marker,
  CASE WHEN starts_with(kind, 'bot') THEN 1
       WHEN kind = 'm.text' THEN (NOT starts_with(body, '!') OR coalesce(list_filter(string_split_regex(body, '\\s+'), lambda t: t <> '')[2] = 'custom', false))::INT
       WHEN kind IN ('m.image', 'm.audio', 'm.file', 'm.video') THEN 1 ELSE 0 END AS keep FROM raw"""),
    ("ranked", """
SELECT *, sum(marker) OVER w AS seen, sum(keep) OVER w AS ctx FROM flags
WINDOW w AS (PARTITION BY room_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("picked", f"""
SELECT room_id, event_id, sender, kind, body, conv, turn, row_number() OVER (PARTITION BY room_id ORDER BY raw_rank = 1, seq) AS pos
FROM ranked WHERE raw_rank = 1 OR seen = 0 AND keep = 1 AND ctx <= {_N}"""),
    ("att", """
SELECT concat('$', conv_id, '-', turn) AS event_id, text, k, CASE WHEN k = 8 AND conv_id % 5 IN (1, 2) THEN NULL ELSE text END AS decoded
FROM (SELECT *, (conv_id * 7 + turn * 3) % 16 AS k FROM conversations)
WHERE (k = 8 AND conv_id % 5 <> 3) OR (k = 6 AND conv_id % 4 <> 0)"""),
    ("br", """
SELECT p.*, a.event_id IS NOT NULL AS got, decoded, text AS raw_text,
  CASE WHEN kind IN ('m.text', 'm.notice', 'm.audio') THEN 'body' WHEN kind = 'm.file' THEN 'file' WHEN kind = 'm.image' THEN 'image' END AS branch
FROM picked p LEFT JOIN att a USING (event_id)"""),
    ("pt", f"""
SELECT room_id, pos, CASE WHEN branch IN ('file', 'image') AND NOT got THEN 'system' WHEN sender = '{CFG.bot_id}' THEN 'assistant' ELSE 'user' END AS role,
  branch = 'image' AND got AS media, branch = 'image' AND got AS is_url,
  CASE WHEN branch = 'body' OR NOT got THEN body WHEN branch = 'file' THEN decoded END AS text,
  CASE WHEN branch = 'image' AND got THEN concat('data:image/png;base64,', to_base64(encode(raw_text))) END AS url
FROM br WHERE branch IS NOT NULL AND NOT (branch = 'file' AND got AND decoded IS NULL)"""),
    ("isl", """
SELECT *, sum(st) OVER (PARTITION BY room_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
FROM (SELECT *, (NOT media OR lag(role) OVER (PARTITION BY room_id ORDER BY pos) IS DISTINCT FROM role)::INT AS st FROM pt)"""),
    ("msg", """
SELECT room_id, grp, arg_min(role, pos) AS role, CASE WHEN arg_min(is_url, pos) THEN 1 ELSE ceil(arg_min(length(text), pos) / 4) + 1 END::BIGINT AS cost
FROM isl GROUP BY ALL"""),
    ("sysm", f"""
SELECT room_id, coalesce(trim(concat(chr(10), chr(10), v), chr(10) || ' '), '{CFG.default_system_message}') AS sys
FROM (SELECT DISTINCT room_id FROM messages) LEFT JOIN (
  SELECT room_id, arg_max(value, (ts, event_id)) AS v FROM settings_log WHERE setting = 'system_message' GROUP BY room_id) USING (room_id)"""),
    ("sc", "SELECT *, CASE WHEN sys = '' THEN 0 ELSE (ceil(length(sys) / 4) + 1)::BIGINT END AS sys_cost FROM sysm"),
    ("cums", """
SELECT m.*, sys, sys_cost, grp = 1 AS pinned, (sys_cost + sum(cost) OVER (PARTITION BY m.room_id ORDER BY grp = 1 DESC, grp DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum FROM msg m JOIN sc USING (room_id)"""),
]

PROMPT_FULL = with_ctes(["messages", "settings_log"], _FULL + [("kept", f"""
SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY grp) AS place FROM cums WHERE cum <= {CFG.max_tokens - 1}""")], """
SELECT room_id, 1 AS pos, 'system' AS role, 1 AS part_pos, 'text' AS type, sys AS text, NULL::VARCHAR AS url FROM kept WHERE pinned AND sys <> ''
UNION ALL
SELECT k.room_id, (place + 1)::INT, k.role, (row_number() OVER (PARTITION BY k.room_id, k.grp ORDER BY i.pos))::INT,
  CASE WHEN is_url THEN 'image_url' ELSE 'text' END, CASE WHEN NOT is_url THEN text END, url
FROM kept k JOIN isl i ON i.room_id = k.room_id AND i.grp = k.grp""")

PROMPT_STATUS = with_ctes(["messages", "settings_log"], _FULL + [("lim", f"SELECT unnest({LIMITS})::BIGINT AS max_tokens"), ("pins", """
SELECT room_id, sys_cost, max_tokens, (SELECT cum FROM cums c WHERE c.room_id = sc.room_id AND pinned) AS pin FROM sc, lim"""), ("st", """
SELECT *, CASE WHEN sys_cost > max_tokens THEN 'system_too_long' WHEN pin IS NULL THEN 'no_messages' WHEN pin > max_tokens THEN 'pinned_overflow' ELSE 'ok' END AS status FROM pins""")], """
SELECT st.room_id, max_tokens, status, count(cum) AS n_kept, coalesce(max(cum), 0)::BIGINT AS tokens
FROM st LEFT JOIN cums ON cums.room_id = st.room_id AND status = 'ok' AND cum <= max_tokens GROUP BY ALL""")

ORACLE = {
    "prompt_full": PROMPT_FULL,
    "prompt_status": PROMPT_STATUS,
    "kind_resolution": """
SELECT concat('$', conv_id, '-', turn) AS event_id, kind,
       CASE WHEN kind IS NOT NULL THEN 'ok' WHEN k IN (2, 8, 14) THEN 'ignored' ELSE 'unprocessable' END AS status
FROM (SELECT *, CASE WHEN k < 5 THEN concat('m.type', k) WHEN k IN (13, 14) THEN NULL
                     WHEN k % 3 = 0 THEN 'm.text' WHEN k % 3 = 1 THEN 'm.image' END AS kind
      FROM (SELECT *, (conv_id * 7 + turn * 3) % 16 AS k FROM conversations))""",
    "context_last_n": _ctx_sql(CFG.max_messages),
    "context_last_small": _ctx_sql(SMALL_N),
    "context_token_budget": _budget_sql(BUDGET),
    "context_default_budget": _budget_sql(CFG.max_tokens - 1),
}

QUERIES = {
    "prompt_full": q_prompt_full,
    "prompt_status": q_prompt_status,
    "kind_resolution": q_kind_resolution,
    "context_last_n": q_context_last_n,
    "context_last_small": q_context_last_small,
    "context_token_budget": q_context_token_budget,
    "context_default_budget": q_context_default_budget,
}
