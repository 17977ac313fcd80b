"""Registered queries: prompt reshaping (media merge, text parts, contents,
tool roles, tool-round splice, prompt assembly) and model replies (tool
calls, tool arguments, tool lookup, classification, model routing)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, TOOL_DEFAULTS, TOOL_MODELS, TOOL_REQUIRED, TOOLS, VISION_MODELS
from ..functions import text as T
from ..operators import context as C
from ..operators import routing as R
from ..operators import toolcalls as TC
from ..sources import views as V
from .oracle_views import with_ctes
from .q_context import BUDGET, SYS_COST, _w1_sql

CFG = DEFAULT_CONFIG
ROUTE_CFG = CFG.with_(tool_model="gpt-4o", emulate_tools=True)
CUSTOM = CFG.custom_kind_prefix + "."
REQUEST_MODELS = ["gpt-4o", "gpt-3.5-turbo-16k", "llava-vision", "gpt-4", "mistral-7b"]


def _ctx(spark, sf):
    return C.last_n_messages(V.messages(spark, sf), CFG)


def _flat(msgs, parts="parts"):
    e = msgs.select("room_id", "msg_seq", F.posexplode(parts).alias("_pos", "p"))
    return e.select("room_id", "msg_seq", (F.col("_pos") + 1).alias("part_pos"),
                    F.col("p.type").alias("type"), F.col("p.text").alias("text"), F.col("p.url").alias("url"))


def q_media_merge(spark, sf):
    pm = C.prepare_messages(_ctx(spark, sf), CFG)
    e = pm.select("room_id", "msg_seq", "role", F.posexplode("parts").alias("_pos", "p"))
    return e.select("room_id", "msg_seq", "role", (F.col("_pos") + 1).alias("part_pos"),
                    F.col("p.type").alias("type"), F.col("p.text").alias("text"), F.col("p.url").alias("url"))


def q_text_parts(spark, sf):
    pm = C.text_parts_only(C.prepare_messages(_ctx(spark, sf), CFG))
    return _flat(pm).select("room_id", "msg_seq", "part_pos", "text")


def q_contents_only(spark, sf):
    return _flat(C.contents_only(C.prepare_messages(_ctx(spark, sf), CFG)), "content")


def _arrays(spark, sf):
    ctx = _ctx(spark, sf).withColumn("role", C.role_of("sender", CFG))
    return C.prompt_arrays(ctx, "body", CUSTOM)


def _explode_msgs(df, col):
    e = df.select("room_id", F.posexplode(col).alias("_pos", "m"))
    return e.select("room_id", (F.col("_pos") + 1).alias("pos"), F.col("m.seq").alias("seq"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_tool_role_rewrite(spark, sf):
    a = _arrays(spark, sf).select("room_id", C.rewrite_tool_roles("messages").alias("msgs"))
    return _explode_msgs(a, "msgs")


def q_splice_round(spark, sf):
    a = _arrays(spark, sf)
    choice = F.struct(F.lit(None).cast("bigint").alias("seq"), F.lit("assistant").alias("role"),
                      F.lit("calling tools").alias("content"), F.lit(None).cast("string").alias("tool_call_id"))
    results = F.transform(F.filter("messages", lambda m: m["role"] == "tool"),
                          lambda m: F.struct(m["seq"].alias("seq"), F.lit("tool").alias("role"),
                                             F.concat(F.lit("result of "), m["tool_call_id"]).alias("content"),
                                             m["tool_call_id"].alias("tool_call_id")))
    s = a.select("room_id", C.splice_round("messages", choice, results).alias("msgs"))
    return _explode_msgs(s, "msgs").select("room_id", "pos", "role", "content")


def q_prompt_build(spark, sf):
    ctx = _ctx(spark, sf).withColumn("role", C.role_of("sender", CFG))
    kept = C.truncate_to_budget(ctx.withColumn("cost", T.message_cost("body")), BUDGET,
                                system_cost=T.system_cost(F.lit(CFG.default_system_message)))
    p = C.assemble_prompt(kept, F.lit(CFG.default_system_message))
    return _explode_msgs(p, "messages").select("room_id", "pos", "role", "content")


def q_prompt_context(spark, sf):
    """The main path: history window → prepared messages (roles, media
    merge, failed attachments) → token budget on the prepared messages,
    each costing its first text part (A6)."""
    pm = C.prepare_messages(_ctx(spark, sf), CFG).withColumnRenamed("msg_seq", "seq")
    kept = C.truncate_to_budget(pm.withColumn("cost", T.parts_cost("parts")), BUDGET,
                                system_cost=T.system_cost(F.lit(CFG.default_system_message)))
    return kept.select("room_id", F.col("seq").alias("msg_seq"), "role", F.size("parts").alias("n_parts"),
                       "cost", "cum", "pinned")


def _calls(spark, sf):
    return TC.extract_tool_call(V.model_replies(spark, sf))


def q_toolcall_extract(spark, sf):
    return _calls(spark, sf).select("reply_id", "kind", "tool", "arguments")


def q_tool_args(spark, sf):
    c = TC.tool_calls(V.model_replies(spark, sf))
    return TC.normalise_tool_args(c).select("reply_id", "tool", "status", "missing", "args")


def q_tool_lookup(spark, sf):
    c = TC.tool_calls(V.model_replies(spark, sf))
    return R.lookup_tool(c).select("reply_id", "tool", "tool_status")


def q_classify_parse(spark, sf):
    c = TC.classify(V.model_replies(spark, sf), prefix=CFG.prefix)
    p = R.parse_command(c, body="routed_body")
    return p.select("reply_id", "type", "prompt", "routed_body", "command", "args")


def requests(spark, sf):
    r = V.model_replies(spark, sf).select("reply_id")
    i = F.col("reply_id")
    model = F.lit(None).cast("string")
    for k, m in enumerate(REQUEST_MODELS):
        model = F.when(i % len(REQUEST_MODELS) == k, F.lit(m)).otherwise(model)
    return r.select("reply_id", model.alias("model"), (i % 2 == 0).alias("use_tools"),
                    (i % 3 != 0).alias("allow_override"))


def q_model_route(spark, sf):
    r = TC.route_model(requests(spark, sf), cfg=ROUTE_CFG)
    return r.select("reply_id", "model_used", "overridden", "tools_attached", "max_tokens", "emulate", "vision")


# ------------------------------------------------------------------ oracle

_BOT = CFG.bot_id
_MM = [
    ("ctx", _w1_sql(CFG.max_messages)),
    ("b", f"""
SELECT room_id, seq, event_id, body,
       CASE WHEN kind IN ('m.text', 'm.notice') THEN 'text'
            WHEN kind = 'm.audio' OR (kind = 'm.file' AND ends_with(body, '.mp3')) THEN 'audio'
            WHEN kind = 'm.file' THEN 'file' WHEN kind = 'm.image' THEN '{"image" if CFG.vision else "drop"}'
            WHEN kind = 'm.video' THEN '{"video" if CFG.video else "drop"}'
            ELSE 'drop' END AS branch,
       CASE WHEN sender = '{_BOT}' THEN 'assistant' ELSE 'user' END AS role0
FROM ctx"""),
    ("r", """
SELECT room_id, seq, CASE WHEN branch = 'file' THEN 'system' ELSE role0 END AS role,
       branch IN ('image', 'video') AS is_media,
       CASE WHEN branch IN ('image', 'video') THEN 'image_url' ELSE 'text' END AS type,
       CASE WHEN branch IN ('image', 'video') THEN NULL ELSE body END AS text,
       CASE WHEN branch IN ('image', 'video') THEN concat('mxc://', event_id) END AS url
FROM b WHERE branch <> 'drop'"""),
    ("s", """
SELECT *, CASE WHEN NOT is_media OR lag(role) OVER (PARTITION BY room_id ORDER BY seq) IS DISTINCT FROM role
               THEN 1 ELSE 0 END AS st FROM r"""),
    ("g", """
SELECT *, sum(st) OVER (PARTITION BY room_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM s"""),
    ("mm", """
SELECT room_id, min(seq) OVER (PARTITION BY room_id, grp) AS msg_seq,
       first_value(role) OVER (PARTITION BY room_id, grp ORDER BY seq) AS role,
       CAST(row_number() OVER (PARTITION BY room_id, grp ORDER BY seq) AS INT) AS part_pos, type, text, url
FROM g"""),
]
_ROLE = f"CASE WHEN starts_with(kind, '{CUSTOM}') THEN 'tool' WHEN sender = '{_BOT}' THEN 'assistant' ELSE 'user' END"
_JS = ("j", """
SELECT reply_id, query, reply,
       CASE WHEN json_valid(s) THEN s END AS js
FROM (SELECT *, regexp_replace(regexp_replace(reply, '^```(?:json)?\\n', ''), '```\\z', '') AS s FROM model_replies) f""")
_CALLS = ("c", """
SELECT reply_id,
       CASE WHEN json_type(js) = 'OBJECT' AND json_exists(js, '$.tool') THEN 'call'
            WHEN json_type(js) = 'OBJECT' THEN 'regenerate' ELSE 'text' END AS kind,
       CASE WHEN json_type(js) = 'OBJECT' AND json_exists(js, '$.tool') THEN json_extract_string(js, '$.tool') END AS tool,
       CASE WHEN json_type(js) = 'OBJECT' AND json_exists(js, '$.tool')
            THEN coalesce(json_extract(js, '$.parameters')::VARCHAR, '{}') END AS arguments
FROM j""")


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_DEF = _values([(t, k, v) for t, d in TOOL_DEFAULTS.items() for k, v in d.items()])
_REQ = _values([(t, k) for t, ks in TOOL_REQUIRED.items() for k in ks])
_KNOWN = ", ".join(f"'{t}'" for t in TOOL_REQUIRED)
_TOOLS = ", ".join(f"'{t}'" for t in TOOLS)


def _model_case(col="reply_id"):
    return "CASE " + " ".join(f"WHEN {col} % {len(REQUEST_MODELS)} = {k} THEN '{m}'"
                              for k, m in enumerate(REQUEST_MODELS)) + " END"


def _is_tool(m):
    return f"({m} IN ({', '.join(repr(x) for x in TOOL_MODELS)}))"


ORACLE = {
    "media_merge": with_ctes(["messages"], _MM, "SELECT * FROM mm"),
    "text_parts": with_ctes(["messages"], _MM, """
SELECT room_id, msg_seq, CAST(row_number() OVER (PARTITION BY room_id, msg_seq ORDER BY part_pos) AS INT) AS part_pos, text
FROM mm WHERE type = 'text'"""),
    "contents_only": with_ctes(["messages"], _MM, "SELECT room_id, msg_seq, part_pos, type, text, url FROM mm"),
    "tool_role_rewrite": with_ctes(["messages"], [("ctx", _w1_sql(CFG.max_messages))], f"""
SELECT room_id, CAST(row_number() OVER (PARTITION BY room_id ORDER BY seq) AS INT) AS pos, seq,
       CASE WHEN starts_with(kind, '{CUSTOM}') THEN 'system' WHEN sender = '{_BOT}' THEN 'assistant' ELSE 'user' END AS role,
       body AS content
FROM ctx"""),
    "splice_round": with_ctes(["messages"], [("ctx", _w1_sql(CFG.max_messages)), ("o", f"""
SELECT room_id, seq, event_id, {_ROLE} AS role, body AS content,
       row_number() OVER (PARTITION BY room_id ORDER BY seq) AS rn,
       count(*) OVER (PARTITION BY room_id) AS k,
       sum(CASE WHEN starts_with(kind, '{CUSTOM}') THEN 1 ELSE 0 END) OVER (PARTITION BY room_id) AS r
FROM ctx"""), ("t", """
SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY seq) AS rt FROM o WHERE role = 'tool'""")], """
SELECT room_id, CAST(rn AS INT) AS pos, role, content FROM o WHERE rn < k
UNION ALL SELECT DISTINCT room_id, CAST(k AS INT) AS pos, 'assistant' AS role, 'calling tools' AS content FROM o
UNION ALL SELECT room_id, CAST(k + rt AS INT) AS pos, 'tool' AS role, concat('result of ', event_id) AS content FROM t
UNION ALL SELECT room_id, CAST(k + r + 1 AS INT) AS pos, role, content FROM o WHERE rn = k"""),
    "prompt_build": with_ctes(["messages"], [("ctx", _w1_sql(CFG.max_messages)), ("c", f"""
SELECT room_id, seq, body, CASE WHEN sender = '{_BOT}' THEN 'assistant' ELSE 'user' END AS role,
       CAST(ceil(length(body) / 4) AS BIGINT) + 1 AS cost, seq = min(seq) OVER (PARTITION BY room_id) AS pinned FROM ctx"""),
        ("kept", f"""
SELECT * FROM (SELECT *, {SYS_COST} + sum(cost) OVER (PARTITION BY room_id ORDER BY pinned DESC, seq DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM c) x WHERE cum <= {BUDGET}""")], f"""
SELECT DISTINCT room_id, 1 AS pos, 'system' AS role, '{CFG.default_system_message}' AS content FROM kept
UNION ALL
SELECT room_id, CAST(1 + row_number() OVER (PARTITION BY room_id ORDER BY seq) AS INT) AS pos, role, body AS content FROM kept"""),
    "prompt_context": with_ctes(["messages"], _MM + [("pm", """
SELECT room_id, msg_seq, any_value(role) AS role, CAST(count(*) AS INT) AS n_parts,
       CAST(ceil(length(coalesce(max(CASE WHEN part_pos = 1 AND type = 'text' THEN text END), '')) / 4) AS BIGINT) + 1 AS cost
FROM mm GROUP BY room_id, msg_seq"""), ("w", f"""
SELECT *, msg_seq = min(msg_seq) OVER (PARTITION BY room_id) AS pinned FROM pm"""), ("run", f"""
SELECT *, CAST({SYS_COST} + sum(cost) OVER (PARTITION BY room_id ORDER BY pinned DESC, msg_seq DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum FROM w""")],
        f"SELECT room_id, msg_seq, role, n_parts, cost, cum, pinned FROM run WHERE cum <= {BUDGET}"),
    "toolcall_extract": with_ctes(["model_replies"], [_JS, _CALLS], "SELECT reply_id, kind, tool, arguments FROM c"),
    "tool_args": with_ctes(["model_replies"], [
        _JS, _CALLS,
        ("calls", "SELECT * FROM c WHERE kind = 'call'"),
        ("d", f"SELECT * FROM (VALUES {_DEF}) d(tool, k, v)"),
        ("req", f"SELECT * FROM (VALUES {_REQ}) q(tool, k)"),
        ("pk", """
SELECT reply_id, tool, k, coalesce(json_extract_string(x, '$'), 'null') AS v,
       CASE json_type(x) WHEN 'NULL' THEN true WHEN 'BOOLEAN' THEN x::VARCHAR = 'false' WHEN 'VARCHAR' THEN json_extract_string(x, '$') = ''
            WHEN 'ARRAY' THEN json_array_length(x) = 0 WHEN 'OBJECT' THEN len(json_keys(x)) = 0 ELSE x::DOUBLE = 0 END AS falsy
FROM (SELECT c.reply_id, c.tool, u.key AS k, json_extract(c.arguments, concat('$."', u.key, '"')) AS x
      FROM calls c, unnest(json_keys(c.arguments)) AS u(key))"""),
        ("merged", """
SELECT reply_id, tool, k, v, falsy FROM pk
UNION ALL
SELECT c.reply_id, c.tool, d.k, d.v, d.v = '' FROM calls c JOIN d ON c.tool = d.tool
WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.reply_id = c.reply_id AND pk.k = d.k)"""),
        ("miss", f"""
SELECT c.reply_id, min(q.k) AS missing FROM calls c JOIN req q ON c.tool = q.tool
LEFT JOIN merged m ON m.reply_id = c.reply_id AND m.k = q.k
WHERE m.v IS NULL OR m.falsy
GROUP BY c.reply_id"""),
        ("agg", "SELECT reply_id, string_agg(concat(k, '=', v), ';' ORDER BY k) AS args FROM merged GROUP BY reply_id")], f"""
SELECT c.reply_id, c.tool,
       CASE WHEN c.tool NOT IN ({_KNOWN}) THEN 'not_found' WHEN m.missing IS NOT NULL THEN 'missing_argument' ELSE 'ok' END AS status,
       CASE WHEN c.tool IN ({_KNOWN}) THEN m.missing END AS missing,
       CASE WHEN c.tool IN ({_KNOWN}) THEN coalesce(a.args, '') END AS args
FROM calls c LEFT JOIN miss m ON c.reply_id = m.reply_id LEFT JOIN agg a ON c.reply_id = a.reply_id"""),
    "tool_lookup": with_ctes(["model_replies"], [_JS, _CALLS], f"""
SELECT reply_id, tool, CASE WHEN tool IN ({_TOOLS}) THEN 'ok' ELSE 'not_found' END AS tool_status
FROM c WHERE kind = 'call'"""),
    "classify_parse": with_ctes(["model_replies"], [("p", """
SELECT *, js IS NOT NULL AND json_type(js) = 'OBJECT' AND json_extract_string(js, '$.type') IS NOT NULL AS ok,
       json_extract_string(js, '$.type') AS t, json_extract_string(js, '$.prompt') AS pr
FROM (SELECT *, CASE WHEN json_valid(reply) THEN reply END AS js FROM model_replies) x"""), ("q", f"""
SELECT reply_id, CASE WHEN ok THEN t ELSE 'chat' END AS type, CASE WHEN ok THEN pr ELSE query END AS prompt,
       CASE WHEN ok AND t <> 'chat' THEN concat_ws(' ', '{CFG.prefix}', t, pr) END AS routed_body
FROM p"""), ("r", """
SELECT *, list_filter(string_split_regex(routed_body, '\\s+'), lambda x: x <> '') AS toks FROM q""")], """
SELECT reply_id, type, prompt, routed_body, toks[2] AS command,
       CASE WHEN len(toks) > 2 THEN array_to_string(toks[3:], ' ') END AS args
FROM r"""),
    "model_route": with_ctes(["model_replies"], [("q", f"""
SELECT reply_id, {_model_case()} AS model, reply_id % 2 = 0 AS use_tools, reply_id % 3 <> 0 AS allow_override
FROM model_replies"""), ("u", f"""
SELECT *, allow_override AND use_tools AND NOT {_is_tool('model')} AS overridden FROM q"""), ("v", f"""
SELECT *, CASE WHEN overridden THEN '{ROUTE_CFG.tool_model}' ELSE model END AS model_used FROM u""")], f"""
SELECT reply_id, model_used, overridden, {_is_tool('model_used')} AND use_tools AS tools_attached,
       CASE WHEN contains(model_used, 'gpt-4') THEN {ROUTE_CFG.max_tokens} END AS max_tokens,
       use_tools AND NOT {_is_tool('model_used')} AS emulate,
       model_used IN ({', '.join(repr(x) for x in VISION_MODELS)}) OR contains(model_used, 'vision') AS vision
FROM v"""),
}

QUERIES = {
    "media_merge": q_media_merge,
    "text_parts": q_text_parts,
    "contents_only": q_contents_only,
    "tool_role_rewrite": q_tool_role_rewrite,
    "splice_round": q_splice_round,
    "prompt_build": q_prompt_build,
    "prompt_context": q_prompt_context,
    "toolcall_extract": q_toolcall_extract,
    "tool_args": q_tool_args,
    "tool_lookup": q_tool_lookup,
    "classify_parse": q_classify_parse,
    "model_route": q_model_route,
}
