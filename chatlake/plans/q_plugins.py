"""Registered queries for the plug-in points (X1-X4), run with deterministic
stub callables (no network in this repository)."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators import plugins as PL
from ..operators import routing as R
from ..operators import toolcalls as TC
from ..sources import views as V
from ..sources.tables import table
from .oracle_views import with_ctes
from .q_prompt import ORACLE as PROMPT_ORACLE
from .q_prompt import _CALLS, _JS, q_prompt_build

CFG = DEFAULT_CONFIG


class FlakyEcho:
    """Stub model: echoes the last message; the first attempt on a prompt
    with an even number of messages fails (exercises the retry rule).  A
    fresh copy is unpickled per task, so the behaviour is per task."""

    def __init__(self):
        self.seen: set = set()

    def __call__(self, msgs):
        key = tuple(m["content"] or "" for m in msgs)
        if len(msgs) % 2 == 0 and key not in self.seen:
            self.seen.add(key)
            raise RuntimeError("transient failure")
        tokens = sum(math.ceil(len(m["content"] or "") / 4) + 1 for m in msgs)
        return "echo: " + (msgs[-1]["content"] or ""), tokens


def digit_classifier(msgs):
    """Stub classifier: text with a digit is a calculation, everything else
    gets an unparsable reply (→ chat)."""
    text = msgs[-1]["content"] or ""
    if re.search("[0-9]", text):
        return json.dumps({"type": "calculate", "prompt": text}), 1
    return "not json", 1


def _dice(dice="6", **_):
    return f"rolled d{dice}"


def _wiki(query=None, **_):
    if not query:
        raise Exception("No query provided.")
    return f"looked up {query}"


STUB_TOOLS = {"dice": _dice, "wikipedia": _wiki}


def q_batch_model_call(spark, sf):
    flat = q_prompt_build(spark, sf)
    prompts = flat.groupBy("room_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("messages"))
    return PL.call_model(prompts, FlakyEcho(), ["room_id"], attempts=5, interval=0)


def q_batch_tools(spark, sf):
    calls = TC.tool_calls(V.model_replies(spark, sf))
    return PL.run_tools(calls, STUB_TOOLS, ["reply_id"])


def q_token_counter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    bpe_like = PL.pandas_counter(lambda s: (s.str.len() + 3) // 4)
    return d.select("doc_id", PL.native_counter("text").alias("tokens_native"), bpe_like("text").alias("tokens_pandas"))


def q_classify_messages(spark, sf):
    m = R.drop_own(V.messages(spark, sf), CFG).where(F.col("kind") == "m.text")
    q = m.where(R.route(cfg=CFG) == "query").select("event_id", "body")
    c = PL.classify_messages(q, digit_classifier, ["event_id"], "body", interval=0, prefix=CFG.prefix)
    return c.select("event_id", "type", "prompt", "routed_body", "tokens")


_PB = PROMPT_ORACLE["prompt_build"]

ORACLE = {
    "batch_model_call": f"""
WITH pb AS ({_PB})
SELECT room_id, concat('echo: ', arg_max(content, pos)) AS reply,
       CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT) + 1) AS BIGINT) AS tokens, 'ok' AS status,
       CAST(CASE WHEN count(*) % 2 = 0 THEN 2 ELSE 1 END AS INT) AS attempts
FROM pb GROUP BY room_id""",
    "batch_tools": with_ctes(["model_replies"], [_JS, _CALLS], """
SELECT reply_id, tool,
       CASE WHEN tool = 'dice' THEN 'ok'
            WHEN tool = 'wikipedia' THEN CASE WHEN coalesce(json_extract_string(arguments, '$.query'), '') <> '' THEN 'ok' ELSE 'error' END
            ELSE 'not_found' END AS status,
       CASE WHEN tool = 'dice' THEN concat('rolled d', coalesce(json_extract_string(arguments, '$.dice'), '6'))
            WHEN tool = 'wikipedia' THEN CASE WHEN coalesce(json_extract_string(arguments, '$.query'), '') <> ''
                 THEN concat('looked up ', json_extract_string(arguments, '$.query'))
                 ELSE 'Error: Something went wrong calling tool wikipedia' END
            ELSE 'Error: Tool not found' END AS result
FROM c WHERE kind = 'call'"""),
    "token_counter": """
SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens_native, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens_pandas
FROM documents""",
    "classify_messages": with_ctes(["messages"], [], f"""
SELECT event_id, CASE WHEN regexp_matches(body, '[0-9]') THEN 'calculate' ELSE 'chat' END AS type, body AS prompt,
       CASE WHEN regexp_matches(body, '[0-9]') THEN concat_ws(' ', '{CFG.prefix}', 'calculate', body) END AS routed_body,
       CAST(1 AS BIGINT) AS tokens
FROM messages
WHERE sender <> '{CFG.bot_id}' AND kind = 'm.text' AND NOT starts_with(body, '!')
  AND NOT starts_with(body, '* {CFG.prefix}')"""),
}

QUERIES = {
    "batch_model_call": q_batch_model_call,
    "batch_tools": q_batch_tools,
    "token_counter": q_token_counter,
    "classify_messages": q_classify_messages,
}
