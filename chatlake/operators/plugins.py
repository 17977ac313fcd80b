"""Python plug-in points (X1-X4): model calls, tools, classifier, token
counters.

These are the only places where Python runs per row, and they run inside
Arrow batches (``mapInPandas`` / pandas UDF) on the executors: Spark
partitions and shuffles the work, the callables only see one batch.  Model
and tool callables are injected (they must be picklable); the repository
ships no network client, tests use deterministic stubs.  Side effects
(model calls) are retried inside the task, so a task retry after an
executor loss repeats at most the calls of one batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RETRY_ATTEMPTS, DEFAULT_RETRY_INTERVAL_SEC, TOOL_FAILED, TOOL_NOT_FOUND
from ..functions import text as T
from .toolcalls import classify


class StopProcessing(Exception):
    """A tool asks to stop processing the message (optional reply text)."""


class Handover(Exception):
    """A tool hands the request back to the model without tools."""


Provider = Callable[[list[dict]], tuple[str, int]]


def _plain(v):
    """Arrow values → plain Python (arrays of structs arrive as arrays of
    dicts)."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist") and not isinstance(v, str):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def call_with_retries(fn: Callable[[], tuple[str, int]], attempts: int = DEFAULT_RETRY_ATTEMPTS,
                      interval: float = DEFAULT_RETRY_INTERVAL_SEC) -> tuple[str | None, int, str, int]:
    """X2 retry rule: up to ``attempts`` tries, ``interval`` seconds apart.
    Returns ``(text, tokens, status, attempts_used)``."""
    for i in range(1, attempts + 1):
        try:
            text, tokens = fn()
            return text, int(tokens or 0), "ok", i
        except Exception:  # noqa: BLE001 - any provider failure is retried
            if i < attempts and interval:
                time.sleep(interval)
    return None, 0, "failed", attempts


def call_model(prompts: DataFrame, provider: Provider, keys: list[str], messages: str = "messages",
               attempts: int = DEFAULT_RETRY_ATTEMPTS, interval: float = DEFAULT_RETRY_INTERVAL_SEC) -> DataFrame:
    """One model call per prompt row → ``keys + (reply, tokens, status,
    attempts)``."""
    key_fields = [f for f in prompts.schema.fields if f.name in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields] +
                       ["reply string", "tokens bigint", "status string", "attempts int"])
    cols = keys + [messages]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf[cols].to_dict("records"):
                msgs = _plain(rec[messages])
                text, tokens, status, used = call_with_retries(lambda: provider(msgs), attempts, interval)
                out.append([rec[k] for k in keys] + [text, tokens, status, used])
            yield pd.DataFrame(out, columns=keys + ["reply", "tokens", "status", "attempts"])

    return prompts.select(*cols).mapInPandas(run, schema)


def classify_messages(queries: DataFrame, provider: Provider, keys: list[str], text: str = "body",
                      attempts: int = DEFAULT_RETRY_ATTEMPTS, interval: float = DEFAULT_RETRY_INTERVAL_SEC,
                      prefix: str = "!bot") -> DataFrame:
    """X3 = X2 + F8: the classifier sees ``[{role: user, content: text}]``;
    its reply is parsed by F8 (failures fall back to ``chat``)."""
    prompts = queries.select(*keys, F.col(text).alias("query"),
                             F.array(F.struct(F.lit("user").alias("role"), F.col(text).alias("content"))).alias("messages"))
    replies = call_model(prompts, provider, keys + ["query"], "messages", attempts, interval)
    return classify(replies.withColumnRenamed("reply", "reply"), "reply", "query", prefix)


ToolFn = Callable[..., str]


def run_tools(calls: DataFrame, registry: dict[str, ToolFn], keys: list[str], tool: str = "tool",
              arguments: str = "arguments") -> DataFrame:
    """Apply registered tool callables to a tool-call table.

    ``status``: ``ok``, ``not_found`` (unknown name), ``missing`` (a
    ``KeyError`` inside the tool, kept apart from an unknown tool), ``error``
    (any other failure, with an error text naming the tool), ``stop`` and
    ``handover`` (control results)."""
    key_fields = [f for f in calls.schema.fields if f.name in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields] +
                       [f"{tool} string", "status string", "result string"])
    cols = keys + [tool, arguments]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf[cols].to_dict("records"):
                name = rec[tool]
                fn = registry.get(name)
                if fn is None:
                    status, result = "not_found", TOOL_NOT_FOUND
                else:
                    try:
                        args = json.loads(rec[arguments] or "{}")
                        result = str(fn(**args))
                        status = "ok"
                    except StopProcessing as e:
                        status, result = "stop", (str(e.args[0]) if e.args else None)
                    except Handover:
                        status, result = "handover", None
                    except KeyError:
                        status, result = "missing", TOOL_NOT_FOUND
                    except Exception:  # noqa: BLE001
                        status, result = "error", TOOL_FAILED.format(tool=name)
                out.append([rec[k] for k in keys] + [name, status, result])
            yield pd.DataFrame(out, columns=keys + [tool, "status", "result"])

    return calls.select(*cols).mapInPandas(run, schema)


def native_counter(text) -> Column:
    """X4 default: JVM-side counter (ceil(chars / 4))."""
    return T.native_token_count(text)


def pandas_counter(count: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Wrap a vectorised Python token counter (e.g. a BPE encoder
    applied per batch) as a pandas UDF returning BIGINT."""

    @F.pandas_udf("bigint")
    def _count(s: pd.Series) -> pd.Series:
        return count(s.fillna("")).astype("int64")

    return lambda c: _count(T.col(c))
