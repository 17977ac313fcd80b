"""Sinks, schema evolution, log levels, attachments folder, plug-ins."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from chatlake.operators import evolve as E
from chatlake.operators import plugins as PL
from chatlake.operators import usage as U
from chatlake.sources import attachments as AT


def test_append_usage_and_totals(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="chatlake-usage-"), "usage")
    recs = spark.createDataFrame([("$1", "!r", "openai", "gpt-4o", 10), ("$2", "!r", "openai", "dall-e-3", 1),
                                  ("$3", "!s", "parcel", "tracking", 1)],
                                 "m string, r string, code string, api string, tokens int")
    rows = recs.select(U.usage_record("m", "r", "code", "api", "tokens", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
                       .alias("u")).select("u.*")
    U.append_usage(rows, path)
    U.append_usage(rows, path)
    U.append_usage(rows, None)                    # no store → no-op
    back = spark.read.parquet(path)
    assert back.count() == 6
    got = {r.api: (r.units, r.requests, r.unit) for r in U.usage_by_api(back).collect()}
    assert got == {"openai-gpt-4o": (20, 2, "tokens"), "openai-dall-e-3": (2, 2, "images"),
                   "parcel-tracking": (2, 2, "lookups")}
    assert {r.room_id: r.total_tokens for r in U.tokens_by_room(back).collect()} == {"!r": 22, "!s": 2}


def test_migrations(spark):
    v1 = spark.createDataFrame([("$1", "!r", 5, "2024-01-01")], "message_id string, room_id string, tokens int, timestamp string")
    v6 = E.migrate(v1, 0, 8)
    assert v6.columns == E.USAGE_V6 and v6.collect()[0].api == "openai"
    assert E.ledger_rows(0, 8) == [1, 3, 4, 5, 6, 7, 8]
    with pytest.raises(ValueError):
        E.migrate(v1, 5, 3)
    empty = spark.createDataFrame([], "id bigint")
    assert E.schema_version(empty).collect()[0].version == 0


def test_log_levels(spark):
    logs = spark.createDataFrame([("debug",), ("info",), ("warning",), ("critical",)], "level string")
    assert [r.level for r in U.level_filter(logs, "info").collect()] == ["info", "warning", "critical"]
    with pytest.raises(ValueError):
        U.level_filter(logs, "loud")
    bad = spark.createDataFrame([("loud",), (None,), ("info",)], "level string")
    assert [r.level for r in U.level_filter(bad, "info").collect()] == ["info"]
    assert [r.level for r in U.unknown_levels(bad).collect()] == ["loud", None]


def test_request_tokens_by_round(spark):
    rounds = [(1, 100, 1, "ok"), (1, 50, 2, "stop"), (2, 100, 1, "ok"), (2, 50, 2, "handover"), (2, 7, 3, "ok"), (3, None, 1, "ok"), (4, 9, 1, "stop")]
    df = spark.createDataFrame([(r, t, s, s, o) for r, t, s, o in rounds], "request_id int, tokens long, ts long, seq long, outcome string")
    got = {r.request_id: (r.rounds, r.outcome, r.tokens) for r in U.request_tokens(df.withColumn("ts", F.timestamp_seconds("ts"))).collect()}
    assert got == {1: (2, "stop", 100), 2: (3, "ok", 107), 3: (1, "ok", 0), 4: (1, "stop", 0)}


def test_malformed_log_lines(spark):
    lines = ["[2024-02-03 04:05:06:000007] - f1 - [INFO] a - [X] b\nc", "[] - f - [INFO] x", "[2024-13-03 04:05:06:000007] - f1 - [INFO] a", "free text", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = U.parse_log(df).collect()
    assert [r.status for r in rows] == ["ok"] + ["malformed"] * 4
    assert (str(rows[0].ts), rows[0].caller, rows[0].level, rows[0].message) == ("2024-02-03 04:05:06.000007", "f1", "info", "a - [X] b\nc")
    assert all(tuple(r)[:4] == (None,) * 4 for r in rows[1:])


def test_read_attachments_folder(spark):
    d = tempfile.mkdtemp(prefix="chatlake-att-")
    with open(os.path.join(d, "$ev1.txt"), "wb") as f:
        f.write(b"hello file")
    with open(os.path.join(d, "$ev2.png"), "wb") as f:
        f.write(b"\x89PNG\r\n")
    att = AT.read_attachments(spark, d)
    got = {r.event_id: (r.mimetype, r.size) for r in att.collect()}
    assert got == {"$ev1": ("text/plain", 10), "$ev2": ("image/png", 6)}
    assert [r.text for r in AT.file_text(att).collect()] == ["hello file"]


def test_model_call_retries(spark):
    class AlwaysFails:
        def __call__(self, msgs):
            raise RuntimeError("down")

    prompts = spark.createDataFrame([("a", [("user", "hi")]), ("b", [("user", "x"), ("assistant", "y")])],
                                    "room_id string, messages array<struct<role:string, content:string>>")

    class FlakyOnce:
        def __init__(self):
            self.n = {}

        def __call__(self, msgs):
            k = len(msgs)
            self.n[k] = self.n.get(k, 0) + 1
            if k == 2 and self.n[k] < 3:
                raise RuntimeError("transient")
            return f"ok {msgs[-1]['content']}", 7

    got = {r.room_id: (r.reply, r.tokens, r.status, r.attempts)
           for r in PL.call_model(prompts, FlakyOnce(), ["room_id"], attempts=5, interval=0).collect()}
    assert got == {"a": ("ok hi", 7, "ok", 1), "b": ("ok y", 7, "ok", 3)}
    failed = PL.call_model(prompts, AlwaysFails(), ["room_id"], attempts=5, interval=0).collect()
    assert {(r.status, r.attempts, r.reply) for r in failed} == {("failed", 5, None)}


def test_run_tools_statuses(spark):
    def _stop(**_):
        raise PL.StopProcessing("done")

    def _handover(**_):
        raise PL.Handover()

    def _keyerror(**kw):
        return kw["missing"]

    def _boom(**_):
        raise ValueError("x")

    calls = spark.createDataFrame([(1, "echo", '{"a": 1}'), (2, "nosuch", "{}"), (3, "stop", "{}"), (4, "handover", "{}"),
                                   (5, "keyerror", "{}"), (6, "boom", "{}"), (7, "echo", None)],
                                  "id int, tool string, arguments string")
    reg = {"echo": lambda **kw: f"echo {sorted(kw.items())}", "stop": _stop, "handover": _handover,
           "keyerror": _keyerror, "boom": _boom}
    got = {r.id: (r.status, r.result) for r in PL.run_tools(calls, reg, ["id"]).collect()}
    assert got == {1: ("ok", "echo [('a', 1)]"), 2: ("not_found", "Error: Tool not found"), 3: ("stop", "done"),
                   4: ("handover", None), 5: ("missing", "Error: Tool not found"),
                   6: ("error", "Error: Something went wrong calling tool boom"), 7: ("ok", "echo []")}
