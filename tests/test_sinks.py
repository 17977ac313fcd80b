"""Batch sinks: settings change log, outbox JSON lines, spaces versions."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from chatlake.functions import payloads as P
from chatlake.operators import spaces as SP
from chatlake.sources import sinks as SK


def test_settings_log_and_outbox(spark):
    base = tempfile.mkdtemp(prefix="chatlake-sinks-")
    log = os.path.join(base, "settings")
    w1 = spark.createDataFrame([("!r", "tts", "1", "2024-01-01 00:00:00", 1)],
                               "room_id string, setting string, value string, ts string, event_id bigint") \
        .withColumn("ts", F.to_timestamp("ts"))
    w2 = spark.createDataFrame([("!r", "tts", "0", "2024-01-02 00:00:00", 2), ("!s", "stt", "1", "2024-01-02 00:00:00", 3)],
                               "room_id string, setting string, value string, ts string, event_id bigint") \
        .withColumn("ts", F.to_timestamp("ts"))
    SK.append_settings(w1, log)
    SK.append_settings(w2, log)
    got = {(r.room_id, r.setting): r.value for r in SK.read_settings(spark, log).collect()}
    assert got == {("!r", "tts"): "0", ("!s", "stt"): "1"}

    out = os.path.join(base, "outbox")
    msgs = spark.createDataFrame([("!r", "hello", False, "2024-01-01 00:00:00")], "room_id string, body string, notice boolean, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    _, env = P.message_envelope("body", "notice")
    SK.write_outbox(msgs.select("room_id", F.lit("m.room.message").alias("event_type"), env.alias("content"), "ts"), out)
    row = spark.read.json(out).collect()[0]
    assert row.event_type == "m.room.message" and json.loads(row.content)["body"] == "hello"

    sp = os.path.join(base, "spaces_v2")
    spaces = spark.createDataFrame([("!s1", "@a", True)], "space_id string, user_id string, active boolean")
    SK.write_spaces(SP.deactivate_users(spaces, spaces.select("user_id")), sp)
    assert spark.read.parquet(sp).collect()[0].active is False
