"""Streaming: availableNow equals batch, restart from the checkpoint adds
nothing, re-delivered events do not duplicate, membership state edges."""

import os
import tempfile

import pandas as pd
from chatlake.operators import spaces as SP
from chatlake.plans import registry
from chatlake.streaming import streams as ST
from pyspark.sql import functions as F


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


MEM = "room_id string, user_id string, membership string, ts timestamp, event_id bigint"


def _ts(s):
    return pd.Timestamp(s).to_pydatetime()


def test_abandoned_stream_edges_and_restart(spark):
    base = tempfile.mkdtemp(prefix="chatlake-stream-")
    src = os.path.join(base, "src")
    out = os.path.join(base, "out")
    rows1 = [
        ("!a", "@x", "leave", _ts("2024-01-01 00:00:00"), 1),   # leave before join: count 0, not 1
        ("!a", "@x", "join", _ts("2024-01-01 00:01:00"), 2),
        ("!a", "@y", "join", _ts("2024-01-01 00:02:00"), 3),
        ("!a", "@y", "leave", _ts("2024-01-01 00:03:00"), 4),  # one left → abandoned
        ("!b", "@x", "join", _ts("2024-01-01 00:00:00"), 5),
        ("!b", "@x", "join", _ts("2024-01-01 00:01:00"), 6),   # rejoin does not double count
        ("!b", "@z", "join", _ts("2024-01-01 00:02:00"), 7),
    ]
    _write(spark, src, "part1", rows1, MEM)
    stream = spark.readStream.schema(MEM).parquet(os.path.join(src, "*"))
    def run(s):
        ST.run_available_now(s, out, foreach_batch=ST.abandoned_sink(out))
        return sorted(r.event_id for r in ST.read_abandoned(spark, out).collect())

    assert run(stream) == [4]
    # a restart with no new files adds nothing
    assert run(spark.readStream.schema(MEM).parquet(os.path.join(src, "*"))) == [4]
    # new data continues from the stored state (room b: z leaves → x alone)
    _write(spark, src, "part2", [("!b", "@z", "leave", _ts("2024-01-01 00:05:00"), 8)], MEM)
    assert run(spark.readStream.schema(MEM).parquet(os.path.join(src, "*"))) == [4, 8]
    # the batch twin agrees on the whole log
    log = spark.read.parquet(os.path.join(src, "*"))
    assert sorted(r.event_id for r in SP.abandoned_events(log).collect()) == [4, 8]


def test_redelivery_dedup_and_restart(spark):
    base = tempfile.mkdtemp(prefix="chatlake-dedup-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    schema = "event_id bigint, ts timestamp, v string"
    _write(spark, src, "p1", [(1, _ts("2024-01-01 00:00:00"), "a"), (1, _ts("2024-01-01 00:00:00"), "a"),
                              (2, _ts("2024-01-01 00:01:00"), "b")], schema)

    def run():
        s = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        ST.run_available_now(s, out, foreach_batch=ST.dedup_sink(out))
        return sorted(r.event_id for r in ST.read_deduped(spark, out).collect())

    assert run() == [1, 2]
    # the same event re-delivered later
    _write(spark, src, "p2", [(2, _ts("2024-01-01 00:01:00"), "b"), (3, _ts("2024-01-01 00:03:00"), "c")], schema)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]


def test_settings_change_log_stream(spark):
    base = tempfile.mkdtemp(prefix="chatlake-settings-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    schema = "room_id string, setting string, value string, ts timestamp, event_id bigint"
    _write(spark, src, "p1", [("r", "tts", "1", _ts("2024-01-01"), 1), ("r", "tts", "0", _ts("2024-01-02"), 2)], schema)

    def run():
        s = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        ST.run_available_now(s, out, foreach_batch=ST.change_log_sink(out))
        return {(r.room_id, r.setting): r.value for r in ST.read_settings(spark, out).collect()}

    assert run() == {("r", "tts"): "0"}
    _write(spark, src, "p2", [("r", "tts", "1", _ts("2024-01-03"), 3), ("s", "stt", "1", _ts("2024-01-01"), 4)], schema)
    assert run() == {("r", "tts"): "1", ("s", "stt"): "1"}
    assert run() == {("r", "tts"): "1", ("s", "stt"): "1"}


def test_usage_totals_stream(spark):
    base = tempfile.mkdtemp(prefix="chatlake-usage-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    schema = "api string, tokens bigint"
    _write(spark, src, "p1", [("openai-gpt", 3), ("openai-gpt", 4), ("openai-dall-e-3", 1)], schema)

    def run():
        s = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        ST.run_available_now(s, out, foreach_batch=ST.totals_sink(out))
        return {r.api: r.units for r in ST.read_totals(spark, out).collect()}

    assert run() == {"openai-gpt": 7, "openai-dall-e-3": 1}
    _write(spark, src, "p2", [("openai-gpt", 10)], schema)
    assert run() == {"openai-gpt": 17, "openai-dall-e-3": 1}


def test_stream_of_a_table_in_one_file_or_in_a_folder_of_files(spark):
    base = tempfile.mkdtemp(prefix="chatlake-table-")
    rows = [(c, t, "user", f"!gptbot word {c} {t}" if t % 2 else "a plain message") for c in range(12) for t in range(4)] + [(None, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    frame.repartition(5).write.parquet(f"{base}/folder/conversations.parquet")
    os.makedirs(f"{base}/named/conversations.parquet")
    os.makedirs(f"{base}/file")
    for k in range(3):                                             # files without an ending
        frame.where(F.coalesce("conv_id", F.lit(0)) % 3 == k).toPandas().astype({"conv_id": "Int64"}).to_parquet(f"{base}/named/conversations.parquet/part-{k}")
    frame.toPandas().astype({"conv_id": "Int64"}).to_parquet(f"{base}/file/conversations.parquet")
    frame.toPandas().astype({"conv_id": "Int64"}).to_parquet(f"{base}/file/pages.parquet")       # a table beside it is not read
    want = sorted(map(str, registry.queries()["message_route"](spark, f"{base}/folder").collect()))
    assert want
    for form in ("folder", "named", "file"):
        got = registry.queries()["stream_route"](spark, f"{base}/{form}/")
        assert sorted(map(str, got.collect())) == want, form
