"""T5 beyond the watermark: a re-delivery older than the watermark is late
data and is dropped, so it cannot appear twice."""

import datetime as dt
import os
import tempfile

from chatlake.streaming import streams as ST

SCHEMA = "event_id bigint, ts timestamp, v string"


def test_late_first_delivery_comes_out_once(spark):
    base = tempfile.mkdtemp(prefix="chatlake-late-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    t0 = dt.datetime(2024, 1, 1)
    days = [(1, 5), (2, 1), (1, 5), (3, 0), (2, 1)]             # out of time order, with repeats

    for i, (event, day) in enumerate(days):
        spark.createDataFrame([(event, t0 + dt.timedelta(days=day), "a")], SCHEMA).write.parquet(os.path.join(src, f"p{i}"))
        s = spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "*"))
        ST.run_available_now(s, out, foreach_batch=ST.dedup_sink(out, every=2))
    assert sorted(r.event_id for r in ST.read_deduped(spark, out).collect()) == [1, 2, 3]


def test_readers_of_empty_sinks(spark):
    out = tempfile.mkdtemp(prefix="chatlake-empty-")
    assert ST.read_settings(spark, out).count() == 0
    assert ST.read_abandoned(spark, out).count() == 0
    assert ST.read_totals(spark, out).count() == 0


def test_redelivery_beyond_watermark(spark):
    base = tempfile.mkdtemp(prefix="chatlake-late-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)

    def add(name, rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(src, name))

    def run():
        s = spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "*"))
        ST.run_available_now(ST.dedup_redelivered(s, delay="10 minutes"), out)
        return sorted(r.event_id for r in spark.read.parquet(f"{out}/data").collect())

    add("p1", [(1, t0, "a"), (2, t0 + dt.timedelta(hours=2), "b")])
    assert run() == [1, 2]
    # event 1 again, two hours behind the newest event: beyond the 10-minute watermark
    add("p2", [(1, t0, "a"), (3, t0 + dt.timedelta(hours=2, minutes=5), "c")])
    assert run() == [1, 2, 3]
