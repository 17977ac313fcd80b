"""T2 as a foreachBatch job: membership state carried across batches,
restart adds nothing, result equals the batch twin over the whole log."""

import os
import tempfile

import pandas as pd

from chatlake.operators import spaces as SP
from chatlake.streaming import streams as ST

MEM = "room_id string, user_id string, membership string, ts timestamp_ntz, event_id bigint"


def _ts(s):
    return pd.Timestamp(s).to_pydatetime()


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, MEM).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


def test_abandoned_sink_incremental(spark):
    base = tempfile.mkdtemp(prefix="chatlake-t2-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")

    def run():
        s = spark.readStream.schema(MEM).parquet(os.path.join(src, "*"))
        ST.run_available_now(s, out, foreach_batch=ST.abandoned_sink(out))
        return sorted(r.event_id for r in ST.read_abandoned(spark, out).collect())

    _write(spark, src, "p1", [
        ("!a", "@x", "leave", _ts("2024-01-01 00:00"), 1),
        ("!a", "@x", "join", _ts("2024-01-01 00:01"), 2),
        ("!a", "@y", "join", _ts("2024-01-01 03:02"), 3),     # another hour bucket
        ("!a", "@y", "leave", _ts("2024-01-01 05:03"), 4),    # x alone → abandoned
        ("!b", "@x", "join", _ts("2024-01-01 00:00"), 5),
        ("!b", "@x", "join", _ts("2024-01-01 02:00"), 6),
        ("!b", "@z", "join", _ts("2024-01-01 02:30"), 7),
    ])
    assert run() == [4]
    assert run() == [4]                                       # restart: nothing new
    # second batch continues from the stored membership state
    _write(spark, src, "p2", [("!b", "@z", "leave", _ts("2024-01-02 00:00"), 8),
                              ("!a", "@y", "join", _ts("2024-01-02 00:00"), 9),
                              ("!a", "@x", "leave", _ts("2024-01-02 01:00"), 10)])
    assert run() == [4, 8, 10]
    whole = spark.read.parquet(os.path.join(src, "*"))
    assert sorted(r.event_id for r in SP.abandoned_events(whole).collect()) == [4, 8, 10]
    # late events change what was emitted before: with w in the room, the leaves of 4 and 10 no longer leave one
    _write(spark, src, "p3", [("!c", "@q", "join", _ts("2024-01-03 00:00"), 11), ("!a", "@w", "join", _ts("2024-01-01 05:02"), 12),
                              ("!b", "@z", "leave", _ts("2024-01-01 03:00"), 13)])
    whole = spark.read.parquet(os.path.join(src, "*"))
    assert run() == sorted(r.event_id for r in SP.abandoned_events(whole).collect()) == [8, 13]


def test_any_order_equals_batch_and_writes_only_the_batch(spark):
    """Several micro-batches out of time order, with compactions between: equal to the batch twin, and what
    a batch writes does not grow with the history."""
    import random

    base = tempfile.mkdtemp(prefix="chatlake-t2-order-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    rnd = random.Random(5)
    t0 = pd.Timestamp("2024-01-01")
    rows = [(f"!r{rnd.randrange(6)}", f"@u{rnd.randrange(4)}", rnd.choice(["join", "join", "leave"]), (t0 + pd.Timedelta(minutes=rnd.randrange(600))).to_pydatetime(), i)
            for i in range(240)]
    sizes = []
    for k in range(6):
        _write(spark, src, f"p{k}", rows[40 * k:40 * k + 40])
        s = spark.readStream.schema(MEM).parquet(os.path.join(src, "*"))
        ST.run_available_now(s, out, foreach_batch=ST.abandoned_sink(out, every=3))
        store = ST.member_store(spark, out, every=3)
        if tail := store.batches():
            sizes.append(spark.read.parquet(f"{out}/members/tail/batch_id={tail[-1]}").count())
    got = sorted((r.event_id, r.members_after) for r in ST.read_abandoned(spark, out).collect())
    whole = spark.read.parquet(os.path.join(src, "*"))
    assert got == sorted((r.event_id, r.members_after) for r in SP.abandoned_events(whole).collect()) and got
    assert sizes and set(sizes) == {40} and len(store.batches()) < 3
