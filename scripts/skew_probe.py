"""Skew probe: the main path on a skewed message table derived from the
given conversations.

Each conversation is repeated ``--repeat`` times (new conversation ids), and
a third of the conversations are put into one hot room.  The probe runs the
flagship query (history window → prepared messages → token budget) and
reads the stage metrics from Spark's event log, written to a fresh scratch
folder: rows shuffled per stage and the largest task input, which for the
window stage stays bounded by (map tasks × 2n) rows although the hot room
holds a third of all rows.

    python scripts/skew_probe.py --sf /root/testdata/sf0.1 --repeat 100
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chatlake.config import DEFAULT_CONFIG as CFG  # noqa: E402
from chatlake.functions import text as T  # noqa: E402
from chatlake.operators import access as A  # noqa: E402
from chatlake.operators import context as C  # noqa: E402
from chatlake.operators import settings as S  # noqa: E402
from chatlake.operators import spaces as SP  # noqa: E402
from chatlake.session import ship_package  # noqa: E402
from chatlake.sources import views as V  # noqa: E402
from chatlake.sources.tables import table  # noqa: E402


def skewed_messages(spark, sf, repeat):
    conv = table(spark, sf, "conversations")
    big = (conv.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
           .withColumn("conv_id", F.col("conv_id") * repeat + F.col("_r")).drop("_r"))
    m = V.messages_of(big)
    hot = (F.abs(F.hash(F.split("event_id", "-")[0])) % 3) == 0
    return m.withColumn("room_id", F.when(hot, F.lit("!hot:alpha.example")).otherwise(F.col("room_id")))


def skewed_members(spark, sf, repeat):
    """Membership events repeated ``repeat`` times (shifted by whole days),
    a third of them in one hot room."""
    ev = table(spark, sf, "events")
    big = (ev.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
           .withColumn("event_id", F.col("event_id") * repeat + F.col("_r"))
           .withColumn("ts", F.col("ts") + F.make_interval(days=F.col("_r").cast("int"))).drop("_r"))
    m = V.member_events_of(big)
    return m.withColumn("room_id", F.when(F.col("event_id") % 3 == 0, F.lit("!hot")).otherwise(F.col("room_id")))


def skewed_settings(spark, sf, repeat):
    """Settings writes repeated ``repeat`` times, a third in one hot room."""
    ev = table(spark, sf, "events")
    big = (ev.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
           .withColumn("event_id", F.col("event_id") * repeat + F.col("_r")).drop("_r"))
    s = V.settings_log_of(big)
    return s.withColumn("room_id", F.when(F.col("event_id") % 3 == 0, F.lit("!hot")).otherwise(F.col("room_id")))


def stage_metrics(log_dir):
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(f) and not os.path.basename(f).startswith((".", "appstatus"))
             and "ckpt" not in f]
    stages = {}
    for path in files:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                sid = ev["Stage ID"]
                s = stages.setdefault(sid, {"tasks": 0, "shuffle_read_records": 0, "max_task_read_records": 0,
                                            "shuffle_write_records": 0, "max_task_ms": 0})
                read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                write = (m.get("Shuffle Write Metrics") or {}).get("Shuffle Records Written", 0)
                s["tasks"] += 1
                s["shuffle_read_records"] += read
                s["shuffle_write_records"] += write
                s["max_task_read_records"] = max(s["max_task_read_records"], read)
                s["max_task_ms"] = max(s["max_task_ms"], ev["Task Info"]["Finish Time"] - ev["Task Info"]["Launch Time"])
    return stages


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--repeat", type=int, default=100)
    ap.add_argument("--cpus", type=int, default=8)
    ap.add_argument("--splits", type=int, default=16)
    ap.add_argument("--what", choices=["context", "membership", "settings", "access"], default="context")
    args = ap.parse_args()
    scratch = tempfile.mkdtemp(prefix="run-skew-")
    spark = (SparkSession.builder.master(f"local[{args.cpus}]").appName("skew-probe")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(args.cpus))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", scratch)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    # spread the derived table over several splits, as a large table would be
    if args.what == "context":
        msgs = skewed_messages(spark, args.sf, args.repeat).repartition(args.splits).cache()
        counts = msgs.groupBy((F.col("room_id") == "!hot:alpha.example").alias("hot")).count().collect()
        ctx = C.last_n_messages(msgs, CFG)
        pm = C.prepare_messages(ctx, CFG).withColumnRenamed("msg_seq", "seq")
        result = C.truncate_to_budget(pm.withColumn("cost", T.parts_cost("parts")), 1000,
                                      system_cost=T.system_cost(F.lit(CFG.default_system_message)))
    elif args.what == "membership":
        mem = skewed_members(spark, args.sf, args.repeat).repartition(args.splits).cache()
        counts = mem.groupBy((F.col("room_id") == "!hot").alias("hot")).count().collect()
        result = SP.abandoned_events(mem)
    elif args.what == "access":
        # allow list in a table, joined without broadcast (as when it is too
        # large to broadcast); the wildcard of one server matches a third of
        # all senders, so its key is hot in the semi join
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        msgs = skewed_messages(spark, args.sf, args.repeat).repartition(args.splits).cache()
        counts = msgs.groupBy(F.col("sender").endswith(":alpha.example").alias("hot")).count().collect()
        users = V.user_spaces(spark, args.sf).where("active").select("user_id")
        allow = users.unionByName(spark.range(1).select(F.lit("*:alpha.example").alias("user_id")))
        result, _ = A.split_allowed(msgs, allow, CFG)
    else:
        log = skewed_settings(spark, args.sf, args.repeat).repartition(args.splits).cache()
        counts = log.groupBy((F.col("room_id") == "!hot").alias("hot")).count().collect()
        result = S.room_profile(log.select("room_id").distinct(), log, CFG)
    t = time.perf_counter()
    result.write.format("noop").mode("overwrite").save()
    secs = time.perf_counter() - t
    spark.stop()
    stages = stage_metrics(scratch)
    print(json.dumps({"rows": {("hot" if r.hot else "other"): r["count"] for r in counts},
                      "flagship_sec": round(secs, 2), "n": CFG.max_messages, "stages": stages}))


if __name__ == "__main__":
    main()
