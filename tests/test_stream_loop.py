"""The continuous loop and the final catch-up share one checkpoint."""

import os
import tempfile

from chatlake.streaming import streams as ST

SCHEMA = "event_id bigint, v string"


def test_loop_then_final_catch_up(spark):
    base = tempfile.mkdtemp(prefix="chatlake-loop-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).write.parquet(os.path.join(src, "p1"))
    q = ST.run_continuously(spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "*")), out, "1 second")
    q.processAllAvailable()
    q.stop()
    spark.createDataFrame([(3, "c")], SCHEMA).write.parquet(os.path.join(src, "p2"))
    ST.run_available_now(spark.readStream.schema(SCHEMA).parquet(os.path.join(src, "*")), out)
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/data").collect()) == [1, 2, 3]
