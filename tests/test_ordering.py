"""The packed (timestamp, id) ordering key sorts like the pair."""

import datetime as dt

from pyspark.sql import functions as F

from chatlake.operators import windows as W


def test_packed_ordering_matches_pair(spark):
    base = dt.datetime(2024, 3, 10, 1, 59, 59)
    rows = [(base + dt.timedelta(microseconds=m), i) for m, i in
            [(0, 5), (0, 3), (1, 0), (3_600_000_000, 1), (-1, 9_000_000_000_000_000_000), (7, 2),
             (0, -4), (0, -9_223_372_036_854_775_808), (1, 9_223_372_036_854_775_807)]]
    for typ in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, f"ts {typ}, id bigint")
        key = W.ordering(df, ["ts", "id"])
        assert df.select(key.alias("k")).schema["k"].dataType.simpleString() == "decimal(38,0)"
        by_key = [(r.ts, r.id) for r in df.orderBy(key).collect()]
        by_pair = [(r.ts, r.id) for r in df.orderBy("ts", "id").collect()]
        assert by_key == by_pair
    other = spark.createDataFrame([(1, "a")], "b int, s string")
    assert "struct" in other.select(W.ordering(other, ["b", "s"]).alias("k")).schema["k"].dataType.simpleString()
    plan = other.groupBy("s").agg(F.max_by("b", W.ordering(other, ["b", "s"]))).schema
    assert plan is not None
