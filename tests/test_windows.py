"""The skew-tolerant window helpers equal plain windows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators import windows as W


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 9), st.integers(-3, 3)),
                min_size=1, max_size=80))
def test_bucketed_lag_and_running_total(spark, rows):
    data = [(f"k{k}", f"u{u}", b, i, v) for i, (k, u, b, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, u string, b int, seq int, v int")
    # order by (b, seq): buckets are ordered and rows inside follow seq
    lag = W.bucketed_lag(df, ["k", "u"], "b", ["b", "seq"], "v", out="p")
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k", "u").orderBy("b", "seq")))
    assert sorted(lag.select("seq", "p").collect()) == sorted(plain.select("seq", "p").collect())
    run = W.running_total(df, "k", "v", "b", ["b", "seq"], out="r")
    plain_r = df.withColumn("r", F.sum("v").over(Window.partitionBy("k").orderBy("b", "seq")
                                                 .rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(run.select("seq", "r").collect()) == sorted(plain_r.select("seq", "r").collect())
