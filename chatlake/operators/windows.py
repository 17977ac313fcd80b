"""Skew-tolerant ordered windows.

A window partitioned by a key sorts every row of that key in one task; if
one key holds a large share of all rows, that task holds them all.  The
helpers here split each key by a time bucket, do the ordered work inside
``(key, bucket)`` partitions, and carry what crosses bucket borders through
a small table with one row per ``(key, bucket)``.  The carried table is
ordered per key by bucket only, so its size is bounded by the number of
buckets, not by the number of rows.

The small tables are aggregations of the *input* rows (partial aggregation
before their shuffle), never of the windowed rows: a join of the windowed
rows with a table derived from those same rows would make Spark compute the
row-level window twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR = "yyyy-MM-dd HH"
DAY = "yyyy-MM-dd"
_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch without the session time zone
    (wall-clock for TIMESTAMP_NTZ, instant for TIMESTAMP)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{ts}`)")
    return F.unix_micros(F.col(ts))


def ordering(df: DataFrame, order: list[str]) -> Column:
    """Sort key for ``max_by``/``min_by``.  ``(timestamp, integer id)`` is
    packed into one DECIMAL(38,0) — micros × 10^20 + (id + 2^63) keeps the
    order —
    so an aggregate whose value is fixed-width runs as a hash aggregate (a
    struct key forces a sort-based one).  Other orders use a struct."""
    if len(order) == 2:
        t0, t1 = (df.schema[c].dataType for c in order)
        if isinstance(t0, (T.TimestampType, T.TimestampNTZType)) and isinstance(t1, (T.LongType, T.IntegerType)):
            big = "decimal(38,0)"
            # id + 2^63 lies in [0, 2^64) < 10^20, so any long id keeps its order
            return (epoch_micros(df, order[0]).cast(big) * F.lit(Decimal(10 ** 20)).cast(big)
                    + F.col(order[1]).cast(big) + F.lit(Decimal(2 ** 63)).cast(big))
    return F.struct(*[F.col(c) for c in order])


def time_bucket(ts: str = "ts", fmt: str = HOUR) -> Column:
    """A sortable bucket label of the timestamp (wall-clock text, so the
    label order follows the timestamp order)."""
    return F.date_format(F.col(ts), fmt)


def bucket_carry(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Per ``(keys, bucket)``: the bucket's last ``value`` (``_last``) and the
    last value of the nearest earlier bucket of the same key (``_carry``)."""
    last = df.groupBy(*keys, bucket).agg(F.max_by(F.col(value), ordering(df, order)).alias("_last"))
    return last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)))


def bucketed_lag(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str,
                 out: str = "prev", carry: DataFrame | None = None) -> DataFrame:
    """``lag(value)`` per ``keys`` in ``order``.

    Inside each ``(keys, bucket)`` the previous row is a plain lag; the
    first row of a bucket takes the last value of the nearest earlier
    bucket of the same key (``carry``, from ``bucket_carry``)."""
    part = keys + [bucket]
    carry = carry if carry is not None else bucket_carry(df, keys, bucket, order, value)
    w = Window.partitionBy(*part).orderBy(*order)
    local = df.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return (local.join(carry.select(*part, "_carry"), part, "left")
            .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_lag", "_first", "_carry"))


def running_total(df: DataFrame, key: str, value: str, bucket: str, order: list[str],
                  out: str = "running", totals: DataFrame | None = None) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``order``: a running sum
    inside each ``(key, bucket)`` plus the total of all earlier buckets of
    the key.  ``totals(key, bucket, _bt)`` may be supplied when the bucket
    totals are known from a smaller table."""
    if totals is None:
        totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_bt"))
    inner = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_local", F.sum(value).over(inner))
    prior = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_bt").over(prior), F.lit(0))).drop("_bt")
    return (local.join(offsets, [key, bucket], "inner")
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_off", "_local"))
