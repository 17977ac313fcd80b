"""The log-structured store: replays, crashes after each step, bounded reads."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from chatlake.streaming.logstore import LogStore, hashed_part

SCHEMA = "k bigint, n bigint"


def added(d):
    return d.groupBy("k").agg(F.sum("n").alias("n"))


def store(spark, path, every=3):
    return LogStore(spark, path, SCHEMA, added, hashed_part("k"), every)


def rows(spark, b):
    return spark.createDataFrame([(k, 1) for k in range(b, b + 4)], SCHEMA)


def totals(s):
    return {r.k: r.n for r in s.current().collect()}


def want(n):
    out = {}
    for b in range(n):
        for k in range(b, b + 4):
            out[k] = out.get(k, 0) + 1
    return out


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["append", "_write_base", "_commit", "_clean"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_crash_around_each_step(spark, monkeypatch, step, when):
    path = tempfile.mkdtemp(prefix="chatlake-log-")
    s = store(spark, path)
    for b in range(2):
        s.appended(rows(spark, b), b)

    def broken(self, *a, real=getattr(LogStore, step), **k):
        if when == "after":
            real(self, *a, **k)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(LogStore, step, broken)
        with pytest.raises(Crash):
            store(spark, path).appended(rows(spark, 2), 2)
    again = store(spark, path)
    assert totals(again) in (want(2), want(3))
    again.appended(rows(spark, 2), 2)                           # the batch is delivered again
    assert totals(again) == want(3)
    for b in range(3, 9):
        again.appended(rows(spark, b), b)
        again.appended(rows(spark, b), b)                       # and every later one twice
    assert totals(again) == want(9)


def test_reads_touch_base_and_bounded_tail(spark):
    path = tempfile.mkdtemp(prefix="chatlake-log-")
    s = store(spark, path, every=2)
    assert s.current().count() == 0 and s.manifest()["upto"] == -1
    for b in range(9):
        s.appended(rows(spark, b), b)
        assert len(s.batches()) < 2
    files = [f for f in s.read().inputFiles()]
    assert all("/base/" in f or "batch_id=8" in f for f in files)
    assert len(os.listdir(f"{path}/base")) <= 2 and len(os.listdir(f"{path}/tail")) <= 4
    assert totals(s) == want(9)
    part = spark.range(1).select(hashed_part(F.lit(5).cast("bigint"))).first()[0]
    some = s.read(parts=[part])
    assert {r.k for r in some.collect()} >= {5} and some.count() < s.read().count()


def test_second_writer_is_refused(spark):
    path = tempfile.mkdtemp(prefix="chatlake-log-")
    s = store(spark, path)
    s.append(rows(spark, 0), 0)
    s.compact()
    with pytest.raises(RuntimeError):
        s._commit({"version": 1, "base": "base/other", "upto": 9})
    assert s.manifest()["upto"] == 0
