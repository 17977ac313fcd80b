"""Context window (W1), token budget (W2) and media merge (W3): edge rows
and property tests against small pure-Python loops written from the
operator descriptions."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlake.config import DEFAULT_CONFIG as CFG
from chatlake.functions import text as T
from chatlake.operators import context as C

SCHEMA = "room_id string, event_id string, sender string, kind string, body string, seq bigint"
MEDIA = {"m.image", "m.audio", "m.file", "m.video"}


def belongs(row, ignore_notices):
    """May this message stand in a context at all?"""
    kind, body = row[3] or "", row[4] or ""
    custom_call = body.split()[1:2] == ["custom"]
    return any((kind.startswith(CFG.custom_kind_prefix), kind in MEDIA, kind == "m.notice" and not ignore_notices,
                kind == "m.text" and (custom_call or not body.startswith("!"))))


def ref_last_n(rows, n, ignore_notices=True):
    """W1 as a set: of the 2n newest messages those after the newest marker that
    belong, and of these the n newest."""
    seqs = sorted((r[5] for r in rows), reverse=True)
    oldest = min(seqs[:2 * n], default=0)
    marks = [r[5] for r in rows if r[3] == "m.text" and (r[4] or "").split() == [CFG.prefix, "ignoreolder"] and r[5] >= oldest]
    fit = [r for r in rows if r[5] >= oldest and r[5] > max(marks, default=-1) and belongs(r, ignore_notices)]
    return [r for r in fit if sum(x[5] >= r[5] for x in fit) <= n]


def cost(body):
    return math.ceil(len(body) / 4) + 1


def ref_truncate(msgs, budget, sys_cost):
    """W2 as the longest prefix of (oldest, newest, second newest, ...) that fits."""
    order = msgs[:1] + msgs[:0:-1]
    fitting = [k for k in range(len(order) + 1) if sys_cost + sum(cost(m[4]) for m in order[:k]) <= budget]
    return order[:max(fitting, default=0)]


def run_w1(spark, rows, n, ignore_notices=True):
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.last_n_messages(df, CFG, n=n, ignore_notices=ignore_notices).select("room_id", "event_id").collect()
    return sorted((r.room_id, r.event_id) for r in out)


def expect_w1(rows, n, ignore_notices=True):
    rooms = {}
    for r in rows:
        rooms.setdefault(r[0], []).append(r)
    return sorted((r[0], r[1]) for rs in rooms.values() for r in ref_last_n(rs, n, ignore_notices))


def msg(room, i, kind="m.text", body="hello", sender="@u:x"):
    return (room, f"${room}-{i}", sender, kind, body, i)


# ------------------------------------------------------------------ W1 edges


def test_w1_edges(spark):
    rows = (
        # only a marker
        [msg("a", 1, body="!bot ignoreolder")]
        # marker newer than all others
        + [msg("b", 1), msg("b", 2), msg("b", 3, body="!bot  ignoreolder")]
        # marker beyond the 2n page (n=2 → page of 4)
        + [msg("c", 1, body="!bot ignoreolder")] + [msg("c", i) for i in range(2, 8)]
        # marker with an extra word is not a marker
        + [msg("d", 1), msg("d", 2, body="!bot ignoreolder now"), msg("d", 3)]
        # custom kinds take slots; lone "!" is dropped
        + [msg("e", 1), msg("e", 2, kind="bot.tool_result", body="r"), msg("e", 3, body="!"),
           msg("e", 4, kind="bot.x", body="y")]
        # unknown kinds use a page slot but are never kept
        + [msg("f", 1), msg("f", 2, kind=None, body=None), msg("f", 3, kind=None, body=None),
           msg("f", 4, kind=None, body=None), msg("f", 5, kind=None, body=None)]
        # second token custom is kept whatever the prefix
        + [msg("g", 1, body="!x custom hi"), msg("g", 2, body="!bot space enable")]
    )
    assert run_w1(spark, rows, 2) == expect_w1(rows, 2)
    got = dict.fromkeys(r for r, _ in run_w1(spark, rows, 2))
    assert "a" not in got and "b" not in got
    assert run_w1(spark, rows, 2) and ("c", "$c-7") in run_w1(spark, rows, 2)


def test_w1_notices_and_exact_n(spark):
    rows = [msg("r", i, kind="m.notice" if i % 2 else "m.text") for i in range(1, 9)]
    for ign in (True, False):
        for n in (1, 3, 4):
            assert run_w1(spark, rows, n, ign) == expect_w1(rows, n, ign)


def test_w1_empty_room(spark):
    assert run_w1(spark, [], 3) == []


BODIES = st.sampled_from(["hi", "!bot ignoreolder", "!bot  ignoreolder", "!bot custom x", "!other y",
                          "* !bot chat z", "!", "plain words here", "!bot ignoreolder now", ""])
KINDS = st.sampled_from(["m.text", "m.text", "m.text", "m.notice", "m.image", "m.file", "bot.tool_result",
                         "m.member", None])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 7), KINDS, BODIES), min_size=1, max_size=120), st.integers(1, 6),
       st.booleans())
def test_w1_property(spark, events, n, ign):
    rows = [(f"r{room}", f"$e{i}", "@u:x", kind, body if kind else None, i) for i, (room, kind, body) in enumerate(events)]
    assert run_w1(spark, rows, n, ign) == expect_w1(rows, n, ign)


# ------------------------------------------------------------------ W2


def run_w2(spark, rows, budget, system="You are a helpful assistant."):
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.truncate_to_budget(df.withColumn("cost", T.message_cost("body")), budget,
                               system_cost=T.system_cost(F.lit(system)))
    return sorted((r.room_id, r.event_id) for r in out.collect())


def expect_w2(rows, budget, system="You are a helpful assistant."):
    sys_cost = 0 if not system else cost(system)
    rooms = {}
    for r in rows:
        rooms.setdefault(r[0], []).append(r)
    out = []
    for rs in rooms.values():
        out += [(m[0], m[1]) for m in ref_truncate(sorted(rs, key=lambda r: r[5]), budget, sys_cost)]
    return sorted(out)


def test_w2_edges(spark):
    sys = "abcd"  # cost 2
    rows = (
        # equal to budget is kept: 2 + 2 + 2 + 2 = 8
        [msg("eq", 1, body="abcd"), msg("eq", 2, body="abcd"), msg("eq", 3, body="abcd")]
        # small message older than an overflowing one must be dropped
        + [msg("ov", 1, body="a"), msg("ov", 2, body="a"), msg("ov", 3, body="x" * 40), msg("ov", 4, body="a")]
        # pin alone overflows
        + [msg("pin", 1, body="x" * 100), msg("pin", 2, body="a")]
        # one message only
        + [msg("one", 1, body="abc")]
    )
    assert run_w2(spark, rows, 8, sys) == expect_w2(rows, 8, sys)
    got = run_w2(spark, rows, 8, sys)
    assert ("eq", "$eq-1") in got and ("eq", "$eq-3") in got
    assert ("ov", "$ov-2") not in got and ("ov", "$ov-4") in got
    assert not [g for g in got if g[0] == "pin"]
    # system alone overflows → nothing; empty system costs 0
    assert run_w2(spark, rows, 3, "x" * 40) == []
    assert run_w2(spark, rows, 8, "") == expect_w2(rows, 8, "")


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="ab ", max_size=30)), min_size=1, max_size=60),
       st.integers(1, 40))
def test_w2_property(spark, msgs, budget):
    rows = [(f"r{room}", f"$e{i}", "@u:x", "m.text", body, i) for i, (room, body) in enumerate(msgs)]
    assert run_w2(spark, rows, budget, "sys") == expect_w2(rows, budget, "sys")


# ------------------------------------------------------------------ W3


def test_w3_media_merge(spark):
    bot = CFG.bot_id
    rows = [
        msg("a", 1, kind="m.image", body="first.png"),           # media first in room → own message
        msg("a", 2, body="text by user"),
        msg("a", 3, kind="m.image", body="p.png"),               # same role → appended
        msg("a", 4, kind="m.image", body="q.png"),               # two media in a row → appended
        msg("a", 5, kind="m.image", body="r.png", sender=bot),   # other role → new message
        msg("a", 6, body="bot text", sender=bot),
        msg("a", 7, kind="m.member", body="x", sender=bot),      # dropped kind in between
        msg("a", 8, kind="m.image", body="s.png", sender=bot),   # joins the bot text
        msg("a", 9, kind="m.file", body="notes.txt"),            # no bytes → system row
        msg("a", 10, kind="m.audio", body="voice.mp3"),
    ]
    pm = C.prepare_messages(spark.createDataFrame(rows, SCHEMA), CFG).orderBy("msg_seq").collect()
    shape = [(m.msg_seq, m.role, [p.type for p in m.parts]) for m in pm]
    assert shape == [
        (1, "user", ["image_url"]),
        (2, "user", ["text", "image_url", "image_url"]),
        (5, "assistant", ["image_url"]),
        (6, "assistant", ["text", "image_url"]),
        (9, "system", ["text"]),
        (10, "user", ["text"]),
    ]


def test_w3_attachments(spark):
    rows = [msg("a", 1, body="hi"), msg("a", 2, kind="m.image", body="p.png"),
            msg("a", 3, kind="m.file", body="ok.txt"), msg("a", 4, kind="m.file", body="bad.bin"),
            msg("a", 5, kind="m.file", body="empty.txt"), msg("a", 6, kind="m.image", body="lost.png")]
    att = spark.createDataFrame([("$a-2", bytearray(b"\x89PNG"), "image/png"), ("$a-3", bytearray(b"hello"), "text/plain"),
                                 ("$a-4", bytearray(b"a\xff"), "application/octet-stream"),
                                 ("$a-5", bytearray(b""), "text/plain")],
                                "event_id string, content binary, mimetype string")
    pm = C.prepare_messages(spark.createDataFrame(rows, SCHEMA), CFG, att).orderBy("msg_seq").collect()
    got = [(m.msg_seq, m.role, [(p.type, p.text, p.url) for p in m.parts]) for m in pm]
    assert got == [
        (1, "user", [("text", "hi", None), ("image_url", None, "data:image/png;base64,iVBORw==")]),
        (3, "user", [("text", "hello", None)]),
        (6, "system", [("text", "lost.png", None)]),
    ]


# ------------------------------------------------------------------ U1/U2/P17-P19


def test_splice_round_edges(spark):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(room_id="a", k=1), Row(room_id="b", k=3)])
    msgs = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.struct(
        i.cast("bigint").alias("seq"), F.lit("user").alias("role"), i.cast("string").alias("content"),
        F.lit(None).cast("string").alias("tool_call_id")))
    choice = F.struct(F.lit(None).cast("bigint").alias("seq"), F.lit("assistant").alias("role"),
                      F.lit("c").alias("content"), F.lit(None).cast("string").alias("tool_call_id"))
    out = df.select("room_id", C.splice_round(msgs, choice, F.array().cast("array<" + C.MSG + ">")).alias("m"))
    got = {r.room_id: [x.content for x in r.m] for r in out.collect()}
    assert got == {"a": ["c", "1"], "b": ["1", "2", "c", "3"]}


def test_tool_role_rewrite(spark):
    df = spark.createDataFrame([("a",)], "room_id string")
    arr = F.array(F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit("tool").alias("role"),
                           F.lit("r").alias("content"), F.lit("$1").alias("tool_call_id")),
                  F.lit(None).cast(C.MSG))
    out = df.select(C.rewrite_tool_roles(arr).alias("m")).collect()[0].m
    assert [(m.role, m.content) for m in out] == [("system", "r")]
    assert "tool_call_id" not in out[0].asDict()
