"""W3 media merge against a plain loop over random rooms, and the A6 cost
of list-form content."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlake.config import DEFAULT_CONFIG as CFG
from chatlake.functions import text as T
from chatlake.operators import context as C

SCHEMA = "room_id string, event_id string, sender string, kind string, body string, seq bigint"


def ref_prepare(rows):
    """Plain loop: text-like rows open a message; failed files open a system
    message; images and videos join the previous message of the same role,
    else open an empty one."""
    out = []
    for _, eid, sender, kind, body, seq in sorted(rows, key=lambda r: r[5]):
        role = "assistant" if sender == CFG.bot_id else "user"
        if kind in ("m.text", "m.notice") or kind == "m.audio" or (kind == "m.file" and body.endswith(".mp3")):
            out.append([role, ["text"]])
        elif kind == "m.file":
            out.append(["system", ["text"]])
        elif (kind == "m.image" and CFG.vision) or (kind == "m.video" and CFG.video):
            if out and out[-1][0] == role:
                out[-1][1].append("image_url")
            else:
                out.append([role, ["image_url"]])
    return out


KINDS = st.sampled_from(["m.text", "m.notice", "m.image", "m.video", "m.audio", "m.file", "m.member", "bot.x"])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), KINDS, st.booleans(), st.sampled_from(["a.mp3", "b.txt", "hi"])),
                min_size=1, max_size=60))
def test_media_merge_property(spark, events):
    rows = [(f"r{room}", f"$e{i}", CFG.bot_id if bot else "@u:x", kind, body, i)
            for i, (room, kind, bot, body) in enumerate(events)]
    pm = C.prepare_messages(spark.createDataFrame(rows, SCHEMA), CFG).collect()
    got = {}
    for m in sorted(pm, key=lambda m: (m.room_id, m.msg_seq)):
        got.setdefault(m.room_id, []).append([m.role, [p.type for p in m.parts]])
    rooms = {}
    for r in rows:
        rooms.setdefault(r[0], []).append(r)
    expect = {k: v for k, v in ((k, ref_prepare(rs)) for k, rs in rooms.items()) if v}
    assert got == expect


def test_parts_cost(spark):
    part = "struct<type:string,text:string,url:string>"
    df = spark.createDataFrame([(1, [("text", "abcdefgh", None), ("image_url", None, "u")]),
                                (2, [("image_url", None, "u"), ("text", "long text here", None)]),
                                (3, [])], f"i int, parts array<{part}>")
    got = [r.c for r in df.orderBy("i").select(T.parts_cost("parts").alias("c")).collect()]
    assert got == [3, 1, 1]
    assert [r.c for r in spark.range(1).select(T.system_cost(F.lit("")).alias("c")).collect()] == [0]
