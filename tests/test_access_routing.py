"""Edge rows for access control, routing, command parsing and settings."""

from pyspark.sql import functions as F

from chatlake.config import DEFAULT_CONFIG as CFG
from chatlake.operators import access as A
from chatlake.operators import routing as R
from chatlake.operators import settings as S
from chatlake.operators import spaces as SP


def py_allowed(uid, allow):
    """Scalar predicate written from the allow-list rule."""
    if not allow:
        return True
    if uid in allow:
        return True
    if uid.startswith("!"):
        return False
    parts = uid.split(":")
    if len(parts) < 2:
        return False
    return f"*:{parts[1]}" in allow or f"@*:{parts[1]}" in allow


def test_allow_list_edges(spark):
    ids = ["@a:x.org", "@b:y.org", "@c:z.org:8448", "!room:x.org", "!other:y.org", "nocolon", "@d:w.org"]
    lists = [[], ["@a:x.org"], ["*:y.org"], ["@*:z.org"], ["!room:x.org"], ["*:x.org"], ["nocolon"]]
    df = spark.createDataFrame([(i,) for i in ids], "uid string")
    for allow in lists:
        got = {r.uid: r.ok for r in df.select("uid", A.id_allowed("uid", A.allow_array(allow)).alias("ok")).collect()}
        assert got == {i: py_allowed(i, allow) for i in ids}, allow


def test_allow_table_matches_literal(spark):
    msgs = spark.createDataFrame(
        [("!r1:x.org", "$1", "@a:x.org"), ("!r2:y.org", "$2", "@b:y.org"), ("!r3:z.org", "$3", "@c:q.org"),
         ("!r4:z.org", "$4", "@bot:alpha.example")],
        "room_id string, event_id string, sender string")
    allow = ["@a:x.org", "!r3:z.org"]
    lit_ok, lit_no = A.split_allowed(msgs, allow, CFG)
    tab_ok, tab_no = A.split_allowed(msgs, spark.createDataFrame([(a,) for a in allow], "user_id string"), CFG)
    ids = lambda d: sorted(r.event_id for r in d.select("event_id").collect())
    assert ids(lit_ok) == ids(tab_ok) == ["$1", "$3"]
    assert ids(lit_no) == ids(tab_no) == ["$2"]
    empty_ok, empty_no = A.split_allowed(msgs, spark.createDataFrame([], "user_id string"), CFG)
    assert ids(empty_ok) == ["$1", "$2", "$3"] and ids(empty_no) == []
    from chatlake.plans.planinfo import plan_text

    for df in (tab_ok, tab_no, lit_ok):
        plan = plan_text(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parse_allow_list(spark):
    df = spark.createDataFrame([('["@a:x", "*:y"]',), ("not json",), ("",), (None,)], "s string")
    got = [r.a for r in df.select(A.parse_allow_list("s").alias("a")).collect()]
    assert got == [["@a:x", "*:y"], [], [], []]
    closed = [r.a for r in df.select(A.parse_allow_list("s", fail_open=False).alias("a")).collect()]
    assert closed == [["@a:x", "*:y"], None, None, None]


def test_route_and_parse(spark):
    bodies = ["!bot", "!botx help", "* !bot help", "*!bot help", "!other", "hello", "!bot\thelp  me   now",
              "  !bot x"]
    df = spark.createDataFrame([(b, "@u:x") for b in bodies] + [("!bot help", CFG.bot_id)], "body string, sender string")
    out = R.parse_command(df.withColumn("route", R.route(cfg=CFG))).collect()
    got = [(r.body, r.route, r.command, r.args) for r in out]
    assert got == [
        ("!bot", "command", None, None),
        ("!botx help", "command", "help", None),       # plain prefix test, no word boundary
        ("* !bot help", "command", "help", None),
        ("*!bot help", "query", "help", None),
        ("!other", "foreign", None, None),
        ("hello", "query", None, None),
        ("!bot\thelp  me   now", "command", "help", "me now"),
        ("  !bot x", "query", "x", None),
        ("!bot help", "ignore", "help", None),
    ]


def test_calculate_and_image_flags(spark):
    df = spark.createDataFrame([("!bot calculate --text 1 --text + 2",), ("!bot calculate 2 --details",),
                                ("!bot calculate --text --details",), ("!bot calculate",)], "body string")
    got = [(r.text, r.results_only, r.prompt, r.status) for r in R.calculate_flags(df).collect()]
    assert got == [(True, True, "1 --text + 2", "ok"), (False, False, "2", "ok"),
                   (True, False, "", "need_prompt"), (False, True, "", "need_prompt")]
    img = spark.createDataFrame([("--portrait a cat", None), ("--landscape sea", None), ("a --portrait", None),
                                 ("--landscape x", "portrait"), ("--portrait y", "landscape"), ("", None)],
                                "p string, o string")
    got = [(r.size, r.image_prompt) for r in R.image_flags(img, "p", F.col("o"), CFG).collect()]
    assert got == [("1024x1792", "a cat"), ("1792x1024", "sea"), ("1024x1024", "a --portrait"),
                   ("1024x1792", "--landscape x"), ("1024x1792", "y"), ("1024x1024", "")]


def test_settings_validation(spark):
    bodies = ["!bot roomsettings classification TRUE", "!bot roomsettings timing yes", "!bot roomsettings systemmessage",
              "!bot roomsettings systemmessage Be  brief", "!bot roomsettings model gpt-4", "!bot roomsettings",
              "!bot roomsettings always_reply false"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [(r.setting, r.value, r.status) for r in S.validate_commands(df, cfg=CFG).collect()]
    assert got == [("use_classification", "1", "store"), ("use_timing", None, "invalid_boolean"),
                   ("system_message", None, "read"), ("system_message", "Be brief", "store"),
                   ("model", None, "unknown"), (None, None, "unknown"), ("always_reply", "0", "store")]
    allowed = S.validate_commands(df, cfg=CFG.with_(allow_model_override=True)).collect()
    assert (allowed[4].setting, allowed[4].value, allowed[4].status) == ("model", "gpt-4", "store")


def test_text_bool_and_system_message(spark):
    df = spark.createDataFrame([("1",), ("0",), ("2",), ("x",), (None,)], "v string")
    assert [r.b for r in df.select(S.text_bool("v").alias("b")).collect()] == [True, False, True, None, None]
    sm = spark.createDataFrame([(None,), ("Be terse",), ("  spaced \n",)], "v string")
    got = [r.s for r in sm.select(S.resolve_system_message("v", CFG).alias("s")).collect()]
    assert got == [CFG.default_system_message, "Be terse", "spaced"]
    forced = [r.s for r in sm.select(S.resolve_system_message("v", CFG.with_(force_system_message=True)).alias("s")).collect()]
    assert forced == [CFG.default_system_message, CFG.default_system_message + "\n\nBe terse",
                      CFG.default_system_message + "\n\n  spaced"]


def test_latest_per_key_ties_and_upsert(spark):
    log = spark.createDataFrame(
        [("r", "tts", "1", "2024-01-01 00:00:00", 1), ("r", "tts", "0", "2024-01-01 00:00:00", 2),
         ("r", "model", None, "2024-01-02 00:00:00", 3), ("s", "tts", "1", "2024-01-01 00:00:00", 4)],
        "room_id string, setting string, value string, ts string, event_id bigint").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.room_id, r.setting): r.value for r in S.latest_per_key(log, ["room_id", "setting"], ["value"]).collect()}
    assert got == {("r", "tts"): "0", ("r", "model"): None, ("s", "tts"): "1"}
    changes = spark.createDataFrame([("r", "tts", "1", "2024-02-01 00:00:00", 9)],
                                    "room_id string, setting string, value string, ts string, event_id bigint") \
        .withColumn("ts", F.to_timestamp("ts"))
    up = {(r.room_id, r.setting): r.value for r in S.upsert(log, changes).collect()}
    assert up[("r", "tts")] == "1" and up[("s", "tts")] == "1"


def test_space_status_and_disable(spark):
    spaces = spark.createDataFrame([("!s1", "@a", True), ("!s2", "@b", False), ("!s3", "@c", True), ("!s0", "@c", False)],
                                   "space_id string, user_id string, active boolean")
    users = spark.createDataFrame([("@a",), ("@b",), ("@c",), ("@d",)], "user_id string")
    got = {r.user_id: (r.status, r.invite_space) for r in SP.space_status(users, spaces).collect()}
    assert got == {"@a": ("enabled", "!s1"), "@b": ("disabled", "!s2"), "@c": ("disabled", "!s0"), "@d": ("none", None)}
    act = {r.user_id: r.space_id for r in SP.active_space(users, spaces).collect()}
    assert act == {"@a": "!s1", "@b": None, "@c": "!s3", "@d": None}
    off = {r.space_id: r.active for r in SP.deactivate_users(spaces, users.where("user_id = '@c'")).collect()}
    assert off == {"!s1": True, "!s2": False, "!s3": False, "!s0": False}
    ins = SP.insert_spaces(spaces, spark.createDataFrame([("!s9", "@d")], "space_id string, user_id string"))
    assert ins.where("space_id = '!s9'").collect()[0].active is True


def test_space_edges_self_pair(spark):
    pairs = spark.createDataFrame([("!sp:a.org", "!r:b.org"), ("!same:a.org", "!same:a.org")], "space_id string, room_id string")
    got = sorted((r.src, r.dst, r.type, tuple(r.via), r.canonical) for r in SP.space_edges(pairs).collect())
    assert got == [("!r:b.org", "!sp:a.org", "m.room.parent", ("a.org", "b.org"), True),
                   ("!sp:a.org", "!r:b.org", "m.space.child", ("b.org", "a.org"), None)]


def test_deny_notice_only_in_two_member_rooms(spark):
    msgs = spark.createDataFrame([("!dm:x", "$1", "@a:x"), ("!big:x", "$2", "@b:x"), ("!none:x", "$3", "@c:x")],
                                 "room_id string, event_id string, sender string")
    members = spark.createDataFrame([("!dm:x", 2), ("!big:x", 5)], "room_id string, members int")
    _, denied = A.split_allowed(msgs, ["@z:q"], CFG)
    got = {r.room_id: (r.members, r.notice, r.notice_body is not None) for r in A.deny_notices(denied, members, CFG).collect()}
    assert got == {"!dm:x": (2, True, True), "!big:x": (5, False, False), "!none:x": (0, False, False)}
