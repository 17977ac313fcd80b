"""The main prompt path: attachments, statuses, plan shape; typed rejects; allow lists; calculations; catalogue."""

import re
import time

import pytest
from pyspark.sql import functions as F

from chatlake.config import DEFAULT_CONFIG as CFG
from chatlake.functions import decode as D
from chatlake.functions import html as H
from chatlake.functions import payloads as P
from chatlake.operators import access as A
from chatlake.operators import context as C
from chatlake.operators import evolve as E
from chatlake.operators import prompt as PR
from chatlake.operators import settings as S
from chatlake.operators import toolcalls as TC
from chatlake.plans import q_context as QC

EVENTS = "room_id string, event_id string, sender string, type string, content string, membership string, body string, seq bigint"
FILES = "event_id string, content binary, mimetype string"
LOG = "room_id string, setting string, value string, ts timestamp, event_id bigint"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def path(spark, events, files=(), log=()):
    e = spark.createDataFrame([(*r, i) for i, r in enumerate(events)], EVENTS)
    f = spark.createDataFrame(list(files), FILES)
    return PR.budgeted_messages(e, f, spark.createDataFrame(list(log), LOG), CFG), f


def test_statuses_of_a_registered_query(spark, sf_dir):
    seen = {r.status for r in QC.QUERIES["prompt_status"](spark, sf_dir).select("status").distinct().collect()}
    assert {"ok", "system_too_long", "pinned_overflow"} <= seen


def test_attachments(spark):
    kinds = [("m.text", "hello"), ("m.image", "a.png"), ("m.file", "ok.txt"), ("m.file", "broken.txt"), ("m.file", "empty.txt"), ("m.file", "gone.txt"),
             ("m.image", "gone.png"), ("m.audio", "a.mp3"), ("m.file", "b.mp3"), ("m.image", "b.png"), ("m.text", "last")]
    events = [("!a", f"$e{i}", "@x:s", k if i % 2 else None, f'{{"msgtype":"{k}"}}', None, b) for i, (k, b) in enumerate(kinds)]
    files = [("$e1", b"\x89PNG", "image/png"), ("$e2", "text é".encode(), "text/plain"), ("$e3", b"a\xff", "text/plain"), ("$e4", b"", "text/plain"), ("$e9", b"img", "image/png"),
             ("$other", b"x" * 100, "image/png"), (None, b"y", "image/png")]
    msgs, f = path(spark, events, files, [("!a", "system_message", "be nice", None, 1)])
    got = sorted((r.pos, r.part_pos, r.role, r.text, r.url) for r in PR.prompt_parts(msgs, f, 3999).collect())
    assert got == [
        (1, 1, "system", "be nice", None), (2, 1, "user", "hello", None), (2, 2, "user", None, "data:image/png;base64,iVBORw=="), (3, 1, "user", "text é", None),
        (4, 1, "system", "gone.txt", None), (5, 1, "system", "gone.png", None), (6, 1, "user", "a.mp3", None), (7, 1, "user", "b.mp3", None),
        (7, 2, "user", None, "data:image/png;base64,aW1n"), (8, 1, "user", "last", None)]


def test_status_edges(spark):
    events = [("!empty", "$m", "@x:s", "m.member", None, "join", None), ("!one", "$o", "@x:s", "m.text", None, None, "x" * 40),
              ("!two", "$t1", "@x:s", "m.text", None, None, "x" * 40), ("!two", "$t2", "@x:s", "m.text", None, None, "!bot something"),
              ("!sys", "$s", "@x:s", "m.text", None, None, "hi")]
    msgs, f = path(spark, events, log=[("!sys", "system_message", "y" * 400, None, 1)])
    base = -(-len(CFG.default_system_message) // 4) + 1
    got = {(r.room_id, r.max_tokens): (r.status, r.n_kept, r.tokens) for r in PR.prompt_status(msgs, [base - 1, base, base + 11, base + 16]).collect()}
    assert got["!empty", base] == ("no_messages", 0, 0) and got["!empty", base - 1][0] == "system_too_long"
    assert got["!one", base] == ("pinned_overflow", 0, 0) and got["!one", base + 11] == ("ok", 1, base + 11)
    assert got["!two", base + 11] == ("ok", 1, base + 11) and got["!two", base + 16] == ("ok", 2, base + 16)
    assert got["!sys", base + 16][0] == "system_too_long"
    assert {r.room_id for r in PR.prompt_parts(msgs, f, base + 11).collect()} == {"!one", "!two"}


def test_bytes_cross_one_exchange(spark, sf_dir):
    msgs, f = QC._full(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(PR.prompt_parts(msgs, f, 3999))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = p.split("== Initial Plan ==")[-1]
    # the column of bytes is produced by one scan's projection and sorted once below its join; the facts carry a length instead
    assert len(re.findall(r"ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>", p)) <= 2
    exchanges = [line for line in tree.splitlines() if "Exchange hashpartitioning(_event" in line]
    assert len(exchanges) == 2                                  # facts and bytes, each once
    assert tree.count("Project [concat($, cast(conv_id") + tree.count("AS content#") >= 1


def test_history_limit_moves_few_rows(spark):
    """A split sends a room's newest rows only, whatever the number of splits."""
    d = spark.range(0, 20_000, 1, 64).selectExpr("if(id < 5, '!cold', '!hot') AS room_id", "concat('$', id) AS event_id", "id AS seq")
    top = C.newest_raw(d, 60)
    assert [r.seq for r in top.where("room_id = '!hot'").orderBy("raw_rank").collect()] == list(range(19_999, 19_939, -1))
    assert plan(top).count("WindowGroupLimit") >= 3
    from pyspark.sql import Window

    part = Window.partitionBy("room_id", "_salt").orderBy(F.desc("seq"))
    salted = d.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(C.SALTS)))
    assert salted.select("_salt", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().agg(F.max("count")).first()[0] == 1
    assert salted.withColumn("r", F.row_number().over(part)).where("r <= 60 AND room_id = '!hot'").count() <= 64 * 60


@pytest.mark.parametrize("page", ["<!-- x ", "<script>x ", "<a x ", "<style>x ", "<script ", "<! x ", '<a href="x', "<a href=u>t</a> "])
def test_unclosed_markup_takes_linear_time(spark, page):
    def seconds(n):
        d = spark.createDataFrame([(page * n,)], "t string")
        t = time.perf_counter()
        d.select(F.length(H.html_to_text("t"))).collect()
        return time.perf_counter() - t

    seconds(10)
    assert min(seconds(16_000) for _ in range(2)) < 4


def test_markup_edges(spark):
    pages = {"a<!-- x > b": "a b", "a<!-- <b> --> b": "a b", "<script>var a='-->'</script>t<!-- u": "t<!-- u", "<a href='u'>t": "t", "<a href=u>t <a>v</a>": "t v (None)",
             "<a class=x href = \"q\">t</a >": "t (q)", "<A HREF='u'>a<b>b</b></A>c": "ab (u)c", "x < y": "x < y", "﷑x": "x", "<a>t</a x>u</a>": "tu",
             "<abbr>t</abbr>": "t", "<script>x": "x", "<style >p{}</STYLE >q": "q", "<!doctype html>t": "t", None: None, "": ""}
    d = spark.createDataFrame([(p,) for p in pages], "t string")
    assert {r.t: r.o for r in d.select("t", H.html_to_text("t").alias("o")).collect()} == pages


def test_strict_arguments(spark):
    cases = {'{"query":"x"}': ("ok", "language=en;query=x;summarize=false"), '{"query":"x"} junk': ("malformed", None), '{"query":"x"}{"query":0}': ("malformed", None),
             '{"query":0,"query":"x"}': ("ok", "language=en;query=x;summarize=false"), '{"query":"x","query":0}': ("missing_argument", "language=en;query=0;summarize=false"),
             "[1]": ("malformed", None), "": ("malformed", None), None: ("missing_argument", "language=en;summarize=false"), '{"query":"x"},{"a":1}': ("malformed", None),
             "{}": ("missing_argument", "language=en;summarize=false"), '{"query":{"a":[1]}}': ("ok", 'language=en;query={"a":[1]};summarize=false')}
    d = spark.createDataFrame([("wikipedia", a) for a in cases] + [("nosuch", "{")], "tool string, arguments string")
    got = {r.arguments: (r.status, r.args) for r in TC.normalise_tool_args(d).where("tool = 'wikipedia'").collect()}
    assert got == cases
    assert TC.normalise_tool_args(d).where("tool = 'nosuch'").first().status == "not_found"


def test_rejected_flags(spark):
    values = {"1": True, "0": False, "2": True, "-3": True, " 1 ": True, "1_0": True, "00": False, "9" * 40: True, "x": None, "1.5": None, "": None, "1__0": None}
    log = spark.createDataFrame([(f"!{i}", "always_reply", v, None, 1) for i, v in enumerate(values)], LOG)
    rooms = log.select("room_id").union(spark.createDataFrame([("!none",)], "room_id string"))
    flags = {r.room_id: r.always_reply for r in S.room_profile(rooms, log, CFG).collect()}
    assert flags == {f"!{i}": v for i, v in enumerate(values.values())} | {"!none": True}
    assert sorted(r.value for r in S.settings_rejects(log).collect()) == sorted(k for k, v in values.items() if v is None)
    both = D.decoded(spark.createDataFrame([("info", "1"), ("loud", "x"), (None, None)], "level string, tts string"), {"level": D.level, "tts": D.flag}).collect()
    assert [[x.field for x in r.rejects] for r in both] == [[], ["level", "tts"], ["level"]] and both[0].tts is True and both[1].level is None


def test_allow_list_by_distinct_ids(spark):
    m = spark.createDataFrame([("$1", "@a:s", "!r"), ("$2", "@b:t", "!r"), ("$3", "@b:t", "!q"), ("$4", "@c:u", None), ("$5", CFG.bot_id, "!q")],
                              "event_id string, sender string, room_id string")
    for listed, want in ((["@a:s"], ["$1"]), (["!q"], ["$3"]), (["*:t"], ["$2", "$3"]), ([], ["$1", "$2", "$3", "$4"]), (["@*:u"], ["$4"])):
        ok, no = A.split_allowed(m, spark.createDataFrame([(x,) for x in listed], "user_id string"), CFG)
        assert sorted(r.event_id for r in ok.collect()) == want
        assert sorted(r.event_id for r in no.collect()) == sorted({"$1", "$2", "$3", "$4"} - set(want))
    # ids are exploded, messages are not
    ok, _ = A.split_allowed(m, spark.createDataFrame([("@a:s",)], "user_id string"), CFG)
    assert "event_id" not in "".join(line for line in plan(ok).splitlines() if "Generate" in line)


def test_allow_list_text(spark):
    texts = {'["a","b"]': ["a", "b"], "[]": [], "x": [], "": [], None: [], '["a"] x': [], '["a"],["b"]': [], '["a",null]': [], "[1]": [], '{"a":1}': []}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in d.select("t", A.parse_allow_list("t").alias("x")).collect()} == texts
    closed = {r.t: r.x for r in d.select("t", A.parse_allow_list("t", fail_open=False).alias("x")).collect()}
    assert [t for t, x in closed.items() if x is not None] == ['["a","b"]', "[]"]


def test_calculation_lines(spark):
    sub = [("s", "i", "p"), ("", None, "p"), (None, "", "")]
    pods = [("In", False, sub), ("Out", True, [("", "i", None)]), (None, None, None)]
    rows = [(1, True, None, False, False, pods), (2, True, None, True, True, pods), (3, True, None, True, False, pods[:1]), (4, False, None, True, True, pods),
            (5, False, "six", False, False, None), (6, True, None, False, False, None), (7, True, None, False, False, [])]
    d = spark.createDataFrame(rows, f"query_id int, success boolean, suggestion string, results_only boolean, text boolean, pods {P.PODS}")
    got = {}
    for r in P.calculation_lines(d).orderBy("query_id", "line_no").collect():
        got.setdefault(r.query_id, []).append(r.line if r.kind == "text" else f"image {r.line}")
    code = "```\np\n```"
    assert got == {1: ["*In*", "*s*", "image i", code, "*Out*", "image i"], 2: ["*Out*"], 3: ["*In*", "*s*", "image i", code], 4: ["Could not process your query."],
                   5: ["Could not process your query.", "Did you mean: six"]}
    assert plan(P.calculation_lines(d)).count("Generate") == 1


def test_catalogue(spark):
    done = E.migrate_catalogue(spark, {}, now="2024-01-01 00:00:00")
    assert sorted(done) == ["migrations", "room_settings", "settings", "token_usage", "user_spaces"]
    assert sorted(r.id for r in done["migrations"].collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert done["token_usage"].columns == E.USAGE_V6
    half = E.migrate_catalogue(spark, {}, to_version=3)
    messages = spark.createDataFrame([("r", "$1", "u", "old", 1), ("r", "$2", "u", "tie", 2), ("r", "$3", "u", "new", 2), ("s", "$4", "u", "own", 1)],
                                     "room_id string, message_id string, user_id string, body string, timestamp bigint")
    own = spark.createDataFrame([("s", "system_message", "kept"), ("s", "model", "m")], "room_id string, setting string, value string")
    done = E.migrate_catalogue(spark, half | {"system_messages": messages, "room_settings": own})
    assert sorted(tuple(r) for r in done["room_settings"].collect()) == [("r", "system_message", "new"), ("s", "model", "m"), ("s", "system_message", "kept")]
    assert sorted(r.id for r in done["migrations"].collect()) == [1, 3, 4, 5, 6, 7, 8] and "system_messages" not in done
    again = E.migrate_catalogue(spark, done)
    assert again["migrations"].count() == 7
    with pytest.raises(ValueError):
        E.migrate_catalogue(spark, done, to_version=5)


def test_weather_is_parsed_once(spark, sf_dir):
    from chatlake.plans import q_payloads as QP

    assert plan(QP.QUERIES["weather_report"](spark, sf_dir)).count("from_json") == 1
