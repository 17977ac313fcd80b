"""Edge rows for payload functions: HTML, fenced JSON / tool calls,
service payloads, image box planning, attachments, form encoding."""

import json
import urllib.parse

from pyspark.sql import functions as F

from chatlake.config import DEFAULT_CONFIG as CFG
from chatlake.functions import html as H
from chatlake.functions import payloads as P
from chatlake.operators import toolcalls as TC
from chatlake.sources import attachments as AT


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r.o for r in df.select(expr(F.col("v")).alias("o")).collect()]


def test_html_edges(spark):
    pages = [
        '<p>Go <a href="/x">here</a> now</p>',
        "<p><a>no href</a></p>",
        "<a href='/single'>s</a> and <A HREF=/bare>b</A>",
        '<a href="/n"><b>nested</b> text</a>',
        "<!-- a > b -->kept",
        '<script>var t="</p>";</script><STYLE>p{}</STYLE>body',
        "&amp;lt; tag &lt;b&gt; &quot;q&quot; &middot; &copy;",
        "a&nbsp;&nbsp;b \n\t c",
        "<!DOCTYPE html><title>T</title><div>x</div><div>y</div>",
        None,
    ]
    got = one_col(spark, pages, H.html_to_text)
    assert got == [
        "Go here (/x) now",
        "no href (None)",
        "s (/single) and b (/bare)",
        "nested text (/n)",
        "kept",
        "body",
        "&lt; tag <b> \"q\" · ©",
        "a b c",
        "Txy",
        None,
    ]


def test_page_report(spark):
    df = spark.createDataFrame([("http://a", 200, "OK", "t"), ("http://b", 404, "Not Found", "t")],
                               "url string, status int, reason string, text string")
    got = [r.r for r in df.select(H.page_report("url", "status", "reason", "text").alias("r")).collect()]
    assert got == ["**Web request**\nURL: http://a\nStatus: 200 OK\n\nt\n", None]


def test_form_encoding_matches_quote_plus(spark):
    values = ["a b*c~d&e=f/g?h#i:j+k%l.m-n_o é", "", "100% sure!"]
    assert one_col(spark, values, P.form_encode) == [urllib.parse.quote_plus(v) for v in values]
    df = spark.createDataFrame([("x y",)], "q string")
    url = df.select(P.wiki_url("q", "de").alias("u")).collect()[0].u
    assert url == ("https://de.wikipedia.org/w/api.php?" + urllib.parse.urlencode(
        {"action": "query", "format": "json", "titles": "x y", "prop": "revisions", "rvprop": "content"}))


def test_fenced_json_and_tool_calls(spark):
    replies = ['```json\n{"tool":"dice","parameters":{"dice":"20"}}```', '```\n{"tool":"x"}```',
               '```json\n{"tool":"x"}', '```json\n{"tool":"x"}```\n', '"a string"', "[1]", "{}",
               '{"tool":"x","parameters":null}', "plain", '{"type":"calculate"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = [(r.kind, r.tool, r.arguments) for r in TC.extract_tool_call(df).orderBy("i").collect()]
    assert got == [("call", "dice", '{"dice":"20"}'), ("call", "x", "{}"), ("call", "x", "{}"),
                   ("text", None, None), ("text", None, None), ("text", None, None), ("regenerate", None, None),
                   ("call", "x", "null"), ("text", None, None), ("regenerate", None, None)]


def test_classify_fallbacks(spark):
    df = spark.createDataFrame([('{"type":"imagine","prompt":"a cat"}', "q1"), ('{"type":"chat","prompt":"x"}', "q2"),
                                ("nope", "q3"), ("[1]", "q4"), ('{"prompt":"p"}', "q5")], "reply string, query string")
    got = [(r.type, r.prompt, r.routed_body) for r in TC.classify(df).collect()]
    assert got == [("imagine", "a cat", "!bot imagine a cat"), ("chat", "x", None), ("chat", "q3", None),
                   ("chat", "q4", None), ("chat", "q5", None)]


def test_tool_args(spark):
    df = spark.createDataFrame([("wikipedia", '{"query":"x","language":"de"}'), ("wikipedia", "{}"),
                                ("weather", '{"latitude":"1"}'), ("dice", "{}"), ("nosuch", "{}"),
                                ("imagine", '{"prompt":""}')], "tool string, arguments string")
    got = [(r.status, r.missing, r.args) for r in TC.normalise_tool_args(df).collect()]
    assert got == [("ok", None, "language=de;query=x;summarize=false"),
                   ("missing_argument", "query", "language=en;summarize=false"),
                   ("missing_argument", "longitude", "latitude=1"), ("ok", None, "dice=6"),
                   ("not_found", None, None), ("missing_argument", "prompt", "orientation=square;prompt=")]


def test_wiki_and_weather_edges(spark):
    wiki = ['{"query":{"pages":{"1":{"title":"T","revisions":[{"*":"body"}]}}}}', '{"nothing":1}',
            '{"query":{"pages":{}}}', '{"query":{"pages":{"1":{"title":"A","revisions":[{"*":"a"}]},'
                                      '"2":{"title":"B","revisions":[{"*":"b"}]}}}}']
    df = spark.createDataFrame([(w,) for w in wiki], "payload string")
    st, tx = P.wiki_report("payload", F.lit("q"))
    got = [(r.s, r.t) for r in df.select(st.alias("s"), tx.alias("t")).collect()]
    assert got == [("ok", "**Wikipedia: T**\nbody"), ("no_results", "No results for q found in Wikipedia."),
                   ("no_results", "No results for q found in Wikipedia."), ("ok", "**Wikipedia: A**\na")]
    w = ('{"current":{"temp":5,"feels_like":3.5,"humidity":80,"wind_speed":2,"sunrise":1704088800,"sunset":1704124800,'
         '"weather":[{"description":"rain"}]},"daily":[{"temp":{"day":6},"summary":"s0","weather":[{"description":"d0"}]}%s]}')
    two = w % ',{"temp":{"day":7},"summary":"s1","weather":[{"description":"d1"}]}'
    df = spark.createDataFrame([(two, "Oslo"), (w % "", None)], "payload string, name string")
    rows = P.weather_reports(df, "payload", "name").select(F.col("status").alias("s"), F.col("text").alias("t")).collect()
    assert rows[0].s == "ok" and rows[0].t == (
        "**Weather report for Oslo**\nCurrent: 5°C, rain\nFeels like: 3.5°C\nHumidity: 80%\nWind: 2m/s\n"
        "Sunrise: 06:00\nSunset: 16:00\n\nToday: 6°C, d0, s0\nTomorrow: 7°C, d1, s1\n")
    assert (rows[1].s, rows[1].t) == ("error", None)


def aspect_error(w, h, nw, nh):
    return abs(w / h - nw / nh)


def test_fit_box(spark):
    """Fits the box, never enlarges, one side is the box's, and no other length of the
    other side keeps the proportions better."""
    long_, short = 2000, 768
    sizes = [(3000, 3000), (2000, 500), (2001, 1999), (1900, 1000), (1, 1), (5000, 60), (60, 5000), (2100, 1000),
             (2400, 1000), (768, 2001), (4000, 3000), (3, 2001)]
    df = spark.createDataFrame(sizes, "w int, h int")
    nw, nh = P.fit_box("w", "h", CFG)
    got = [(r.a, r.b) for r in df.select(nw.alias("a"), nh.alias("b")).collect()]
    for (w, h), (a, b) in zip(sizes, got):
        box = (long_, short) if w > h else (short, long_)
        if (w > h and w <= long_) or (w <= h and h <= long_):
            assert (a, b) == (w, h)
            continue
        assert 1 <= a <= min(w, box[0]) and 1 <= b <= min(h, box[1])
        assert a == box[0] or b == box[1]
        others = [(x, b) for x in range(1, box[0] + 1)] if b == box[1] else [(a, y) for y in range(1, box[1] + 1)]
        assert aspect_error(w, h, a, b) <= min(aspect_error(w, h, *o) for o in others) + 1e-12
    nw0, nh0 = P.fit_box("w", "h", CFG.with_(image_long_side=0))
    assert [(r.a, r.b) for r in df.select(nw0.alias("a"), nh0.alias("b")).collect()] == sizes


def test_attachment_text_and_data_url(spark):
    df = spark.createDataFrame([(1, bytearray(b"hello")), (2, bytearray(b"a\xff")), (3, bytearray(b"")), (4, None)],
                               "id int, content binary")
    assert [(r.id, r.text) for r in AT.file_text(df).collect()] == [(1, "hello")]
    long_bytes = bytearray(range(256)) * 4
    d = spark.createDataFrame([(long_bytes,)], "c binary").select(AT.data_url(F.lit("x/y"), "c").alias("u")).collect()[0].u
    import base64

    assert d == "data:x/y;base64," + base64.b64encode(bytes(long_bytes)).decode()


def test_envelopes(spark):
    import json

    df = spark.createDataFrame([("hi <b>", False, None), ("n", True, None), ("r", False, "bot.tool_result")],
                               "body string, notice boolean, mt string")
    mt, env = P.message_envelope("body", "notice", "mt")
    got = [(r.m, json.loads(r.e)) for r in df.select(mt.alias("m"), env.alias("e")).collect()]
    assert got[0] == ("m.text", {"msgtype": "m.text", "body": "hi <b>", "format": "org.matrix.custom.html",
                                 "formatted_body": "hi &lt;b&gt;"})
    assert got[1][0] == "m.notice"
    assert got[2][1] == {"msgtype": "bot.tool_result", "content": "r"}
    f = spark.createDataFrame([("a.png", "image/png", bytearray(b"1234"), 10, 20)],
                              "n string, m string, c binary, w int, h int")
    e = json.loads(f.select(P.file_envelope("n", "m", "c", F.lit("m.image"), F.lit("mxc://s/1"), "w", "h").alias("e"))
                   .collect()[0].e)
    assert e == {"body": "a.png", "info": {"mimetype": "image/png", "size": 4, "w": 10, "h": 20},
                 "msgtype": "m.image", "url": "mxc://s/1"}


def test_pod_lines_from_nested(spark):
    nested = spark.createDataFrame(
        [(1, [("Input", [("", "img1", "x")]), ("", [("sub", None, "42"), ("", None, "")])])],
        "query_id int, pods array<struct<title:string, subpods:array<struct<title:string, img:string, plaintext:string>>>>")
    pods, subs = P.flatten_pods(nested)
    lines = P.pod_lines(pods, subs, text=False).orderBy("pod_pos", "sub_pos", "step").collect()
    assert [(r.kind, r.line) for r in lines] == [("text", "*Input*"), ("image", "img1"), ("text", "*sub*"),
                                                 ("text", "```\n42\n```")]
    text_only = P.pod_lines(pods, subs, text=True).orderBy("pod_pos", "sub_pos", "step").collect()
    assert [r.line for r in text_only] == ["*Input*", "```\nx\n```", "*sub*", "```\n42\n```"]
    fails = spark.createDataFrame([("2+2",), (None,)], "s string").select(P.failed_query_lines("s").alias("l")).collect()
    assert [r.l for r in fails] == [["Could not process your query.", "Did you mean: 2+2"],
                                    ["Could not process your query."]]


def test_lists_hold_every_item(spark):
    many = [{"title": f"t{i}", "url": f"u{i}", "description": "d", "name": f"n{i}", "code": f"c{i}"} for i in range(25)]
    rows = [(1, json.dumps(many)), (2, "[]"), (3, "no json"), (4, json.dumps([{"title": "only"}])), (5, None)]
    df = spark.createDataFrame(rows, "i int, payload string")
    got = {r.i: (r.a, r.b) for r in df.select("i", P.result_list("payload", F.lit("q")).alias("a"), P.carrier_list("payload").alias("b")).collect()}
    head = "**Search results for q**"
    assert got[1][0] == head + "".join(f"\nt{i}\nu{i}\nd\n" for i in range(25))
    assert got[1][1] == "\n".join(f"* n{i} - c{i}" for i in range(25))
    assert got[2] == (head, "") and got[4] == (head, "") and got[5] == (None, None)


def test_wiki_without_title(spark):
    payloads = ['{"query":{"pages":{"1":{"title":"T","revisions":[{"*":"x"}]}}}}', '{"query":{"pages":{"1":{"revisions":[{"*":"x"}]}}}}',
                '{"query":{"pages":{"1":{"title":"T"}}}}', '{"query":{"pages":{}}}', "{"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    status, text = P.wiki_report("p", F.lit("q"))
    got = [(r.s, r.t is not None) for r in df.select("i", status.alias("s"), text.alias("t")).orderBy("i").collect()]
    assert got == [("ok", True)] + [("no_results", True)] * 4


def test_html_anchors_and_entities(spark):
    from time import perf_counter

    from chatlake.functions import html as H

    cases = [('<a data-href="/x" href="/y">t</a>', "t (/y)"), ("&#8217;&mdash;&#x41;&#0;&#xD800;&#99999999;&amp;#65;", "’—A&#0;&#xD800;&#99999999;&#65;"),
             ("<a href='/1'>one<a href='/2'>two</a>", "onetwo (/2)"), ("<a>bare <b>x</b></a>", "bare x (None)"), ("&# &#; a&#65", "&# &#; a&#65")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "h string")
    assert [r.t for r in df.select(H.html_to_text("h").alias("t")).collect()] == [t for _, t in cases]
    big = spark.createDataFrame([('<a href="/x">open ' * 8000,)], "h string").select(H.html_to_text("h").alias("t"))
    big.collect()
    start = perf_counter()
    assert big.collect()[0].t.startswith("open open")
    assert perf_counter() - start < 5
