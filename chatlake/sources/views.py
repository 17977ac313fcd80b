"""Derived fixture views over the driver's tables (FIXTURES.md §2).

Each view is a projection (and sometimes a filter) over one base table, so
Catalyst prunes the scan to the columns used and the views cost one narrow
stage each.  Views that need a join or a grouping say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

SERVERS = ["alpha.example", "beta.example", "gamma.example"]


def _server(n: Column) -> Column:
    """Server name picked by ``n % 3``."""
    m = n % 3
    return (F.when(m == 0, F.lit(SERVERS[0]))
            .when(m == 1, F.lit(SERVERS[1]))
            .otherwise(F.lit(SERVERS[2])))


def _room(n: Column) -> Column:
    r = n % 10
    return F.concat(F.lit("!r"), r.cast("string"), F.lit(":"), _server(r))


def messages(spark: SparkSession, sf_dir: str, bot_id: str = "@bot:alpha.example",
             prefix: str = "!bot", custom_kind: str = "bot.tool_result") -> DataFrame:
    """V1: chat messages of ten rooms, every kind and command form present."""
    return messages_of(table(spark, sf_dir, "conversations"), bot_id, prefix, custom_kind)


def messages_of(conversations: DataFrame, bot_id: str = "@bot:alpha.example",
                prefix: str = "!bot", custom_kind: str = "bot.tool_result") -> DataFrame:
    """V1 over any conversations frame (batch or stream)."""
    c = conversations.select("conv_id", "turn", "role", "text")
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    k = (conv * 7 + turn * 3) % 16
    kind = (F.when(k == 5, "m.notice").when(k == 6, "m.image").when(k == 7, "m.audio")
            .when(k == 8, "m.file").when(k == 9, custom_kind).when(k == 10, "m.member")
            .otherwise("m.text"))
    body = (F.when(k == 0, F.when(conv % 5 == 0, F.lit(f"{prefix} ignoreolder"))
                   .otherwise(F.lit(f"{prefix} space Enable")))
            .when(k == 1, F.concat(F.lit(f"{prefix} custom "), text))
            .when(k == 2, F.lit(f"{prefix} calculate 1 + 1 --text --details"))
            .when(k == 3, F.concat(F.lit(f"* {prefix} chat "), text))
            .when(k == 4, F.lit("!other thing"))
            .when(k == 11, F.lit(f"{prefix} imagine --portrait a cat"))
            .when(k == 12, F.lit(f"{prefix} nosuch"))
            .when(k == 7, F.lit("voice.mp3"))
            .when(k == 8, F.lit("clip.mp4"))
            .otherwise(text))
    sender = (F.when(F.col("role") == "assistant", F.lit(bot_id))
              .otherwise(F.concat(F.lit("@u"), (conv % 17).cast("string"), F.lit(":"), _server(conv))))
    return c.select(
        _room(conv).alias("room_id"),
        F.concat(F.lit("$"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("event_id"),
        sender.alias("sender"),
        kind.alias("kind"),
        body.alias("body"),
        (conv * 8 + turn).alias("seq"),
        (F.lit(1704067200000) + conv * 3600000 + turn * 60000).alias("sent_ms"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before their kind is known: type given or not, content with or without
    ``msgtype``, broken or missing, membership events among them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    k = (F.col("conv_id") * 7 + F.col("turn") * 3) % 16
    msgtype = F.when(k % 3 == 0, "m.text").when(k % 3 == 1, "m.image")
    content = F.when(k == 13, F.lit("{broken")).when(k != 14, F.to_json(F.struct(msgtype.alias("msgtype"), F.col("text").alias("body"))))
    return c.select(F.concat(F.lit("$"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"),
                    F.when(k < 5, F.concat(F.lit("m.type"), k.cast("string"))).alias("type"), content.alias("content"),
                    F.when(k.isin(2, 8, 14), "join").alias("membership"))


def room_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of V1 before their kind is known: the ``type`` of every other one is given, the
    others have a ``msgtype`` in their content, and one in nineteen has neither."""
    m = messages(spark, sf_dir)
    conv, turn = F.floor(F.col("seq") / 8), F.col("seq") % 8
    bare, typed = (conv * 3 + turn) % 19 == 0, (conv + turn) % 2 == 0
    return m.select("room_id", "event_id", "sender", "body", "seq", "sent_ms", F.when(~bare & typed, F.col("kind")).alias("type"),
                    F.when(bare, F.lit("{}")).when(~typed, F.to_json(F.struct(F.col("kind").alias("msgtype")))).alias("content"),
                    F.when(F.col("kind") == "m.member", "join").alias("membership"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of files and images of V1, which are the turn's text; some files are broken or
    empty, some files and images are missing."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    conv, k = F.col("conv_id"), (F.col("conv_id") * 7 + F.col("turn") * 3) % 16
    raw = F.encode("text", "utf-8")
    content = F.when((k == 8) & (conv % 5 == 1), F.concat(raw, F.unhex(F.lit("FF")))).when((k == 8) & (conv % 5 == 2), F.unhex(F.lit(""))).otherwise(raw)
    return c.where(((k == 8) & (conv % 5 != 3)) | ((k == 6) & (conv % 4 != 0))).select(
        F.concat(F.lit("$"), conv.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"), content.alias("content"),
        F.when(k == 6, "image/png").otherwise("text/plain").alias("mimetype"))


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: room setting writes, one for each event."""
    return settings_log_of(table(spark, sf_dir, "events"))


def settings_log_of(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type")
    u, et, eid = F.col("user_id"), F.col("event_type"), F.col("event_id")
    setting = (F.when(et == "click", "always_reply").when(et == "view", "tts")
               .when(et == "error", "stt").when(et == "signup", "model")
               .otherwise("system_message"))
    value = (F.when(et == "signup", F.concat(F.lit("model-"), (eid % 4).cast("string")))
             .when(et == "purchase", F.concat(F.lit("Be terse "), (eid % 9).cast("string")))
             .otherwise((eid % 2).cast("string")))
    return e.select(_room(u).alias("room_id"), setting.alias("setting"), value.alias("value"),
                    F.col("ts"), eid.alias("event_id"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one usage record per event."""
    return usage_log_of(table(spark, sf_dir, "events"))


def usage_log_of(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.concat(F.lit("$"), F.col("event_id").cast("string")).alias("message_id"),
        F.concat(F.lit("!r"), (F.col("user_id") % 10).cast("string")).alias("room_id"),
        F.concat(F.lit("openai-"), F.col("event_type")).alias("api"),
        F.floor(F.col("value") * 10).cast("bigint").alias("tokens"),
        F.col("ts"),
    )


def member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: membership changes of 2000 rooms."""
    return member_events_of(table(spark, sf_dir, "events"))


def member_events_of(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type")
    return e.select(
        F.concat(F.lit("!m"), (F.col("event_id") % 2000).cast("string")).alias("room_id"),
        F.concat(F.lit("@u"), F.col("user_id").cast("string"), F.lit(":alpha.example")).alias("user_id"),
        F.when(F.col("event_type") == "error", "leave").otherwise("join").alias("membership"),
        F.col("ts"), F.col("event_id"),
    )


def room_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room state events, a type for every event type."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props")
    et = F.col("event_type")
    kind = (F.when(et == "view", "m.room.avatar").when(et == "click", "m.room.name").when(et == "signup", "m.room.topic")
            .when(et == "error", "m.room.encryption").otherwise("m.room.canonical_alias"))
    return e.select(F.concat(F.lit("!m"), (F.col("event_id") % 2000).cast("string")).alias("room_id"), kind.alias("type"),
                    F.lit("").alias("state_key"), F.col("props").alias("content"), F.col("ts"), F.col("event_id"))


def invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending invitations: the rooms of signup events."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return (e.where(F.col("event_type") == "signup")
            .select(F.concat(F.lit("!m"), (F.col("event_id") % 2000).cast("string")).alias("room_id"),
                    F.col("event_id")))


def ignored_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore list: room numbers divisible by 7 (a rule, so it stays small
    relative to its source and is computed, not listed)."""
    e = table(spark, sf_dir, "events").select("event_id")
    return (e.select((F.col("event_id") % 2000).alias("n")).where(F.col("n") % 7 == 0)
            .select(F.concat(F.lit("!m"), F.col("n").cast("string")).alias("room_id")).distinct())


def user_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: one space per user (distinct over the event stream)."""
    e = table(spark, sf_dir, "events").select("user_id")
    return (e.select(
        F.concat(F.lit("!space"), F.col("user_id").cast("string"), F.lit(":alpha.example")).alias("space_id"),
        F.concat(F.lit("@u"), F.col("user_id").cast("string"), F.lit(":alpha.example")).alias("user_id"),
        (F.col("user_id") % 3 != 0).alias("active")).distinct())


def wiki_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: encyclopedia payloads with the documents' texts as content; one in eleven
    has no page, one in thirteen a page without a title, one in seventeen a page without content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i, did = F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.when(i % 13 != 0, F.concat(F.lit("doc "), did))
    content = F.when(i % 17 != 0, F.col("text"))
    page = F.struct(title.alias("title"), F.array(F.struct(content.alias("*"))).alias("revisions"))
    payload = F.when(i % 11 == 0, F.lit('{"query":{"pages":{}}}')).otherwise(
        F.concat(F.lit('{"query":{"pages":'), F.to_json(F.create_map(did, page)), F.lit("}}")))
    return d.select(i.alias("id"), payload.alias("payload"))


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather payloads with current and two daily forecasts."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    i = F.col("event_id")

    def s(x):
        return x.cast("string")

    payload = F.concat(
        F.lit('{"current":{"temp":'), s(i % 40), F.lit(',"feels_like":'), s(i % 38),
        F.lit(',"humidity":'), s(i % 100), F.lit(',"wind_speed":'), s(i % 25),
        F.lit(',"sunrise":'), s(F.lit(1704088800) + i % 3600),
        F.lit(',"sunset":'), s(F.lit(1704124800) + i % 3600),
        F.lit(',"weather":[{"description":"'), F.col("event_type"),
        F.lit('"}]},"daily":[{"temp":{"day":'), s(i % 30),
        F.lit('},"summary":"a","weather":[{"description":"x"}]},{"temp":{"day":'), s(i % 31),
        F.lit('},"summary":"b","weather":[{"description":"y"}]}]}'))
    return e.select(i.alias("id"), payload.alias("payload"))


def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested calculation results, one for each order with a pod for each of its lines;
    one in nine failed, and half of these have a suggestion."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity")
    n = F.col("l_linenumber")
    sub = lambda title, img, text: F.struct(title.alias("title"), img.alias("img"), text.alias("plaintext"))
    none = F.lit(None).cast("string")
    pod = F.struct(n.alias("_n"), "l_partkey", "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus", F.when(n % 4 != 0, F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))).otherwise("").alias("title"), (F.col("l_returnflag") == "R").alias("is_result"), F.array(
        sub(F.col("l_linestatus"), F.when(n % 2 == 0, F.concat(F.lit("img-"), F.col("l_partkey").cast("string"))), F.col("l_partkey").cast("string")),
        sub(F.lit(""), none, F.when(n % 3 != 0, F.col("l_quantity").cast("int").cast("string")))).alias("subpods"))
    q = li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(pod)).alias("_p"))
    i = F.col("query_id")
    return q.select("query_id", (i % 9 != 0).alias("success"), F.when(i % 18 == 0, F.concat(F.lit("order "), i.cast("string"))).alias("suggestion"),
                    (i % 2 == 0).alias("results_only"), (i % 5 == 0).alias("text"),
                    F.transform("_p", lambda p: F.struct(p["title"].alias("title"), p["is_result"].alias("is_result"), p["subpods"].alias("subpods"))).alias("pods"))


def broken_settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 with values that are no integers (the event's properties, an ``x`` after the number, nothing) and blanks around some."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), "props")
    s = settings_log(spark, sf_dir).join(e, F.col("event_id") == F.col("_e"))
    i, v = F.col("event_id"), F.col("value")
    bad = F.when(i % 7 == 0, F.col("props")).when(i % 7 == 1, F.concat(F.lit(" "), v, F.lit(" "))).when(i % 7 == 2, F.concat(v, F.lit("x"))) \
        .when(i % 7 == 3, F.lit("")).when(i % 7 == 4, F.concat(F.lit("0000000000000000000000000"), v)).otherwise(v)
    return s.select(F.concat("room_id", F.lit("/"), (i % 50).cast("string")).alias("room_id"), "setting", bad.alias("value"), "ts", "event_id")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: log records with every level."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "props")
    et = F.col("event_type")
    level = (F.when(et == "view", "debug").when(et == "click", "info").when(et == "signup", "warning")
             .when(et == "error", "error").otherwise("critical"))
    return e.select(F.col("ts"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("caller"),
                    level.alias("level"), F.col("props").alias("message"))


def media_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: image sizes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p.select(F.col("p_partkey").alias("media_id"), (F.col("p_size") * 100).alias("w"),
                    ((F.col("p_partkey") % 40 + 1) * 60).cast("int").alias("h"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies around the documents' texts: fenced, plain, concatenated, with words
    after them, and tool arguments of every JSON type that may pass for empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    text = F.to_json(F.struct(F.col("text").alias("query")))              # {"query":"..."}
    fence, end = F.lit("```json\n"), F.lit("```")
    call = F.concat(F.lit('{"tool":"wikipedia","parameters":'), text, F.lit("}"))
    typed = F.concat(F.lit('{"type":"imagine","prompt":'), F.expr("substr(to_json(named_struct('q', text)), 6)"))
    weather = lambda lat: F.lit('{"tool":"weather","parameters":{"latitude":%s,"longitude":"51"}}' % lat)
    shapes = [F.concat(fence, call, end), call, F.concat(call, F.lit(" "), call), F.concat(call, F.lit(" or {so}")), F.col("text"),
              typed, F.concat(typed, F.lit(" {}")), F.concat(F.lit("["), call, F.lit("]")), weather('"0"'), weather("0"), weather('""'),
              weather("false"), weather('"false"'), weather("null"), weather("[]"), weather("12.5"), F.lit('{"tool":"nosuch"}'),
              F.lit('{"tool":"wikipedia"}'), F.lit("{}"), F.lit('```json\n{"tool":"dice","parameters":{"dice":"20"}}```')]
    reply = F.element_at(F.array(*shapes), (F.pmod(i, F.lit(len(shapes))) + 1).cast("int"))
    return d.select(i.alias("reply_id"), F.concat(F.lit("q"), i.cast("string")).alias("query"), reply.alias("reply"))


def settings_commands(spark: SparkSession, sf_dir: str, prefix: str = "!bot") -> DataFrame:
    """Settings commands derived from the event stream: every alias, an
    unknown name, and values that are valid, invalid or missing."""
    return settings_commands_of(table(spark, sf_dir, "events"), prefix)


def settings_commands_of(events: DataFrame, prefix: str = "!bot") -> DataFrame:
    e = events.select("event_id", "user_id", "ts")
    i = F.col("event_id")
    name = (F.when(i % 7 == 0, "classification").when(i % 7 == 1, "timing").when(i % 7 == 2, "systemmessage")
            .when(i % 7 == 3, "always_reply").when(i % 7 == 4, "model").when(i % 7 == 5, "tts")
            .otherwise("bogus"))
    value = (F.when(i % 5 == 0, F.lit("true")).when(i % 5 == 1, F.lit("FALSE")).when(i % 5 == 2, F.lit("yes"))
             .when(i % 5 == 3, F.lit("")).otherwise(F.concat(F.lit("Be brief "), F.col("user_id").cast("string"))))
    head = (F.when(i % 11 == 0, F.lit(f"* {prefix} roomsettings ")).when(i % 11 == 1, F.lit(f"{prefix} chat "))
            .when(i % 11 == 2, F.lit("!other roomsettings ")).otherwise(F.lit(prefix + " roomsettings ")))
    body = (F.when(i % 13 == 0, F.concat(F.lit(prefix + " systemmessage "), value))
            .when(i % 13 == 1, F.concat(F.lit(f"* {prefix} systemmessage "), value))
            .otherwise(F.concat(head, name, F.lit(" "), value)))
    return e.select(_room(F.col("user_id")).alias("room_id"), i.alias("event_id"),
                    F.regexp_replace(body, r"\s+$", "").alias("body"), F.col("ts"))
