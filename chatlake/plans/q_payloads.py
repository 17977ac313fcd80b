"""Registered queries: web pages, URL encoding, service payloads,
calculation pods, result lists, attachments, envelopes, image boxes, word
counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..functions import html as H
from ..functions import payloads as P
from ..functions import text as T
from ..sources import attachments as AT
from ..sources import views as V
from ..sources.tables import table
from .oracle_views import with_ctes

CFG = DEFAULT_CONFIG
CUSTOM = CFG.custom_kind_prefix + "."


def _pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    return (p.withColumn("status", F.when(F.col("page_id") % 13 == 0, F.lit(404)).otherwise(F.lit(200)))
            .withColumn("reason", F.when(F.col("page_id") % 13 == 0, F.lit("Not Found")).otherwise(F.lit("OK"))))


def q_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_to_text("html").alias("text"))


def q_page_report(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", "status", H.page_report("url", "status", "reason", H.html_to_text("html")).alias("report"))


def _lang():
    lang = F.regexp_extract(F.col("url"), r"/([a-z]{2})/", 1)
    return F.when(lang == "", F.lit("en")).otherwise(lang)


def q_url_query(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    search = P.form_encode(F.concat(F.col("url"), F.lit(" page "), F.col("page_id").cast("string")))
    title = F.concat(F.lit("title "), F.col("page_id").cast("string"), F.lit(" *~&"))
    return p.select("page_id", search.alias("search_q"), P.wiki_url(title, _lang()).alias("wiki_request"))


def q_wiki_extract(spark, sf):
    w = V.wiki_payloads(spark, sf)
    status, text = P.wiki_report("payload", F.concat(F.lit("q"), F.col("id").cast("string")))
    return w.select("id", status.alias("status"), text.alias("text"))


def _station():
    return F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("station "), (F.col("id") % 7).cast("string")))


def q_weather_report(spark, sf):
    return P.weather_reports(V.weather_payloads(spark, sf), "payload", _station()).select("id", "status", "text")


def q_calculation_lines(spark, sf):
    return P.calculation_lines(V.calculations(spark, sf))


def calc_results(spark, sf):
    """Calculation results in relational form: one pod per order (title =
    priority, empty for every fourth), one subpod per line."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    pods = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pod_pos"),
                    F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("title"))
    subs = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("query_id"), F.col("l_orderkey").alias("pod_pos"),
                    F.col("l_linenumber").alias("sub_pos"), F.col("l_returnflag").alias("title"),
                    F.when(F.col("l_linenumber") % 2 == 0,
                           F.concat(F.lit("img-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                                    F.col("l_linenumber").cast("string"))).alias("img"),
                    F.col("l_partkey").cast("string").alias("plaintext")))
    return pods, subs


def q_pod_flatten(spark, sf):
    pods, subs = calc_results(spark, sf)
    return P.pod_lines(pods, subs, text=False)


def search_payloads(spark, sf):
    """One search per order, its lines as the results: a JSON array of a naturally small group."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    line = F.struct(F.col("l_linenumber").alias("k"), F.struct(
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("https://example.com/part/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat(F.lit('by "'), F.col("l_returnflag"), F.lit('"')).alias("description"),
        F.col("l_returnflag").alias("name"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("code")).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["r"])
    return li.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.to_json(rows).alias("payload"))


def q_result_list(spark, sf):
    query = F.concat(F.lit("order "), F.col("order_id").cast("string"))
    return search_payloads(spark, sf).select("order_id", P.result_list("payload", query).alias("text"))


def q_carrier_list(spark, sf):
    return search_payloads(spark, sf).select("order_id", P.carrier_list("payload").alias("text"))


def _doc_bytes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    raw = F.encode(F.col("text"), "UTF-8")
    return d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
                    .alias("content"))


def q_file_text(spark, sf):
    return AT.file_text(_doc_bytes(spark, sf)).select("doc_id", "text")


def q_data_url(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", AT.data_url(F.lit("text/plain"), F.encode(F.col("text"), "UTF-8")).alias("url"))


def q_outbox_envelope(spark, sf):
    m = V.messages(spark, sf)
    custom = F.when(F.startswith(F.col("kind"), F.lit(CUSTOM)), F.col("kind"))
    mt, env = P.message_envelope(F.col("body"), F.col("kind") == "m.notice", custom, CUSTOM)
    e = m.select("event_id", env.alias("env"))
    return e.select("event_id", *[F.get_json_object("env", f"$.{k}").alias(k)
                                  for k in ("msgtype", "body", "content", "format", "formatted_body")])


def q_file_envelope(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    env = P.file_envelope(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit("text/plain"),
                          F.encode(F.col("text"), "UTF-8"), F.lit("m.file"),
                          F.concat(F.lit("mxc://alpha.example/doc"), F.col("doc_id").cast("string")))
    e = d.select("doc_id", env.alias("env"))
    return e.select("doc_id", F.get_json_object("env", "$.body").alias("body"),
                    F.get_json_object("env", "$.info.mimetype").alias("mimetype"),
                    F.get_json_object("env", "$.info.size").cast("bigint").alias("size"),
                    F.get_json_object("env", "$.msgtype").alias("msgtype"),
                    F.get_json_object("env", "$.url").alias("url"))


def q_fit_box(spark, sf):
    m = V.media_meta(spark, sf)
    nw, nh = P.fit_box("w", "h", CFG)
    return m.select("media_id", "w", "h", nw.alias("new_w"), nh.alias("new_h"))


def q_word_count(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", T.word_count("text").alias("words"))


# ------------------------------------------------------------------ oracle


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    return _s(pattern)


_HTML_SQL = "html"
for _p in (H.COMMENT, H.SCRIPT, H.STYLE, H.DECLARATION):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, {_re(_p)}, '', 'g')"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""
_HTML_SQL = f"regexp_replace({_HTML_SQL}, {_re(_HREF)}, '\\4 (\\1\\2\\3)', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, {_re('(?is)<a(?:[ ][^>]*)?>(.*?)</a *>')}, '\\1 (None)', 'g')"
_HTML_SQL = f"regexp_replace({_HTML_SQL}, {_re(H.TAG)}, '', 'g')"
for _e, _c in H.ENTITIES:
    _HTML_SQL = f"replace({_HTML_SQL}, {_s(_e)}, {_s(_c)})"
_HTML_SQL = f"trim(regexp_replace({_HTML_SQL}, {_s(H.SPACE)}, ' ', 'g'))"


def _enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def _thumb_sql(bx: int, by: int) -> tuple[str, str]:
    fx, cx = f"floor({by} * a)", f"ceil({by} * a)"
    nx = f"greatest(CASE WHEN abs(a - {cx} / {by}.0) < abs(a - {fx} / {by}.0) THEN {cx} ELSE {fx} END, 1)"
    fy, cy = f"floor({bx} / a)", f"ceil({bx} / a)"

    def ey(n):
        return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE abs(a - {bx} / {n}) END)"

    ny = f"greatest(CASE WHEN {ey(cy)} < {ey(fy)} THEN {cy} ELSE {fy} END, 1)"
    fits, xfit = f"({bx} >= w AND {by} >= h)", f"({bx}.0 / {by} >= a)"
    return (f"CASE WHEN {fits} THEN w WHEN {xfit} THEN {nx} ELSE {bx} END",
            f"CASE WHEN {fits} THEN h WHEN {xfit} THEN {by} ELSE {ny} END")


_LW, _LH = _thumb_sql(CFG.image_long_side, CFG.image_short_side)
_PW, _PH = _thumb_sql(CFG.image_short_side, CFG.image_long_side)
_L = CFG.image_long_side
_NL = "chr(10)"
_LANG = "CASE WHEN regexp_extract(url, '/([a-z]{2})/', 1) = '' THEN 'en' ELSE regexp_extract(url, '/([a-z]{2})/', 1) END"
_TITLE = "concat('title ', page_id, ' *~&')"
_WX = "payload -> 'current'"


def _d(i: int) -> str:
    return f"(payload -> 'daily' -> {i})"


ORACLE = {
    "html_to_text": f"SELECT page_id, {_HTML_SQL} AS text FROM pages",
    "page_report": f"""
SELECT page_id, status,
       CASE WHEN status = 200 THEN concat('**Web request**', {_NL}, 'URL: ', url, {_NL}, 'Status: ', status, ' ', reason,
                                          {_NL}, {_NL}, t, {_NL}) END AS report
FROM (SELECT page_id, url, CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status,
             CASE WHEN page_id % 13 = 0 THEN 'Not Found' ELSE 'OK' END AS reason, {_HTML_SQL} AS t FROM pages) x""",
    "url_query": f"""
SELECT page_id, {_enc("concat(url, ' page ', page_id)")} AS search_q,
       concat('https://', {_LANG}, '.wikipedia.org/w/api.php?action=query&format=json&titles=', {_enc(_TITLE)},
              '&prop=revisions&rvprop=content') AS wiki_request
FROM pages""",
    "wiki_extract": with_ctes(["wiki_pages"], [("q", """
SELECT *, found AND title IS NOT NULL AND content IS NOT NULL AS ok FROM wiki_pages""")], """
SELECT id, CASE WHEN ok THEN 'ok' ELSE 'no_results' END AS status,
       CASE WHEN ok THEN concat('**Wikipedia: ', title, '**', chr(10), content)
            ELSE concat('No results for q', id, ' found in Wikipedia.') END AS text
FROM q"""),
    "weather_report": with_ctes(["weather_payloads"], [("t", f"""
SELECT id, '**Weather report' || coalesce(' for ' || CASE WHEN id % 3 = 0 THEN NULL ELSE concat('station ', id % 7) END, '')
  || '**' || {_NL}
  || 'Current: ' || ({_WX} ->> 'temp') || '°C, ' || ({_WX} -> 'weather' -> 0 ->> 'description') || {_NL}
  || 'Feels like: ' || ({_WX} ->> 'feels_like') || '°C' || {_NL}
  || 'Humidity: ' || ({_WX} ->> 'humidity') || '%' || {_NL}
  || 'Wind: ' || ({_WX} ->> 'wind_speed') || 'm/s' || {_NL}
  || 'Sunrise: ' || strftime(epoch_ms(CAST({_WX} ->> 'sunrise' AS BIGINT) * 1000), '%H:%M') || {_NL}
  || 'Sunset: ' || strftime(epoch_ms(CAST({_WX} ->> 'sunset' AS BIGINT) * 1000), '%H:%M') || {_NL} || {_NL}
  || 'Today: ' || ({_d(0)} -> 'temp' ->> 'day') || '°C, ' || ({_d(0)} -> 'weather' -> 0 ->> 'description') || ', '
  || ({_d(0)} ->> 'summary') || {_NL}
  || 'Tomorrow: ' || ({_d(1)} -> 'temp' ->> 'day') || '°C, ' || ({_d(1)} -> 'weather' -> 0 ->> 'description') || ', '
  || ({_d(1)} ->> 'summary') || {_NL} AS text
FROM weather_payloads""")], "SELECT id, CASE WHEN text IS NULL THEN 'error' ELSE 'ok' END AS status, text FROM t"),
    "calculation_lines": """
WITH q AS (SELECT DISTINCT l_orderkey AS i FROM lineitem),
l AS (SELECT l_orderkey AS i, l_linenumber AS n,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_returnflag, l_linestatus) AS r, l_returnflag = 'R' AS res, CASE WHEN l_linenumber % 4 <> 0 THEN concat('supplier ', l_suppkey) ELSE '' END AS t,
             l_linestatus AS st, l_partkey AS p, l_quantity AS qty FROM lineitem),
c AS (SELECT * FROM (SELECT *, bool_or(res) OVER (PARTITION BY i) AS has FROM l) WHERE i % 9 <> 0 AND (i % 2 <> 0 OR NOT has OR res)),
x AS (
  SELECT i, r, 0 AS k, 'text' AS kind, concat('*', t, '*') AS line FROM c WHERE t <> ''
  UNION ALL SELECT i, r, 1, 'text', concat('*', st, '*') FROM c WHERE st <> ''
  UNION ALL SELECT i, r, 2, CASE WHEN n % 2 = 0 AND i % 5 <> 0 THEN 'image' ELSE 'text' END,
    CASE WHEN n % 2 = 0 AND i % 5 <> 0 THEN concat('img-', p) ELSE concat('```', chr(10), p, chr(10), '```') END FROM c
  UNION ALL SELECT i, r, 3, 'text', concat('```', chr(10), qty::INT, chr(10), '```') FROM c WHERE n % 3 <> 0
  UNION ALL SELECT i, 0, 0, 'text', 'Could not process your query.' FROM q WHERE i % 9 = 0
  UNION ALL SELECT i, 0, 1, 'text', concat('Did you mean: order ', i) FROM q WHERE i % 18 = 0)
SELECT i AS query_id, row_number() OVER (PARTITION BY i ORDER BY r, k)::INT AS line_no, kind, line FROM x""",
    "pod_flatten": f"""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS t FROM orders),
     s AS (SELECT o.o_custkey, l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT o_custkey AS query_id, o_orderkey AS pod_pos, 0 AS sub_pos, 0 AS step, 'text' AS kind, concat('*', t, '*') AS line
FROM o WHERE t IS NOT NULL AND t <> ''
UNION ALL
SELECT o_custkey, l_orderkey, l_linenumber, 1, 'text', concat('*', l_returnflag, '*') FROM s
WHERE l_returnflag IS NOT NULL AND l_returnflag <> ''
UNION ALL
SELECT o_custkey, l_orderkey, l_linenumber, 2,
       CASE WHEN l_linenumber % 2 = 0 THEN 'image' ELSE 'text' END,
       CASE WHEN l_linenumber % 2 = 0 THEN concat('img-', l_orderkey, '-', l_linenumber)
            ELSE concat('```', {_NL}, l_partkey, {_NL}, '```') END
FROM s""",
    "result_list": f"""
SELECT l_orderkey AS order_id, concat('**Search results for order ', l_orderkey, '**', string_agg(
         concat({_NL}, 'part ', l_partkey, {_NL}, 'https://example.com/part/', l_partkey, {_NL}, 'by "', l_returnflag, '"', {_NL}),
         '' ORDER BY l_linenumber, l_partkey::VARCHAR, l_returnflag)) AS text
FROM lineitem GROUP BY l_orderkey""",
    "carrier_list": f"""
SELECT l_orderkey AS order_id, string_agg(concat('* ', l_returnflag, ' - c', l_linenumber), {_NL} ORDER BY l_linenumber, l_partkey::VARCHAR, l_returnflag) AS text
FROM lineitem GROUP BY l_orderkey""",
    "file_text": "SELECT doc_id, text FROM documents WHERE doc_id % 9 <> 0 AND text <> ''",
    "data_url": "SELECT doc_id, concat('data:text/plain;base64,', to_base64(encode(text))) AS url FROM documents",
    "outbox_envelope": with_ctes(["messages"], [("m", f"""
SELECT *, CASE WHEN starts_with(kind, '{CUSTOM}') THEN kind WHEN kind = 'm.notice' THEN 'm.notice' ELSE 'm.text' END AS mt
FROM messages""")], f"""
SELECT event_id, mt AS msgtype,
       CASE WHEN starts_with(mt, '{CUSTOM}') THEN NULL ELSE body END AS body,
       CASE WHEN starts_with(mt, '{CUSTOM}') THEN body END AS content,
       CASE WHEN starts_with(mt, '{CUSTOM}') THEN NULL ELSE 'org.matrix.custom.html' END AS format,
       CASE WHEN starts_with(mt, '{CUSTOM}') THEN NULL
            ELSE replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS formatted_body
FROM m"""),
    "file_envelope": """
SELECT doc_id, concat('doc', doc_id, '.txt') AS body, 'text/plain' AS mimetype, CAST(octet_length(encode(text)) AS BIGINT) AS size,
       'm.file' AS msgtype, concat('mxc://alpha.example/doc', doc_id) AS url
FROM documents""",
    "fit_box": with_ctes(["media_meta"], [("b", "SELECT *, CAST(w AS DOUBLE) / h AS a FROM media_meta")], f"""
SELECT media_id, w, h,
       CAST(CASE WHEN w > h AND w > {_L} THEN {_LW} WHEN NOT (w > h) AND h > {_L} THEN {_PW} ELSE w END AS INT) AS new_w,
       CAST(CASE WHEN w > h AND w > {_L} THEN {_LH} WHEN NOT (w > h) AND h > {_L} THEN {_PH} ELSE h END AS INT) AS new_h
FROM b"""),
    "word_count": """
SELECT doc_id, CAST(coalesce(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')), 0) AS INTEGER) AS words
FROM documents""",
}

QUERIES = {
    "html_to_text": q_html_to_text,
    "page_report": q_page_report,
    "url_query": q_url_query,
    "wiki_extract": q_wiki_extract,
    "weather_report": q_weather_report,
    "pod_flatten": q_pod_flatten,
    "calculation_lines": q_calculation_lines,
    "result_list": q_result_list,
    "carrier_list": q_carrier_list,
    "file_text": q_file_text,
    "data_url": q_data_url,
    "outbox_envelope": q_outbox_envelope,
    "file_envelope": q_file_envelope,
    "fit_box": q_fit_box,
    "word_count": q_word_count,
}
