"""Service payloads and outbound envelopes as native column expressions
(F3, F4, F9-F11, F17, L4, A9, S10, S11).  JSON is parsed with explicit
schemas (``from_json``); numbers that are printed back are read as strings
so their text is kept exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (CALC_DID_YOU_MEAN, CALC_FAILED, DEFAULT_CONFIG, HTML_MESSAGE_FORMAT, CARRIER_LINE,
                      SEARCH_HEADER, SEARCH_RESULT, WEATHER_REPORT, WIKI_NO_RESULTS, WIKI_REPORT, WIKI_REQUEST, WIKI_REQUEST_ARGS, BotConfig)
from .text import col, fill, let

# --------------------------------------------------------------------- F3/F4


def form_encode(value) -> Column:
    """``quote_plus`` (form encoding, space → ``+``).  The JVM encoder
    keeps ``*`` and escapes ``~``; ``quote_plus`` does the opposite."""
    e = F.url_encode(col(value))
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_string(pairs: list[tuple[str, Column | str]]) -> Column:
    """``k1=v1&k2=v2`` with both sides form-encoded, in the given order."""
    parts = [F.concat(form_encode(F.lit(k)), F.lit("="), form_encode(v if isinstance(v, Column) else F.lit(v)))
             for k, v in pairs]
    return F.concat_ws("&", *parts)


def wiki_url(query, language="en") -> Column:
    """The encyclopedia request of the lookup tool."""
    lang = language if isinstance(language, Column) else F.lit(language)
    qs = query_string([(k, col(query) if v is None else v) for k, v in WIKI_REQUEST_ARGS])
    return fill(WIKI_REQUEST, language=lang, query=qs)


# ------------------------------------------------------------------------ F9

WIKI_SCHEMA = "struct<query:struct<pages:map<string,struct<title:string,revisions:array<struct<`*`:string>>>>>>"


def wiki_report(payload, query) -> tuple[Column, Column]:
    """F9 + L4: first page of ``query.pages`` → ``revisions[0].*``.
    Returns ``(status, text)``; any missing part → ``no_results``."""
    doc = F.from_json(col(payload), WIKI_SCHEMA)
    page = F.try_element_at(F.map_values(doc["query"]["pages"]), F.lit(1))
    content = F.try_element_at(page["revisions"], F.lit(1))["*"]
    ok = page["title"].isNotNull() & content.isNotNull()
    text = F.when(ok, fill(WIKI_REPORT, title=page["title"], content=content)) \
        .otherwise(fill(WIKI_NO_RESULTS, query=col(query)))
    return F.when(ok, F.lit("ok")).otherwise(F.lit("no_results")), text


# ----------------------------------------------------------------------- F10

_W = "array<struct<description:string>>"
WEATHER_SCHEMA = (f"struct<current:struct<temp:string,feels_like:string,humidity:string,wind_speed:string,"
                  f"sunrise:bigint,sunset:bigint,weather:{_W}>,"
                  f"daily:array<struct<temp:struct<day:string>,summary:string,weather:{_W}>>>")


def _hhmm(epoch) -> Column:
    """``HH:mm`` of an epoch second in UTC, computed arithmetically so the
    result does not depend on the session time zone."""
    s = F.pmod(col(epoch), F.lit(86400))
    hh = F.lpad((s / 3600).cast("int").cast("string"), 2, "0")
    mm = F.lpad(((s % 3600) / 60).cast("int").cast("string"), 2, "0")
    return F.concat(hh, F.lit(":"), mm)


def weather_text(payload, name=None) -> Column:
    """the weather report; NULL when a needed field is missing.  The payload is parsed once."""
    def text_of(d: Column) -> Column:
        cur = d["current"]
        day0 = F.try_element_at(d["daily"], F.lit(1))
        day1 = F.try_element_at(d["daily"], F.lit(2))

        def desc(w):
            return F.try_element_at(w["weather"], F.lit(1))["description"]

        nm = col(name) if name is not None else F.lit(None).cast("string")
        return fill(WEATHER_REPORT,             # NULL as soon as any part is missing
                    for_name=F.when(nm != "", F.concat(F.lit(" for "), nm)).otherwise(F.lit("")),
                    temp=cur["temp"], description=desc(cur), feels_like=cur["feels_like"],
                    humidity=cur["humidity"], wind_speed=cur["wind_speed"],
                    sunrise=_hhmm(cur["sunrise"]), sunset=_hhmm(cur["sunset"]),
                    day0=day0["temp"]["day"], description0=desc(day0), summary0=day0["summary"],
                    day1=day1["temp"]["day"], description1=desc(day1), summary1=day1["summary"])

    return let(F.from_json(col(payload), WEATHER_SCHEMA), text_of)


def weather_reports(payloads: DataFrame, payload: str = "payload", name=None) -> DataFrame:
    """all columns, ``status`` (``error`` when a needed field is missing) and ``text``.  The payload is parsed once a row."""
    d = payloads.withColumn("text", weather_text(payload, name))
    return d.withColumn("status", F.when(F.col("text").isNull(), F.lit("error")).otherwise(F.lit("ok")))


# ----------------------------------------------------------------------- F11


def flatten_pods(nested: DataFrame, id_col: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Nested calculation results → ``(pods, subpods)`` tables with
    positions (``posexplode``, narrow)."""
    p = nested.select(id_col, F.posexplode("pods").alias("pod_pos", "pod"))
    pods = p.select(id_col, (F.col("pod_pos") + 1).alias("pod_pos"), F.col("pod.title").alias("title"))
    subs = (p.select(id_col, (F.col("pod_pos") + 1).alias("pod_pos"), F.posexplode("pod.subpods").alias("sub_pos", "s"))
            .select(id_col, "pod_pos", (F.col("sub_pos") + 1).alias("sub_pos"), F.col("s.title").alias("title"),
                    F.col("s.img").alias("img"), F.col("s.plaintext").alias("plaintext")))
    return pods, subs


def pod_lines(pods: DataFrame, subpods: DataFrame, text: bool = False, id_col: str = "query_id") -> DataFrame:
    """F11 + X6: the lines a calculation result is sent as.

    Per pod a ``*title*`` line when the title is non-empty; per subpod a
    ``*title*`` line, then its image unless ``text``, else its plaintext in
    a code fence.  ``(pod_pos, sub_pos, step)`` orders the lines."""
    pod_l = (pods.where(F.col("title").isNotNull() & (F.col("title") != ""))
             .select(id_col, "pod_pos", F.lit(0).alias("sub_pos"), F.lit(0).alias("step"),
                     F.lit("text").alias("kind"), F.concat(F.lit("*"), F.col("title"), F.lit("*")).alias("line")))
    title_l = F.when(F.col("title").isNotNull() & (F.col("title") != ""),
                     F.struct(F.lit(1).alias("step"), F.lit("text").alias("kind"),
                              F.concat(F.lit("*"), F.col("title"), F.lit("*")).alias("line")))
    use_img = F.col("img").isNotNull() & (F.col("img") != "") & F.lit(not text)
    body_l = (F.when(use_img, F.struct(F.lit(2).alias("step"), F.lit("image").alias("kind"), F.col("img").alias("line")))
              .when(F.col("plaintext").isNotNull() & (F.col("plaintext") != ""),
                    F.struct(F.lit(2).alias("step"), F.lit("text").alias("kind"),
                             F.concat(F.lit("```\n"), F.col("plaintext"), F.lit("\n```")).alias("line"))))
    sub_l = (subpods.select(id_col, "pod_pos", "sub_pos",
                            F.explode(F.filter(F.array(title_l, body_l), lambda x: x.isNotNull())).alias("l"))
             .select(id_col, "pod_pos", "sub_pos", "l.step", "l.kind", "l.line"))
    return pod_l.unionByName(sub_l)


def choose_pods(results_only: bool, pods: DataFrame, results: DataFrame) -> DataFrame:
    """F11 head: the results pods when ``results_only`` and the query has
    any, else all pods (per query, via a semi/anti join on the id)."""
    if not results_only:
        return pods
    with_results = results.select("query_id").distinct()
    return results.unionByName(pods.join(with_results, "query_id", "left_anti"))


def failed_query_lines(suggestion) -> Column:
    """F11 failure: a fixed line plus an optional "Did you mean" line."""
    s = col(suggestion)
    return F.filter(F.array(F.lit(CALC_FAILED), fill(CALC_DID_YOU_MEAN, suggestion=s)), lambda x: x.isNotNull())


PODS = "array<struct<title:string,is_result:boolean,subpods:array<struct<title:string,img:string,plaintext:string>>>>"


def calculation_lines(results: DataFrame, id_col: str = "query_id") -> DataFrame:
    """F11 + X6 on nested results: every line that is sent for each query, in order, from one generator a record.

    ``results(id, success, suggestion, results_only, text, pods)``.  A failed query has its fixed line and,
    with a suggestion, a second one.  Otherwise the pods are those marked as results if these are
    asked for and there are any, else all; a pod gives its title, a subpod its title and its image
    (unless ``text``) or its plaintext in a code fence.  Empty and missing titles and texts give no line.
    Returns the id, ``line_no`` (from 1), ``kind`` (``text`` or ``image``) and ``line``."""
    line = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("line"))
    some = lambda c: F.coalesce(c != "", F.lit(False))
    none = "array<struct<kind:string,line:string>>"

    def title(x: Column) -> Column:
        return F.when(some(x["title"]), line("text", F.concat(F.lit("*"), x["title"], F.lit("*"))))

    def subpod(x: Column) -> Column:
        body = F.when(some(x["img"]) & ~F.col("text"), line("image", x["img"])) \
            .when(some(x["plaintext"]), line("text", F.concat(F.lit("```\n"), x["plaintext"], F.lit("\n```"))))
        return F.array(title(x), body)

    def of_pods(pods: Column) -> Column:
        best = F.filter(pods, lambda p: F.coalesce(p["is_result"], F.lit(False)))
        chosen = F.when(F.col("results_only") & (F.size(best) > 0), best).otherwise(pods)
        return F.flatten(F.transform(chosen, lambda p: F.concat(
            F.array(title(p)), F.flatten(F.transform(F.coalesce(p["subpods"], F.array().cast("array<struct<title:string,img:string,plaintext:string>>")), subpod)))))

    failed = F.transform(failed_query_lines("suggestion"), lambda x: line("text", x))
    lines = F.when(~F.col("success"), failed.cast(none)).otherwise(F.coalesce(of_pods(F.col("pods").cast(PODS)).cast(none), F.array().cast(none)))
    kept = F.filter(lines, lambda x: x.isNotNull())
    return results.select(id_col, F.posexplode(kept).alias("_n", "l")).select(id_col, (F.col("_n") + 1).alias("line_no"), "l.kind", "l.line")


# ------------------------------------------------------------------------ A9


def item_list(payload, fields: list[str], template: str, sep: str = "") -> Column:
    """Every element of a JSON array of objects, rendered in its order.  A
    function of the row: nothing is grouped, cut or moved.  NULL for a payload that is
    no array; an element that lacks a field renders as an empty string."""
    items = F.from_json(col(payload), "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    return F.array_join(F.transform(items, lambda x: F.coalesce(fill(template, **{f: x[f] for f in fields}), F.lit(""))), sep)


def result_list(payload, query) -> Column:
    """All results of a search, after its header."""
    return F.concat(fill(SEARCH_HEADER, query=col(query)), item_list(payload, ["title", "url", "description"], SEARCH_RESULT))


def carrier_list(payload) -> Column:
    """All carriers, one line each."""
    return item_list(payload, ["name", "code"], CARRIER_LINE, "\n")


# ----------------------------------------------------------------------- F17


def _round_aspect(cands: tuple[Column, Column], err) -> Column:
    lo, hi = cands
    pick = F.when(err(hi) < err(lo), hi).otherwise(lo)     # first minimum wins
    return F.greatest(pick, F.lit(1))


def _thumbnail(w: Column, h: Column, bx: int, by: int) -> tuple[Column, Column]:
    """Aspect-preserving fit into ``(bx, by)``, never enlarging; of the two
    integer neighbours the one closer to the original aspect is taken."""
    aspect = w / h
    x_fit = F.lit(bx) / F.lit(by) >= aspect
    yx = F.lit(by) * aspect
    new_x = _round_aspect((F.floor(yx), F.ceil(yx)), lambda n: F.abs(aspect - n / F.lit(by)))
    xy = F.lit(bx) / aspect
    new_y = _round_aspect((F.floor(xy), F.ceil(xy)),
                          lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.abs(aspect - F.lit(bx) / n)))
    fits = (F.lit(bx) >= w) & (F.lit(by) >= h)
    out_w = F.when(fits, w).when(x_fit, new_x).otherwise(F.lit(bx))
    out_h = F.when(fits, h).when(x_fit, F.lit(by)).otherwise(new_y)
    return out_w.cast("int"), out_h.cast("int")


def fit_box(w, h, cfg: BotConfig = DEFAULT_CONFIG) -> tuple[Column, Column]:
    """landscape images wider than the long side go into (long, short);
    other images taller than the long side go into (short, long); a zero
    limit disables resizing."""
    W, H = col(w), col(h)
    long_, short = cfg.image_long_side, cfg.image_short_side
    if not (long_ and short):
        return W.cast("int"), H.cast("int")
    lw, lh = _thumbnail(W, H, long_, short)
    pw, ph = _thumbnail(W, H, short, long_)
    land = W > H
    new_w = F.when(land & (W > long_), lw).when(~land & (H > long_), pw).otherwise(W)
    new_h = F.when(land & (W > long_), lh).when(~land & (H > long_), ph).otherwise(H)
    return new_w.cast("int"), new_h.cast("int")


# ------------------------------------------------------------------ S10/S11


def html_escape(text) -> Column:
    t = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def message_envelope(body, notice=None, msgtype=None,
                     custom_prefix: str = DEFAULT_CONFIG.custom_kind_prefix + ".") -> tuple[Column, Column]:
    """``(msgtype, content JSON)``: the given type, else ``m.notice``
    for notices, else ``m.text``; custom types carry ``{msgtype, content}``,
    others ``{msgtype, body, format, formatted_body}`` (the formatted body is
    the HTML-escaped text; markdown rendering is not part of the engine)."""
    n = col(notice) if notice is not None else F.lit(False)
    mt = F.coalesce(col(msgtype) if msgtype is not None else F.lit(None).cast("string"),
                    F.when(n, F.lit("m.notice")).otherwise(F.lit("m.text")))
    custom = F.to_json(F.struct(mt.alias("msgtype"), col(body).alias("content")))
    plain = F.to_json(F.struct(mt.alias("msgtype"), col(body).alias("body"),
                               F.lit(HTML_MESSAGE_FORMAT).alias("format"),
                               html_escape(body).alias("formatted_body")))
    return mt, F.when(F.startswith(mt, F.lit(custom_prefix)), custom).otherwise(plain)


def file_envelope(filename, mimetype, content, msgtype, url, w=None, h=None) -> Column:
    """``{body, info{mimetype, size[, w, h]}, msgtype, url}``."""
    info = [col(mimetype).alias("mimetype"), F.octet_length(col(content)).alias("size")]
    if w is not None:
        info += [col(w).alias("w"), col(h).alias("h")]
    return F.to_json(F.struct(col(filename).alias("body"), F.struct(*info).alias("info"),
                              col(msgtype).alias("msgtype"), col(url).alias("url")))
