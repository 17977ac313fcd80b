"""Model replies, tool calls and model routing.

Replies are parsed with ``try_parse_json`` into VARIANT, so objects, arrays,
scalars and garbage are told apart without a schema and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, TOOL_DEFAULTS, TOOL_MODELS, TOOL_REQUIRED, VISION_MODELS, BotConfig
from ..functions import decode as D
from ..functions import text as T


def strip_fence(text) -> Column:
    """drop a leading ```` ```json\\n ```` (or ```` ```\\n ````) and a
    trailing ```` ``` ````."""
    s = F.regexp_replace(T.col(text), r"^```(?:json)?\n", "")
    return F.regexp_replace(s, r"```\z", "")


def strict_parse_json(text) -> Column:
    """A VARIANT if the whole text is one JSON value, else NULL.

    ``try_parse_json`` stops after the first complete value and ignores what
    follows.  The text is therefore parsed as the first element of an array
    whose second one is the text's own digest: only if nothing but one value
    stands before it does the digest come back as the second element."""
    t = T.col(text)
    mark = F.md5(t)
    both = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), mark, F.lit('"]')))
    pair = F.try_variant_get(both, "$", "array<variant>")
    return F.when((F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == mark), F.get(pair, F.lit(0)))


def looks_like_object(text) -> Column:
    """Cheap shape test before a parse: after surrounding whitespace, ``{`` … ``}``."""
    trimmed = F.btrim(T.col(text), F.lit(" \t\n\r"))
    return F.coalesce((F.left(trimmed, F.lit(1)) == "{") & (F.right(trimmed, F.lit(1)) == "}"), F.lit(False))


def json_decode(text) -> Column:
    """fenced JSON → VARIANT; NULL when it does not parse."""
    return strict_parse_json(strip_fence(text))


def is_object(v) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(T.col(v)), F.lit("OBJECT")), F.lit(False))


def extract_tool_call(df: DataFrame, reply: str = "reply") -> DataFrame:
    """``kind`` = ``call`` (object with ``tool``; ``arguments`` = JSON of
    ``parameters``, ``{}`` when absent), ``regenerate`` (object without
    ``tool``) or ``text`` (anything else, including unparsable text)."""
    # only text shaped like an object can be a call, so nothing else is
    # parsed; each step is its own column so the reply is parsed once
    # Filters on ``kind`` are pushed below this projection with the columns
    # inlined, so every derived column refers to the parsed value once:
    # ``_call`` holds the tool key and the parameters of a call (NULL for
    # anything else), extracted in one pass over the parsed value.
    call_t = "struct<tool:variant,parameters:variant>"
    d = (df.withColumn("_s", strip_fence(reply))
         .withColumn("_v", F.when(looks_like_object("_s"), strict_parse_json("_s")))
         .withColumn("_call", F.try_variant_get("_v", "$", call_t)))
    tool_v = F.col("_call.tool")
    has_tool = tool_v.isNotNull()
    return (d.withColumn("kind", F.when(has_tool, F.lit("call")).when(F.col("_v").isNotNull(), F.lit("regenerate"))
                         .otherwise(F.lit("text")))
            .withColumn("tool", F.when(has_tool, F.try_variant_get(tool_v, "$", "string")))
            .withColumn("arguments", F.when(has_tool, F.coalesce(F.to_json(F.col("_call.parameters")), F.lit("{}"))))
            .drop("_s", "_v", "_call"))


def tool_calls(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Only the rows whose reply is a tool call, with ``tool`` and
    ``arguments``.  The selection is an ``explode`` of a one-element array
    built only for calls: a filter on a derived ``kind`` would be pushed
    below the projection with the parse inlined (parsed twice per row);
    a generator is evaluated once."""
    call_t = "struct<tool:variant,parameters:variant>"
    d = (df.withColumn("_s", strip_fence(reply))
         .withColumn("_call", F.try_variant_get(F.when(looks_like_object("_s"), strict_parse_json("_s")), "$", call_t)))
    tool_v = F.col("_call.tool")
    found = F.when(tool_v.isNotNull(), F.array(F.struct(
        F.try_variant_get(tool_v, "$", "string").alias("tool"),
        F.coalesce(F.to_json(F.col("_call.parameters")), F.lit("{}")).alias("arguments"))))
    keep = [c for c in df.columns]
    return d.select(*keep, F.explode(found).alias("_c")).select(*keep, "_c.tool", "_c.arguments")


def classify(df: DataFrame, reply: str = "reply", query: str = "query", prefix: str = "!bot") -> DataFrame:
    """F8: classifier reply ``{type, prompt}``; any failure → ``chat`` with
    the original query.  Non-chat results are rewritten to a command body
    ``<prefix> {type} {prompt}`` for the command parser (P9)."""
    parsed = F.try_variant_get(F.when(looks_like_object(reply), strict_parse_json(reply)), "$", "struct<type:string,prompt:string>")
    ok = parsed.isNotNull() & parsed["type"].isNotNull()
    typ = F.when(ok, parsed["type"]).otherwise(F.lit("chat"))
    prompt = F.when(ok, parsed["prompt"]).otherwise(T.col(query))
    return (df.withColumn("type", typ).withColumn("prompt", prompt)
            .withColumn("routed_body", F.when(F.col("type") != "chat",
                                              F.concat_ws(" ", F.lit(prefix), F.col("type"), F.col("prompt")))))


def _map_lit(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _as_text(v: Column) -> Column:
    """A JSON value as text: strings as they are, anything else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _falsy(v: Column) -> Column:
    """JSON ``null``, ``false``, a zero number, and the empty string, array and object.
    Other strings are truthy whatever they spell."""
    return F.to_json(v).rlike(r'^(?:null|false|""|\[\]|\{\}|-?0+(?:\.0*)?(?:[eE][+-]?\d+)?)$')


def normalise_tool_args(df: DataFrame, tool: str = "tool", arguments: str = "arguments") -> DataFrame:
    """Defaults fill missing arguments; every required argument must be
    present and truthy by its JSON type.  ``status``: ``ok``, ``missing_argument`` (with
    ``missing``), ``malformed`` for arguments that are not exactly one JSON object (see
    ``decode.arguments``), or ``not_found`` for an unknown tool; ``args`` is the
    merged map rendered as sorted ``k=v`` pairs, NULL unless the arguments could be read."""
    t = F.col(tool)
    # per-tool defaults and required names: literal maps keyed by tool
    all_defaults = F.create_map(*[x for name in TOOL_REQUIRED
                                  for x in (F.lit(name), _map_lit(TOOL_DEFAULTS.get(name, {})))])
    all_required = F.create_map(*[x for name in TOOL_REQUIRED
                                  for x in (F.lit(name), F.array(*[F.lit(k) for k in TOOL_REQUIRED[name]])
                                            .cast("array<string>"))])
    defaults = F.coalesce(F.try_element_at(all_defaults, t), _map_lit({}))
    required = F.coalesce(F.try_element_at(all_required, t), F.array().cast("array<string>"))
    known = t.isin(list(TOOL_REQUIRED))
    d = df.withColumn("_decoded", D.arguments(arguments))
    d = d.withColumn("_given", F.col("_decoded.value")).withColumn("_malformed", F.col("_decoded.reject").isNotNull())
    pair = lambda k, v, bad: F.struct(k.alias("key"), v.alias("value"), bad.alias("falsy"))
    own = F.transform("_given", lambda e: pair(e["key"], _as_text(e["value"]), _falsy(e["value"])))
    d = d.withColumn("_own", F.coalesce(own, F.array().cast("array<struct<key:string,value:string,falsy:boolean>>")))
    rest = F.filter(F.map_entries(defaults), lambda e: ~F.exists("_own", lambda o: o["key"] == e["key"]))
    d = d.withColumn("_merged", F.concat("_own", F.transform(rest, lambda e: pair(e["key"], e["value"], e["value"] == ""))))
    d = d.withColumn("_missing", F.filter(required, lambda k: ~F.exists("_merged", lambda m: (m["key"] == k) & ~m["falsy"])))
    rendered = F.array_join(F.transform(F.array_sort("_merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    has_missing = F.size("_missing") > 0
    return (d.withColumn("status", F.when(~known, F.lit("not_found")).when(F.col("_malformed"), F.lit("malformed"))
                         .when(has_missing, F.lit("missing_argument")).otherwise(F.lit("ok")))
            .withColumn("missing", F.when(known & ~F.col("_malformed") & has_missing, F.element_at("_missing", 1)))
            .withColumn("args", F.when(known & ~F.col("_malformed"), rendered))
            .drop("_given", "_decoded", "_malformed", "_own", "_merged", "_missing"))


def is_tool_model(model) -> Column:
    """P15."""
    return T.col(model).isin(TOOL_MODELS)


def is_vision_model(model) -> Column:
    """P15."""
    m = T.col(model)
    return m.isin(VISION_MODELS) | F.contains(m, F.lit("vision"))


def route_model(df: DataFrame, model: str = "model", use_tools: str = "use_tools",
                allow_override: str = "allow_override", cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """Model switch to the tool model, tool attachment, token cap and
    tool emulation for each request row."""
    m = F.col(model)
    tool_model = F.lit(cfg.tool_model).cast("string")
    switch = (F.col(allow_override) & F.col(use_tools) & tool_model.isNotNull()
              & ~(is_tool_model(m) | F.lit(cfg.force_tools)))
    used = F.when(switch, tool_model).otherwise(m)
    return (df.withColumn("model_used", used)
            .withColumn("overridden", switch)
            .withColumn("tools_attached", (is_tool_model("model_used") & F.col(use_tools)) | F.lit(cfg.force_tools))
            .withColumn("max_tokens", F.when(F.contains(F.col("model_used"), F.lit("gpt-4")), F.lit(cfg.max_tokens)))
            .withColumn("emulate", F.col(use_tools) & F.lit(cfg.emulate_tools) & ~F.lit(cfg.force_tools)
                        & ~is_tool_model("model_used"))
            .withColumn("vision", is_vision_model("model_used")))
