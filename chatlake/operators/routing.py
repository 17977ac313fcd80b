"""Event dispatch, message routing and command parsing (P2, P3, P8-P10,
P13, P22, P23, J7, F19).

Every operator is a projection or a filter over the message table — no
shuffle.  Fixed registries (J7) are literal maps, so a lookup is a
projection too; registries kept in storage use an equi join instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COMMANDS, DEFAULT_CONFIG, ORIENTATION_SIZES, SPACE_SUBCOMMANDS, TEXT_KIND, TOOLS, BotConfig
from ..functions import text as T

MEMBER_KIND = "m.member"
INVITE_KIND = "m.invite"


def handlers_for(kind) -> Column:
    """Handlers an event is dispatched to (several may match)."""
    k = T.col(kind)
    return F.filter(F.array(
        F.when(k == INVITE_KIND, F.lit("invite")),
        F.when(k == TEXT_KIND, F.lit("message")),
        F.when(k == MEMBER_KIND, F.lit("membership"))), lambda h: h.isNotNull())


def dispatch(events: DataFrame) -> DataFrame:
    """One row per (event, matching handler)."""
    return events.withColumn("handler", F.explode(handlers_for("kind")))


def drop_own(events: DataFrame, cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """Drop the bot's own events."""
    return events.where(F.col("sender") != F.lit(cfg.bot_id))


def route(sender="sender", body="body", cfg: BotConfig = DEFAULT_CONFIG) -> Column:
    """``ignore`` (own), ``command`` (prefix or edited ``* prefix``),
    ``foreign`` (another bot's ``!`` command) or ``query``.  Plain prefix
    test, no word boundary."""
    b = T.col(body)
    return (F.when(T.col(sender) == F.lit(cfg.bot_id), F.lit("ignore"))
            .when(F.startswith(b, F.lit(cfg.prefix)) | F.startswith(b, F.lit("* " + cfg.prefix)), F.lit("command"))
            .when(F.startswith(b, F.lit("!")), F.lit("foreign"))
            .otherwise(F.lit("query")))


def strip_edit_marker(body="body") -> Column:
    """Remove a leading ``"* "`` (edited message)."""
    b = T.col(body)
    return F.when(F.startswith(b, F.lit("* ")), F.substr(b, F.lit(3))).otherwise(b)


def parse_command(df: DataFrame, body: str = "body") -> DataFrame:
    """``tokens``, ``command`` (2nd token or NULL) and ``args`` (tokens 3..
    joined by one space, NULL when none)."""
    toks = T.tokens(strip_edit_marker(body))
    return (df.withColumn("tokens", toks)
            .withColumn("command", F.try_element_at(F.col("tokens"), F.lit(2)))
            .withColumn("args", F.when(F.size("tokens") > 2,
                                       F.array_join(T.tail("tokens", 3), " "))))


def registry_map(names: list[str] | dict[str, str]) -> Column:
    """A fixed name → handler registry as a literal map.  Looking a name up
    is a projection: no join and nothing to broadcast."""
    pairs = names.items() if isinstance(names, dict) else ((n, n) for n in names)
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def registry(spark: SparkSession, names: list[str]) -> DataFrame:
    """The same registry as a table (for registries that live in storage:
    join it with ``join_registry``)."""
    return spark.createDataFrame([(n, n) for n in names], "name string, handler string")


def join_registry(df: DataFrame, reg: DataFrame, key: str) -> DataFrame:
    """J7 against a registry table: a left equi join; AQE broadcasts the
    registry when its measured size is under the threshold."""
    r = reg.withColumnRenamed("name", "_name")
    return df.join(r, F.col(key) == F.col("_name"), "left").drop("_name")


def lookup_command(df: DataFrame, command: str = "command") -> DataFrame:
    """Command name → handler; unknown or missing → ``unknown``."""
    return df.withColumn("handler", F.coalesce(F.try_element_at(registry_map(COMMANDS), F.col(command)),
                                               F.lit("unknown")))


def lookup_tool(df: DataFrame, tool: str = "tool") -> DataFrame:
    """Tool name → tool; unknown → status ``not_found``."""
    impl = F.try_element_at(registry_map(TOOLS), F.col(tool))
    return (df.withColumn("tool_impl", impl)
            .withColumn("tool_status", F.when(F.col("tool_impl").isNull(), F.lit("not_found")).otherwise(F.lit("ok"))))


def space_request(tokens="tokens") -> Column:
    """the case-folded sub-command of ``space`` when the body has exactly
    three tokens and it is a known one; else NULL (status report)."""
    t = T.col(tokens)
    sub = F.lower(F.try_element_at(t, F.lit(3)))
    return F.when((F.size(t) == 3) & sub.isin(SPACE_SUBCOMMANDS), sub)


def _remove_first(arr: Column, value: str) -> Column:
    pos = F.array_position(arr, F.lit(value))
    return F.filter(arr, lambda x, i: (i + 1) != pos)


def calculate_flags(df: DataFrame, body: str = "body") -> DataFrame:
    """Strip the first ``--text`` and the first ``--details`` anywhere in
    the prompt; ``text`` turns on, ``results_only`` off; an empty rest gives
    ``status = need_prompt``."""
    prompt = T.tail(T.tokens(body), 3)
    has_text = F.array_contains(prompt, "--text")
    p1 = F.when(has_text, _remove_first(prompt, "--text")).otherwise(prompt)
    has_details = F.array_contains(p1, "--details")
    p2 = F.when(has_details, _remove_first(p1, "--details")).otherwise(p1)
    rest = F.array_join(p2, " ")
    return (df.withColumn("text", has_text).withColumn("results_only", ~has_details)
            .withColumn("prompt", rest)
            .withColumn("status", F.when(rest == "", F.lit("need_prompt")).otherwise(F.lit("ok"))))


def image_flags(df: DataFrame, prompt: str = "prompt", orientation: Column | None = None,
                cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """Image size from an orientation argument or a leading
    ``--portrait`` / ``--landscape`` token (only for the model that supports
    sizes); the flag token is removed only when it decided the size.
    ``quality`` is ``hd`` for that model, else ``standard``."""
    orient = orientation if orientation is not None else F.lit(None).cast("string")
    toks = T.tokens(prompt)
    first = F.try_element_at(toks, F.lit(1))
    sized = F.lit(cfg.image_model == "dall-e-3")
    portrait_arg = F.coalesce(orient == "portrait", F.lit(False))
    landscape_arg = F.coalesce(orient == "landscape", F.lit(False))
    portrait_flag = F.coalesce(first == "--portrait", F.lit(False))
    landscape_flag = F.coalesce(first == "--landscape", F.lit(False))
    size = (F.when(sized & (portrait_arg | portrait_flag), F.lit(ORIENTATION_SIZES["portrait"]))
            .when(sized & (landscape_arg | landscape_flag), F.lit(ORIENTATION_SIZES["landscape"]))
            .otherwise(F.lit(ORIENTATION_SIZES["square"])))
    delete_first = sized & ((~portrait_arg & portrait_flag) |
                            (~portrait_arg & ~portrait_flag & ~landscape_arg & landscape_flag))
    new_prompt = F.when(delete_first, F.array_join(T.tail(toks, 2), " ")).otherwise(T.col(prompt))
    return (df.withColumn("size", size).withColumn("image_prompt", new_prompt)
            .withColumn("quality", F.lit("hd" if cfg.image_model == "dall-e-3" else "standard")))


def reply_gate(df: DataFrame, always_reply: str = "always_reply", from_chat_command: str | None = None,
               cfg: BotConfig = DEFAULT_CONFIG) -> Column:
    """P10: reply when asked through the chat command, when the room always
    replies, or when the body mentions the bot."""
    fc = F.col(from_chat_command) if from_chat_command else F.lit(False)
    return fc | F.col(always_reply) | F.coalesce(F.contains(F.col("body"), F.lit(cfg.bot_id)), F.lit(False))
