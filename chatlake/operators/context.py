"""Context assembly: history window (W1), token budget (W2), media merge
(W3) and prompt sequence assembly (U1, U2, P13, P17-P19).

All windows partition by ``room_id``.  The first one ranks newest-first
and is cut at ``2n`` rows with ``row_number() <= k``, which Catalyst turns
into a ``WindowGroupLimit`` on both sides of the exchange, after a limit by (room,
salt) whose salt is constant within a split: a split sends ``2n`` rows of a room at
most, a first-level reducer gets ``2n * splits / SALTS`` of them, and the
room's reducer ``2n * SALTS``, however many splits hold the room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (AUDIO_KIND, DEFAULT_CONFIG, FILE_KIND, IMAGE_KIND, MEDIA_KINDS,
                      NOTICE_KIND, TEXT_KIND, VIDEO_KIND, BotConfig)
from ..functions import text as T



def newest_first():
    """Rooms, newest message first (built lazily: window specs need a
    session, and this module is also imported inside Python workers)."""
    return Window.partitionBy("room_id").orderBy(F.col("seq").desc())


def running_newest():
    return newest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def role_of(sender, cfg: BotConfig = DEFAULT_CONFIG) -> Column:
    """The bot's own messages are ``assistant``, everyone else ``user``."""
    return F.when(T.col(sender) == F.lit(cfg.bot_id), F.lit("assistant")).otherwise(F.lit("user"))


def is_marker(cfg: BotConfig = DEFAULT_CONFIG) -> Column:
    """A text body that is exactly ``<prefix> ignoreolder``."""
    return (F.col("kind") == TEXT_KIND) & T.is_exact_command(F.col("body"), [cfg.prefix, "ignoreolder"])


def context_eligible(cfg: BotConfig = DEFAULT_CONFIG, ignore_notices: bool = True) -> Column:
    """Which history rows may enter the context.

    Custom kinds are kept; text is kept unless it starts with ``!`` (it is
    still kept when its second token is ``custom``); notices only when
    ``ignore_notices`` is off; media is kept; anything else is dropped.
    """
    kind, body = F.col("kind"), F.col("body")
    second = T.token_at(body, 2)
    text_ok = (~F.startswith(body, F.lit("!"))) | F.coalesce(second == "custom", F.lit(False))
    return (F.when(F.startswith(kind, F.lit(cfg.custom_kind_prefix)), F.lit(True))
            .when(kind == TEXT_KIND, F.coalesce(text_ok, F.lit(False)))
            .when(kind == NOTICE_KIND, F.lit(not ignore_notices))
            .when(kind.isin(MEDIA_KINDS), F.lit(True))
            .otherwise(F.lit(False)))


def resolve_kind(events: DataFrame) -> DataFrame:
    """An event's ``kind`` is its ``type``, else the ``msgtype`` of its ``content`` (JSON).
    ``kind_status``: ``ok``; without either, ``ignored`` for membership events
    (``membership`` not NULL), which are skipped quietly, and ``unprocessable`` for
    others, which deserve a warning."""
    kind = F.coalesce(F.col("type"), F.get_json_object("content", "$.msgtype"))
    return events.withColumn("kind", kind).withColumn(
        "kind_status", F.when(F.col("kind").isNotNull(), "ok").when(F.col("membership").isNotNull(), "ignored").otherwise("unprocessable"))


#: Groups of splits that a room's messages are limited in before the limit of the room itself.
SALTS = 256


def newest_raw(messages: DataFrame, k: int, salts: int = SALTS) -> DataFrame:
    """L1: the ``k`` newest rows of each room with ``raw_rank``, in two levels.

    A limit by room alone leaves ``k`` rows of each split to one reducer, which for a
    room in all splits grows with their number.  Splits are therefore dealt into ``salts``
    groups and rows limited by (room, group) first.  All rows of a split are in one group, so its own limit
    leaves ``k`` rows of a room, as a plain limit would, and the total shuffle is that of a plain limit
    and ``salts * k`` rows of a room more.  Which group a split is in has no influence on the result."""
    part = Window.partitionBy("room_id", "_salt").orderBy(F.col("seq").desc())
    first = (messages.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withColumn("_part_rank", F.row_number().over(part))
             .where(F.col("_part_rank") <= k).drop("_salt", "_part_rank"))
    return first.withColumn("raw_rank", F.row_number().over(newest_first())).where(F.col("raw_rank") <= k)


def last_n_messages(messages: DataFrame, cfg: BotConfig = DEFAULT_CONFIG, n: int | None = None,
                    ignore_notices: bool = True) -> DataFrame:
    """S1 + P1 + P7 + W1 + L1: the context window of every room.

    Newest-first over at most ``2n`` raw rows (L1), stop at an
    ``ignoreolder`` marker (any sender), keep eligible rows, stop at ``n``
    kept rows.  Returns the kept rows with ``ctx_rank`` (1 = newest); order
    by ``seq`` for the chronological list (L2).
    """
    n = n or cfg.max_messages
    # Rows without a kind still occupy a slot of the fetched page; they
    # are never kept (context_eligible is false for a NULL kind).
    raw = newest_raw(messages, 2 * n)
    flagged = (raw
               .withColumn("_marker", F.when(is_marker(cfg), 1).otherwise(0))
               .withColumn("_keep", F.when(context_eligible(cfg, ignore_notices), 1).otherwise(0))
               .withColumn("_markers_seen", F.sum("_marker").over(running_newest()))
               .withColumn("ctx_rank", F.sum("_keep").over(running_newest())))
    return (flagged
            .where((F.col("_markers_seen") == 0) & (F.col("_keep") == 1) & (F.col("ctx_rank") <= n))
            .drop("_marker", "_keep", "_markers_seen"))


def context_with_trigger(messages: DataFrame, cfg: BotConfig = DEFAULT_CONFIG, n: int | None = None,
                         ignore_notices: bool = True) -> DataFrame:
    """W1 + P13 in the same window: the trigger is the room's newest row
    (``raw_rank = 1``); its history copy is dropped and the trigger is put
    last (``is_trigger``, ``pos``), whether or not it is eligible for the
    context.  No aggregation or join: everything stays inside the one
    shuffle by room."""
    n = n or cfg.max_messages
    raw = newest_raw(messages, 2 * n)
    flagged = (raw
               .withColumn("_marker", F.when(is_marker(cfg), 1).otherwise(0))
               .withColumn("_keep", F.when(context_eligible(cfg, ignore_notices), 1).otherwise(0))
               .withColumn("_markers_seen", F.sum("_marker").over(running_newest()))
               .withColumn("ctx_rank", F.sum("_keep").over(running_newest())))
    in_ctx = (F.col("_markers_seen") == 0) & (F.col("_keep") == 1) & (F.col("ctx_rank") <= n)
    rows = (flagged.withColumn("is_trigger", F.col("raw_rank") == 1)
            .where(in_ctx | F.col("is_trigger"))
            .drop("_marker", "_keep", "_markers_seen"))
    order = Window.partitionBy("room_id").orderBy(F.col("is_trigger"), F.col("seq"))
    return rows.withColumn("pos", F.row_number().over(order))


def truncate_to_budget(ctx: DataFrame, max_tokens: int, cost: Column | str = "cost",
                       system_cost: Column | int = 0) -> DataFrame:
    """Token-budget truncation of every room's context.

    Order = the oldest context row first (pinned), then newest to older.
    Rows are added while ``system + running cost <= max_tokens`` and the
    walk stops at the first overflow.  Every cost is >= 1, so the running
    sum is strictly increasing and the stop equals the filter
    ``cum <= budget``; an overflowing pin or system message leaves no rows.
    Output columns: ``pinned``, ``cost``, ``cum``.
    """
    sys_cost = system_cost if isinstance(system_cost, Column) else F.lit(system_cost)
    oldest = Window.partitionBy("room_id")
    order = Window.partitionBy("room_id").orderBy(F.col("pinned").desc(), F.col("seq").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = ctx.withColumn("cost", T.col(cost)) if not (isinstance(cost, str) and cost == "cost") else ctx
    return (c.withColumn("pinned", F.col("seq") == F.min("seq").over(oldest))
            .withColumn("cum", sys_cost + F.sum("cost").over(order))
            .where(F.col("cum") <= F.lit(max_tokens)))


def media_kind_branch(cfg: BotConfig = DEFAULT_CONFIG) -> Column:
    """How a context row enters the prompt.

    ``text`` – text/notice body; ``audio`` – audio or ``*.mp3`` file, body
    as text; ``file`` – other files, decoded as UTF-8 text; ``image`` /
    ``video`` when enabled; else ``drop``.  A ``.mp4`` file is caught by the
    generic file branch first.
    """
    kind, body = F.col("kind"), F.col("body")
    return (F.when(kind.isin(TEXT_KIND, NOTICE_KIND), F.lit("text"))
            .when((kind == AUDIO_KIND) | ((kind == FILE_KIND) & F.endswith(body, F.lit(".mp3"))), F.lit("audio"))
            .when(kind == FILE_KIND, F.lit("file"))
            .when((kind == IMAGE_KIND) & F.lit(cfg.vision), F.lit("image"))
            .when((kind == VIDEO_KIND) & F.lit(cfg.video), F.lit("video"))
            .otherwise(F.lit("drop")))


PART = "struct<type:string,text:string,url:string>"


def prepare_messages(ctx: DataFrame, cfg: BotConfig = DEFAULT_CONFIG,
                     attachments: DataFrame | None = None) -> DataFrame:
    """P11 + P12 + S8 + S9 + P25 + W3: context rows → prompt messages.

    ``attachments(event_id, content BINARY, mimetype)`` holds fetched
    attachment bytes; a file, image or video row without bytes counts as a
    failed fetch and becomes a ``system`` message holding its body (P25).
    Without an attachments table, images and videos reference their event
    URL and files fail.  Image and video parts append to the preceding
    emitted message of the same role, else open a new message (W3,
    gaps-and-islands).  Output: one row per message with
    ``(room_id, msg_seq, role, parts)``; ``msg_seq`` is the first row's seq.
    """
    from ..sources.attachments import data_url, utf8_text

    rows = ctx.withColumn("branch", media_kind_branch(cfg)).where(F.col("branch") != "drop")
    rows = rows.withColumn("role", role_of("sender", cfg))
    if attachments is not None:
        # Reduce the (large) attachments table to the media rows of the
        # context first: a semi join whose small side (context ids, at most
        # n per room) can be broadcast, so attachment bytes are not shuffled.
        wanted = rows.where(F.col("branch").isin("file", "image", "video")).select("event_id")
        att = (attachments.join(wanted, "event_id", "left_semi")
               .select("event_id", F.col("content").alias("_bytes"), F.col("mimetype").alias("_mime")))
        rows = rows.join(att, "event_id", "left")
    else:
        rows = (rows.withColumn("_bytes", F.lit(None).cast("binary"))
                .withColumn("_mime", F.lit(None).cast("string")))
    has_url = "url" in ctx.columns
    ref_url = F.col("url") if has_url else F.concat(F.lit("mxc://"), F.col("event_id"))
    branch = F.col("branch")
    file_text = utf8_text(F.col("_bytes"))
    failed = ((branch == "file") & F.col("_bytes").isNull()) | \
        (branch.isin("image", "video") & F.col("_bytes").isNull() & F.lit(attachments is not None))
    media_url = F.when(F.col("_bytes").isNotNull(), data_url(F.col("_mime"), F.col("_bytes"))).otherwise(ref_url)
    rows = (rows
            .withColumn("role", F.when(failed, F.lit("system")).otherwise(F.col("role")))
            .withColumn("part", F.when(failed, F.struct(F.lit("text").alias("type"), F.col("body").alias("text"),
                                                        F.lit(None).cast("string").alias("url")))
                        .when(branch.isin("text", "audio"),
                              F.struct(F.lit("text").alias("type"), F.col("body").alias("text"),
                                       F.lit(None).cast("string").alias("url")))
                        .when(branch == "file",
                              F.struct(F.lit("text").alias("type"), file_text.alias("text"),
                                       F.lit(None).cast("string").alias("url")))
                        .otherwise(F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                                            media_url.alias("url"))))
            .withColumn("is_media", branch.isin("image", "video") & ~failed)
            # undecodable or empty files are dropped silently
            .where(~((branch == "file") & ~failed & (F.col("part.text").isNull() | (F.col("part.text") == "")))))
    w = Window.partitionBy("room_id").orderBy("seq")
    prev_role = F.lag("role").over(w)
    starts = (~F.col("is_media")) | prev_role.isNull() | (prev_role != F.col("role"))
    grouped = (rows.withColumn("_start", F.when(starts, 1).otherwise(0))
               .withColumn("grp", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return (grouped.groupBy("room_id", "grp")
            .agg(F.min("seq").alias("msg_seq"),
                 F.min_by("role", "seq").alias("role"),
                 F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("_parts"))
            .select("room_id", "msg_seq", "role",
                    F.transform("_parts", lambda x: x["part"]).alias("parts")))


# --------------------------------------------------------------------------
# Prompt sequences (U1, U2, P17-P19).  Per-room arrays are only built from
# the context window, whose size is bounded by ``n`` (W1), never from a
# whole room.

MSG = "struct<seq:bigint,role:string,content:string,tool_call_id:string>"


def prompt_arrays(rows: DataFrame, content: str = "body", tool_kinds_prefix: str | None = None) -> DataFrame:
    """Context rows → one ordered message array per room.  Rows of custom
    kinds (``tool_kinds_prefix``) become ``tool`` messages carrying their
    event id as ``tool_call_id``."""
    is_tool = F.startswith(F.col("kind"), F.lit(tool_kinds_prefix)) if tool_kinds_prefix else F.lit(False)
    msg = F.struct(F.col("seq").cast("bigint").alias("seq"),
                   F.when(is_tool, F.lit("tool")).otherwise(F.col("role")).alias("role"),
                   F.col(content).alias("content"),
                   F.when(is_tool, F.col("event_id")).alias("tool_call_id"))
    return rows.groupBy("room_id").agg(F.array_sort(F.collect_list(msg)).alias("messages"))


def text_parts_only(msgs: DataFrame, parts: str = "parts") -> DataFrame:
    """Keep text parts; messages left without any are dropped."""
    return (msgs.withColumn(parts, F.filter(parts, lambda p: p["type"] == "text"))
            .where(F.size(parts) > 0))


def contents_only(msgs: DataFrame, parts: str = "parts") -> DataFrame:
    """The contents of each message without its role."""
    return msgs.select("room_id", "msg_seq", F.col(parts).alias("content"))


def rewrite_tool_roles(messages) -> Column:
    """``tool`` → ``system`` and ``tool_call_id`` removed; NULL entries
    (non-records) dropped."""
    kept = F.filter(T.col(messages), lambda m: m.isNotNull())
    return F.transform(kept, lambda m: F.struct(
        m["seq"].alias("seq"),
        F.when(m["role"] == "tool", F.lit("system")).otherwise(m["role"]).alias("role"),
        m["content"].alias("content")))


def splice_round(messages, choice: Column, results) -> Column:
    """``orig[:-1] + [choice] + results + orig[-1:]``."""
    a = T.col(messages)
    n = F.size(a)
    head = F.when(n > 1, F.slice(a, 1, n - 1)).otherwise(F.array().cast("array<" + MSG + ">"))
    tail = F.when(n > 0, F.slice(a, n, 1)).otherwise(F.array().cast("array<" + MSG + ">"))
    return F.concat(head, F.array(choice.cast(MSG)), T.col(results), tail)


def assemble_prompt(kept: DataFrame, system_text: Column, role: str = "role", content: str = "body") -> DataFrame:
    """System message first, then the pinned oldest row and the kept
    tail in chronological order (W2 output, bounded per room)."""
    rows = kept.select("room_id", F.struct(F.col("seq").cast("bigint").alias("seq"), F.col(role).alias("role"),
                                           F.col(content).alias("content")).alias("m"))
    agg = rows.groupBy("room_id").agg(F.array_sort(F.collect_list("m")).alias("_tail"))
    system = F.struct(F.lit(None).cast("bigint").alias("seq"), F.lit("system").alias("role"),
                      system_text.alias("content"))
    return agg.select("room_id", F.concat(F.array(system), F.col("_tail")).alias("messages"))
