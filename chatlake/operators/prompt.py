"""The main path of every room in one plan: kinds (P1), history window with its trigger
(W1, P13), attachments (S8, S9, P25), media merge (W3), the room's own system
message (F12) and the token budget (W2) with a status for every room.

Late materialisation.  What the windows need of an attachment is whether it was fetched and
how many characters it decodes to.  These facts are computed where the bytes are
scanned; only they are joined to the context.  The bytes themselves are joined
once, to the parts that the budget kept, so they cross one exchange at most.

Everything per room works on the at most ``2n`` rows of the history window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, BotConfig
from ..functions import text as T
from ..sources.attachments import data_url, utf8_text
from . import context as C
from .settings import resolve_system_message, settings_wide

OK, NO_MESSAGES, SYSTEM_TOO_LONG, PINNED_OVERFLOW = "ok", "no_messages", "system_too_long", "pinned_overflow"


def attachment_facts(attachments: DataFrame) -> DataFrame:
    """``_event``, ``_chars``: characters of the attachment as UTF-8 text, NULL if it is none."""
    return attachments.select(F.col("event_id").alias("_event"), F.lit(True).alias("_found"),
                              F.char_length(utf8_text(F.col("content"))).alias("_chars"))


def _parts(ctx: DataFrame, attachments: DataFrame, cfg: BotConfig) -> DataFrame:
    """Context rows with ``role``, ``source`` (``body``, ``file`` or ``url``; NULL: not in the prompt), ``is_media``, ``chars``."""
    d = ctx.withColumn("branch", C.media_kind_branch(cfg)).join(attachment_facts(attachments), F.col("event_id") == F.col("_event"), "left")
    branch, found = F.col("branch"), F.coalesce(F.col("_found"), F.lit(False))
    media = branch.isin("image", "video")
    failed = (media | (branch == "file")) & ~found
    source = (F.when(branch.isin("text", "audio") | failed, "body").when((branch == "file") & (F.coalesce(F.col("_chars"), F.lit(0)) > 0), "file")
              .when(media, "url"))
    return d.select("room_id", "event_id", "pos", "body", source.alias("source"),
                    F.when(failed, F.lit("system")).otherwise(C.role_of("sender", cfg)).alias("role"), (media & found).alias("is_media"),
                    F.when(source == "file", F.col("_chars")).when(source == "body", F.char_length(F.coalesce("body", F.lit("")))).otherwise(F.lit(0)).alias("chars"))


def budgeted_messages(events: DataFrame, attachments: DataFrame, settings_log: DataFrame, cfg: BotConfig = DEFAULT_CONFIG,
                      n: int | None = None, ignore_notices: bool = True) -> DataFrame:
    """A row for each prepared message of each room, and one with a NULL ``grp`` for what is left out:
    ``role``, ``parts`` (pos, event_id, source, body), ``cost``, ``pinned``, ``cum`` (system message
    included), ``system_message``, ``system_cost``.

    The room's newest event is the trigger: it stands last whatever it is, so every room
    has a row here.  ``cum`` grows by at least one a message, in the order pinned, newest, …,
    oldest, so the first overflow ends the prompt exactly where ``cum`` passes the limit."""
    ctx = C.context_with_trigger(C.resolve_kind(events), cfg, n, ignore_notices)
    rows = _parts(ctx, attachments, cfg)
    used = F.col("source").isNotNull()
    by_place = Window.partitionBy("room_id").orderBy(~used, "pos")
    starts = used & (~F.col("is_media") | ~F.lag("role").over(by_place).eqNullSafe(F.col("role")))
    rows = rows.withColumn("_start", starts.cast("int"))
    rows = rows.withColumn("grp", F.when(used, F.sum("_start").over(by_place.rowsBetween(Window.unboundedPreceding, 0))))
    part = F.struct("pos", "event_id", "source", "body", "chars")
    msgs = rows.groupBy("room_id", "grp").agg(F.min_by("role", "pos").alias("role"), F.array_sort(F.collect_list(part)).alias("parts"))
    first = F.get("parts", F.lit(0))
    cost = F.when(first["source"] == "url", F.lit(0)).otherwise(F.ceil(first["chars"] / F.lit(4))) + 1
    system = settings_wide(settings_log).select("room_id", "raw_system_message")
    msgs = msgs.join(system, "room_id", "left").withColumn("system_message", resolve_system_message("raw_system_message", cfg))
    msgs = msgs.withColumn("cost", F.when(F.col("grp").isNotNull(), cost).otherwise(0).cast("long")) \
        .withColumn("pinned", F.coalesce(F.col("grp") == 1, F.lit(False))).withColumn("system_cost", T.system_cost("system_message"))
    order = Window.partitionBy("room_id").orderBy(F.desc("pinned"), F.desc_nulls_last("grp")).rowsBetween(Window.unboundedPreceding, 0)
    return msgs.withColumn("cum", F.col("system_cost") + F.sum("cost").over(order)).drop("raw_system_message")


def _status(limit: Column, system_cost: Column, pinned_cum: Column) -> Column:
    return (F.when(system_cost > limit, SYSTEM_TOO_LONG).when(pinned_cum.isNull(), NO_MESSAGES)
            .when(pinned_cum > limit, PINNED_OVERFLOW).otherwise(OK))


def prompt_status(msgs: DataFrame, limits: list[int]) -> DataFrame:
    """For each room and limit ``status``, ``n_kept`` messages and ``tokens`` (both 0 unless ``ok``).
    All limits come from one pass over the messages."""
    room = msgs.groupBy("room_id").agg(F.max("system_cost").alias("_system"), F.max(F.when(F.col("pinned"), F.col("cum"))).alias("_pinned"),
                                       F.collect_list(F.when(F.col("grp").isNotNull(), F.col("cum"))).alias("_cums"))
    d = room.withColumn("max_tokens", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])))
    d = d.withColumn("status", _status(F.col("max_tokens"), F.col("_system"), F.col("_pinned")))
    kept = F.when(F.col("status") == OK, F.filter("_cums", lambda c: c <= F.col("max_tokens"))).otherwise(F.array().cast("array<long>"))
    return d.select("room_id", "max_tokens", "status", F.size(kept).cast("long").alias("n_kept"),
                    F.coalesce(F.array_max(kept), F.lit(0)).cast("long").alias("tokens"))


def prompt_parts(msgs: DataFrame, attachments: DataFrame, max_tokens: int) -> DataFrame:
    """The prompts as rows: ``room_id``, ``pos`` (1: the system message), ``role``, ``part_pos``, ``type``, ``text``, ``url``.

    Parts of all rooms meet the attachments in one join.  Every part has a key of its own (the system
    message its room's), so that text parts don't pile up under a null key."""
    kept = msgs.where(F.col("grp").isNotNull() & (F.col("cum") <= max_tokens) & (F.col("system_cost") <= max_tokens))
    kept = kept.withColumn("_place", F.row_number().over(Window.partitionBy("room_id").orderBy("grp")))
    text = "struct<pos:int,event_id:string,source:string,body:string,chars:int>"
    system = F.struct(F.lit(1).alias("pos"), F.lit("system").alias("role"), F.array(F.struct(
        F.lit(0).alias("pos"), F.concat(F.lit("system of "), F.col("room_id")).alias("event_id"), F.lit("body").alias("source"),
        F.col("system_message").alias("body"), F.lit(0).alias("chars")).cast(text)).alias("parts"))
    own = F.struct((F.col("_place") + 1).cast("int").alias("pos"), F.col("role").alias("role"), F.col("parts").cast(f"array<{text}>").alias("parts"))
    rows = kept.select("room_id", F.explode(F.when(F.col("pinned") & (F.col("system_cost") > 0), F.array(system, own)).otherwise(F.array(own))).alias("m"))
    rows = rows.select("room_id", "m.pos", "m.role", F.posexplode("m.parts").alias("_k", "p"))
    files = attachments.select(F.col("event_id").alias("_event"), F.col("content").alias("_bytes"), F.col("mimetype").alias("_mime"))
    rows = rows.withColumn("_key", F.col("p.event_id")).join(files, F.col("_key") == F.col("_event"), "left")
    source = F.col("p.source")
    return rows.select("room_id", "pos", "role", (F.col("_k") + 1).alias("part_pos"),
                       F.when(source == "url", "image_url").otherwise("text").alias("type"),
                       F.when(source == "body", F.col("p.body")).when(source == "file", utf8_text(F.col("_bytes"))).alias("text"),
                       F.when(source == "url", data_url(F.col("_mime"), F.col("_bytes"))).alias("url"))
