"""Allow-list access control.

An id passes when it is listed exactly, or — unless it starts with ``!`` —
when ``*:server`` or ``@*:server`` is listed (``server`` is the part after the
first ``:``, a port cut off).  A message passes when its sender or its room
passes.  An empty list allows everyone.

The check is an equi-key test on a small set of candidate keys per message,
never an ``OR`` join condition (which would plan as a nested-loop join):

* list from configuration → ``arrays_overlap`` with a literal array, a pure
  projection (no join, no shuffle);
* list held in a table → candidate keys of the distinct ids of the messages' distinct (sender,
  room) pairs, then one semi join of the messages on the pair; sides are broadcast only
  if AQE measures them under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, DENY_NOTICE, BotConfig
from ..functions import text as T


def parse_allow_list(json_text, fail_open: bool = True) -> Column:
    """P5: JSON array of strings; any failure → empty list (= everyone) when
    ``fail_open``, else NULL (= nobody)."""
    # the second element of the outer array only comes out if exactly one array stands before it
    both = F.from_json(F.concat(F.lit("["), T.col(json_text), F.lit(",[]]")), "array<array<variant>>", {"allowSingleQuotes": "false"})
    items = F.when(F.size(both) == 2, F.get(both, F.lit(0)))
    parsed = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    ok = parsed.isNotNull() & F.forall(parsed, lambda x: x.isNotNull())
    fallback = F.array().cast("array<string>") if fail_open else F.lit(None).cast("array<string>")
    return F.when(ok, parsed).otherwise(fallback)


def candidate_keys(id_col) -> Column:
    """Keys under which an id may be listed."""
    i = T.col(id_col)
    srv = T.server_of(i)
    wild = F.when(~F.startswith(i, F.lit("!")) & srv.isNotNull(),
                  F.array(F.concat(F.lit("*:"), srv), F.concat(F.lit("@*:"), srv)))
    return F.concat(F.array(i), F.coalesce(wild, F.array().cast("array<string>")))


def id_allowed(id_col, allow: Column) -> Column:
    """P4 against a literal/array column allow list."""
    return (F.size(allow) == 0) | F.arrays_overlap(candidate_keys(id_col), allow)


def message_allowed(allow: Column, sender="sender", room="room_id") -> Column:
    """Sender passes or room passes."""
    keys = F.concat(candidate_keys(sender), candidate_keys(room))
    return F.coalesce((F.size(allow) == 0) | F.arrays_overlap(keys, allow), F.lit(False))


def allow_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def split_allowed(messages: DataFrame, allow: Column | list | tuple | DataFrame,
                  cfg: BotConfig = DEFAULT_CONFIG) -> tuple[DataFrame, DataFrame]:
    """P3 + J8: (allowed, denied) messages from other senders."""
    others = messages.where(F.col("sender") != F.lit(cfg.bot_id))
    if isinstance(allow, DataFrame):
        return _split_by_table(others, allow)
    arr = allow if isinstance(allow, Column) else allow_array(allow)
    flag = message_allowed(arr)
    return others.where(flag), others.where(~flag)


def _split_by_table(msgs: DataFrame, allow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J8 with the list in a table ``allow(user_id)``.

    Messages are first reduced to their distinct (sender, room) pairs, and these to distinct
    ids; only ids are exploded into candidate keys and met with the list.  The pairs that pass
    select the messages in one semi join.  An empty table allows everyone: the list size is a
    scalar subquery (no join)."""
    keys = allow.select(F.col("user_id").alias("_key")).distinct()
    size = keys.agg(F.count("*")).scalar()
    pairs = msgs.select(F.col("sender").alias("_s"), F.col("room_id").alias("_r")).distinct()
    ids = pairs.select(F.explode(F.array("_s", "_r")).alias("_id")).where("_id IS NOT NULL").distinct()
    passed = ids.select("_id", F.explode(F.array_distinct(candidate_keys("_id"))).alias("_key")).join(keys, "_key", "left_semi").select("_id").distinct()
    by_sender = pairs.join(passed, F.col("_s") == F.col("_id"), "left").withColumn("_ok", F.col("_id").isNotNull()).drop("_id")
    both = by_sender.join(passed, F.col("_r") == F.col("_id"), "left")
    good = both.where(F.col("_ok") | F.col("_id").isNotNull() | (size == 0)).select("_s", "_r")
    same = F.col("sender").eqNullSafe(F.col("_s")) & F.col("room_id").eqNullSafe(F.col("_r"))
    return msgs.join(good, same, "left_semi"), msgs.join(good, same, "left_anti")


def deny_notices(denied: DataFrame, members: DataFrame, cfg: BotConfig = DEFAULT_CONFIG) -> DataFrame:
    """A denied message in a room with exactly two members yields a
    notice; ``members(room_id, members)`` comes from A4."""
    text = DENY_NOTICE.format(operator=cfg.operator)
    d = denied.join(members, "room_id", "left").withColumn("members", F.coalesce(F.col("members"), F.lit(0)))
    return d.withColumn("notice", F.col("members") == 2) \
        .withColumn("notice_body", F.when(F.col("notice"), F.lit(text)))
