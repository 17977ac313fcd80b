"""Membership and spaces (A4, T2 batch twin, J3-J6, J9, S6, S7, U3, L3).

Membership is an event log ``(room_id, user_id, membership, ts,
event_id)``.  Current membership is W4 (``max_by`` per ``(room, user)``),
member counts are a second hash aggregate — both pre-aggregate before the
shuffle, so a room with a third of all events is not funnelled through one
task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ROOM_PARENT_EVENT, SPACE_CHILD_EVENT
from ..functions import text as T
from . import windows as W
from .settings import latest_per_key


def current_membership(events: DataFrame) -> DataFrame:
    """Latest membership per ``(room_id, user_id)``."""
    return latest_per_key(events, ["room_id", "user_id"], ["membership"])


def member_counts(events: DataFrame) -> DataFrame:
    """A4: joined members per room (rooms whose members all left count 0).
    Only the latest joined flag per (room, user) is needed; with a packed
    ordering key both aggregations are hash aggregates."""
    joined = (F.col("membership") == "join").cast("int")
    cur = events.groupBy("room_id", "user_id").agg(
        F.max_by(joined, W.ordering(events, ["ts", "event_id"])).alias("_joined"))
    return cur.groupBy("room_id").agg(F.coalesce(F.sum("_joined"), F.lit(0)).cast("bigint").alias("members"))


PAIR = ["room_id", "user_id"]
ORDER = ["ts", "event_id"]


def _member_counts_at_events(events: DataFrame, bucket_fmt: str, prior: DataFrame | None = None,
                             base: DataFrame | None = None) -> DataFrame:
    """Members of the room right after each event (``members_after``).

    A user's delta is +1 on becoming joined and -1 on leaving a joined
    state.  The previous state comes from a bucketed lag (a hot (room,
    user) pair is spread over its time buckets); the count is a bucketed
    running sum per room.  Per (room, user, bucket) the deltas add up to
    "last state in the bucket − state before it", so the per-bucket totals
    come from the small carry table without touching the rows again.
    ``prior`` (room, user, _prior) and ``base`` (room, _base) carry state
    from earlier data (streaming)."""
    d0 = (events.withColumn("_joined", (F.col("membership") == "join").cast("int"))
          .withColumn("_bucket", W.time_bucket("ts", bucket_fmt)))
    carry = W.bucket_carry(d0, PAIR, "_bucket", ORDER, "_joined")
    if prior is not None:
        carry = (carry.join(prior, PAIR, "left")
                 .withColumn("_carry", F.coalesce(F.col("_carry"), F.col("_prior"))).drop("_prior"))
    d = W.bucketed_lag(d0, PAIR, "_bucket", ORDER, "_joined", out="_prev", carry=carry)
    d = d.withColumn("delta", F.col("_joined") - F.coalesce(F.col("_prev"), F.lit(0)))
    totals = carry.groupBy("room_id", "_bucket").agg(
        F.sum(F.col("_last") - F.coalesce(F.col("_carry"), F.lit(0))).alias("_bt"))
    r = W.running_total(d, "room_id", "delta", "_bucket", ORDER, out="_run", totals=totals)
    if base is not None:
        r = r.join(base, "room_id", "left")
    else:
        r = r.withColumn("_base", F.lit(0))
    return r.withColumn("members_after", (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_run")).cast("bigint"))


def abandoned_events(events: DataFrame, bucket_fmt: str = W.HOUR) -> DataFrame:
    """T2 (batch twin): leave events after which exactly one member is left
    in the room (no single task sorts a whole room or a whole pair)."""
    r = _member_counts_at_events(events, bucket_fmt)
    return r.where((F.col("membership") == "leave") & (F.col("members_after") == 1)) \
        .select("room_id", "user_id", "event_id", "ts", "members_after")


def abandoned_increment(events: DataFrame, state: DataFrame | None,
                        bucket_fmt: str = W.HOUR) -> tuple[DataFrame, DataFrame]:
    """T2 for one batch of new membership events on top of the current
    membership ``state(room_id, user_id, membership, ts, event_id)`` left by
    earlier batches.  Returns ``(abandoned leave events, new state)``.

    Same algorithm as ``abandoned_events``: the previous membership of a
    (room, user) comes from the batch (bucketed lag) or, for its first event
    in the batch, from the state; each room's count starts from its joined
    members in the state.  The new state is the latest row per (room, user)
    over state ∪ batch."""
    cols = ["room_id", "user_id", "membership", "ts", "event_id"]
    prior = base = None
    if state is not None:
        prior = state.select(*PAIR, (F.col("membership") == "join").cast("int").alias("_prior"))
        base = state.groupBy("room_id").agg(F.count_if(F.col("membership") == "join").alias("_base"))
    r = _member_counts_at_events(events.select(*cols), bucket_fmt, prior, base)
    out = (r.where((F.col("membership") == "leave") & (F.col("members_after") == 1))
           .select("room_id", "user_id", "event_id", "ts", "members_after"))
    log = events.select(*cols) if state is None else state.select(*cols).unionByName(events.select(*cols))
    return out, latest_per_key(log, ["room_id", "user_id"], ["membership"])


def pending_invites(invites: DataFrame, ignored: DataFrame, joined: DataFrame) -> DataFrame:
    """Invited rooms minus the ignore list minus rooms already joined."""
    return (invites.select("room_id").distinct()
            .join(ignored.select("room_id"), "room_id", "left_anti")
            .join(joined.select("room_id"), "room_id", "left_anti"))


def rooms_without(rooms: DataFrame, state: DataFrame, event_type: str) -> DataFrame:
    """Rooms that have no state event of the given type."""
    return rooms.join(state.where(F.col("type") == event_type).select("room_id"), "room_id", "left_anti")


def one_space_per_user(spaces: DataFrame, active_only: bool) -> DataFrame:
    """L3 made deterministic: per user the smallest space id (optionally only
    active spaces) with its flag."""
    s = spaces.where(F.col("active")) if active_only else spaces
    return s.groupBy("user_id").agg(F.min_by(F.struct("space_id", "active"), F.col("space_id")).alias("_s")) \
        .select("user_id", F.col("_s.space_id").alias("space_id"), F.col("_s.active").alias("active"))


def active_space(users: DataFrame, spaces: DataFrame) -> DataFrame:
    """The active space of each user (NULL when none)."""
    return users.join(one_space_per_user(spaces, True).select("user_id", "space_id"), "user_id", "left")


def space_status(users: DataFrame, spaces: DataFrame) -> DataFrame:
    """``none`` without a row, ``disabled`` when inactive, else
    ``enabled``; ``invite_space`` ignores the flag (disabled rows still
    count for invites)."""
    any_row = one_space_per_user(spaces, False)
    j = users.join(any_row, "user_id", "left")
    return j.select("user_id",
                    F.when(F.col("space_id").isNull(), "none").when(~F.col("active"), "disabled")
                    .otherwise("enabled").alias("status"),
                    F.col("space_id").alias("invite_space"))


def insert_spaces(spaces: DataFrame, new: DataFrame) -> DataFrame:
    """Append new spaces; a missing ``active`` defaults to TRUE."""
    n = new if "active" in new.columns else new.withColumn("active", F.lit(None).cast("boolean"))
    return spaces.unionByName(n.select("space_id", "user_id", F.coalesce(F.col("active"), F.lit(True)).alias("active")))


def deactivate_users(spaces: DataFrame, users: DataFrame) -> DataFrame:
    """``UPDATE … SET active = FALSE WHERE user_id IN users`` as a
    left join on a distinct flag table plus a projection."""
    flag = users.select("user_id").distinct().withColumn("_off", F.lit(True))
    return (spaces.join(flag, "user_id", "left")
            .select("space_id", "user_id",
                    F.when(F.col("_off"), F.lit(False)).otherwise(F.col("active")).alias("active")))


def rooms_for_spaces(membership: DataFrame, spaces: DataFrame) -> DataFrame:
    """Every room whose current members include a user with an active
    space → ``(space_id, room_id)``."""
    joined = (F.col("membership") == "join").cast("int")
    cur = (membership.groupBy("room_id", "user_id")
           .agg(F.max_by(joined, W.ordering(membership, ["ts", "event_id"])).alias("_joined"))
           .where(F.col("_joined") == 1))
    act = one_space_per_user(spaces, True).select("user_id", "space_id")
    return cur.join(act, "user_id").select("space_id", "room_id").distinct()


def space_edges(pairs: DataFrame) -> DataFrame:
    """Per ``(space, room)`` with ``space <> room`` a child edge
    (``via = [room server, space server]``) and a parent edge
    (``via = [space server, room server]``, canonical)."""
    p = pairs.where(F.col("space_id") != F.col("room_id"))
    rs, ss = T.server_of("room_id"), T.server_of("space_id")
    edge = "struct<src:string,dst:string,type:string,via:array<string>,canonical:boolean>"
    child = F.struct(F.col("space_id").alias("src"), F.col("room_id").alias("dst"),
                     F.lit(SPACE_CHILD_EVENT).alias("type"), F.array(rs, ss).alias("via"),
                     F.lit(None).cast("boolean").alias("canonical")).cast(edge)
    parent = F.struct(F.col("room_id").alias("src"), F.col("space_id").alias("dst"),
                      F.lit(ROOM_PARENT_EVENT).alias("type"), F.array(ss, rs).alias("via"),
                      F.lit(True).alias("canonical")).cast(edge)
    return p.select(F.explode(F.array(child, parent)).alias("e")).select("e.*")
