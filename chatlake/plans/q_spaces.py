"""Registered queries: membership, invites, avatars, spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators import routing as R
from ..operators import settings as S
from ..operators import spaces as SP
from ..sources import views as V
from .oracle_views import with_ctes
from .q_routing import _CMD_CTE, commands

CFG = DEFAULT_CONFIG
BOT_MEMBER = "@u1:alpha.example"    # the user of the membership fixture that stands for the bot


def askers(spark, sf):
    """Users who wrote to the bot (distinct non-bot senders)."""
    return R.drop_own(V.messages(spark, sf), CFG).select(F.col("sender").alias("user_id")).distinct()


def q_room_members(spark, sf):
    return SP.member_counts(V.member_events(spark, sf))


def q_abandoned_rooms(spark, sf):
    return SP.abandoned_events(V.member_events(spark, sf))


def q_pending_invites(spark, sf):
    """Joined rooms: where the bot's newest membership is ``join``."""
    own = V.member_events(spark, sf).where(F.col("user_id") == BOT_MEMBER)
    joined = S.latest_per_key(own, ["room_id"], ["membership"]).where(F.col("membership") == "join")
    return SP.pending_invites(V.invites(spark, sf), V.ignored_rooms(spark, sf), joined)


def q_rooms_without_avatar(spark, sf):
    rooms = V.member_events(spark, sf).select("room_id").distinct()
    return SP.rooms_without(rooms, V.room_state(spark, sf), "m.room.avatar")


def q_user_space(spark, sf):
    return SP.active_space(askers(spark, sf), V.user_spaces(spark, sf))


def q_space_status(spark, sf):
    return SP.space_status(askers(spark, sf), V.user_spaces(spark, sf))


def q_space_edges(spark, sf):
    e = SP.space_edges(SP.rooms_for_spaces(V.member_events(spark, sf), V.user_spaces(spark, sf)))
    # the two via servers as plain columns (flat output for comparison)
    return e.select("src", "dst", "type", F.col("via")[0].alias("via_first"), F.col("via")[1].alias("via_second"),
                    "canonical")


def q_space_disable(spark, sf):
    leavers = V.member_events(spark, sf).where(F.col("membership") == "leave").select("user_id")
    return SP.deactivate_users(V.user_spaces(spark, sf), leavers)


def q_space_enable(spark, sf):
    spaces = V.user_spaces(spark, sf)
    req = (commands(spark, sf).where((F.col("command") == "space") & (R.space_request("tokens") == "enable"))
           .select(F.col("sender").alias("user_id")).distinct())
    new = (req.join(spaces.where(F.col("active")).select("user_id"), "user_id", "left_anti")
           .select(F.concat(F.lit("!space-"), F.col("user_id")).alias("space_id"), "user_id"))
    return SP.insert_spaces(spaces, new)


def _srv(c):
    return f"CASE WHEN contains({c}, ':') THEN split_part({c}, ':', 2) END"


_CUR = ("cur", """
SELECT room_id, user_id, membership FROM member_events
QUALIFY row_number() OVER (PARTITION BY room_id, user_id ORDER BY ts DESC, event_id DESC) = 1""")
_USERS = ("users", f"SELECT DISTINCT sender AS user_id FROM messages WHERE sender <> '{CFG.bot_id}'")

ORACLE = {
    "room_members": with_ctes(["member_events"], [_CUR], """
SELECT room_id, CAST(count(*) FILTER (WHERE membership = 'join') AS BIGINT) AS members FROM cur GROUP BY room_id"""),
    "abandoned_rooms": with_ctes(["member_events"], [("d", """
SELECT *, CAST(membership = 'join' AS INT)
          - coalesce(lag(CAST(membership = 'join' AS INT)) OVER (PARTITION BY room_id, user_id ORDER BY ts, event_id), 0) AS delta
FROM member_events"""), ("r", """
SELECT *, sum(delta) OVER (PARTITION BY room_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m
FROM d""")], """
SELECT room_id, user_id, event_id, ts, CAST(m AS BIGINT) AS members_after FROM r WHERE membership = 'leave' AND m = 1"""),
    "pending_invites": with_ctes(["invites", "ignored_rooms", "member_events"], [("joined", f"""
SELECT room_id FROM member_events WHERE user_id = '{BOT_MEMBER}'
GROUP BY room_id HAVING arg_max(membership, (ts, event_id)) = 'join'""")], """
SELECT DISTINCT room_id FROM invites
WHERE room_id NOT IN (SELECT room_id FROM ignored_rooms) AND room_id NOT IN (SELECT room_id FROM joined)"""),
    "rooms_without_avatar": with_ctes(["member_events", "room_state"], [], """
SELECT DISTINCT room_id FROM member_events
WHERE room_id NOT IN (SELECT room_id FROM room_state WHERE type = 'm.room.avatar')"""),
    "user_space": with_ctes(["messages", "user_spaces"], [_USERS], """
SELECT u.user_id, s.space_id FROM users u
LEFT JOIN (SELECT user_id, min(space_id) AS space_id FROM user_spaces WHERE active GROUP BY user_id) s ON u.user_id = s.user_id"""),
    "space_status": with_ctes(["messages", "user_spaces"], [_USERS, ("a", """
SELECT user_id, min(space_id) AS space_id, arg_min(active, space_id) AS active FROM user_spaces GROUP BY user_id""")], """
SELECT u.user_id, CASE WHEN a.space_id IS NULL THEN 'none' WHEN NOT a.active THEN 'disabled' ELSE 'enabled' END AS status,
       a.space_id AS invite_space
FROM users u LEFT JOIN a ON u.user_id = a.user_id"""),
    "space_edges": with_ctes(["member_events", "user_spaces"], [_CUR, ("act", """
SELECT user_id, min(space_id) AS space_id FROM user_spaces WHERE active GROUP BY user_id"""), ("p", """
SELECT DISTINCT a.space_id, c.room_id FROM cur c JOIN act a ON c.user_id = a.user_id
WHERE c.membership = 'join' AND a.space_id <> c.room_id""")], f"""
SELECT space_id AS src, room_id AS dst, 'm.space.child' AS type, {_srv('room_id')} AS via_first, {_srv('space_id')} AS via_second,
       CAST(NULL AS BOOLEAN) AS canonical FROM p
UNION ALL
SELECT room_id AS src, space_id AS dst, 'm.room.parent' AS type, {_srv('space_id')} AS via_first, {_srv('room_id')} AS via_second,
       true AS canonical FROM p"""),
    "space_disable": with_ctes(["member_events", "user_spaces"], [], """
SELECT s.space_id, s.user_id,
       CASE WHEN s.user_id IN (SELECT user_id FROM member_events WHERE membership = 'leave') THEN false ELSE s.active END AS active
FROM user_spaces s"""),
    "space_enable": with_ctes(["messages", "user_spaces"], [_CMD_CTE, ("req", """
SELECT DISTINCT sender AS user_id FROM cmd WHERE command = 'space' AND len(toks) = 3 AND lower(toks[3]) = 'enable'""")], """
SELECT space_id, user_id, active FROM user_spaces
UNION ALL
SELECT concat('!space-', user_id) AS space_id, user_id, true AS active FROM req
WHERE user_id NOT IN (SELECT user_id FROM user_spaces WHERE active)"""),
}

QUERIES = {
    "room_members": q_room_members,
    "abandoned_rooms": q_abandoned_rooms,
    "pending_invites": q_pending_invites,
    "rooms_without_avatar": q_rooms_without_avatar,
    "user_space": q_user_space,
    "space_status": q_space_status,
    "space_edges": q_space_edges,
    "space_disable": q_space_disable,
    "space_enable": q_space_enable,
}
