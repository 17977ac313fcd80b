"""The newest message of a room closes its context, once."""

from chatlake.config import DEFAULT_CONFIG as CFG
from chatlake.operators import context as C
from chatlake.sources import views as V


def test_trigger_is_newest_and_last(spark, sf_dir):
    msgs = V.messages(spark, sf_dir)
    newest = {}
    for r in msgs.select("room_id", "event_id", "seq").collect():
        newest[r.room_id] = max(newest.get(r.room_id, (-1, "")), (r.seq, r.event_id))
    plain = {(r.room_id, r.event_id) for r in C.last_n_messages(msgs, CFG).select("room_id", "event_id").collect()}
    got = C.context_with_trigger(msgs, CFG).select("room_id", "event_id", "seq", "is_trigger", "pos").collect()
    for room, (seq, event) in newest.items():
        own = sorted((r for r in got if r.room_id == room), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(own[0].pos, own[0].pos + len(own)))
        assert [r.is_trigger for r in own] == [False] * (len(own) - 1) + [True]
        assert (own[-1].event_id, own[-1].seq) == (event, seq)
        rest = [r.event_id for r in own[:-1]]
        assert set(rest) == {e for r, e in plain if r == room} - {event} and [r.seq for r in own[:-1]] == sorted(r.seq for r in own[:-1])
