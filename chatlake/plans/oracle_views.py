"""DuckDB text of the fixture views (FIXTURES.md §2), used to build the
independent SQL oracle of every registered query.  The oracle queries are
written from the operator semantics, not generated from the Spark plans."""

from __future__ import annotations

VIEW_SQL = {
    "messages": """
SELECT concat('!r', conv_id % 10, ':', CASE conv_id % 10 % 3 WHEN 0 THEN 'alpha.example' WHEN 1 THEN 'beta.example' ELSE 'gamma.example' END) AS room_id,
       concat('$', conv_id, '-', turn) AS event_id,
       CASE role WHEN 'assistant' THEN '@bot:alpha.example'
            ELSE concat('@u', conv_id % 17, ':', CASE conv_id % 3 WHEN 0 THEN 'alpha.example' WHEN 1 THEN 'beta.example' ELSE 'gamma.example' END) END AS sender,
       CASE k WHEN 5 THEN 'm.notice' WHEN 6 THEN 'm.image' WHEN 7 THEN 'm.audio' WHEN 8 THEN 'm.file' WHEN 9 THEN 'bot.tool_result' WHEN 10 THEN 'm.member' ELSE 'm.text' END AS kind,
       CASE k WHEN 0 THEN CASE WHEN conv_id % 5 = 0 THEN '!bot ignoreolder' ELSE '!bot space Enable' END
              WHEN 1 THEN concat('!bot custom ', text) WHEN 2 THEN '!bot calculate 1 + 1 --text --details'
              WHEN 3 THEN concat('* !bot chat ', text) WHEN 4 THEN '!other thing'
              WHEN 11 THEN '!bot imagine --portrait a cat' WHEN 12 THEN '!bot nosuch'
              WHEN 7 THEN 'voice.mp3' WHEN 8 THEN 'clip.mp4' ELSE text END AS body,
       conv_id * 8 + turn AS seq,
       1704067200000 + conv_id * 3600000 + turn * 60000 AS sent_ms
FROM (SELECT conv_id, turn, role, text, (conv_id * 7 + turn * 3) % 16 AS k FROM conversations) c""",
    "settings_log": """
SELECT concat('!r', user_id % 10, ':', CASE user_id % 10 % 3 WHEN 0 THEN 'alpha.example' WHEN 1 THEN 'beta.example' ELSE 'gamma.example' END) AS room_id,
       CASE event_type WHEN 'click' THEN 'always_reply' WHEN 'view' THEN 'tts' WHEN 'error' THEN 'stt' WHEN 'signup' THEN 'model' ELSE 'system_message' END AS setting,
       CASE event_type WHEN 'signup' THEN concat('model-', event_id % 4) WHEN 'purchase' THEN concat('Be terse ', event_id % 9) ELSE CAST(event_id % 2 AS STRING) END AS value,
       ts, event_id
FROM events""",
    "usage_log": """
SELECT concat('$', event_id) AS message_id, concat('!r', user_id % 10) AS room_id,
       concat('openai-', event_type) AS api, CAST(floor(value * 10) AS BIGINT) AS tokens, ts
FROM events""",
    "member_events": """
SELECT concat('!m', event_id % 2000) AS room_id, concat('@u', user_id, ':alpha.example') AS user_id,
       CASE event_type WHEN 'error' THEN 'leave' ELSE 'join' END AS membership, ts, event_id
FROM events""",
    "room_state": """
SELECT concat('!m', event_id % 2000) AS room_id,
       CASE event_type WHEN 'view' THEN 'm.room.avatar' WHEN 'click' THEN 'm.room.name' WHEN 'signup' THEN 'm.room.topic'
            WHEN 'error' THEN 'm.room.encryption' ELSE 'm.room.canonical_alias' END AS type,
       '' AS state_key, props AS content, ts, event_id
FROM events""",
    "invites": """
SELECT concat('!m', event_id % 2000) AS room_id, event_id FROM events WHERE event_type = 'signup'""",
    "ignored_rooms": """
SELECT DISTINCT concat('!m', event_id % 2000) AS room_id FROM events WHERE event_id % 2000 % 7 = 0""",
    "user_spaces": """
SELECT DISTINCT concat('!space', user_id, ':alpha.example') AS space_id, concat('@u', user_id, ':alpha.example') AS user_id, user_id % 3 <> 0 AS active
FROM events""",
    "wiki_pages": """
SELECT doc_id AS id, doc_id % 11 <> 0 AS found, CASE WHEN doc_id % 13 <> 0 THEN concat('doc ', doc_id) END AS title,
       CASE WHEN doc_id % 17 <> 0 THEN text END AS content
FROM documents""",
    "weather_payloads": """
SELECT event_id AS id, concat('{"current":{"temp":', event_id % 40, ',"feels_like":', event_id % 38, ',"humidity":', event_id % 100, ',"wind_speed":', event_id % 25,
       ',"sunrise":', 1704088800 + event_id % 3600, ',"sunset":', 1704124800 + event_id % 3600, ',"weather":[{"description":"', event_type, '"}]},"daily":[{"temp":{"day":', event_id % 30,
       '},"summary":"a","weather":[{"description":"x"}]},{"temp":{"day":', event_id % 31, '},"summary":"b","weather":[{"description":"y"}]}]}') AS payload
FROM events""",
    "settings_commands": """
SELECT room_id, event_id, regexp_replace(CASE WHEN event_id % 13 = 0 THEN concat('!bot systemmessage ', v)
         WHEN event_id % 13 = 1 THEN concat('* !bot systemmessage ', v)
         ELSE concat(CASE event_id % 11 WHEN 0 THEN '* !bot roomsettings ' WHEN 1 THEN '!bot chat '
                          WHEN 2 THEN '!other roomsettings ' ELSE '!bot roomsettings ' END, name, ' ', v) END, '\\s+$', '') AS body, ts
FROM (SELECT *, concat('!r', user_id % 10, ':', CASE user_id % 10 % 3 WHEN 0 THEN 'alpha.example' WHEN 1 THEN 'beta.example' ELSE 'gamma.example' END) AS room_id,
         CASE event_id % 7 WHEN 0 THEN 'classification' WHEN 1 THEN 'timing' WHEN 2 THEN 'systemmessage'
              WHEN 3 THEN 'always_reply' WHEN 4 THEN 'model' WHEN 5 THEN 'tts' ELSE 'bogus' END AS name,
         CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes' WHEN 3 THEN ''
              ELSE concat('Be brief ', user_id) END AS v FROM events)""",
    "log_records": """
SELECT ts, concat('f', user_id % 5) AS caller,
       CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'warning' WHEN 'error' THEN 'error' ELSE 'critical' END AS level,
       props AS message
FROM events""",
    "media_meta": """
SELECT p_partkey AS media_id, p_size * 100 AS w, CAST((p_partkey % 40 + 1) * 60 AS INT) AS h FROM part""",
    "model_replies": """
SELECT doc_id AS reply_id, concat('q', doc_id) AS query,
       CASE doc_id % 20 WHEN 0 THEN concat('```json', chr(10), call, '```') WHEN 1 THEN call WHEN 2 THEN concat(call, ' ', call)
            WHEN 3 THEN concat(call, ' or {so}') WHEN 4 THEN text WHEN 5 THEN typed WHEN 6 THEN concat(typed, ' {}')
            WHEN 7 THEN concat('[', call, ']') WHEN 16 THEN '{"tool":"nosuch"}' WHEN 17 THEN '{"tool":"wikipedia"}' WHEN 18 THEN '{}'
            WHEN 19 THEN concat('```json', chr(10), '{"tool":"dice","parameters":{"dice":"20"}}', '```')
            ELSE concat('{"tool":"weather","parameters":{"latitude":',
                        CASE doc_id % 20 WHEN 8 THEN '"0"' WHEN 9 THEN '0' WHEN 10 THEN '""' WHEN 11 THEN 'false' WHEN 12 THEN '"false"'
                             WHEN 13 THEN 'null' WHEN 14 THEN '[]' WHEN 15 THEN '12.5' END, ',"longitude":"51"}}') END AS reply
FROM (SELECT doc_id, text, concat('{"tool":"wikipedia","parameters":', json_object('query', text), '}') AS call,
             concat('{"type":"imagine","prompt":', to_json(text), '}') AS typed FROM documents)""",
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with CTEs for the named fixture views."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}" if names else body


def with_ctes(names: list[str], extra: list[tuple[str, str]], body: str) -> str:
    """Fixture views followed by extra named CTEs, then the body."""
    parts = [f"{n} AS ({VIEW_SQL[n]}\n)" for n in names] + [f"{n} AS ({sql}\n)" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body
