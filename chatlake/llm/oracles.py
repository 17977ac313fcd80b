"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .linededup import DIVISOR, MODULUS, MULTIPLIER, WINDOW
from .quality import STOP_WORDS
from .urls import FOLDS, LIMIT, ORDER, RULES, STEPS

_STOP = ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(
    {x for ws in STOP_WORDS.values() for w in ws for x in (w, w.capitalize())}))

OP10 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_ell,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop, len(list_filter(w, lambda x: x >= 'A')) AS n_let
  FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR n_repeat_words > 0.5 * n_words) AS base_failed,
  NOT (n_words < 50 OR n_repeat_words > 0.5 * n_words OR n_words > 1000000 OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR n_symbols > 0.1 * n_words OR n_stop < 0.02 * n_words
    OR n_dup_lines > 0.3 * n_lines OR n_ell > 0.3 * n_lines OR n_let < 0.6 * n_words) AS kept
FROM m
"""

_NORM = ("list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")

OP8 = f"""
WITH b AS (SELECT item_id, {_NORM.format('text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_NORM.format('text')} AS w FROM documents),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""

_ROLLED = "0::BIGINT"
for _back in range(WINDOW - 1, -1, -1):
    _ROLLED = f"(({_ROLLED}) * {MULTIPLIER} + coalesce(lag(h, {_back}) OVER v, 0)) % {MODULUS}"


def line_dedup_sql(source: str, columns: str) -> str:
    """CTEs that end in ``kept``: every row of ``source`` with ``n_lines``, ``n_removed``,
    ``n_chunks`` and the remaining ``left_text``."""
    return f"""
src AS (SELECT row_number() OVER () AS r, {columns} FROM {source}),
l AS (
  SELECT r, doc_id, i, x, ('0x' || substr(md5(x), 1, 8))::BIGINT % {MODULUS} AS h
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS x,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM src WHERE text IS NOT NULL)),
e AS (SELECT *, ({_ROLLED}) % {DIVISOR} = 0 AS is_end FROM l WINDOW v AS (PARTITION BY r ORDER BY i)),
n AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
ch AS (SELECT r, doc_id, c, min(i) AS first_line, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM n GROUP BY r, doc_id, c),
gone AS (
  SELECT r, c, n FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, first_line) AS k FROM ch
                       WHERE n > 1 AND regexp_matches(t, '\\S')) WHERE k > 1),
rest AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS left_text FROM n ANTI JOIN gone USING (r, c) GROUP BY r),
lost AS (SELECT r, sum(n) AS n_removed, count(*) AS n_chunks FROM gone GROUP BY r),
nl AS (SELECT r, count(*) AS n_lines FROM l GROUP BY r),
kept AS (
  SELECT src.*, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_chunks, 0)::BIGINT AS n_chunks,
    CASE WHEN src.text IS NULL THEN NULL ELSE coalesce(left_text, '') END AS left_text
  FROM src LEFT JOIN nl USING (r) LEFT JOIN lost USING (r) LEFT JOIN rest USING (r))"""


OP6 = f"""
WITH {line_dedup_sql('documents', 'doc_id, text')}
SELECT doc_id, n_lines, n_removed, n_chunks, sha256(left_text) AS kept_sha256 FROM kept
"""

def _rule_cases(give) -> str:
    out = ""
    for action, rule in sorted(RULES, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        out += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{give(action, rule)}'"
    return f"CASE{out} END"


def _level(name: str) -> str:
    return ", ".join(f"max(CASE WHEN k = {k} THEN coalesce({name}, 0) END) AS {name}{k}" for k in range(ORDER + 1))


def _chance(n: str, c: str, t: str) -> str:
    p = "(1.0::DOUBLE / 256)"
    for k in range(ORDER + 1):
        p = f"(CASE WHEN {n}{k} > 0 THEN ({c}{k} + {t}{k} * {p}) / ({n}{k} + {t}{k}) ELSE {p} END)"
    return p


OP2 = f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, {_rule_cases(lambda a, r: r)} AS rule, {_rule_cases(lambda a, r: a)} AS ruled, lower(concat(host, path)) AS s FROM h),
u AS (SELECT s, count(*) AS n, ruled = 'allow' AS accepted, ('0x' || substr(md5(s), 1, 6))::BIGINT % {FOLDS} AS fold FROM r GROUP BY s, ruled),
w AS (SELECT s, n, accepted, fold, substr(concat(repeat(chr(2), {ORDER}), s, chr(3)), i, {ORDER + 1}) AS w
      FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM u)),
k AS (SELECT unnest(range(0, {ORDER + 1})) AS k),
g AS (SELECT substr(w, {ORDER + 1} - k, k + 1) AS gram, sum(CASE WHEN accepted THEN n ELSE 0 END) AS a, sum(CASE WHEN accepted THEN 0 ELSE n END) AS r
      FROM w, k WHERE accepted IS NOT NULL AND fold <> 0 GROUP BY 1),
c AS (SELECT left(gram, length(gram) - 1) AS ctx, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr
      FROM g GROUP BY 1),
d AS (SELECT DISTINCT w FROM w WHERE accepted IS NULL OR fold = 0),
l AS (SELECT w, {', '.join(map(_level, ('a', 'r', 'na', 'nr', 'ta', 'tr')))}
      FROM d CROSS JOIN k LEFT JOIN g ON gram = substr(w, {ORDER + 1} - k, k + 1) LEFT JOIN c ON ctx = substr(w, {ORDER + 1} - k, k) GROUP BY w),
t AS (SELECT w, ln({_chance('na', 'a', 'ta')}) - ln({_chance('nr', 'r', 'tr')}) AS ratio FROM l),
sw AS (SELECT s, substr(concat(repeat(chr(2), {ORDER}), s, chr(3)), i, {ORDER + 1}) AS w
       FROM (SELECT s, unnest(range(1, length(s) + 2)) AS i FROM (SELECT DISTINCT s FROM u WHERE accepted IS NULL OR fold = 0))),
sc AS (SELECT s, sum(ratio) / count(*) AS score FROM sw JOIN t USING (w) GROUP BY s),
hist AS (SELECT floor(greatest(least(score, {LIMIT}), -{LIMIT}) * {STEPS}) AS b, sum(CASE WHEN accepted THEN n ELSE 0 END) AS a,
                sum(CASE WHEN accepted THEN 0 ELSE n END) AS r FROM sc JOIN u USING (s) WHERE accepted IS NOT NULL AND fold = 0 GROUP BY 1),
gain AS (SELECT b, round(sum(a) OVER v / greatest(sum(a) OVER (), 1) - sum(r) OVER v / greatest(sum(r) OVER (), 1), 9) AS x FROM hist
         WINDOW v AS (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (SELECT coalesce((SELECT b FROM gain ORDER BY x DESC, abs(b) LIMIT 1), 0) / {STEPS} AS b,
                coalesce((SELECT na > 0 AND nr > 0 FROM c WHERE ctx = ''), false) AS learned)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN NOT learned OR score >= b THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN sc ON r.rule IS NULL AND r.s = sc.s, best
"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
g AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS top FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM g
"""


def _crc32(text: str) -> str:
    """Bit by bit over the bytes of a text of ASCII characters."""
    step = "xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END)"
    eight = "xor(crc, byte)"
    for _ in range(8):
        eight = step.replace("crc", f"({eight})")
    fold = eight.replace("crc", "acc").replace("byte", "x")
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT), lambda acc, x: {fold}), 4294967295)"


OP12 = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', role, text))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, max(i) AS own, c - c % 100 AS base FROM t GROUP BY c),
k AS (SELECT c, own, base, h, least(h, coalesce((SELECT own FROM s AS z WHERE z.c = s.base), 0)) AS lent
      FROM (SELECT *, {_crc32('c::VARCHAR')} % 6 AS h FROM s) AS s),
u AS (
  SELECT k.c, t.i AS p, r, x FROM k JOIN t ON t.c = k.base AND t.i <= h
  UNION ALL SELECT k.c, t.i - h + lent, r, x FROM k JOIN t ON t.c = k.c AND t.i > h),
l AS (SELECT k.c, coalesce(max(p), 0) AS len FROM k LEFT JOIN u USING (c) GROUP BY k.c),
w AS (
  SELECT c, p, length(x) AS chars, md5(string_agg(concat(length(r), ':', r, length(x), ':', x), '') OVER (PARTITION BY c ORDER BY p)) AS a
  FROM u
  UNION ALL SELECT c, 0, 0, '' FROM k),
v AS (SELECT *, lag(a) OVER (PARTITION BY c ORDER BY p) AS pa FROM w),
n AS (SELECT a, any_value(pa) AS pa, max(p) AS depth, min(c) AS rep, count(*) AS n, max(chars) AS chars FROM v GROUP BY a),
d AS (SELECT pa AS a, count(*) AS kids FROM n WHERE pa IS NOT NULL GROUP BY pa),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN d USING (a)),
roll AS (
  SELECT v.a, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * f.chars) AS saved
  FROM f JOIN v ON v.c = f.rep AND v.p <= f.depth GROUP BY v.a),
e AS (SELECT a, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM v JOIN l USING (c) WHERE p = len GROUP BY a)
SELECT f.rep AS conv_id, f.depth::BIGINT AS depth, up.rep AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN roll USING (a) LEFT JOIN e USING (a) LEFT JOIN f AS up ON up.a = f.pa
"""

OP13 = """
WITH p AS (
  SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
held AS (
  SELECT DISTINCT lang, phrase FROM (
    SELECT lang, a, k - 1 AS k, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase
    FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 2)) AS o
  JOIN f USING (lang, k, phrase) WHERE 100 * o.a >= 100 * f.a),
c AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS left_part, array_to_string(w[j + 1:k], ' ') AS right_part
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f ANTI JOIN held USING (lang, phrase) WHERE k > 1)),
s AS (
  SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = left_part JOIN f AS y ON y.lang = c.lang AND y.phrase = right_part JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""

ORACLE = {"op11_warc_archive": OP11, "op12_prefix_trie": OP12, "op13_collocations": OP13, "op2_url_filter": OP2, "op6_line_dedup": OP6, "op8_decontamination": OP8, "op10_quality_rules": OP10}
