"""The registered queries against SQL or brute force over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chatlake.llm import queries as Q
from chatlake.plans.verify import compare

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    r = compare(Q.QUERIES[name](spark, sf_dir), duck, Q.ORACLE[name])
    assert r["ok"], r


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    from chatlake.llm.tokens import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = Q.QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    want = set()
    for k, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(k, p, 4096 * p, len(x), zlib.crc32(x.tobytes())) for p, x in
                 enumerate(ids[a:a + 4096] for a in range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096
    assert len(at) <= 1.01 * sum(at.values()) / 4096 + 2


def test_url_filter(spark, sf_dir, duck):
    from math import log

    from chatlake.llm import urls as U

    got = {r.page_id: r for r in U.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    split, rules = {}, {}
    for page, url in duck.execute("SELECT page_id, url FROM pages").fetchall():
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in U.RULES if (host == (h := r[1].split("/", 1)[0]) or host.endswith("." + h))
                and path.startswith("/" + r[1].split("/", 1)[1])]
        split[page], rules[page] = (host, path), max(fits, key=lambda r: len(r[1]), default=(None, None))
    seen = {True: Counter(), False: Counter()}
    fold = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:6], 16) % U.FOLDS
    text = {p: "".join(split[p]).lower() for p in split}
    wins = lambda s: [(U.START * U.ORDER + s + U.END)[i:i + U.ORDER + 1] for i in range(len(s) + 1)]
    for p in split:
        if rules[p][0] and fold(text[p]):
            seen[rules[p][0] == "allow"].update(w[-k:] for w in wins(text[p]) for k in range(1, U.ORDER + 2))
    after = {c: {} for c in seen}
    for c, grams in seen.items():
        for g, n in grams.items():
            after[c].setdefault(g[:-1], []).append(n)

    def chance(c, w):
        p = 1 / 256
        for k in range(U.ORDER + 1):
            ns = after[c].get(w[U.ORDER - k:-1], [])
            p = (seen[c][w[U.ORDER - k:]] + len(ns) * p) / (sum(ns) + len(ns)) if ns else p
        return p

    score = lambda s: sum(log(chance(True, w)) - log(chance(False, w)) for w in wins(s)) / len(wins(s))
    free = [p for p in split if not rules[p][0]]
    assert free and all(abs(got[p].score - score(text[p])) < 1e-9 for p in free)
    assert all((got[p].host, got[p].path) == split[p] and got[p].rule == rules[p][1] for p in split)
    assert all(got[p].verdict == rules[p][0] for p in split if rules[p][0])
    allowed, blocked = ([score(text[p]) for p in free if got[p].verdict == v] for v in ("allow", "block"))
    assert min(allowed) > max(blocked)


def test_token_rollup(spark, sf_dir, duck):
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in Q.QUERIES["op3_token_rollup"](spark, sf_dir).collect()}
    want = duck.execute(r"""
        SELECT source, lang, count(*), sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+')))::BIGINT
        FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 GROUP BY ALL""").fetchall()
    assert {k[:2]: v for k, v in got.items() if k[2] == "words"} == {(s, x): (n, w) for s, x, n, w in want}
    assert {k[:2]: v[0] for k, v in got.items() if k[2] != "words"} == {(s, x): n for s, x, n, _ in want}

    from tokenizers import Tokenizer

    from chatlake.llm.tokens import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokens = Counter()
    for s, x, text in duck.execute("SELECT source, lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1").fetchall():
        tokens[s, x] += len(t.encode(text or "", add_special_tokens=False).ids)
    assert {k[:2]: v[1] for k, v in got.items() if k[2] != "words"} == dict(tokens)


def test_sharding(spark, sf_dir, texts):
    rows = Q.QUERIES["op4_kd_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_sharding_tree(spark, sf_dir):
    """The shards against the same tree, node by node, on all points at once."""
    from chatlake.llm import kdshard as K

    points = [(r._id, r._size, tuple(r._c), r._tie) for r in K.points(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", K.DIMENSIONS).collect()]
    want = {}

    def place(node, first, k):
        if k == 1 or not node:
            want.update((p[0], first) for p in node)
            return
        low = [min(p[2][d] for p in node) for d in range(4)]
        width = [max(p[2][d] for p in node) - low[d] for d in range(4)]
        d = width.index(max(width))
        step = lambda p: (min(int((p[2][d] - low[d]) / width[d] * K.BINS), K.BINS - 1) if width[d] > 0 else 0, p[3])
        weight = Counter()
        for p in node:
            weight[step(p)] += p[1]
        target, so_far, cut = sum(weight.values()) * (k // 2) / k, 0, None
        for key in sorted(weight):
            if so_far + weight[key] >= target:
                cut = key if so_far + weight[key] - target >= target - so_far else (key[0], key[1] + 1)
                break
            so_far += weight[key]
        place([p for p in node if step(p) < cut], first, k // 2)
        place([p for p in node if step(p) >= cut], first + k // 2, k - k // 2)

    place(points, 0, 24)
    assert {r.doc_id: r.shard for r in Q.QUERIES["op4_kd_sharding"](spark, sf_dir).collect()} == want


def test_language_id(spark, sf_dir, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = Q.QUERIES["op5_language_id"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def simhash(text):
    from xxhash import xxh64

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    h = [xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits=4):
    keys = sorted(prints)
    least = {k: k for k in keys}

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= bits and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {k: find(k) for k in keys}


def test_simhash(spark, sf_dir, texts):
    rows = Q.QUERIES["op7_simhash"](spark, sf_dir).collect()
    prints = {k: simhash(t) for k, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == groups(prints)


def without_repeats(texts, length=200):
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, hit) if not y)
        out.append((len(b), sum(hit), sum(1 for x in bytes(hit).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group, bits", [(512, 1 << 26), (2, 1 << 26), (3, 1 << 6)])
def test_suffix_dedup(spark, group, bits, monkeypatch):
    """Groups that are refined down to two entries, and a parse that is filtered by a join, give the same."""
    import duckdb

    from chatlake.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "GROUP", group)
    monkeypatch.setattr(suffixdedup, "BITMAP", bits)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{TINY}/documents.parquet' ORDER BY doc_id").fetchall()
    want = dict(zip([d[0] for d in docs], without_repeats([(d[1] or "").encode() for d in docs])))
    got = {r[0]: tuple(r[1:]) for r in Q.QUERIES["op9_suffix_dedup"](spark, TINY).collect()}
    assert got == want


def test_suffix_dedup_refinement(spark, monkeypatch):
    """Hot near copies: one passage whose surroundings differ at many distances; the rows of a round are at most two an open entry."""
    import random

    from chatlake.llm import suffixdedup

    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(160):
        w = list(passage)
        for _ in range(2):
            w[r.randrange(60)] = word()
        texts.append(" ".join(w).encode())
    made, inner = [], suffixdedup._refined

    def counted(rows, size):
        out = inner(rows, size)
        made.append((size, rows.count(), out.count()))
        return out

    monkeypatch.setattr(suffixdedup, "GROUP", 4)
    monkeypatch.setattr(suffixdedup, "_refined", counted)
    d = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffixdedup.dedup(d).collect()}
    assert got == dict(enumerate(without_repeats(texts)))
    assert made and made[-1][0] < made[0][0] and all(out <= 2 * rows for _, rows, out in made)
