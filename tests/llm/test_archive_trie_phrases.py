"""WARC archives, the prefix trie and collocations: brute force, edge cases and small limits."""

import glob
import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatlake.llm import collocations, trie, warc

PAGES = "page_id long, url string, html string, _id string, _refers_to long, record_type string"


def pages(spark):
    big, other = "<p>" + "word " * 400, "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (3, None, big), (4, "u", other), (9, "u", other), (None, "u", other),
            (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (10, "http://a/b%20c?é", "x" * 3_000_000), (None, "only", "z" * 2000),
            (11, "u", "\0\r\n\r\n" * 300)]
    return spark.createDataFrame([(*r, "i", 5, "t") for r in rows], PAGES), rows


@pytest.mark.parametrize("limits", [(1 << 30, 4 << 20), (5000, 1000)])
def test_archives(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", limits[0])
    monkeypatch.setattr(warc, "BLOCK_BYTES", limits[1])
    d, rows = pages(spark)
    got = warc.archive(d, folder=f"file://{tmp_path}/w").collect()
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == raw and p is not None), default=None) if len(raw) >= 1000 else None
        ref = top if top != page else None
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if ref is None else "revisit", ref))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.url for r in got} == {u if u is None or "\r" not in u else "http://a/2%0D%0AX:%20y" for _, u, _ in rows}


def test_archive_holds_its_dictionary(spark, tmp_path):
    import zstandard

    d = spark.range(3000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat(repeat('<li>row ', 20), id, repeat('</li>', 20), md5(string(id))) AS html")
    index = warc.write_archives(d, f"file://{tmp_path}/w")
    assert index.agg({"records": "sum"}).first()[0] == 3000
    names = glob.glob(f"{tmp_path}/w/*.warc.zst")
    assert sorted({r.archive for r in index.collect()}) == sorted(n.rsplit("/", 1)[1] for n in names)
    seen = 0
    for n in names:
        raw = open(n, "rb").read()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY
        own = zstandard.ZstdCompressionDict(raw[8:8 + size])
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=own).stream_reader(raw, read_across_frames=True))
        kinds = [f["warc-type"] for f, _ in warc.records(stream)]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"}
        seen += len(kinds) - 1
        with pytest.raises(zstandard.ZstdError):                   # records can't be read without it
            zstandard.ZstdDecompressor().stream_reader(raw[8 + size:], read_across_frames=True).read()
    assert seen == 3000


def test_broken_archive(spark, tmp_path):
    raw = warc.record("1", "u", b"x" * 10, None, "2020-01-01T00:00:00Z")
    fields, block = next(warc.records(io.BufferedReader(io.BytesIO(raw))))
    assert warc.page_of(fields, block)[:3] == ("1", "u", 10)
    with pytest.raises(ValueError):
        warc.page_of(fields, block.replace(b"x", b"y"))
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(raw[:-8]))))


def test_no_pages(spark, tmp_path):
    d, _ = pages(spark)
    assert warc.archive(d.limit(0), folder=f"file://{tmp_path}/w").count() == 0


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        built[c] = base[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, m in members.items():
        e = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(s)))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(e.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, a long, c string, rep long, p long, key string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3, "k") for r in rows], CONVERSATIONS)


def sample(seed):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice("ab"), rnd.choice(["x", "yé", "zzz"])) for c in [*range(0, 40), *range(100, 130), 205, 317, -5, -205] for t in range(rnd.choice([1, 1, 3, 7, 12]))]
    rows += [(7, None, None, None), (7, None, None, None), (7, 3, "a", "x"), (7, 3, "a", "x"), (None, 1, "a", "lost"), (400, None, "", ""), (401, 0, None, None)]
    rows += [(500, t, "a", f"long {t % 7}") for t in range(300)] + [(501, t, "a", f"long {t % 7}") for t in range(300)]
    return rows


@pytest.mark.parametrize("local, part", [(None, 1 << 16), (3, 16), (1, 7)])
def test_trie(spark, monkeypatch, local, part):
    monkeypatch.setattr(trie, "PART", part)
    rows = sample(local or 0)
    if local == 1:
        rows = [r for r in rows if r[0] is None or r[0] < 40]
    got = [tuple(r) for r in trie.prefix_trie(talk(spark, rows), local=local).collect()]
    assert sorted(got, key=repr) == sorted(brute_trie(rows), key=repr)


def test_no_conversations(spark):
    assert trie.prefix_trie(talk(spark, [(None, 1, "a", "b")])).count() == 0


def test_deep_chains_fall_apart_fast():
    rnd = np.random.default_rng(3)
    n = 3000
    parent = np.concatenate(([-1, -1], np.where(rnd.random(n - 2) < 0.9, np.arange(1, n - 1), rnd.integers(0, n, n - 2) % np.arange(1, n - 1))))
    depth = np.zeros(n, np.int64)
    for v in range(n):
        depth[v] = 1 if parent[v] < 0 else depth[parent[v]] + 1
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parent = np.where(parent[order] < 0, -1, place[parent[order]])
    own, values = rnd.integers(1, 50, n), rnd.integers(0, 1000, (n, 2))
    weight, want = own.copy(), values.copy()
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            weight[parent[v]] += weight[v]
            want[parent[v]] += want[v]
    assert (trie.split_locally(parent, depth[order], weight, values) == want).all()


def brute_phrases(rows, least, top, longest=5):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    held = {(x, q) for (x, p), a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i:i + k]] if often[x, q] == a}
    best = defaultdict(list)
    for (x, p), a in often.items():
        if (x, p) not in held:
            score, k = min((1000 * a * n[x] // (f[x, p[:k]] * f[x, p[k:]]), k) for k in range(1, len(p)))
            best[x].append((-score, -a, " ".join(p).encode(), f[x, p[:k]], f[x, p[k:]]))
    return [(x, i + 1, p.decode(), -a, l, r, n[x], -s) for x, rows in best.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]


DOCS = "doc_id long, lang string, text string, phrase string, f long, n long, score long"


@pytest.mark.parametrize("least, top, first", [(2, 5, 0.1), (1, 25, 0.01)])
def test_phrases(spark, least, top, first):
    rnd = random.Random(top)
    words = [f"w{k}" for k in range(40)] + ["É", "é", "The", "tHe", "a b"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(rnd.choice(["en", "fr", None]), "".join(w + rnd.choice([" "] * 8 + ["  ", "\t", ". ", "\n", ",", "!? "]) for w in rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 80]))))
            for _ in range(120)]
    rows += [("en", "new york city hall is new york city hall")] * 6 + [(None, None), ("en", ""), ("de", " \t. "), ("xx", "one")]
    d = spark.createDataFrame([(1, *r, "p", 1, 2, 3) for r in rows], DOCS)
    got = [tuple(r) for r in collocations.mine(d, least=least, top=top, first=first).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, least, top))


def test_long_text_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "AT_ONCE", 50)
    rows = [("en", "alpha beta, gamma delta. " * 300), ("en", "alpha beta " * 200)]
    d = spark.createDataFrame([(1, *r, "p", 1, 2, 3) for r in rows], DOCS)
    assert sorted(tuple(r) for r in collocations.mine(d).collect()) == sorted(brute_phrases(rows, 100, 2000))
    assert list(collocations._lines(iter([b"A b.\nc" * 200]))) and len(list(collocations._lines(iter([b"A b.\nc" * 200])))) > 2
    assert collocations.mine(d.limit(0)).count() == 0


def run_task(scan, batches):
    """The batches that a task of the scan gives for these."""
    class Lines:
        def mapInArrow(self, each, schema):
            self.each = each
            raise StopIteration

    lines = Lines()
    with pytest.raises(StopIteration):
        scan(lines)
    return lines.each(iter(batches))


def test_a_line_is_counted_in_lots(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rnd = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    pieces = [rnd.choices(words, [1 / (k + 1) for k in range(3000)], k=rnd.randrange(60)) for _ in range(2500)]
    text = ". ".join(" ".join(p) for p in pieces)
    docs = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    [line] = run_task(collocations.encoded, [docs])
    assert line.column(1)[0].as_py()[0] == "\n" and len(np.frombuffer(line.column(2)[0].as_py(), "<i4")) == sum(map(len, pieces)) + len(pieces) - 1
    every = SimpleNamespace(value=np.full(collocations.FEWEST_BITS // 64, 2**64 - 1, np.uint64))
    for lengths, head, frequent in (((2,), 1, every), ((3, 4, 5), 2, every), ((2, 3, 4), None, None)):
        scan = lambda lines: collocations.count_phrases(lines, every, lengths, head, frequent)  # noqa: E731, B023
        monkeypatch.setattr(collocations, "LOT", len(text))
        whole = sorted(r for b in run_task(scan, [line]) for r in zip(*b.to_pydict().values()))
        monkeypatch.setattr(collocations, "LOT", 1 << 11)
        held, most, rows = 0, 0, 0
        tracemalloc.start()
        for b in run_task(scan, [line]):
            most, rows = max(most, b.num_rows), rows + b.num_rows
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(whole) and most < rows / 5                      # the more lots, the fewer rows at once
        assert held < 50 * sum(map(len, pieces))
        assert sorted(r for b in run_task(scan, [line]) for r in zip(*b.to_pydict().values())) == whole
        found = Counter(" ".join(p[i:i + k]) for k in lengths for p in pieces for i in range(len(p) - k + 1))
        assert {p: a for _, p, a, *_ in whole} == found


def test_scans_get_and_give_little_at_once(spark, monkeypatch):
    import pyarrow.parquet as pq

    key, seen, count = "spark.sql.execution.arrow.maxBytesPerBatch", {}, collocations.count_words

    def counted(lines):
        def each(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        seen["batches"] = [r.n for r in lines.coalesce(1).mapInArrow(each, "n long").collect()]
        metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in lines.inputFiles()]
        seen["groups"] = [m.row_group(k).num_rows for m in metas for k in range(m.num_row_groups)]
        return count(lines)

    monkeypatch.setattr(collocations, "count_words", counted)
    rnd, before = random.Random(3), spark.conf.get(key)
    rows = [("en", " ".join(rnd.choices(["ab", "cd", "ef.", "gh"], k=2_200_000))) for _ in range(3)] + [("fr", "ab cd " * 60)] * 2
    d = spark.createDataFrame([(1, *r, "p", 1, 2, 3) for r in rows], DOCS).coalesce(1)
    assert sorted(tuple(r) for r in collocations.mine(d).collect() if r.lang == "fr") == sorted(brute_phrases(rows[3:], 100, 2000))
    for parts in seen.values():                                            # a long line and the next, not all seven of the task
        assert sum(parts) == 7 and max(parts) <= 2
    assert spark.conf.get(key) == before


def test_small_batches_make_the_same_lines(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(4)
    rows = [(rnd.choice(["en", "fr", "de"]), " ".join(rnd.choices(["x", "y", "z."], k=40))) for _ in range(300)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x for x, _ in part]), pa.array([t for _, t in part])], names=["lang", "text"])

    def lines(size):
        return [r for b in run_task(collocations.encoded, [batch(rows[k:k + size]) for k in range(0, len(rows), size)]) for r in zip(*b.to_pydict().values())]

    assert len(lines(len(rows))) == len(lines(7)) == 3 and lines(len(rows)) == lines(7)
    # some lines' worth is held at most, however many languages there are
    monkeypatch.setattr(collocations, "AT_ONCE", 100)
    rows = [(f"l{k % 50}", "x y z. " * 10) for k in range(500)]
    parts, read, ahead = lines(1), [], []
    assert sum(len(np.frombuffer(ids, "<i4")) for *_, ids in parts) >= 500 * 40 and {x for x, *_ in parts} == {x for x, _ in rows}

    def fed():
        for r in rows:
            read.append(len(r[1]))
            yield batch([r])

    for _, line in collocations._by_language(fed()):
        read.append(-len(line))
        ahead.append(sum(read))
    assert max(ahead) < 5 * 6 * collocations.AT_ONCE

    # and what a scan gives comes in parts
    monkeypatch.setattr(collocations, "ROWS", 10)
    words = [f"w{k}" for k in range(95)]
    [line] = run_task(collocations.encoded, [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(words)])], names=["lang", "text"])])
    got = [b.to_pydict()["phrase"] for b in run_task(collocations.count_words, [line])]
    assert max(map(len, got)) == 10 and sorted(w for g in got for w in g) == sorted(words)
