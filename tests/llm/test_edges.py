"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chatlake.llm import decontam, kdshard, langid, linededup, packing, quality, rollup, simhash, suffixdedup, urls
from chatlake.llm.tokens import counted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id long, _text string, _key string, piece int"
WORDS = "the quick brown fox jumps over lazy dogs and then sleeps under a warm red blanket of leaves"
LONG = "\n".join(f"line {i} of the long text, with the number {i * 7919 % 104729}" for i in range(20_000))
PASSAGE = " ".join(f"item{i}" for i in range(60))


def rows():
    docs = [(1, WORDS), (1, WORDS), (2, None), (3, ""), (4, LONG), (5, LONG), (6, " \t\n "), (None, WORDS), (None, None),
            (7, PASSAGE), (8, f"before {PASSAGE} after"), (9, "a\nb\nc"), (10, "\0 nul  nbsp é É"), (11, "x" * 100_000)]
    return [(i, t, "en" if t else None, None, None, "r", 99, "other", "k", 7) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "quick brown fox"), (3, None), (4, ""), (5, "!!"), (None, PASSAGE)], "item_id long, text string")


def test_quality(docs, none):
    r = quality.judge(docs).collect()
    assert len(r) == len(rows())
    by_words = {x.n_words: x for x in r}
    assert by_words[0].base_failed and not by_words[0].kept and by_words[0].word_chars == 0
    long = max(r, key=lambda x: x.n_words)
    words = LONG.split()
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    first, hit = {}, set()
    for i, g in enumerate(grams):
        if g in first:
            hit |= {*range(first[g], first[g] + 3), *range(i, i + 3)}
        else:
            first[g] = i
    assert (long.n_words, long.n_repeat_words) == (len(words), len(hit))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and quality.judge(none).count() == quality.keep_good(none).count() == 0


def test_repeat_words_by_text_agrees(spark):
    texts = spark.createDataFrame([(t,) for t in ("a b c a b c", "a a a a a", "a b c d", "a b c", "", "x y z x y q x y z", LONG[:5000])], "t string")
    ws = F.split("t", r"[\s]+")
    r = texts.select(quality.let(ws, quality._repeat_words).alias("a"),
                     F.when(F.size(ws) >= 4, quality.let(ws, quality._repeat_words_by_text)).otherwise(0).alias("b")).collect()
    assert all(x.a == x.b for x in r) and [x.a for x in r][:4] == [6, 5, 0, 0]


def test_line_dedup(docs, none):
    out = linededup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    text = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert text[4] == LONG and text[1] == WORDS and text[2] is None and text[3] == "" and text[9] == "a\nb\nc"
    assert len(text[5]) < 0.1 * len(LONG)            # what is left are chunks of a single line
    assert linededup.remove_repeats(none).count() == linededup.report(none).count() == 0


def test_line_dedup_first_place_and_collisions(spark):
    block = "same one\nsame two\nsame three\nsame four\nsame five\nsame six"
    d = spark.createDataFrame([(3, f"top c\n{block}\nend c"), (2, f"top b\n{block}\nend b"), (None, block)], "doc_id long, text string")
    text = {r.doc_id: r.text for r in linededup.remove_repeats(d).collect()}
    assert text[2].startswith("top b") and block in text[2]
    assert len(text[3]) < len(text[2]) and text[3].startswith("top c") and len(text[None]) < len(block)


def test_decontamination(docs, none, items):
    r = decontam.judge(docs, items).collect()
    by = {x.doc_id: x for x in r}
    assert len(r) == len(rows())
    assert (by[7].n_words, by[7].n_hit, by[7]["items"]) == (60, 60, ["1"])
    assert (by[8].n_words, by[8].n_hit) == (62, 60) and [tuple(s) for s in by[8].spans] == [(1, 61)]
    assert (by[1].n_hit, by[1]["items"]) == (3, ["2"]) and by[2].n_hit == by[4].n_hit == 0
    kept = decontam.drop_hit_documents(docs, items)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {None, 2, 3, 4, 5, 6, 9, 10, 11}
    cut = {x.doc_id: x.text for x in decontam.drop_hit_spans(docs, items).collect()}
    assert cut[8] == "before after" and cut[7] == "" and cut[4] == LONG and cut[2] is None
    assert decontam.judge(none, items).count() == decontam.drop_hit_documents(none, items).count() == 0
    assert decontam.judge(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.hits(docs, decontam.test_windows(items), broadcast_windows=0).count() == decontam.hits(docs, decontam.test_windows(items)).count()


def test_simhash(docs, none):
    r = simhash.near_copies(docs).collect()
    by = {x.doc_id: x for x in r}
    assert len(r) == len(rows()) and by[2].fingerprint == by[3].fingerprint == by[6].fingerprint == 0
    assert by[2].component_id == by[3].component_id == by[6].component_id == 2 and by[5].component_id == 4
    assert {x.component_id for x in r if x.doc_id is None} == {1, 2}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted({x.component_id for x in r})
    assert simhash.near_copies(none).count() == simhash.keep_first(none).count() == 0


def test_simhash_large_subtries_agree(spark):
    import numpy as np

    from chatlake.llm.components import components

    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    noise = np.uint64(1) << rng.integers(0, 64, (5, 60, 3)).astype(np.uint64)
    values = np.unique(center[:, None] ^ noise[..., 0] ^ noise[..., 1] ^ noise[..., 2])
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "_fp long")
    label = {}
    for cap in (512, 8):
        label[cap] = {r.node: r.label for r in components(simhash.links(fps, 4, cap)).collect()}
    parts = lambda x: sorted(sorted(k for k in x if x[k] == v) for v in set(x.values()))
    assert parts(label[512]) == parts(label[8])


def test_trie_pairs_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(7)
    v = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    w = np.unique(np.concatenate([v, v[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)), v[:80] ^ np.uint64(0b1111)]))
    for bits in (0, 1, 4):
        i, j = simhash.trie_pairs(w, np.array([0, 100, len(w)]), bits)
        near = np.bitwise_count(w[:, None] ^ w[None, :]) <= bits
        part = np.arange(len(w)) >= 100
        a, b = np.nonzero(np.triu(near & (part[:, None] == part[None, :]), 1))
        assert sorted(zip(np.minimum(i, j), np.maximum(i, j))) == sorted(zip(a, b))


def test_components_of_chains_and_stars(spark):
    from chatlake.llm.components import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({label[i] for i in range(201)}) == 1 and len({label[1000 + i] for i in range(50)}) == 1
    assert label[0] != label[1000] and 5000 not in label


def test_packing(docs, none):
    r = packing.pack_documents(docs).collect()
    whole = {}
    for x in r:
        whole.setdefault(x.doc_id, []).append((x.piece, x.start, x.length))
    assert whole[2] == whole[3] == [(0, 0, 1)] and len(whole[1]) == 2
    pieces = sorted(whole[4])
    assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 4096 for _, _, n in pieces[:-1])
    used = {}
    for x in r:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 4096
    assert packing.pack_documents(none).count() == 0


def test_packing_plan_uses_every_piece():
    from collections import Counter

    hist = {4096: 3, 4000: 7, 2048: 9, 1365: 10, 700: 31, 96: 5, 1: 40}
    got = Counter()
    for lengths, n in packing.plan(hist):
        assert sum(lengths) <= 4096
        for x in lengths:
            got[x] += n
    assert got == hist and packing.plan({}) == []


def test_whole_text_ids():
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from chatlake.llm.tokens import Encoder, tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    t, e, r = Tokenizer.from_file(path), Encoder(path), random.Random(3)
    parts = list("abAB éÉİßΣς 's1٣漢字かな\t\n\r\x0b\x0c\x1c\x85   ​̧́!?.,<|>\0😀👍🏽") + ["<|endoftext|>", "'ll", "é"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert e.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_sharding(docs, none):
    r = kdshard.shard(docs, shards=5).collect()
    assert len(r) == len(rows()) and {x.shard for x in r} <= set(range(5))
    slots = {}
    for x in r:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({x.shard for x in r if x.doc_id == 1}) == 1
    assert kdshard.shard(none, shards=5).count() == 0
    assert {x.shard for x in kdshard.shard(docs, target_bytes=10 ** 9).collect()} == {0}


def test_sharding_cuts_ties(spark):
    same = spark.createDataFrame([(i, "text" * 20, "en", "hot", 80) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [x.n for x in kdshard.shard(same, shards=7, dims=("source", "lang")).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) < 12


def test_language_id(spark, docs, none):
    labelled = spark.createDataFrame([("the house and the garden with trees", "en"), ("le jardin et la maison dans les arbres", "fr"),
                                      ("дом и сад", "ru"), (None, "en"), ("text", None)], "text string, lang string")
    m = langid.train(labelled)
    assert m.langs == ["en", "fr", "ru"]
    mixed = spark.createDataFrame([(1, "the house and the garden with the trees and the house with the garden "
                                       "le jardin et la maison dans les arbres et le jardin"), (2, "сад дом"), (3, "12 !"), (4, None)],
                                  "doc_id long, text string")
    by = {r.doc_id: r for r in langid.identify(mixed, m).collect()}
    assert [s.lang for s in by[1].spans] == ["en", "fr"] and by[1].spans[0].end == by[1].spans[1].start
    assert by[2].lang_pred == "ru" and by[3].lang_pred == by[4].lang_pred == "und" and by[4].score == 0 and by[4].spans == []
    assert langid.identify(docs, m).count() == len(rows()) and langid.identify(none, m).count() == 0
    empty = langid.train(labelled.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_viterbi_against_all_paths():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(2)
    lengths = np.array([4, 1, 0, 5])
    score = -rng.random((10, 3)) * 4
    path = langid.viterbi(score, lengths, 1.5)
    at = 0
    for n in lengths:
        cost = lambda p: sum(score[at + i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        if n:
            assert abs(cost(path[at:at + n]) - max(cost(p) for p in product(range(3), repeat=int(n)))) < 1e-9
        at += n


def test_url_filter(spark):
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/x?q=/y#z"), (4, "http://A.Example.COM/en/x?q=/y#z"),
             (5, "http://www.example.com/en/1"), (6, "http://x.net/es/"), (7, "http://x.net/de/"), (8, "http://y.com"), (None, "ftp://u@x.org:80#f"),
             (9, "x://y://z/p")]
    d = spark.createDataFrame([(*p, "host", 1.0) for p in pages], "page_id long, url string, host string, score double")
    by = {r.page_id: r for r in urls.judge(d).collect()}
    assert urls.judge(d).count() == len(pages) and urls.judge(d.limit(0)).count() == 0
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by[5].rule == "www.example.com/en/" and by[6].rule == "net/es/" and by[8].rule is None and by[8].path == ""
    assert (by[None].host, by[None].path) == ("u@x.org:80", "") and by[1].host == by[2].path == by[3].host == "" and by[9].host == "y:"
    assert {r.verdict for r in urls.judge(d.where("page_id IN (1, 7)")).collect()} == {"allow"}


def test_suffix_dedup(docs, none):
    r = suffixdedup.dedup(docs).collect()
    by = {x.doc_id: x for x in r}
    assert len(r) == len(rows()) and by[2].n_bytes == by[3].n_bytes == 0
    assert by[4].n_removed == by[5].n_removed == len(LONG) and bytes(by[4].kept) == b"" and len(by[4].spans) == 1
    assert by[1].n_removed == 0 and bytes(by[1].kept) == WORDS.encode()
    assert by[11].n_removed == 100_000
    assert by[7].n_removed == len(PASSAGE) and by[8].n_bytes - by[8].n_removed == len("before  after")
    assert suffixdedup.dedup(none).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    text = hashlib.sha512(b"x").hexdigest() * 2
    d = spark.createDataFrame([(1, text), (1, text), (2, text[:199])], "doc_id long, text string")
    r = {(x.doc_id, x.n_removed) for x in suffixdedup.dedup(d).collect()}
    assert r == {(1, len(text)), (2, 0)}


def test_rollup(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"
    a = spark.createDataFrame([("insert", "s", "en", "1", 10, None), ("insert", "s", "en", "1", 10, None), ("insert", None, None, "1", None, None),
                               ("delete", "s", "en", "1", 4, None), ("revise", "s", "en", "1", 7, 10)], schema)
    total = lambda: {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert total() == set()
    assert r.commit("a/1", a) and not r.commit("a/1", a)
    assert total() == {("s", 1, 13), (None, 1, 0)}
    r.compact()
    assert not r.commit("a/1", a) and total() == {("s", 1, 13), (None, 1, 0)}
    assert r.commit("2", spark.createDataFrame([("delete", "s", "en", "1", 13, None)], schema)) and r.commit("empty", a.limit(0))
    r.compact()
    r.compact()
    assert total() == {(None, 1, 0)}
    with pytest.raises(Exception, match="unknown operation"):
        r.commit("bad", spark.createDataFrame([("drop", "s", "en", "1", 1, None)], schema))
    assert total() == {(None, 1, 0)} and r.commit("bad", a)


def test_rollup_compaction_stopped_between_steps(spark, tmp_path, monkeypatch):
    """A compaction that ends after its ledger part, or after its snapshot, leaves the totals and all batch ids right."""
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"
    a = spark.createDataFrame([("insert", "s", "en", "1", 10, None)], schema)
    total = lambda: [(x.n_docs, x.n_tokens) for x in r.totals().collect()]

    def stop(*_):
        raise RuntimeError("lost")

    assert r.commit("1", a) and r.commit("2", a)
    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "totals", stop)
        with pytest.raises(RuntimeError):
            r.compact()
    assert total() == [(2, 20)] and not r.commit("1", a) and r.commit("3", a)
    fs = rollup.Rollup._fs

    class Deletes:
        def __init__(self, inner):
            self.exists, self.listStatus, self.delete = inner.exists, inner.listStatus, stop

    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "_fs", lambda self, path: (Deletes(fs(self, path)[0]), fs(self, path)[1]))
        with pytest.raises(RuntimeError):
            r.compact()
    assert total() == [(3, 30)] and not r.commit("2", a) and not r.commit("3", a) and r.commit("4", a)
    r.compact()
    assert total() == [(4, 40)] and not any(r.commit(b, a) for b in "1234") and r._committed("deltas") == []
    ledger = spark.read.parquet(f"{r.folder}/batches").groupBy("snapshot").count().collect()
    assert sorted(x["count"] for x in ledger) == [1, 3]         # a compaction adds its own ids only


def test_counted_keeps_other_columns(docs):
    out = counted(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["n_tokens"]
    assert out.where("doc_id = 3").first().n_tokens == 0
    clash = counted(docs.withColumn("N_Tokens", F.lit("x")))
    assert clash.columns == out.columns and clash.where("doc_id = 3").first().n_tokens == 0


def test_language_needs_letters(spark):
    """Superscripts, fractions and circled digits are no letters."""
    d = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "7 __ ²"), (4, "the a² and"), (5, "x²y")], "doc_id long, text string")
    model = langid.train(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (1, 2, 3))
    assert got[4].lang_pred == "en" and langid.words_of("x²y É½z") == ["x", "y", "é", "z"]


def test_kept_rows_are_measured_once(docs):
    once = quality.judge(docs)._jdf.queryExecution().executedPlan().toString().count("split(")
    assert quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString().count("split(") <= 2 * once


def test_rank_in_groups_is_gapless_by_blocks(spark):
    from pyspark.sql import functions as F

    from chatlake.llm.common import rank_in_groups

    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"), "id")
    for per in (2, 300, 100_000):
        out = rank_in_groups(df, ["g"], ["id"], "r", 5000, per)
        assert sorted(out.columns) == ["g", "id", "r"]
        by = out.groupBy("g").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count_distinct("r").alias("d"), F.count("*").alias("n")).collect()
        assert len(by) == 3 and all(x.a == 0 and x.b == x.n - 1 == x.d - 1 for x in by)
    assert rank_in_groups(df.limit(0), ["g"], ["id"], "r", 0).count() == 0


def test_url_case_variants_keep_their_own_verdicts(spark):
    urls_ = [f"http://a{i}.net/es/x" for i in range(8)] + [f"http://b{i}.com/y" for i in range(8)]
    urls_ += [u.replace("/es/", "/ES/") for u in urls_[:8]]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "page_id long, url string")
    r = {x.page_id: x for x in urls.judge(pages).collect()}
    assert all(r[i].rule == "net/es/" and r[i].score is None for i in range(8))
    assert all(r[i].rule is None and r[i].score < 0 and r[i].verdict == "block" for i in range(16, 24))


def test_decontamination_of_all_lengths_in_one_pass(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "c"), (3, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b c y"), (2, " ".join(f"w{i}" for i in range(11))), (3, "a"), (4, "")], "doc_id long, text string")
    r = {x.doc_id: (x.n_hit, x["items"]) for x in decontam.judge(docs, items).collect()}
    assert r == {1: (3, ["1", "2"]), 2: (11, ["3"]), 3: (0, []), 4: (0, [])}
