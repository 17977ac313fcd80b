"""Language identification of whole texts, with spans of mixed-language text.

Words are runs of letters, lower-cased.  A word's script (by code point ranges)
narrows the languages to those that were seen to use it.  Each of these scores the
word by the log probability of its letters, pairs and triples, word ends included
(naive Bayes over hashed features).  Viterbi over the words, with a
penalty for each switch, labels every word; equal neighbours form spans, and the
language of most letters is the text's.

The model learns from a sample of the labelled rows: all rows of a language
up to ``SAMPLE`` rows, else a share by a hash that gives about that many.  It is
``FEATURES`` numbers for each language, however large the corpus is.

Nulls and edge cases: a null text or one without letters is ``und`` with score 0 and no
spans; rows without text or language teach nothing; without any labelled row
all texts are ``und``; ties go to the language that sorts first; a word
in a script that no language uses takes its neighbours' language; null ids are
kept; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import base

#: About so many rows of each language are learned from.
SAMPLE = 4_000
FEATURES = 1 << 15
#: Nats: most that one word can speak against a language, and the price of a switch.
WORD_LIMIT, SWITCH = 6.0, 9.0
#: A language uses a script if it has so great a part of its words.
SCRIPT_SHARE = 0.01
#: Words whose scores a task keeps at most.
CACHE = 400_000
#: Words that are labelled together (and one text more).
WORDS_AT_ONCE = 1_500_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")

# First code points of script ranges and their scripts (0: any other).
SCRIPT_STARTS = np.array([0x0000, 0x0041, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80,
                          0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00])
SCRIPT_NAMES = ["other", "latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "other", "thai",
                "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other",
                "han", "other"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
SCRIPT_IDS = np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two zeros, and the words' first places."""
    line = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return line, np.flatnonzero(line == 0)[:-1]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, word by word, and where each word's begin."""
    line, starts = _codes(words)
    nul = line == 0
    mixed, keep = [], []
    for n in (1, 2, 3):
        h = np.full(len(line) - n + 1, n, np.uint64)
        inner = np.ones(len(h), bool)
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (line[k:k + len(h)] + np.uint64(0x7F4A7C15))
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1 or n == 1:
                inner &= ~nul[k:k + len(h)]
        if n == 2:
            inner &= ~(nul[:-1] & nul[1:])
        mixed.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FEATURES.bit_length() + 1))
        keep.append(inner)
    at = np.concatenate([np.flatnonzero(k) for k in keep])
    buckets = np.concatenate([m[k] for m, k in zip(mixed, keep)]).astype(np.int64)
    word = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(word, kind="stable")
    return buckets[order], np.searchsorted(word[order], np.arange(len(words)))


def scripts(words: list[str]) -> np.ndarray:
    """Of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    return SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, first, side="right") - 1]


def words_of(text: str) -> list[str]:
    """Runs of letters; superscript digits, fractions and the like are word characters but no letters."""
    out = LETTERS.findall(text.lower())
    if all(map(str.isalpha, out)):
        return out
    return "".join(c if c.isalpha() else " " for w in out for c in (*w, " ")).split()


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray        # FEATURES x languages
    uses: np.ndarray           # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        """At most 0, which the best language of a word has."""
        buckets, starts = features(words)
        total = np.add.reduceat(self.weights[buckets], starts, axis=0)
        usable = self.uses[scripts(words)]
        total = np.where(usable | ~usable.any(axis=1, keepdims=True), total, -np.inf)
        total = np.maximum(total - total.max(axis=1, keepdims=True), -WORD_LIMIT)
        return np.where(usable.any(axis=1, keepdims=True), total, 0.0)


def viterbi(score: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of every text: a language for each of its words.

    ``score``: words x languages, text after text.  All texts advance together, the
    longest ones first, so that those still running are always the first rows."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    running = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    stay = np.ones(score.shape, bool)
    came = np.zeros(len(score), np.int16)
    state = np.zeros((len(lengths), score.shape[1]))
    for t, n in enumerate(running):
        at = starts[:n] + t
        if t:
            top = state[:n].argmax(axis=1)
            moved = state[np.arange(n), top] - switch
            stay[at] = state[:n] >= moved[:, None]
            came[at] = top
            state[:n] = np.maximum(state[:n], moved[:, None])
        state[:n] += score[at]
    path = np.zeros(len(score), np.int64)
    now = state.argmax(axis=1) if len(lengths) else np.zeros(0, np.int64)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        path[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], came[at])
    return path


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    d = labelled.select(F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).where(
        "_text IS NOT NULL AND _lang IS NOT NULL")
    ship_package(d.sparkSession)
    sizes = {r["_lang"]: r["n"] for r in d.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((len(SCRIPTS), 0), bool))
    share = F.coalesce(*[F.when(F.col("_lang") == x, F.lit(min(1.0, sample / sizes[x]))) for x in langs])
    rows = d.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < share * (1 << 20))

    def count(frames) -> Iterator:
        import pandas as pd

        total, seen = np.zeros((FEATURES, len(langs)), np.int64), np.zeros((len(SCRIPTS), len(langs)), np.int64)
        for f in frames:
            for text, lang in zip(f["_text"], f["_lang"]):
                if words := words_of(text):
                    k = langs.index(lang)
                    total[:, k] += np.bincount(features(words)[0], minlength=FEATURES)
                    seen[:, k] += np.bincount(scripts(words), minlength=len(SCRIPTS))
        both = np.concatenate([total, seen])
        at, lang = np.nonzero(both)
        yield pd.DataFrame({"at": at, "lang": lang, "n": both[at, lang]})

    counts = rows.mapInPandas(count, "at long, lang long, n long").groupBy("at", "lang").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((FEATURES + len(SCRIPTS), len(langs)))
    table[counts["at"].to_numpy(), counts["lang"].to_numpy()] = counts["n"].to_numpy()
    seen, table = table[FEATURES:], table[:FEATURES] + 0.5
    return Model(langs, np.log(table / table.sum(axis=0)), seen >= SCRIPT_SHARE * np.maximum(seen.sum(axis=0), 1))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row for each document: the id, ``lang_pred``, ``score`` (the part of its letters in
    words of that language) and ``spans`` (first word, past the last, language)."""
    ship_package(docs.sparkSession)
    d = base(docs, id_col, text_col)
    shared = d.sparkSession.sparkContext.broadcast(model)

    def each(batches) -> Iterator:
        import pyarrow as pa

        m: Model = shared.value
        known: dict[str, int] = {}
        table, size = np.zeros((1024, len(m.langs)), np.float32), np.zeros(1024, np.int64)

        def learn(new: list[str], first: int) -> None:
            """Scores of new words, whose numbers begin at ``first``."""
            nonlocal table, size
            while len(table) < first + len(new):
                table, size = np.concatenate([table, np.zeros_like(table)]), np.concatenate([size, np.zeros_like(size)])
            for k in range(0, len(new), 20_000):
                part = new[k:k + 20_000]
                table[first + k:first + k + len(part)] = m.word_scores(part)
                size[first + k:first + k + len(part)] = [len(w) for w in part]

        def label(ids: list[np.ndarray]):
            lengths = np.array([len(x) for x in ids], np.int64)
            line = np.concatenate([np.zeros(0, np.int32), *ids])
            path = viterbi(table[line], lengths, switch) if len(line) else np.zeros(0, np.int64)
            text_of = np.repeat(np.arange(len(ids)), lengths)
            n = max(1, len(m.langs))
            letters = np.bincount(text_of * n + path, weights=size[line], minlength=len(ids) * n).reshape(len(ids), n)
            place = np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            opens = np.flatnonzero((place == 0) | np.concatenate(([True], path[1:] != path[:-1]))) if len(line) else np.zeros(0, np.int64)
            last = np.append(opens[1:], len(line))[:len(opens)]
            offsets = np.searchsorted(text_of[opens], np.arange(len(ids) + 1))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(place[opens], pa.int32()), pa.array(place[opens] + last - opens, pa.int32()),
                 pa.array([m.langs[k] for k in path[opens]], pa.string())], names=["start", "end", "lang"]))
            total = letters.sum(axis=1)
            pred = [m.langs[k] if t else UNKNOWN for k, t in zip(letters.argmax(axis=1), total)]
            return pa.array(pred, pa.string()), pa.array(letters.max(axis=1) / np.maximum(total, 1)), spans

        for b in batches:
            at, ids, words = 0, [], 0
            new: list[str] = []
            for r in range(b.num_rows):
                # words become numbers text by text, so a batch's words are never all held as strings
                own = words_of(b.column(1)[r].as_py()) if m.langs else []
                for w in {w for w in own if w not in known}:
                    known[w] = len(known)
                    new.append(w)
                ids.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                words += len(own)
                if words > WORDS_AT_ONCE or r == b.num_rows - 1:
                    learn(new, len(known) - len(new))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), *label(ids)],
                                                     names=["_id", "lang_pred", "score", "spans"])
                    at, ids, words, new = r + 1, [], 0, []
                    if len(known) > CACHE:
                        known = {}

    out = d.mapInArrow(each, f"_id {d.schema['_id'].dataType.simpleString()}, lang_pred string, score double, "
                             "spans array<struct<start:int,end:int,lang:string>>")
    return out.withColumnRenamed("_id", id_col)
