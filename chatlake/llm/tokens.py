"""Token ids of whole texts, computed word by word inside a task.

The tokenizer drops white space and never joins characters across it, so a
text's ids are the ids of its pieces between spaces and line feeds.  A task
keeps the ids of pieces it has met (twice ``CACHE`` and one text's at most), which spares
most of the encoding in ordinary text.  Only tokenizers with this property
may be used; ``tests/llm`` checks it against whole-text encoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

CACHE = 500_000
#: A character that is a piece of its own between other pieces.
MARK = "\0"
#: Longer pieces are encoded but not kept.
LONG_PIECE = 64
#: Characters of texts whose new pieces are encoded together (and one text more).
GROUP = 2_000_000
#: Marks that are tokens of their own after a letter, and what ends the last token of a word in the vocabulary.
ENDS, WORD_END = ".,;:!?", "</w>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One for each worker process, which may run many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Pieces met of late are in ``known``, those before in ``older``; pieces that are met
    again move up, so frequent ones stay when the rest is dropped."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        self.mark = self._ids(MARK)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[k for t, k in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece.  Pieces of letters alone are one word each, so the tokens that end a word part them."""
        words = [p for p in pieces if p.lower().isalpha()]
        ids = self._ids(" ".join(words))
        ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
        if len(ends) != len(words):
            return self._pieces(pieces)
        line = ids.tobytes()
        found = {w: line[4 * a:4 * b] for w, a, b in zip(words, [0, *ends], ends)}
        others = [p for p in pieces if p not in found]
        if others:
            found.update(zip(others, self._pieces(others)))
        return [found[p] for p in pieces]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: all in one call, with marks between them.  The mark's only id
        comes from its character alone, and pieces that hold it are encoded by themselves."""
        plain = [p for p in pieces if MARK not in p]
        if len(self.mark) != 1 or len(plain) < len(pieces):
            return [self._ids(p).tobytes() for p in pieces]
        ids = self._ids(f" {MARK} ".join(plain))
        ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
        line = ids.tobytes()
        return [line[4 * (a + 1):4 * b] for a, b in zip([-1, *ends], ends)]

    def _learn(self, new: set[str]) -> None:
        """Ids of new pieces.  Words are encoded without the mark that ends them and, if they are ASCII,
        in lower case, which the tokenizer makes of them anyway; so their forms share one encoding."""
        known, older = self.known, self.older
        forms, need = {}, {}
        for p in new:
            if p in older:
                known[p] = older[p]
                continue
            core, end = (p[:-1], p[-1]) if p[-1] in ENDS and p[:-1].lower().isalpha() else (p, "")
            forms[p] = core, end = core.lower() if core.isascii() else core, end
            for part in (core, end):
                if part not in known:
                    need[part] = older.get(part)
        fresh = [x for x, ids in need.items() if ids is None]
        if fresh:
            need.update(zip(fresh, self._encoded(fresh)))
        known.update(need)
        for p, (core, end) in forms.items():
            known[p] = known[core] + known[end]

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; new pieces of some ``GROUP`` characters are encoded together."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            new: set[str] = set()
            while upto < len(texts) and size < GROUP:
                new |= set(texts[upto].replace("\n", " ").split(" ")).difference(self.known)
                size += len(texts[upto])
                upto += 1
            if new:
                self._learn(new)
            get = self.known.__getitem__
            for t in texts[at:upto]:
                yield b"".join(map(get, t.replace("\n", " ").split(" ")))
            for p in new:
                if len(p) > LONG_PIECE:
                    del self.known[p]
            if len(self.known) > CACHE:
                self.known, self.older = {"": b""}, self.known
            at = upto

    def ids(self, text: str) -> bytes:
        return next(self.many([text]))


def counted(docs: DataFrame, text_col: str = "text", tokenizer: str = "word_bpe_49k.json", name: str = "n_tokens") -> DataFrame:
    """All columns but the text, and the number of its tokens (null: 0), which takes the place of a
    column that is called so, in whatever case."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col and c.lower() != name.lower()]
    d = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col))

    def each(batches):
        import pyarrow as pa

        encode = encoder(tokenizer_path(tokenizer)).many
        for b in batches:
            n = [len(ids) // 4 for ids in encode(b.column(len(rest)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*rest, name])

    schema = d.select(*[F.col(f"`{c}`") for c in rest]).schema.add(name, "long")
    return d.mapInArrow(each, schema)
