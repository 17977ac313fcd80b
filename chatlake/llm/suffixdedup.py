"""Suffix-array dedup by prefix-free parsing.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in the corpus
is removed; strings do not cross documents, and all are judged on the input.

Parsing.  A rolling hash of 8 bytes runs over the text.  Its minimum (the last one
of equals) among the first ``WINDOW`` places of a string is the string's trigger, so a
string's trigger follows from the string alone, wherever it stands.  The
strings of one trigger start at neighbouring places: these places are a
phrase, and the bytes that their strings span are the phrase in context.

Dictionary and parse.  Equal strings have triggers at the same distance and equal
bytes after it, ``CORE`` of them at least.  So the parse's suffixes, which begin at the
triggers, are put into classes by these first bytes, and only classes with two
suffixes or more matter.  Phrases that are the same in the same context are one
entry of the dictionary; an entry that the parse holds twice repeats whole.
Only where a class holds different entries are the suffixes of its entries
sorted, and neighbours that agree in ``LENGTH`` bytes mark repeats.  Each entry's marks
then go back to all its places in the parse, which gives them for the corpus.
The corpus order itself, a row for each byte, is never written: equality of
neighbours in it is all that is asked for, and classes have that.

Refinement.  One task sorts ``GROUP`` entries at most.  A larger group is refined first: the
distances from the trigger, at which its strings start, are halved, and each half
of an entry goes to the group of the bytes that all strings of this half
share, which are more bytes than before.  Entries that agree in all bytes of
a half repeat there whole; one of them goes on for the others.  A group with one
left is done, one of ``GROUP`` at most is sorted, others are refined
again.  At a single distance the shared bytes are the string, so seven
rounds are enough.  A round makes two rows for each entry that is still open at most.

Distribution: parse rows are (document, place, class, entry), one for some 50 bytes.
Rows whose class can't repeat are left out by a bitmap of ``BITMAP`` bits (classes that fall
on a set bit by chance stay in and do no harm), or by a join where more than an eighth of
the bits would be set.  Counts combine before they are shuffled.  Documents are
named by 128 bits of their id and text.  Texts are compressed before they meet their marks.

Nulls and edge cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a
row that is repeated is a copy like any other, and its strings start elsewhere;
null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import base, shared_folder

LENGTH = 200
WINDOW = 128
CORE = LENGTH - WINDOW + 1
GRAM = 8
BITMAP = 1 << 26
#: Entries that one task sorts together.
GROUP = 512
#: Bytes that are hashed at a time.
BLOCK = 4 << 20


def triggers(buf: np.ndarray) -> np.ndarray:
    """For every place the last minimum of the hashes of the ``WINDOW`` places from there on."""
    n = len(buf)
    grams = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(GRAM - 1, np.uint8)]), GRAM)
    h = np.ascontiguousarray(grams).view("<u8").ravel()
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    low = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    at = np.arange(n, dtype=np.int32)
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        if step < n:
            at[:-step] = np.where(low[step:] <= low[:-step], at[step:], at[:-step])
            low[:-step] = np.minimum(low[:-step], low[step:])
        size += step
    return at


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, first place, bytes) in lists of about ``BLOCK`` bytes; a longer text goes in parts
    that share ``LENGTH`` - 1 bytes, so each string is whole in one of them."""
    now, size = [], 0
    for k, t in enumerate(texts):
        for s in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            part = t[s:s + BLOCK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            now.append((k, s, part))
            size += len(part)
            if size >= BLOCK:
                yield now
                now, size = [], 0
    if now:
        yield now


def parse(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of one row for each phrase: text, trigger, places from the trigger back to the
    phrase's last and first place, class and entry."""
    from xxhash import xxh64_intdigest

    for block in _blocks(texts):
        line = b"".join(p for _, _, p in block)
        size = np.array([len(p) for _, _, p in block])
        begin = np.cumsum(size) - size
        at = triggers(np.frombuffer(line, np.uint8))
        starts = np.zeros(len(line) + 1, np.int32)
        np.add.at(starts, begin, 1)
        np.add.at(starts, begin + size - LENGTH + 1, -1)
        place = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
        a = at[place].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (place[1:] != place[:-1] + 1))))
        trigger, first, last = a[new], place[new], place[np.append(new[1:], len(place)) - 1]
        own = np.searchsorted(begin, first, side="right") - 1
        n = len(new)
        class_ = np.fromiter((xxh64_intdigest(line[t:t + CORE]) for t in trigger.tolist()), np.uint64, n)
        entry = np.fromiter((xxh64_intdigest(line[f:e + LENGTH], t - f + 1) for f, e, t in
                             zip(first.tolist(), last.tolist(), trigger.tolist())), np.uint64, n)
        text = np.array([k for k, _, _ in block])[own]
        shift = np.array([s for _, s, _ in block])[own] - begin[own]
        yield text, trigger + shift, trigger - last, trigger - first, class_.view(np.int64), entry.view(np.int64)


def _bit(class_: np.ndarray) -> np.ndarray:
    return (class_.view(np.uint64) >> np.uint64(8)) % np.uint64(BITMAP)


def repeated_suffixes(entries: list[tuple[int, int, bytes]]) -> list[int]:
    """For (last, first, bytes) of a class's entries a mask of the repeated distances: the entries'
    suffixes in order, neighbours equal in ``LENGTH`` bytes."""
    order = sorted(b[first - d:first - d + LENGTH] + k.to_bytes(4, "big") + d.to_bytes(1, "big")
                   for k, (last, first, b) in enumerate(entries) for d in range(last, first + 1))
    out = [0] * len(entries)
    for x, y in zip(order, order[1:]):
        if x[:LENGTH] == y[:LENGTH]:
            for z in (x, y):
                out[int.from_bytes(z[LENGTH:LENGTH + 4], "big")] |= 1 << z[-1]
    return out


def _halves(mask: int) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(int(np.uint64(x & (2 ** 64 - 1)).astype(np.int64)) for x in (mask, mask >> 64))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` and two longs that name each (id, text): ``_u1``, ``_u2``."""
    return base(docs, id_col, text_col).select(
        "_id", "_text", *[F.xxhash64(F.lit(seed), "_id", F.length("_text"), "_text").alias(f"_u{seed}") for seed in (1, 2)])


PARSE = "u1 long, u2 long, at long, last int, first int, class long, entry long"


def _parse_rows(d: DataFrame, bitmap=None, only: str | None = None) -> DataFrame:
    """Rows of ``PARSE``, of classes on set bits of the bitmap, if given; or their ``only`` column."""
    def each(batches) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in PARSE.split(", ")]
        for b in batches:
            u1, u2 = (b.column(k).to_numpy() for k in (0, 1))
            for text, at, last, first, class_, entry in parse(b.column(2).cast(pa.large_binary()).to_pylist()):
                cols = [u1[text], u2[text], at, last.astype(np.int32), first.astype(np.int32), class_, entry]
                if only:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[names.index(only)])], names=[only])
                    continue
                if bitmap is not None:
                    bit = _bit(class_)
                    keep = bitmap.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) > 0
                    cols = [c[keep] for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    schema = next(c for c in PARSE.split(", ") if c.split()[0] == only) if only else PARSE
    return d.select("_u1", "_u2", "_text").mapInArrow(each, schema)


def _bitmap(classes: DataFrame):
    """Broadcast: bits of the classes, as 64-bit words."""
    bit = F.pmod(F.shiftrightunsigned("class", 8), F.lit(BITMAP))
    words = classes.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(shiftrightunsigned(class, 8), {BITMAP}) & 63 AS INT))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(BITMAP // 64, np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return classes.sparkSession.sparkContext.broadcast(table)


def _packed_texts(d: DataFrame) -> DataFrame:
    def each(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack(t) for t in b.column(3).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], names=["_u1", "_u2", "_id", "z"])

    return d.select("_u1", "_u2", "_id", "_text").mapInArrow(each, f"_u1 long, _u2 long, _id {d.schema['_id'].dataType.simpleString()}, z binary")


def _same_text():
    return (F.col("_u1") == F.col("u1")) & (F.col("_u2") == F.col("u2"))


def _contexts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """For ``u1``, ``u2``, ``at``, ``last``, ``first``, ``class``, ``entry``, ``n``: the same without place, with the entry's bytes."""
    by_text = wanted.groupBy("u1", "u2").agg(F.collect_list(F.struct("at", "last", "first", "class", "entry", "n")).alias("want"))
    rows = texts.select("_u1", "_u2", "z").dropDuplicates(["_u1", "_u2"]).join(by_text, _same_text()).select("z", "want")

    def each(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kinds = {"last": pa.int32(), "first": pa.int32(), "class": pa.int64(), "entry": pa.int64(), "n": pa.int64()}

        def batch(wants, got):
            return pa.RecordBatch.from_arrays([pa.array([w[c] for w in wants], k) for c, k in kinds.items()] + [pa.array(got, pa.binary())],
                                              names=[*kinds, "bytes"])

        wants, got = [], []
        for b in batches:
            for z, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = unpack(z)
                wants += want
                got += [t[w["at"] - w["first"]:w["at"] - w["last"] + LENGTH] for w in want]
                if len(got) > 20_000:
                    yield batch(wants, got)
                    wants, got = [], []
        yield batch(wants, got)

    return rows.mapInArrow(each, "last int, first int, class long, entry long, n long, bytes binary")


ROWS = "class long, entry long, last int, first int, bytes binary"


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """``class``, ``entry`` and marks (``lo``, ``hi``) from the order of the suffixes of each group (``k1``, ``k2``)."""
    rows = rows.select("k1", "k2", "class", "entry", "last", "first", "bytes").repartition("k1", "k2").sortWithinPartitions("k1", "k2")

    def each(batches) -> Iterator:
        import pyarrow as pa

        def flush(group):
            masks = repeated_suffixes([e[2:] for e in group])
            return [(*e[:2], *_halves(m)) for e, m in zip(group, masks) if m]

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], names=["class", "entry", "lo", "hi"])

        now, group = None, []
        for b in batches:
            found = []
            for k1, k2, *entry in zip(*(c.to_pylist() for c in b.columns)):
                if (k1, k2) != now:
                    found += flush(group)
                    now, group = (k1, k2), []
                group.append(entry)
            yield batch(found)
        yield batch(flush(group))

    return rows.mapInArrow(each, "class long, entry long, lo long, hi long")


def halves(last: int, first: int, bytes_: bytes, size: int) -> list[tuple[int, int, bytes, bytes]]:
    """The parts of an entry by blocks of ``size`` distances: last and first distance, the bytes
    of the strings that start there, and the bytes that all strings of the block share."""
    out = []
    for low in range(last // size * size, first + 1, size):
        y, f = max(last, low), min(first, low + size - 1)
        out.append((y, f, bytes_[first - f:first - y + LENGTH], bytes_[first - low:first - low - size + 1 + LENGTH]))
    return out


def _refined(rows: DataFrame, size: int) -> DataFrame:
    """The parts of all entries by blocks of ``size`` distances, with their group (``k1``, ``k2``), its number of
    different parts ``n``, how many entries have the part, ``copies``, and if this one stands ``first_of`` them."""
    def each(batches) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        names = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                kept, keys = [], []
                for class_, entry, last, first, bytes_ in zip(*(c.to_pylist() for c in b.slice(k, 2000).columns)):
                    for y, f, whole, shared in halves(last, first, bytes_, size):
                        kept.append((class_, entry, y, f, whole))
                        keys.append((*_halves(xxh3_128_intdigest(shared, y // size)), *_halves(xxh3_128_intdigest(whole, y << 8 | f))))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], t) for i, t in enumerate(kinds)] +
                                                 [pa.array([r[i] for r in keys], pa.int64()) for i in range(4)],
                                                 names=[*names, "k1", "k2", "w1", "w2"])

    parts = _written(rows.select("class", "entry", "last", "first", "bytes").mapInArrow(
        each, ROWS + ", k1 long, k2 long, w1 long, w2 long"), "parts")
    whole = _written(parts.groupBy("k1", "k2", "w1", "w2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("class", "entry")).alias("one")), "wholes")
    groups = whole.groupBy(F.col("k1").alias("g1"), F.col("k2").alias("g2")).agg(F.count(F.lit(1)).alias("n"))
    whole = whole.join(groups, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))).where("n > 1 OR copies > 1") \
        .select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "copies", "one", "n")
    first = (F.col("class") == F.col("one.class")) & (F.col("entry") == F.col("one.entry"))
    return _written(parts.join(whole, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")))
                    .select("class", "entry", "last", "first", F.when(first, F.col("bytes")).alias("bytes"), "k1", "k2", "n", "copies",
                            first.alias("first_of")), "refined")


def _between(last, first):
    """``lo`` and ``hi`` with the bits from last to first."""
    def bits(start):
        y, f = F.greatest(last - start, F.lit(0)), F.least(first - start, F.lit(63))
        ones = F.lit(-1).cast("long")
        # a shift takes the last six bits of its number, so a word of no bits is a case of its own
        return F.when(y > f, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.call_function("shiftleft", ones, y + 63 - f), F.lit(63) - f))

    return bits(0).alias("lo"), bits(64).alias("hi")


def _class_marks(contexts: DataFrame) -> DataFrame:
    """``class``, ``entry`` and marks (``lo``, ``hi``) of the entries of classes with ``n`` different ones."""
    rows = contexts.withColumn("k1", F.col("class")).withColumn("k2", F.lit(0).cast("long"))
    sort, whole, size = [rows.where(F.col("n") <= GROUP)], [], WINDOW
    while not (large := rows.where(F.col("n") > GROUP)).isEmpty():
        size //= 2
        rows = _refined(large, size)
        whole.append(rows.where("copies > 1").select("class", "entry", *_between(F.col("last"), F.col("first"))))
        rows = rows.where("first_of AND n > 1")
        sort.append(rows.where(F.col("n") <= GROUP))
    columns = ["k1", "k2", "class", "entry", "last", "first", "bytes"]
    out = _sorted_groups(functools.reduce(DataFrame.union, [r.select(*columns) for r in sort]))
    return functools.reduce(DataFrame.union, whole, out)


def marks(d: DataFrame, texts: DataFrame) -> DataFrame:
    """``u1``, ``u2`` and ``marks``: (at, last, first, lo, hi) of all the text's phrases with repeated strings."""
    classes = _written(_parse_rows(d, only="class").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"), "classes")
    if classes.count() <= BITMAP // 8:
        rows = _parse_rows(d, _bitmap(classes))
    else:
        rows = _parse_rows(d).join(classes, "class", "left_semi")
    rows = _written(rows, "parse")
    place = F.struct("u1", "u2", "at", "last", "first")
    entries = _written(rows.groupBy("class", "entry").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("p")), "entries")
    mixed = entries.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("class", "c")
    wanted = entries.join(mixed, F.col("class") == F.col("c")).select("p.*", "class", "entry", "n")
    some = _class_marks(_written(_contexts(wanted, texts), "contexts"))
    every = F.lit(-1).cast("long")
    whole = entries.where("copies > 1").select("class", "entry", every.alias("lo"), every.alias("hi"))
    known = _written(some.union(whole).groupBy(F.col("class").alias("c"), F.col("entry").alias("e"))
                     .agg(F.bit_or("lo").alias("lo"), F.bit_or("hi").alias("hi")), "marks")
    return rows.join(known, (F.col("class") == F.col("c")) & (F.col("entry") == F.col("e"))) \
        .groupBy("u1", "u2").agg(F.collect_list(F.struct("at", "last", "first", "lo", "hi")).alias("marks"))


def _starts(marked: list[dict]) -> np.ndarray:
    """Places where repeated strings start."""
    at, last, first, lo, hi = (np.array([m[c] for m in marked], np.int64) for c in ("at", "last", "first", "lo", "hi"))
    bits = np.unpackbits(np.stack([lo, hi], axis=1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
    k, d = np.nonzero(bits)
    ok = (d >= last[k]) & (d <= first[k])
    return at[k[ok]] - d[ok]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the id, ``n_bytes``, ``n_removed``, ``spans`` (removed runs: first
    byte, past the last) and ``kept`` (the remaining bytes; a cut may split a character)."""
    ship_package(docs.sparkSession)
    d = _keyed(docs, id_col, text_col)
    texts = _packed_texts(d)
    joined = texts.join(marks(d, texts), _same_text(), "left").select("_id", "z", "marks")

    def each(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            size, gone, spans, kept = [], [], [], []
            for z, marked in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = unpack(z)
                size.append(len(t))
                if not marked:
                    gone.append(0), spans.append([]), kept.append(t)
                    continue
                p = _starts(marked)
                cover = np.zeros(len(t) + 1, np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + LENGTH, -1)
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                gone.append(int(hit.sum()))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(t, np.uint8)[~hit].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind),
                                              pa.array(kept, pa.binary())], names=["_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(each, f"_id {d.schema['_id'].dataType.simpleString()}, n_bytes long, n_removed long, "
                                   "spans array<struct<start:bigint,end:bigint>>, kept binary").withColumnRenamed("_id", id_col)
