"""Benchmark decontamination: token windows of the documents against a
broadcast hash set of normalised test windows, every hit verified.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
A test item of ``window`` words or more gives all its windows; a shorter one
gives a single window of all its words; one without words gives none.  Each
document position is looked up by the hash of its next words, first in a bitmap
sized by the windows and, where that has the bit, in the set; a hash hit counts only
if the words themselves are equal.  Only positions with a set bit become rows,
each with the words of its window and not with the document's.

The set is broadcast only if the number of distinct test windows is at most
``broadcast_windows``; beyond it the same join is left to a shuffle by hash.

Nulls and edge cases: a null or empty text has no words and no hits; null
item texts give no window; a null item id takes part as an item of its own
and is left out of the list of ids; equal items all count; an empty benchmark
hits nothing.  Rows with the same id and text are one document and share
their result; the number of rows is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base, let, lower_ascii, row_key, words

#: ASCII characters other than letters and digits; words are lower-cased after the split.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: About 64 bytes of key and row each, and a list of item ids: some 300 MB at most.
BROADCAST_WINDOWS = 2_000_000
#: Of the bitmap that goes before the set: least and most, powers of two.  Between them, 8 bits a window
#: and more, up to all windows that are broadcast; it only spares probes, beyond it as within.
BITS, MOST_BITS = 1 << 20, 1 << 24


def norm_words(text: Column) -> Column:
    """Lower-cased words.  Only words with other than ASCII characters need the
    character-wise mapping; ``lower`` would change their other letters too."""
    return F.transform(words(text, SEPARATORS), _norm)


def _norm(w: Column) -> Column:
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(lower_ascii(w))


def test_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``_len``, ``_h`` (hash of the words' hashes), ``_words``
    (space-joined) and ``_items`` (the ids of the items that hold it)."""
    w = base(items, item_col, text_col).select("_id", norm_words(F.col("_text")).alias("_w")).where(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
    rows = w.select("_id", n.alias("_len"), F.explode(F.transform(starts, lambda i: F.slice("_w", i, n))).alias("_s"))
    hashes = F.transform("_s", lambda x: F.xxhash64(x))
    by_len = F.coalesce(*[F.when(F.col("_len") == k, let(hashes, _first_hash(k)))
                          for k in range(1, window + 1)])
    return (rows.groupBy("_len", by_len.alias("_h"), F.concat_ws(" ", "_s").alias("_words"))
            .agg(F.collect_set("_id").alias("_items")))


def _hash(h: Column, at: Column, n: int) -> Column:
    """Of every third of the ``n`` words from place ``at`` and the last one: a probe
    only has to be selective, as words decide.  Element by element: a slice
    would copy the array at every place."""
    return F.xxhash64(*[F.get(h, at + k) for k in sorted({*range(0, n, 3), n - 1})])


def _first_hash(n: int):
    return lambda h: _hash(h, F.lit(0), n)


def _bitmap(windows: DataFrame, bits: int) -> Column:
    """``bits`` bits as an array of longs, those of the windows' hashes set: a literal of that size."""
    word = F.shiftright(F.col("_h").bitwiseAND(bits - 1), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_h").bitwiseAND(63).cast("int"))
    words_ = [0] * (bits // 64)
    for r in windows.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect():
        words_[r["w"]] = r["b"]
    return F.split(F.lit(",".join(map(str, words_))), ",").cast("array<bigint>")


def _probes(lengths: list[int], bitmap: Column, bits: int):
    """From the words and their hashes: (length, place, probe, the window's words) of every place and
    length whose probe may be in the set."""
    def may_be(p: Column) -> Column:
        h = p["h"]
        return F.getbit(F.get(bitmap, F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1

    def of_length(x: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(x["h"]) - n), lambda i: F.struct(i.alias("at"), _hash(x["h"], i, n).alias("h")))
        found = F.transform(F.filter(every, may_be), lambda p: F.struct(
            F.lit(n).alias("n"), p["at"].alias("at"), p["h"].alias("h"),
            F.concat_ws(" ", *[_norm(F.get(x["w"], p["at"] + k)) for k in range(n)]).alias("words")))
        return F.when(F.size(x["h"]) >= n, found).otherwise(F.expr("CAST(array() AS array<struct<n:int,at:int,h:bigint,words:string>>)"))

    return lambda x: F.concat(*[of_length(x, n) for n in lengths])


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Verified occurrences: ``_key`` of the document, ``_at`` (first word,
    from 0), ``_len``, ``_items``.  One scan of the documents for all window lengths:
    ``window``, and those of shorter items."""
    stats = {r["_len"]: r["n"] for r in windows.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(stats.values())
    side = F.broadcast(windows) if n <= broadcast_windows else windows
    bits = min(MOST_BITS, max(BITS, 1 << (8 * n).bit_length()))
    d = base(docs, id_col, text_col).select(
        row_key(F.col("_id"), F.col("_text")).alias("_key"), words(F.col("_text"), SEPARATORS).alias("_w"))
    both = F.struct(F.col("_w").alias("w"), F.transform("_w", lambda w: F.xxhash64(_norm(w))).alias("h"))
    rows = d.select("_key", F.explode(let(both, _probes(sorted(stats) or [WINDOW], _bitmap(windows, bits), bits))).alias("_p"))
    found = rows.join(side, (F.col("_p.n") == F.col("_len")) & (F.col("_p.h") == F.col("_h")))
    return found.where(F.col("_p.words") == F.col("_words")).select("_key", F.col("_p.at").alias("_at"), "_len", "_items")


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: the id, ``n_words``, ``n_hit`` (words inside a
    hit window), ``items`` (ids of the items hit, as strings in order) and
    ``spans`` (runs of hit words: first, past the last)."""
    found = hits(docs, test_windows(items, item_col, item_text_col, window), id_col, text_col)
    by_doc = found.groupBy("_key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("_at").alias("s"), (F.col("_at") + F.col("_len")).alias("e")))).alias("_h"),
        F.collect_set("_items").alias("_sets")).select(
            F.col("_key").alias("_hit_key"), "_h",
            F.array_sort(F.array_distinct(F.transform(F.flatten("_sets"), lambda i: i.cast("string")))).alias("_items"))
    zero = F.expr("CAST(array() AS array<struct<s:int,e:int>>)")
    # a start that no earlier window reaches opens a run; ends grow with starts only where lengths agree, so take the largest so far
    runs = F.aggregate("_h", zero, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(x))))
    own = base(docs, id_col, text_col).select(
        "_id", row_key(F.col("_id"), F.col("_text")).alias("_key"),
        F.size(words(F.col("_text"), SEPARATORS)).cast("long").alias("n_words"))
    joined = own.join(by_doc.select("_hit_key", "_items", F.when(F.size("_h") > 0, runs).alias("_runs")),
                      F.col("_key") == F.col("_hit_key"), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("_id").alias(id_col), "n_words",
        F.coalesce(F.aggregate("_runs", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]), F.lit(0)).alias("n_hit"),
        F.coalesce("_items", none).alias("items"), F.coalesce("_runs", zero).alias("spans"))


def drop_hit_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a verified hit, all columns."""
    found = hits(docs, test_windows(items, item_col, item_text_col, window), id_col, text_col).select(
        F.col("_key").alias("_hit_key")).distinct()
    cols = docs.columns
    key = row_key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return (docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), key.alias("_key"))
            .join(found, F.col("_key") == F.col("_hit_key"), "left_anti").select("_row.*"))


def drop_hit_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All documents, hit words cut out of their texts together with the
    separators that follow them; all columns in their order."""
    cols = docs.columns
    key = row_key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{text_col}`").alias("_t"),
                      key.alias("_i"))
    spans = judge(row.select("_i", "_t").distinct(), items, "_i", "_t", item_col, item_text_col, window) \
        .where("n_hit > 0").select(F.col("_i").alias("_hit_id"), "spans")
    keyed = row.join(spans, F.col("_i") == F.col("_hit_id"), "left")
    tokens = F.regexp_extract_all("_t", F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), 1)
    head = F.regexp_extract("_t", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(tokens, lambda t, k: ~F.exists("spans", lambda s: (k >= s["s"]) & (k < s["e"])))
    text = F.when(F.col("spans").isNull(), F.col("_t")).otherwise(F.concat(head, F.array_join(kept, "")))
    return keyed.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in cols])
