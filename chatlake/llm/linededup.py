"""Line dedup by content-defined chunks of lines.

A line's hash is taken from its MD5.  A rolling hash over the last ``window`` line
hashes ends a chunk after a line where it falls into one of ``divisor``
classes, so an inserted or removed line moves only the boundaries near it.
A chunk of two lines or more with a character other than white space that
occurs more than once in all documents, by its bytes, is removed everywhere but
at its first occurrence (smallest id, null ids last; then first place in the text).

Distribution: the repeated chunks are written once and read for both the grouping and the
join, and each join starts from written tables, so that adaptive execution
can split its hot keys.  Chunks travel as 16-byte digests; only chunks whose digest repeats
are compared by their bytes, as a grouping by the text itself.  Both
groupings combine before the shuffle, so a chunk that a third of all
documents hold leaves each task as one row.

Nulls and edge cases: a null text has no lines and stays null; an empty
text is one empty line; a text that loses all its lines becomes empty; a last
line without ``\\n`` is a line like any other; rows with the same id and text are
one document, count once and are treated alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, row_key

WINDOW = 2
DIVISOR = 4
MULTIPLIER = 1_000_003
MODULUS = (1 << 31) - 1


def _line_hash(line: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"), F.lit(MODULUS))


def chunk_ends(hashes: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Places (from 1) of the lines that end a chunk, in order; the last line
    always does.  ``hashes`` must be a plain column or a lambda variable."""
    def rolled(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            out = F.pmod(out * MULTIPLIER + F.coalesce(F.get(hashes, i - back), F.lit(0)), F.lit(MODULUS))
        return out

    places = F.sequence(F.lit(1), F.size(hashes))
    return F.filter(places, lambda i: (i == F.size(hashes)) | (F.pmod(rolled(i - 1), F.lit(divisor)) == 0))


def _joined(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end - 1 as text.  Element by element: a slice would copy the whole array for every run."""
    return F.array_join(F.transform(F.sequence(start, end - 1), lambda k: F.get(lines, k)), "\n")


def chunks(docs: DataFrame, id_col: str, text_col: str, window: int, divisor: int) -> DataFrame:
    """The chunks of two lines or more: ``_key`` of the document, ``_id``, ``_at``
    (first line, from 0), ``_n`` (lines), ``_chunk`` (the text)."""
    text = F.col(f"`{text_col}`")
    d = docs.where(text.isNotNull()).select(
        F.col(f"`{id_col}`").alias("_id"), row_key(F.col(f"`{id_col}`"), text).alias("_key"),
        F.split(text, "\n").alias("_lines"))
    d = d.where(F.size("_lines") > 1)
    ends = let(F.transform("_lines", lambda x: _line_hash(x)), lambda h: chunk_ends(h, window, divisor))
    spans = let(ends, lambda e: F.transform(e, lambda end, k: F.struct(
        F.coalesce(F.get(e, k - 1), F.lit(0)).alias("at"), end.alias("end"))))
    long = F.filter(spans, lambda s: s["end"] - s["at"] > 1)
    texts = F.transform(long, lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"),
                                                 _joined(F.col("_lines"), s["at"], s["end"]).alias("text")))
    rows = d.select("_id", "_key", F.explode(texts).alias("_s"))
    return rows.select("_id", "_key", F.col("_s.at").alias("_at"), (F.col("_s.end") - F.col("_s.at")).alias("_n"),
                       F.col("_s.text").alias("_chunk")).where(F.col("_chunk").rlike(r"\S"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            divisor: int = DIVISOR) -> DataFrame:
    """One row for each document that loses lines: ``_key`` and ``_gone``, the
    array of (``at``, ``n``) runs to remove."""
    digest = F.md5("_chunk")
    place = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_key").alias("key"),
                     F.col("_at").alias("at"))
    every = chunks(docs, id_col, text_col, window, divisor).select("*", digest.alias("_digest"))
    # digests that occur at two places; equal places are repeated rows of one document
    twice = cut(every.groupBy("_digest").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
                .where("lo != hi").select(F.col("_digest").alias("_twice")))
    some = cut(every.join(twice, F.col("_digest") == F.col("_twice"), "left_semi"))
    # byte comparison: the text itself is the grouping key
    first = some.groupBy("_digest", "_chunk").agg(F.min(place).alias("_first"))
    first = cut(first.groupBy("_digest").agg(F.collect_list(F.struct("_chunk", "_first")).alias("_firsts")))
    same = F.filter("_firsts", lambda f: f["_chunk"] == F.col("_chunk"))[0]["_first"]
    later = some.join(first.withColumnRenamed("_digest", "_d"), F.col("_digest") == F.col("_d")).where(same != place)
    return later.groupBy("_key").agg(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"))).alias("_gone"))


def _kept(text: Column, gone: Column) -> Column:
    """The lines between the runs to remove, put together again."""
    def rest(x: Column) -> Column:
        lines, runs = x["lines"], x["runs"]
        parts = F.transform(runs, lambda g, k: F.struct(F.coalesce(F.get(runs, k - 1)["end"], F.lit(0)).alias("from"), g["at"].alias("to")))
        return F.array_join(F.transform(F.filter(parts, lambda r: r["to"] > r["from"]),
                                        lambda r: _joined(lines, r["from"], r["to"])), "\n")

    lines = F.split(text, "\n")
    runs = F.concat(F.transform(F.array_sort(gone), lambda g: F.struct(g["at"].alias("at"), (g["at"] + g["n"]).alias("end"))),
                    F.array(F.struct(F.size(lines).alias("at"), F.size(lines).alias("end"))))
    return let(F.struct(lines.alias("lines"), runs.alias("runs")), rest)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          divisor: int = DIVISOR) -> DataFrame:
    """``_row`` (the document, all columns), ``_gone`` (null where nothing was) and
    ``_left`` (the text without what is gone)."""
    lost = repeats(docs, id_col, text_col, window, divisor).withColumnRenamed("_key", "_lost_key")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_key"))
    out = own.join(lost, F.col("_key") == F.col("_lost_key"), "left")
    text = F.col(f"_row.`{text_col}`")
    return out.select("_row", "_gone", F.when(F.col("_gone").isNull(), text).otherwise(_kept(text, F.col("_gone"))).alias("_left"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   divisor: int = DIVISOR) -> DataFrame:
    """All documents, all columns in order, repeated chunks cut from the text."""
    out = dedup(docs, id_col, text_col, window, divisor)
    return out.select(*[F.col("_left" if c == text_col else f"_row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           divisor: int = DIVISOR) -> DataFrame:
    """One row for each document: the id, ``n_lines``, ``n_removed`` (lines),
    ``n_chunks`` (removed) and the remaining ``text``."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = dedup(narrow, "id", "text", window, divisor)
    gone = F.coalesce("_gone", F.array().cast("array<struct<at:int,n:int>>"))
    return out.select(
        F.col("_row.id").alias(id_col),
        F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(F.split("_row.text", "\n"))).cast("long").alias("n_lines"),
        F.aggregate(gone, F.lit(0).cast("long"), lambda a, g: a + g["n"]).alias("n_removed"),
        F.size(gone).cast("long").alias("n_chunks"), F.col("_left").alias("text"))
