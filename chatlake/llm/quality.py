"""Quality rules: a threshold table compiled into one projection.

A rule names a measure of the text, a comparison and a bound.  ``compile_rules``
turns the table into Catalyst columns, so that the verdict of every document
is one projection of its scan: no shuffle, no user function.

Nulls and edge cases: a null or empty text has no words, all its counts are 0
and it fails the length rule; a null id is kept as it is; repeated rows are
judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base, let, words

# Frequent function words of the languages that the corpus holds.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "by", "this", "are", "was"],
    "fr": ["le", "la", "les", "de", "des", "un", "une", "et", "en", "que", "qui", "du", "pour", "par", "est"],
    "de": ["der", "die", "das", "und", "ein", "eine", "zu", "den", "mit", "von", "ist", "nicht", "auf", "für", "im"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "se", "del"],
}


@dataclass(frozen=True)
class Rule:
    """Reject a document if ``measure op bound`` holds.  Ratios are written
    as ``numerator``, ``denominator`` of counts and compared by
    multiplication, so no division by zero arises."""

    name: str
    numerator: str
    op: str
    bound: float
    denominator: str = "one"


#: The table.  Counts are those of ``measures``.
RULES = [
    Rule("too_few_words", "n_words", "<", 50),
    Rule("repeated_word_windows", "n_repeat_words", ">", 0.5, "n_words"),
    Rule("too_many_words", "n_words", ">", 1_000_000),
    Rule("short_mean_word", "word_chars", "<", 2.0, "n_words"),
    Rule("long_mean_word", "word_chars", ">", 20.0, "n_words"),
    Rule("symbol_ratio", "n_symbols", ">", 0.10, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 0.02, "n_words"),
    Rule("duplicate_line_ratio", "n_dup_lines", ">", 0.30, "n_lines"),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", ">", 0.30, "n_lines"),
    Rule("few_lettered_words", "n_lettered_words", "<", 0.60, "n_words"),
]
#: Rules that make ``base_failed``.
BASE_RULES = ("too_few_words", "repeated_word_windows")


def _covered(places: Column) -> Column:
    """Words that 3-word windows at these places (sorted) cover: each window adds
    the distance to the next one, at most 3."""
    return F.aggregate(F.transform(places, lambda i, k: F.least(F.coalesce(F.get(places, k + 1) - i, F.lit(3)), F.lit(3))),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words_by_text(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted by
    their words with their place as the last key, and equal neighbours are
    occurrences of one repeated window."""
    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    windows = F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.alias("i")))
    repeated = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, k: (
        (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))))
    return let(let(repeated, lambda r: F.sort_array(F.transform(r, lambda x: x["i"]))), _covered)


PLACE_BITS = 24


def _repeat_words(ws: Column) -> Column:
    """The same count from numbers: a window's hash and its place share one long
    (``PLACE_BITS`` low bits hold the place), so sorting longs brings equal
    windows together.  Neighbours with equal hashes are compared by their
    words; a text where any of them differ (a collision), or with more words
    than places fit, is counted by its texts instead.  So the count is exact."""
    low = (1 << PLACE_BITS) - 1
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    packed = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - 3),
        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(~low).bitwiseOR(i.cast("long"))))

    def near(s: Column) -> Column:
        top = lambda x: F.shiftright(x, PLACE_BITS)
        return F.filter(s, lambda x, k: (top(x) == top(F.get(s, k - 1))) | (top(x) == top(F.get(s, k + 1))))

    def count(r: Column) -> Column:
        place = lambda x: x.bitwiseAND(low).cast("int")
        same = lambda i, j: ((F.get(ws, i) == F.get(ws, j)) & (F.get(ws, i + 1) == F.get(ws, j + 1))
                             & (F.get(ws, i + 2) == F.get(ws, j + 2)))
        differ = F.exists(
            F.transform(r, lambda x, k: F.when(F.shiftright(x, PLACE_BITS) == F.shiftright(F.get(r, k + 1), PLACE_BITS),
                                               ~same(place(x), place(F.get(r, k + 1)))).otherwise(False)), lambda x: x)
        return F.when(differ, _repeat_words_by_text(ws)).otherwise(
            let(F.sort_array(F.transform(r, place)), _covered))

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).when(F.size(ws) >= low, _repeat_words_by_text(ws)).otherwise(
        let(let(F.sort_array(packed), near), lambda r: F.when(F.size(r) == 0, F.lit(0).cast("long")).otherwise(count(r))))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules speak of, one row for each document.

    Words are runs of characters other than space and U+0009 to U+000D; lines
    are what ``\\n`` splits, and only lines with a word count.  A word counts as
    lettered if it begins with a character from ``A`` on, which leaves out
    numbers and most punctuation."""
    stop = sorted({x for ws in STOP_WORDS.values() for w in ws for x in (w, w.capitalize())})
    text = F.col("_text")
    d = base(docs, id_col, text_col).select("_id", "_text", words(text).alias("_w"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    end = lambda y: F.rtrim(y)
    return d.select(
        F.col("_id").alias(id_col),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            F.size(F.filter(x, lambda y: end(y).endswith("...") | end(y).endswith("…"))).cast("long").alias("ell"))
            ).alias("_l"),
        let(F.col("_w"), _repeat_words).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: w >= "A")).cast("long").alias("n_lettered_words"),
    ).select(id_col, "n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"),
             F.col("_l.n").alias("n_lines"), F.col("_l.ell").alias("n_ellipsis_lines"), "n_repeat_words",
             "n_stop_words", "n_lettered_words")


def compile_rules(rules: list[Rule] = RULES) -> dict[str, Column]:
    """Rule name to the boolean column that is true where it rejects."""
    out = {}
    for r in rules:
        left, right = F.col(r.numerator).cast("double"), F.lit(float(r.bound))
        if r.denominator != "one":
            right = right * F.col(r.denominator)
        out[r.name] = {"<": left < right, ">": left > right}[r.op]
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES,
          base_rules: tuple[str, ...] = BASE_RULES) -> DataFrame:
    """Counts, ``base_failed``, ``failed_rules`` (names in table order) and
    ``kept`` for every document."""
    compiled = compile_rules(rules)
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in compiled.items()]))
    based = [compiled[n] for n in base_rules if n in compiled]
    any_of = F.lit(False)
    for c in based:
        any_of = any_of | c
    return measures(docs, id_col, text_col).withColumns({"base_failed": any_of, "failed_rules": failed}) \
        .withColumn("kept", F.size("failed_rules") == 0)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    The counts are taken from the row's own text, so no join is needed and
    repeated ids do no harm.  The rows are selected by a generator over an array that only kept rows have:
    a filter would be pushed below the projection with every measure inlined, and each
    would be computed again for each rule."""
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    kept = judge(row, "_row", "_t", rules).select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return kept.select("_row.*")
