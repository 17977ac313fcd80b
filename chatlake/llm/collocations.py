"""Phrase collocations by best-first branch and bound.

Phrases grow from their first word, one word at a time.  A cut of a phrase into two parts
scores 1000 a n / (l r); the right part is met at least as often as the phrase, so no phrase scores more
than 1000 n / l for any prefix, and none that begins with word w more than 1000 n / f(w).  This bound needs
counts of prefixes only, falls as w becomes more frequent and is the same for all that grows from w.  So first words are
expanded from the rarest on, until the bound of the next one is below the score of the
``TOP``-th survivor; words whose bound equals that score are still expanded, since ties are settled by count and phrase.

Rounds.  The first round expands a language's rarest words, up to a share ``FIRST`` of its occurrences.  The
``TOP``-th best score among its survivors is a lower bound of the final one, so the second round expands exactly the
words whose bound reaches it (all, if there are fewer survivors), and then the language is settled.

A round.  Words that occur ``least`` times or more are the frontier; one scan counts the pairs that continue it, another
all longer phrases that continue a pair which occurs as often.  A last scan counts right parts that begin with words outside
the frontier.  Scans read lines of numbered words, which are written once; they pick phrases by a bitmap of the frontier, sized by
its number, whose chance hits cost rows but no truth: counts, words and phrases are exact strings.

Survival.  If a longer candidate holds a phrase as often as the phrase occurs, so does one that is a word
longer, and then every occurrence has the same neighbour on that side.  Scans therefore keep the least and
greatest hash of the left and right neighbours, and no longer phrase needs to be counted for it.

Distribution: a task counts phrases in ``AT_ONCE`` words at a time and emits each once, in lots of first words
so that it holds little more than the line; counts combine in the task
and after the shuffle, keyed by language and phrase, so neither a frequent phrase nor a language is a hot key.
What lies between Spark and Python is outside the heap, on top of it: batches go to Python by
bytes (``BATCH``) and come back by rows (``ROWS``), and a written line has pages of its own and shares its row group with few.
Scores are computed in 38 decimal digits.  The best of a language are limited in each task first.

Nulls and edge cases: a null text is empty, a null language ``und``; texts of any length go whole,
cut between pieces; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import shared_folder

UNKNOWN = "und"
LONGEST, LEAST, TOP = 5, 100, 2000
#: Share of a language's occurrences whose rarest words the first round expands.
FIRST = 0.25
#: Words of a line (and one piece more), of which a task counts each phrase once.
AT_ONCE = 1_000_000
#: Places of a line that a task works on at a time: phrases are taken by their first word, so none is met in two lots.
LOT = 1 << 17
#: Bytes of a batch that goes to Python, and of a row group of lines (both end with the row that goes beyond), and rows of a batch that comes back.
BATCH, ROWS = 1 << 22, 1 << 14
#: Bits for each phrase of a bitmap, and the fewest and most bits of one.
BITS, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

# Bytes that end a piece, and the space that separates words besides the blank.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
_END = b"\n"
#: How lines are written: a row is a few megabytes, so a page ends and a row group is measured after each.
PAGES = {"parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size": BATCH}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _lines(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Texts as lines of words, with end marks between pieces, some ``AT_ONCE`` words at a time."""
    held, size = [], 0
    most = 6 * AT_ONCE
    for t in texts:
        t = t.lower().translate(_TABLE)
        while len(t) > most:
            cut = t.find(b"\n", most)
            if cut < 0:
                break
            yield t[:cut]
            t = t[cut + 1:]
        held.append(t)
        size += len(t)
        if size > most:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def _words(line: bytes) -> Iterator[bytes]:
    """Words and end marks; some pieces are split at a time."""
    at = 0
    while at < len(line):
        end = line.find(b"\n", at + LOT)
        end = len(line) if end < 0 else end
        yield from (w for w in line[at:end].replace(b"\n", b" \n ").split(b" ") if w)
        at = end


def word_hash(lang: str, words: Iterable[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode())
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64)


def phrase_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Of phrases whose k-th words have the hashes ``parts[k]``."""
    h = np.zeros_like(parts[0])
    for p in parts:
        h = (h ^ p) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _by_language(batches, langs: int = 0, texts: int = 1) -> Iterator[tuple[str, bytes]]:
    """(language, line) of Arrow batches; texts are put together by language, across batches.  Where the languages hold as much as
    four lines, the one that holds most goes out."""
    most = 6 * AT_ONCE
    held, size, total = {}, {}, 0
    for b in batches:
        for k, x in enumerate(b.column(langs).to_pylist()):
            t = b.column(texts)[k].as_buffer().to_pybytes()
            held.setdefault(x, []).append(t)
            size[x] = size.get(x, 0) + len(t)
            total += len(t)
            if size[x] <= most:
                if total <= 4 * most:
                    continue
                x = max(size, key=size.get)
            total -= size.pop(x)
            yield from ((x, line) for line in _lines(iter(held.pop(x))))
    for x, own in held.items():
        yield from ((x, line) for line in _lines(iter(own)))


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang`` and ``text``; a null language is ``und``, rows without text say nothing."""
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text")) \
        .where("text IS NOT NULL AND text != ''")


def encoded(source: DataFrame) -> DataFrame:
    """Lines of words as numbers: ``lang``, ``words`` (the line's distinct words, the end mark first) and ``ids``
    (little-endian 32-bit places in ``words``).  Texts are split into words once; scans read these."""
    def each(batches) -> Iterator:
        import pyarrow as pa

        for x, line in _by_language(batches):
            known = {_END: 0}
            ids = np.fromiter((known.setdefault(w, len(known)) for w in _words(line)), "<i4")
            own = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array([w.decode() for w in known], pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()), own, pa.array([ids.tobytes()], pa.binary())], names=["lang", "words", "ids"])

    return source.mapInArrow(each, "lang string, words array<string>, ids binary")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH`` bytes for the scans that run inside; all of them are written or collected there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _rows(batch) -> Iterator:
    """A batch in parts of ``ROWS`` rows."""
    for k in range(0, batch.num_rows, ROWS):
        yield batch.slice(k, ROWS)


def _encoded_lines(batches) -> Iterator[tuple]:
    """Language, words (an Arrow array) and ids of each line."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), b.column(1)[k].values, np.frombuffer(b.column(2)[k].as_buffer(), "<i4")


def count_words(lines: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (a word), ``f``."""
    def each(batches) -> Iterator:
        import pyarrow as pa

        for x, words, ids in _encoded_lines(batches):
            n = np.bincount(ids, minlength=len(words))[1:]
            yield from _rows(pa.RecordBatch.from_arrays([pa.array([x] * len(n), pa.string()), words.slice(1), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"]))

    return lines.mapInArrow(each, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame):
    """Broadcast bits of the phrases (``lang``, ``phrase``), of a size that follows from their number up to ``MOST_BITS``."""
    spark = phrases.sparkSession
    n = phrases.count()
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS * n - 1).bit_length()))

    def each(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = [int(phrase_hash([word_hash(x, [w]) for w in p.encode().split(b" ")])[0]) % size for x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([k >> 6 for k in at], pa.int64()), pa.array(np.left_shift(np.uint64(1), np.array(at, np.uint64) & np.uint64(63)).view(np.int64))],
                                             names=["at", "bits"])

    words = phrases.select("lang", "phrase").mapInArrow(each, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _hit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h % np.uint64(64 * len(table))
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


GRAMS = "lang string, phrase string, a long, l_low long, l_high long, r_low long, r_high long"


def count_phrases(lines: DataFrame, bitmap, lengths: tuple[int, ...], head: int | None, frequent=None) -> DataFrame:
    """Phrases of these lengths whose first ``head`` words (None: that all together) are on the bitmap and whose last word is
    on ``frequent``, if given: ``lang``, ``phrase``, ``a`` and the least and greatest hash of the left and of the right neighbour (0: none)."""
    def each(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for x, names, ids in _encoded_lines(batches):
            table = word_hash(x, (w.encode() for k in range(0, len(names), LOT) for w in names.slice(k, LOT).to_pylist()))
            table[0] = 0
            often = _hit(frequent.value, phrase_hash([table])) if frequent is not None else np.ones(len(table), bool)
            often[0] = False
            # end marks around, so that every place has neighbours and phrases cannot leave the line
            own, m = np.concatenate(([0], ids, np.zeros(LONGEST + 1)), dtype=np.int32, casting="unsafe"), len(ids)
            lots = -(-m // LOT)
            for lot in range(lots):
                at, upto = np.flatnonzero((own[1:m + 1] > 0) & (own[1:m + 1] % lots == lot)) + 1, 1
                for k in sorted(lengths):
                    while upto < k:                                # places from which k words follow
                        at = at[own[at + upto] > 0]
                        upto += 1
                    if head and k == min(lengths):
                        at = at[_hit(bitmap.value, phrase_hash([table[own[at + j]] for j in range(head)]))]
                    if frequent is not None:                       # a rare word is in no candidate
                        at = at[often[own[at + k - 1]]]
                    here = at if head else at[_hit(bitmap.value, phrase_hash([table[own[at + j]] for j in range(k)]))]
                    if not len(here):
                        continue
                    rank = own[here].astype(np.int64)
                    for j in range(1, k):                          # places of equal phrases get equal numbers
                        rank = rank * np.int64(len(table)) + own[here + j]
                        if j < k - 1:
                            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
                    order = np.argsort(rank, kind="stable")
                    rank, here = rank[order], here[order]
                    starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
                    left, right = table[own[here - 1]].view(np.int64), table[own[here + k]].view(np.int64)
                    one = here[starts]
                    text = pc.binary_join_element_wise(*[names.take(pa.array(own[one + j])) for j in range(k)], " ")
                    yield from _rows(pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(one), pa.string()), text, pa.array(np.diff(np.append(starts, len(here))).astype(np.int64)),
                         *[pa.array(f.reduceat(v, starts)) for v in (left, right) for f in (np.minimum, np.maximum)]],
                        names=[c.split()[0] for c in GRAMS.split(", ")]))

    return lines.mapInArrow(each, GRAMS).groupBy("lang", "phrase").agg(
        F.sum("a").alias("a"), F.min("l_low").alias("l_low"), F.max("l_high").alias("l_high"), F.min("r_low").alias("r_low"), F.max("r_high").alias("r_high"))


def _written(df: DataFrame, name: str, **options) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def expanded(lines: DataFrame, band: DataFrame, frequent, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """Candidates that begin with the words of the band: ``lang``, ``phrase``, ``size``, ``a``, ``lone`` (no longer
    candidate holds it as often)."""
    starts = band.select(F.col("lang").alias("_x"), F.col("phrase").alias("_w"))
    size = F.size(F.split("phrase", " "))
    lone = ~((F.col("l_low") == F.col("l_high")) & (F.col("l_low") != 0)) & ~((F.col("r_low") == F.col("r_high")) & (F.col("r_low") != 0))

    def grown(front: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
        rows = count_phrases(lines, _bitmap(front), lengths, lengths[0] - 1, frequent).where(F.col("a") >= least)
        # chance hits of the bitmap belong to other bands
        rows = rows.join(starts, (F.col("lang") == F.col("_x")) & (F.substring_index("phrase", " ", 1) == F.col("_w")), "left_semi")
        return _written(rows.select("lang", "phrase", size.alias("size"), "a", ((size == longest) | lone).alias("lone")), "phrases")

    pairs = grown(band, (2,))
    if longest == 2 or pairs.isEmpty():
        return pairs
    return pairs.unionByName(grown(pairs, tuple(range(3, longest + 1))))


def scored(survivors: DataFrame, counts: DataFrame, totals: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``phrase``, ``a`` and the lowest-scoring cut: ``l``, ``r``, ``n``, ``score``."""
    words = F.split("phrase", " ")
    cuts = survivors.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("_left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.lit(longest)), " ").alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        c = counts.select(F.col("lang").alias("_x"), F.col("phrase").alias("_p"), F.col("f").alias(name))
        cuts = cuts.join(c, (F.col("lang") == F.col("_x")) & (F.col(side) == F.col("_p"))).drop("_x", "_p", side)
    cuts = cuts.join(totals.select(F.col("lang").alias("_x"), "n"), F.col("lang") == F.col("_x")).drop("_x")
    big = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"CAST(({big(1000)} * {big('a')} * {big('n')}) div ({big('l')} * {big('r')}) AS BIGINT)"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "a", "_b.l", "_b.r", "n", "_b.score")


def _top(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST,
         top: int = TOP, first: float = FIRST) -> DataFrame:
    """The ``top`` best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    ship_package(docs.sparkSession)
    with _small_batches(docs.sparkSession):
        scores = _scores(_source(docs, lang_col, text_col), least, longest, top, first)
    return _top(scores, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scores(source: DataFrame, least: int, longest: int, top: int, first: float) -> DataFrame:
    """The scored survivors of both rounds, written."""
    lines = _written(encoded(source), "phrase-lines", **PAGES)
    every = count_words(lines)
    totals_path = _written(every.withColumn("_few", F.col("f") < least).groupBy("lang", "_few", F.when(~F.col("_few"), F.col("phrase")).alias("phrase"))
                           .agg(F.sum("f").alias("f")), "phrase-words")
    totals = _written(totals_path.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    words = totals_path.where("NOT _few").select("lang", "phrase", "f")
    frequent = _bitmap(words)
    # how far the first round goes: occurrences by frequency, in steps of a 64th of a doubling
    step = F.floor(F.log2(F.col("f").cast("double")) * 64)
    steps = words.groupBy("lang", step.alias("s")).agg(F.sum("f").alias("f"), F.max("f").alias("most"))
    upto = Window.partitionBy("lang").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("share", F.sum("f").over(upto) / F.sum("f").over(Window.partitionBy("lang")))
    limit = steps.groupBy(F.col("lang").alias("x")).agg(F.coalesce(F.max(F.when(F.col("share") <= first, F.col("most"))), F.min("most")).alias("done"))
    limit = _written(limit, "phrase-limit")
    banded = words.join(limit, F.col("lang") == F.col("x"))
    band = _written(banded.where("f <= done").select("lang", "phrase", "f"), "phrase-band")
    found, looked_up = None, None
    for round_ in (1, 2):
        new = expanded(lines, band, frequent, least, longest)
        found = new if found is None else found.unionByName(new)
        survivors = found.where("lone")
        known = words.unionByName(found.select("lang", "phrase", F.col("a").alias("f")))
        if looked_up is not None:
            known = known.unionByName(looked_up)
        parts = F.split("phrase", " ")
        rights = survivors.select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.lit(longest)), " "))).alias("phrase"))
        wanted = rights.where(F.contains("phrase", F.lit(" "))).distinct()
        wanted = _written(wanted.join(known, ["lang", "phrase"], "left_anti"), "phrase-rights")
        if not wanted.isEmpty():
            more = count_phrases(lines, _bitmap(wanted), tuple(range(2, longest)), None).select("lang", "phrase", F.col("a").alias("f"))
            more = _written(more.join(wanted, ["lang", "phrase"], "left_semi"), "phrase-counts")
            looked_up = more if looked_up is None else looked_up.unionByName(more)
            known = known.unionByName(more)
        scores = _written(scored(survivors, known, totals, longest), "phrase-scores")
        if round_ == 1:
            # a language with `top` survivors needs the words whose bound reaches the last one's score, others all
            last = _top(scores, top).where(F.col("rank") == top).select(F.col("lang").alias("y"), "score", "n")
            rest = banded.where("f > done").join(last, F.col("lang") == F.col("y"), "left")
            need = F.col("score").isNull() | (F.expr("(CAST(1000 AS DECIMAL(38,0)) * n) div CAST(f AS DECIMAL(38,0))") >= F.col("score"))
            band = _written(rest.where(need).select("lang", "phrase", "f"), "phrase-band")
            if band.isEmpty():
                break
    return scores
