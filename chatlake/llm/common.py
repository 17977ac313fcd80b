"""Helpers shared by the training-data operators.

Every operator takes the columns that it needs from a DataFrame under
private names (``_id``, ``_text``), so that further columns of the input,
whatever they are called, can neither clash with nor slip into its work.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Separators of words for the operators whose words are runs of other characters.
SPACES = r"[\x20\x09-\x0D]+"


def base(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """The id, the text (null: empty) and further named columns, under private names."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
                       *[F.col(f"`{c}`").alias(name) for name, c in more.items()])


def row_key(*cols: Column) -> Column:
    """A digest that names a row by content, the same however often a lost
    task runs again.  Rows that agree in all the columns share it."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"),
                                                              F.lit(":"), c.cast("string"))) for c in cols]
    return F.md5(F.concat(*parts))


def words(text: Column, spaces: str = SPACES) -> Column:
    """Words of a text, without empty ones."""
    return F.filter(F.split(text, spaces), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable holds
    it, where a plain column would be computed again for every element that
    an inner lambda visits."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder of the session."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rank_in_groups(df: DataFrame, group: list[str], order: list[str], rank: str, rows: int | Column,
                   bucket_rows: int = 1024) -> DataFrame:
    """Gapless numbers from 0 within each group, for groups of any size.

    ``rows``: a group's rows, or a bound of them.  They are dealt into hash buckets of the ``order``
    columns, of about ``bucket_rows`` rows, and buckets into about as many blocks as a block has
    buckets.  A row's number is its block's start plus its bucket's start in the block plus its place in the
    bucket.  No task ever holds a whole hot group, nor all its bucket counts: a running sum goes
    over the buckets of a block or the blocks of a group, the square root of the buckets.
    Rows that agree in all ``order`` columns are numbered in any order."""
    from pyspark.sql import Window

    rows = F.lit(rows) if isinstance(rows, int) else rows
    wide = F.greatest(F.ceil(F.sqrt(rows / bucket_rows)), F.lit(1)).cast("long")
    dealt = df.withColumn("_wide", wide).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_wide") * F.col("_wide"))) \
        .withColumn("_block", (F.col("_bucket") / F.col("_wide")).cast("long")).drop("_wide")
    counts = dealt.groupBy(*group, "_block", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counts.groupBy(*group, "_block").agg(F.sum("_n").alias("_n"))

    def before(by: list[str], place: str) -> Column:
        return F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def side(t: DataFrame, by: list[str], place: str, start: str) -> DataFrame:
        names = [c for c in t.columns if c != "_n"]
        return t.select(*[F.col(c).alias(f"{start}{i}") for i, c in enumerate(names)], before(by, place).alias(start))

    def same(cols: list[str], start: str) -> Column:
        every = F.lit(True)
        for i, c in enumerate(cols):
            every = every & F.col(c).eqNullSafe(F.col(f"{start}{i}"))
        return every

    keys = [*group, "_block", "_bucket"]
    starts = side(counts, [*group, "_block"], "_bucket", "_in") \
        .join(side(blocks, group, "_block", "_at"), reduce(Column.__and__, [
            F.col(f"_in{i}").eqNullSafe(F.col(f"_at{i}")) for i in range(len(group) + 1)])) \
        .select(*[F.col(f"_in{i}") for i in range(len(keys))], (F.col("_in") + F.col("_at")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (dealt.withColumn("_place", place).join(starts, same(keys, "_in"))
            .withColumn(rank, (F.col("_start") + F.col("_place")).cast("long"))
            .drop("_bucket", "_block", "_place", "_start", *[f"_in{i}" for i in range(len(keys))]))
