"""Typed decoding that says what it could not decode.

A decoder turns a raw column into ``struct<value, reject>``: the typed value, or NULL and the
reason.  ``decoded`` applies several to one frame and gathers the rejects of
each row, so valid and quarantined rows come from the same pass: select on
``size(rejects)``, or write with it as a partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOG_LEVELS
from .text import col

REJECT = "array<struct<field:string,raw:string,reason:string>>"


def _checked(value: Column, bad: Column, reason: str) -> Column:
    return F.struct(F.when(~F.coalesce(bad, F.lit(False)), value).alias("value"), F.when(bad, F.lit(reason)).alias("reject"))


def flag(raw) -> Column:
    """a boolean stored as an integer in text, of any length; blanks around and single
    underscores between digits are part of the integer form."""
    r = col(raw)
    return _checked(r.rlike("[1-9]"), r.isNotNull() & ~r.rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"), "not_an_integer")


def level(raw, levels: list[str] = LOG_LEVELS) -> Column:
    """A log level as its place in the order of severity; a missing one is unknown."""
    r = col(raw)
    known = F.coalesce(r.isin(levels), F.lit(False))
    return _checked(F.array_position(F.array(*[F.lit(x) for x in levels]), r).cast("int"), ~known, "unknown_level")


def arguments(raw) -> Column:
    """The entries of a JSON object, in their order; text after the object, any other value and
    single quotes are rejected, NULL is an empty object.  Of a repeated key the last entry
    stays, as with a strict parser.  (A key repeated within a nested value is rejected.)

    The text is parsed as the first element of an array whose second one is an object
    named by the text's digest; only a text that is one object leaves exactly these two."""
    r = col(raw)
    mark = F.md5(r)
    both = F.from_json(F.concat(F.lit("["), r, F.lit(',{"'), mark, F.lit('":0}]')), "array<map<string,variant>>", {"allowSingleQuotes": "false"})
    none = F.array().cast("array<struct<key:string,value:variant>>")

    def entries(pair: Column) -> Column:
        ok = (F.size(pair) == 2) & F.get(pair, F.lit(0)).isNotNull() & F.coalesce(F.get(F.map_keys(F.get(pair, F.lit(1))), F.lit(0)) == mark, F.lit(False))
        own = F.map_entries(F.get(pair, F.lit(0)))
        last = F.filter(own, lambda e, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda x: x["key"] == e["key"]))
        return _checked(F.when(r.isNull(), none).otherwise(last), r.isNotNull() & ~F.coalesce(ok, F.lit(False)), "not_an_object")

    return F.transform(F.array(both), entries)[0]


def decoded(df: DataFrame, decoders: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Each named column replaced by its typed value, and ``rejects``: field, raw text and reason of what is not."""
    raw = df.select("*", *[d(c).alias(f"_d_{c}") for c, d in decoders.items()])
    reject = lambda c: F.when(F.col(f"_d_{c}.reject").isNotNull(),
                              F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw"), F.col(f"_d_{c}.reject").alias("reason")))
    rejects = F.filter(F.array(*[reject(c) for c in decoders]), lambda x: x.isNotNull()).cast(REJECT)
    return raw.select(*[F.col(f"_d_{c}.value").alias(c) if c in decoders else F.col(c) for c in df.columns], rejects.alias("rejects"))
