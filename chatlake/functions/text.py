"""Column factories for text: whitespace tokens, word counts, id parts,
token costs.  All are built-in Catalyst expressions (code-generated, no
Python in the task)."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, **values) -> Column:
    """A brace template as a ``concat`` of literal pieces and columns (or
    plain values); NULL when any filled-in value is NULL."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            v = values[field]
            parts.append(v.cast("string") if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*parts)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def tail(arr, start: int) -> Column:
    """The elements of an array from ``start`` (counted from 1) to its end."""
    return F.filter(col(arr), lambda x, i: i >= start - 1)


def tokens(text) -> Column:
    """Whitespace split with empty pieces removed (Python ``str.split()``)."""
    return F.filter(F.split(col(text), WS), lambda t: t != "")


def token_at(text, i: int) -> Column:
    """1-based whitespace token, NULL when missing."""
    return F.try_element_at(tokens(text), F.lit(i))


def word_count(text) -> Column:
    """A5: number of whitespace-separated words (maximal non-whitespace
    runs, counted without building the word array); NULL text counts 0."""
    return F.coalesce(F.regexp_count(col(text), F.lit(r"\S+")), F.lit(0)).cast("int")


def starts_with(text, prefix: str) -> Column:
    return F.startswith(col(text), F.lit(prefix))


def server_of(user_id) -> Column:
    """the part after the first ':' and before a second ':' (a port is
    cut off); NULL when the id has no ':'."""
    return F.try_element_at(F.split(col(user_id), ":"), F.lit(2))


def is_exact_command(text, words: list[str]) -> Column:
    """Body equals the given words separated by any whitespace."""
    pattern = r"^\s*" + r"\s+".join(re.escape(w) for w in words) + r"\s*$"
    return F.coalesce(col(text).rlike(pattern), F.lit(False))


def native_token_count(text) -> Column:
    """Default token counter: ceil(chars / 4).  Deterministic, JVM side."""
    return F.ceil(F.char_length(F.coalesce(col(text), F.lit(""))) / F.lit(4)).cast("bigint")


def message_cost(text, counter=native_token_count) -> Column:
    """Tokens of a message's first text + 1."""
    return counter(text) + F.lit(1)


def parts_cost(parts, counter=native_token_count) -> Column:
    """A6 on list-form content: only the first part's text counts; content
    that starts with an image (no text) costs 1."""
    first = F.try_element_at(col(parts), F.lit(1))
    text = F.when(first["type"] == "text", first["text"]).otherwise(F.lit(""))
    return counter(F.coalesce(text, F.lit(""))) + F.lit(1)


def system_cost(text, counter=native_token_count) -> Column:
    """Cost of a system message; an empty one costs 0."""
    t = col(text)
    return F.when(t.isNull() | (t == ""), F.lit(0).cast("bigint")).otherwise(counter(t) + F.lit(1))
