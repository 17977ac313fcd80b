"""HTML → plain text by built-in expressions (no Python per row), in time linear in the page.

A pattern such as ``<!--.*?-->`` costs the rest of the page for every opener that is never closed.
Openers that no closer follows are therefore made unrecognisable first (found once, by
the last closer).  Tags are then taken one after the other from the left, and anchors become
marks: a page is split at the marks of its opening anchors and each piece worked on by itself.
A ``>`` ends a tag, also within quotes.  The marks are six code points that are no characters; they
are removed from the page beforehand.

Anchors become ``text (href)`` (``(None)`` without an href), comments,
scripts, styles and declarations go, remaining tags go, entities are
decoded (``&amp;`` last), whitespace runs collapse to one space, and the
ends are stripped.  Adjacent block tags leave no space between their texts,
as a tag-stripping text extractor does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WEB_REPORT
from .text import col, fill, let

# Entities decoded after tags are removed (``&amp;`` last).
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&euro;", "€"),
    ("&amp;", "&"),
]

COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
DECLARATION = r"(?s)<![^>]*>"
# Marks: of an opener that nothing closes, of one without a ">" after it, an opening anchor, the end of its attributes, a
# closing anchor, another end of an anchor.
BARE, LONE, OPEN, ATTRIBUTES, CLOSE, STOP = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5"
MARKS = BARE + LONE + OPEN + ATTRIBUTES + CLOSE + STOP
# An anchor's content ends at the next opening or closing anchor tag.
HREF = r"""(?is)^(?:.*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TAG = r"(?s)</?[a-zA-Z][^>]*>"
OTHER_TAG = r"(?s)</?(?![aA][\s>])[a-zA-Z][^>]*>"
REMOVED = [r"(?is)<!--.*?-->", r"<script\b[^>]*>.*?</script\s*>", r"<style\b[^>]*>.*?</style\s*>", "<\ufdd0?![^>]*>"]
SPACE = "[\\s\u00a0]+"


def _numeric_entities(s: Column) -> Column:
    """``&#8217;`` and ``&#x2019;`` as their characters; numbers that name none stay as written."""
    def one(part: Column, i: Column) -> Column:
        digits = F.regexp_extract(part, r"^(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 0)
        number = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substring_index(F.substr(digits, F.lit(2)), ";", 1), 16, 10)) \
            .otherwise(F.substring_index(digits, ";", 1)).try_cast("int")
        valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(i == 0, part).when(F.coalesce(valid, F.lit(False)), F.concat(char, F.substr(part, F.length(digits) + 1))) \
            .otherwise(F.concat(F.lit("&#"), part))

    return F.when(F.contains(s, F.lit("&#")), F.array_join(F.transform(F.split(s, "&#"), one), "")).otherwise(s)


TO_LAST_END = r"(?s)\A(.*>)"


def _closable(s: Column, opener: str, *before: str, mark: str = BARE) -> Column:
    """Openers from which no end is ahead are marked: those after the text that ``before`` finds, each within the one before."""
    head = s
    for pattern in before:
        head = let(head, lambda h: F.regexp_extract(h, pattern, 1))  # noqa: B023 - used at once
    cut = let(head, lambda h: F.concat(h, F.regexp_replace(F.substr(s, F.length(h) + 1), f"(?i)<({opener})", f"<{mark}$1")))
    return F.when(s.rlike(f"(?i)<{opener}"), cut).otherwise(s)


def _anchors(s: Column) -> Column:
    """Anchors as ``text (href)``, or ``text`` if never closed."""
    s = F.regexp_replace(s, r"(?i)</a\s*>", CLOSE)
    s = F.regexp_replace(s, r"(?i)</a\s[^>]*>", STOP)
    s = F.regexp_replace(s, r"(?i)<a(\s[^>]*)?>", f"{OPEN}$1{ATTRIBUTES}")

    def piece(p: Column, i: Column) -> Column:
        at = F.locate(ATTRIBUTES, p)
        attributes, rest = F.substr(p, F.lit(1), at - 1), F.substr(p, at + 1)
        end = F.length(F.regexp_extract(rest, f"^[^{CLOSE}{STOP}]*", 0))
        href = F.when(F.length(attributes) > 0, F.regexp_replace(F.regexp_extract(attributes, HREF, 0), HREF, "$1$2$3"))
        named = attributes.rlike(HREF)
        closed = F.substr(rest, end + 1, F.lit(1)) == CLOSE
        text = F.concat(F.substr(rest, F.lit(1), end), F.lit(" ("), F.when(named, href).otherwise(F.lit("None")), F.lit(")"), F.substr(rest, end + 2))
        return F.when(i == 0, p).when(closed, text).otherwise(rest)

    split = F.array_join(F.transform(F.split(s, OPEN), piece), "")
    return F.regexp_replace(F.when(F.contains(s, F.lit(OPEN)), split).otherwise(s), f"[{CLOSE}{STOP}]", "")


def html_to_text(html) -> Column:
    def without_hidden(s: Column) -> Column:
        # one pass removes comments, scripts, styles and declarations (the
        # alternation tries them left to right at each position)
        return F.when(F.contains(s, F.lit("<")), F.regexp_replace(s, "|".join(REMOVED), "")).otherwise(s)

    s = F.translate(col(html), MARKS, "")
    s = let(s, lambda v: _closable(v, r"[a-z/!]", TO_LAST_END, mark=LONE))
    s = let(s, lambda v: _closable(v, "!--", r"(?s)\A(.*)-->"))
    for name in ("script", "style"):
        s = let(s, lambda v: _closable(v, rf"{name}\b", rf"(?is)\A(.*)</{name}\s*>", TO_LAST_END))  # noqa: B023 - used at once
    s = let(s, without_hidden)
    s = F.replace(s, F.lit(BARE), F.lit(""))
    s = F.regexp_replace(s, OTHER_TAG, "")
    s = F.replace(let(s, _anchors), F.lit(LONE), F.lit(""))
    for ent, ch in ENTITIES[:-1]:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.replace(let(s, _numeric_entities), F.lit(ENTITIES[-1][0]), F.lit(ENTITIES[-1][1]))
    s = F.regexp_replace(s, SPACE, " ")
    return F.btrim(s)


def page_report(url, status, reason, text) -> Column:
    """the web-request tool's report; only status 200 yields one."""
    return F.when(col(status) == 200, fill(WEB_REPORT, url=col(url), status=col(status), reason=col(reason),
                                           text=col(text)))
