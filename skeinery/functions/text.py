"""Text functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format names with their file extensions.
EXTENSIONS = {"markdown": "md", "html": "html", "text": "txt"}


def collapse_whitespace(s: Column) -> Column:
    """Runs of white space (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def cut_navigation(s: Column) -> Column:
    """Drop the rest of a text from the first ``Previous`` after ``Edit page``, then after ``Was this page helpful``."""
    for mark in ("Edit page", "Was this page helpful"):
        s = F.regexp_replace(s, rf"(?s)^(.*?{mark}.*?)Previous.*$", "$1")
    return s


def drop_trackers(s: Column) -> Column:
    """Remove tracker addresses up to the next closing bracket, or to the end."""
    for mark in (r"analytics\.twitter\.com", r"t\.co/1/i/adsct", r"analytics\."):
        s = F.regexp_replace(s, mark + r"(?s)[^)]*\)?", "")
    return s


def remove_page_noise(s: Column) -> Column:
    """Navigation tails and tracker addresses removed, white space collapsed."""
    return collapse_whitespace(drop_trackers(cut_navigation(s)))


def strip_html(html: Column) -> Column:
    """Text after each tag, joined by spaces and cleaned.

    A piece is what follows a ``<``; of each the text between its first and second ``>`` is kept, so text before the first
    tag is lost.
    """
    pieces = F.filter(F.split(html, "<"), lambda x: x.contains(">"))
    return remove_page_noise(F.array_join(F.transform(pieces, lambda x: F.split(x, ">").getItem(1)), " "))


def truncate(s: Column, n: int) -> Column:
    """At most ``n`` characters, then ``...`` if something was cut."""
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def count_tokens(s: Column) -> Column:
    """Estimated tokens: characters divided by four, plus one."""
    return (F.floor(F.char_length(s) / 4) + 1).cast("int")


def escape_string(s: Column) -> Column:
    """Backslashes and single quotes escaped."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def query_terms(query: str) -> list[str]:
    """Words of a query without the marks around them, lower-cased; empty ones dropped."""
    out = []
    for word in query.split():
        while word and not word[0].isalnum():
            word = word[1:]
        while word and not word[-1].isalnum():
            word = word[:-1]
        if word:
            out.append(word.lower())
    return out


def snippet(content: Column, terms: Sequence[str], length: int = 300) -> Column:
    """Up to ``length`` characters around the first place of any term, ``...`` where text is cut off."""
    low, n = F.lower(content), F.char_length(content)
    start = F.lit(0)
    if terms:
        places = F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda x: x > 0)
        start = F.coalesce(F.array_min(places) - 1, F.lit(0))
    a = F.greatest(start - length // 2, F.lit(0))
    e = F.least(a + length, n)
    a = F.when((e - a < length) & (n > length), n - length).otherwise(a)
    body = content.substr(a + 1, e - a)
    return F.concat(F.when(a > 0, "...").otherwise(""), body, F.when(e < n, "...").otherwise(""))


def extension(fmt: Column) -> Column:
    """File extension of a format; unknown ones as markdown."""
    out = F
    for name, ext in EXTENSIONS.items():
        out = out.when(F.lower(fmt) == name, ext)
    return out.otherwise(EXTENSIONS["markdown"])


def parse_format(name: Column) -> Column:
    """Format of a name or extension; unknown ones are markdown."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("html", "htm"), "html").when(low.isin("text", "txt"), "text").otherwise("markdown")


def cell(json: Column, most: int = 500) -> Column:
    """A JSON value for display: arrays as ``[n items]``, objects as ``{n} keys``, strings cut."""
    kind = F.substring(F.trim(json), 1, 1)
    keys = F.size(F.json_object_keys(json))
    return (
        F.when(json.isNull(), "null")
        .when(kind == "[", F.concat(F.lit("["), F.json_array_length(json).cast("string"), F.lit(" items]")))
        .when(kind == "{", F.concat(F.lit("{"), keys.cast("string"), F.lit("} keys")))
        .otherwise(truncate(F.regexp_replace(json, '^"(.*)"$', "$1"), most))
    )
