"""URL functions as Spark expressions; only reference resolution needs Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_NOT_NAVIGABLE = r"^(?i)(#|javascript:|mailto:|tel:|data:)"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, i)


def scheme(url: Column) -> Column:
    """Lower-cased scheme; empty where the URL is not absolute."""
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port without user information, lower-cased; empty where the URL is not absolute."""
    return F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))


def host(url: Column) -> Column:
    """Lower-cased host without port; empty where the URL is not absolute."""
    return F.regexp_replace(authority(url), r":\d*$", "")


def path(url: Column) -> Column:
    """Path of an absolute URL, ``/`` if empty."""
    p = _part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, without fragment and default port, ``//`` in the path replaced once.

    The query stays as it is; what is no absolute URL stays unchanged; null stays null.
    """
    drop = F.when(scheme(url) == "https", F.lit(r":443$")).when(scheme(url) == "http", F.lit(r":80$")).otherwise(F.lit(r":$"))
    whole = F.concat(
        scheme(url),
        F.lit("://"),
        F.regexp_extract(_part(url, 2), "^(.*@)?", 1),
        F.regexp_replace(authority(url), drop, F.lit("")),
        F.replace(path(url), F.lit("//"), F.lit("/")),
        _part(url, 4),
    )
    return F.when(url.rlike(_ABSOLUTE), whole).otherwise(url)


def same_origin(a: Column, b: Column) -> Column:
    """Whether scheme and host agree, ports ignored; false where either is no absolute URL."""
    ok = a.rlike(_ABSOLUTE) & b.rlike(_ABSOLUTE)
    return F.coalesce(ok & (scheme(a) == scheme(b)) & (host(a) == host(b)), F.lit(False))


def origin(url: Column) -> Column:
    """scheme://host, the port left out; null where the URL is not absolute."""
    return F.when(url.rlike(_ABSOLUTE), F.concat(scheme(url), F.lit("://"), host(url)))


def sanitize_identifier(s: Column) -> Column:
    """Letters, digits and ``_`` of the lower-cased string, others as ``_``; ``__`` is shortened in one pass; at most 64 characters."""
    x = F.replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]", "_"), F.lit("__"), F.lit("_"))
    x = F.left(F.regexp_replace(x, "^_+|_+$", ""), F.lit(64))
    return F.when(F.coalesce(x, F.lit("")) == "", "default").otherwise(x)


def derive_group(url: Column, override: Column | None = None) -> Column:
    """Group of a page: the sanitized host, ``unknown`` without one, or the sanitized override."""
    base = F.when(F.coalesce(host(url), F.lit("")) == "", F.lit("unknown")).otherwise(host(url))
    return sanitize_identifier(base if override is None else F.coalesce(override, base))


def is_navigable(href: Column) -> Column:
    """Whether a reference leads to a page: not empty, no fragment, script, mail, phone or data reference."""
    return F.coalesce((F.trim(href) != "") & ~F.trim(href).rlike(_NOT_NAVIGABLE), F.lit(False))


@F.pandas_udf(T.StringType())
def _join(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from urllib.parse import urljoin

    def one(base: str | None, ref: str | None) -> str | None:
        if base is None or ref is None:
            return None
        try:
            return urljoin(base, ref.strip())
        except ValueError:
            return None

    for base, ref in batches:
        yield pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


def resolve_link(href: Column, base: Column) -> Column:
    """Normalized absolute http(s) URL of a reference on a page; null where it leads nowhere.

    Absolute and root-relative references are resolved natively, others by an Arrow UDF.
    """
    ref = F.trim(href)
    absolute = ref.rlike("^(?i)https?://")
    rooted = ref.startswith("/") & ~ref.startswith("//")
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    target = F.when(absolute, ref).when(rooted & ~ref.contains(".."), F.concat(root, ref)).otherwise(_join(base, ref))
    # bound to a lambda variable: the target's expression would otherwise be repeated throughout the normalized one
    whole = F.transform(F.array(target), lambda t: F.when(t.rlike("^(?i)https?://"), normalize_url(t))).getItem(0)
    return F.when(is_navigable(href), whole)
