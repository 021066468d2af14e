"""Validation of captures and crawl results: the first failing rule names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Title patterns of soft error pages, in order of precedence.
SOFT_404 = ("page not found", "file not found", "not found", "no such", "404")

MIN_BYTES = 50


def status_reason(status: Column) -> Column:
    """``HTTP n`` for client and server errors."""
    return F.when(status.between(400, 599), F.concat(F.lit("HTTP "), status.cast("string")))


def soft_404_reason(title: Column) -> Column:
    """Reason naming the first pattern a title contains."""
    low = F.lower(title)
    reason = F
    for p in SOFT_404:
        reason = reason.when(low.contains(p), f'soft 404 (title contains "{p}")')
    return reason


def length_reason(html: Column, least: int = MIN_BYTES) -> Column:
    """Reason for markup of fewer bytes than ``least``."""
    n = F.octet_length(html)
    return F.when(n < least, F.concat(F.lit("content too short ("), n.cast("string"), F.lit(f" chars, min {least})")))


def noindex_reason(html: Column) -> Column:
    low = F.lower(html)
    return F.when(low.contains("noindex") & low.contains("<meta") & low.contains("robots"), "robots noindex")


def reject_reason(html: Column, title: Column, status: Column) -> Column:
    """Status, soft error, length, noindex, in this order; null for a good capture."""
    return F.coalesce(status_reason(status), soft_404_reason(title), length_reason(html), noindex_reason(html))


def needs_settle(html: Column) -> Column:
    """Whether scripts may still change the page."""
    return F.coalesce(F.lower(html).contains("<script"), F.lit(False))


def choose_links(raw: Column, dom: Column) -> Column:
    """Links of the rendered page where it has over twice as many and more than five, else those of the markup."""
    return F.when((F.size(dom) > 2 * F.size(raw)) & (F.size(dom) > 5), dom).otherwise(raw)


def run_counters(results: DataFrame) -> DataFrame:
    """total, successful and errors of a run, one row; zeros for an empty run."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("errors"))
