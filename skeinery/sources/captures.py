"""Page captures as tables, and results made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.functions import html as H
from skeinery.functions import urls
from skeinery.operators.validate import reject_reason


def with_redirects(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """``requests`` (url) with final_url by a map of redirects (url, final_url); unchanged where there is none."""
    known = redirects.groupBy("url").agg(F.first("final_url", ignorenulls=True).alias("__final"))
    return requests.join(known, "url", "left").withColumn("final_url", F.coalesce("__final", "url")).drop("__final")


def results(captures: DataFrame, fmt: str = "markdown", validate: bool = True, collapse: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Crawl results of captures: url, depth, content, format, title, links_found, error, http_status, local_storage, meta.

    ``captures``: url, html and optionally title, http_status, depth, local_storage. A missing status counts as 200; rejected captures are
    error rows with empty content and no links. ``keep`` names further columns to return.
    """
    have = set(captures.columns)
    status = F.coalesce(F.col("http_status"), F.lit(200)) if "http_status" in have else F.lit(200)
    title = F.coalesce(F.col("title"), H.extract_title(F.col("html"))) if "title" in have else H.extract_title(F.col("html"))
    base = captures.select(
        "url",
        (F.col("depth") if "depth" in have else F.lit(0)).alias("depth"),
        "html",
        title.alias("title"),
        status.cast("int").alias("http_status"),
        (F.col("local_storage") if "local_storage" in have else F.lit(None).cast("map<string,string>")).alias("local_storage"),
        *[c for c in keep if c != "html"],
    )
    missing = F.when(F.col("html").isNull(), "page not captured")
    reason = reject_reason(F.col("html"), F.col("title"), F.col("http_status")) if validate else F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
    marked = base.withColumn("error", F.coalesce(missing, reason))
    ok = F.col("error").isNull()
    return marked.select(
        "url",
        "depth",
        F.when(ok, H.extract(F.col("html"), fmt, collapse)).otherwise("").alias("content"),
        F.lit(fmt).alias("format"),
        "title",
        F.when(ok, F.size(H.link_hrefs(F.col("html")))).otherwise(0).cast("bigint").alias("links_found"),
        "error",
        "http_status",
        "local_storage",
        F.when(ok, H.structured_meta(F.col("html"))).alias("meta"),
        *keep,
    )


def batch(url_list: DataFrame, captures: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Results of a list of URLs without validation; URLs that were not captured are error rows."""
    wanted = url_list.select(urls.normalize_url(F.col("url")).alias("url")).distinct()
    known = captures.withColumn("url", urls.normalize_url(F.col("url"))).dropDuplicates(["url"])
    return results(wanted.join(known, "url", "left"), fmt, validate=False)


def navigate(captures: DataFrame, url: str) -> DataFrame:
    """url and title of a captured page."""
    return captures.where(urls.normalize_url(F.col("url")) == urls.normalize_url(F.lit(url))).select("url", H.extract_title(F.col("html")).alias("title"))


def snapshot(captures: DataFrame, url: str) -> DataFrame:
    """url, title and text of a captured page."""
    hit = captures.where(urls.normalize_url(F.col("url")) == urls.normalize_url(F.lit(url)))
    return hit.select("url", H.extract_title(F.col("html")).alias("title"), H.extract(F.col("html"), "text").alias("content"))


def parse_storage(json: str):
    """Local storage from JSON text."""
    return F.from_json(F.col(json), "map<string,string>")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """origin, ord, url of every location in sitemap files (origin, xml); index files are not followed, broken files give none."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc>"), 1)
    return sitemaps.select("origin", F.posexplode(locs).alias("ord", "raw")).select("origin", "ord", F.trim(H.unescape(F.col("raw"))).alias("url")).where(F.col("url") != "")
