"""The registry's commands bound to a store, a table of captures and a provider of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.operators import embed, search, store
from skeinery.operators.registry import Registry, default_registry
from skeinery.plans import pipeline
from skeinery.sources import captures, files


def bound(kept: store.Store, pages: DataFrame, provider: embed.Provider | None = None, model: str = "") -> Registry:
    """A registry whose commands run: ``pages`` are the captures (url, html, title, http_status); queries by vector need a provider."""
    spark = kept.spark

    def vector(query: str) -> list[float]:
        if provider is None:
            raise ValueError("no provider of vectors")
        return provider([query])[0]

    def batch(urls: list[str], format: str) -> DataFrame:
        return captures.batch(spark.createDataFrame([(u,) for u in urls], "url string"), pages, format)

    def load(path: str, group: str) -> int:
        rows = files.import_pages(spark, path, group)
        kept.upsert_pages(rows)
        kept.index_pages(rows)
        return rows.count()

    def crawl(url: str, max_depth: int, max_pages: int, same_origin: bool, format: str) -> DataFrame:
        return pipeline.crawl_into_store(kept, pages, [url], provider, model, max_depth=max_depth, max_pages=max_pages, same_origin=same_origin, fmt=format)

    def status(group: str | None) -> DataFrame:
        return store.group_stats(kept.read("page"), kept.read("discovered"), kept.read("chunk"), group)

    return default_registry(
        {
            "navigate": lambda url: captures.navigate(pages, url),
            "snapshot": lambda url: captures.snapshot(pages, url),
            "extract": lambda url, format: batch([url], format).select("url", "title", "content", "error"),
            "batch": batch,
            "crawl": crawl,
            "import": load,
            "export": lambda group, path: files.export_store(kept, path, group),
            "db list": lambda: store.group_list(kept.read("page")).orderBy("grp"),
            "db status": status,
            "db query": lambda query, group, limit: kept.search(query, limit, group).join(kept.read("page").select("grp", "url", "title"), ["grp", "url"]).orderBy(F.desc("score"), "grp", "url"),
            "db vector": lambda query, group, limit: search.knn_search(kept.read("chunk"), kept.read("page"), vector(query), limit, group),
            "db hybrid": lambda query, group, limit, bm25_limit: search.hybrid_search(kept.read("page"), kept.read("chunk"), query, vector(query), bm25_limit, limit, group),
            "db reset": lambda group: kept.reset_group(group),
            "db reset-all": lambda: kept.reset_all(),
        }
    )
