"""A crawl taken all the way into the store: pages, links, chunks with vectors, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.functions import urls
from skeinery.operators import embed, graph
from skeinery.operators.store import Store, to_page
from skeinery.session import cut


def crawl_into_store(store: Store, captures: DataFrame, seeds: list[str] | DataFrame, provider: embed.Provider | None = None, model: str = "", group: str | None = None, stemmed: bool = True, chunking: dict | None = None, **crawling) -> DataFrame:
    """Crawl, store what succeeded and return the crawl's rows.

    Pages are upserted with their postings, every navigable link of a stored page becomes an edge, and the pages' chunks are replaced, with
    vectors if there is a provider. ``group`` overrides the group taken from each host.
    """
    rows = cut(graph.crawl(captures, seeds, with_links=True, **crawling))
    grouped = rows.withColumn("grp", urls.derive_group(F.col("url"), F.lit(group) if group else None))
    pages = to_page(grouped)
    store.upsert_pages(pages)
    store.index_pages(pages, stemmed)
    refs = grouped.where(F.col("error").isNull()).select("grp", F.col("url").alias("src_url"), "final", F.explode("hrefs").alias("href"))
    edges = refs.select("grp", "src_url", urls.resolve_link(F.col("href"), F.col("final")).alias("dst_url")).where(F.col("dst_url").isNotNull()).distinct()
    store.insert_links(edges.select("*", F.lit(None).cast("string").alias("anchor_text"), F.current_timestamp().alias("discovered_at")))
    if provider is not None:
        store.replace_chunks(embed.chunk_embed_index(grouped, store.read("page").select("grp", "url"), provider, model, **(chunking or {})))
    return rows.drop("hrefs", "final")
