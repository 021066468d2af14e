"""Structured Streaming over files of crawl results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from skeinery.functions import urls
from skeinery.operators.store import Store, to_page

RESULT_SCHEMA = "url string, depth int, content string, format string, title string, links_found bigint, error string, http_status int, meta string, crawled_at timestamp"


def result_stream(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """Results arriving as JSON line files."""
    return spark.readStream.schema(RESULT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_seen(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Results whose URL was not seen within the watermark; a page may come again after it."""
    return stream.withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["url"])


def into_store(stream: DataFrame, store: Store, checkpoint: str, sinks: list[Callable[[DataFrame], None]] | None = None, once: bool = True) -> StreamingQuery:
    """Upsert successful results of each micro-batch and hand the batch to further sinks.

    The upsert is idempotent by (url, grp) and crawl time, so a batch repeated after a failure changes nothing.
    """

    def emit(batch: DataFrame, _: int) -> None:
        kept = batch.withColumn("grp", urls.derive_group(F.col("url"))).persist()
        try:
            if not kept.isEmpty():
                store.upsert_pages(to_page(kept, "crawled_at"))
                for sink in sinks or []:
                    sink(kept.drop("grp"))
        finally:
            kept.unpersist()

    w = stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def host_spacing(stream: DataFrame, least_seconds: float) -> DataFrame:
    """host, url, at, start_at: when each request may start so that a host's starts keep their distance; state is the host's last start."""

    def place(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "url"])
        out = []
        for url, at in zip(rows["url"], rows["at"]):
            t = at.timestamp()
            last = t if last is None else max(t, last + least_seconds)
            out.append((key[0], url, at, pd.Timestamp(last, unit="s")))
        state.update((last,))
        yield pd.DataFrame(out, columns=["host", "url", "at", "start_at"])

    keyed = stream.select(urls.host(F.col("url")).alias("host"), "url", F.col("crawled_at").alias("at"))
    return keyed.groupBy("host").applyInPandasWithState(place, "host string, url string, at timestamp, start_at timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def counters(stream: DataFrame, every: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Results and errors per window."""
    return stream.withWatermark("crawled_at", delay).groupBy(F.window("crawled_at", every)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNotNull()).alias("errors"))
