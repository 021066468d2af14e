"""Embedding of chunks by a provider, with batching, retries and a monitor."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, ATTEMPTS = 100, 4

Provider = Callable[[list[str]], list[list[float]]]


def retry_delay(attempt: int, first: float = 5.0) -> float:
    """Seconds to wait after a failed attempt (1, 2, ...): doubled each time."""
    return first * 2 ** (attempt - 1)


class HashProvider:
    """Deterministic offline vectors from hashed words."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class HttpProvider:
    """Posts ``{model, input}`` to endpoints in turn and reads ``data[].embedding``."""

    def __init__(self, endpoints: Sequence[str], model: str, first_delay: float = 5.0, timeout: float = 300.0, api_key: str | None = None):
        self.endpoints, self.model, self.first_delay, self.timeout, self.api_key = list(endpoints), model, first_delay, timeout, api_key
        self.turn = 0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": texts}).encode()
        failure: Exception | None = None
        for attempt in range(1, ATTEMPTS + 1):
            url = self.endpoints[self.turn % len(self.endpoints)]
            self.turn += 1
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=self.timeout) as r:
                    got = [x["embedding"] for x in json.load(r)["data"]]
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                return got
            except Exception as e:  # noqa: BLE001
                detail = e.read().decode(errors="replace") if hasattr(e, "read") else str(e)
                failure = RuntimeError(f"embedding failed: {detail}")
            if attempt < ATTEMPTS:
                time.sleep(retry_delay(attempt, self.first_delay))
        raise failure


def embed(chunks: DataFrame, provider: Provider, model: str, batch: int = BATCH, text_col: str = "chunk_text") -> DataFrame:
    """``chunks`` with embedding, model, dimensions; null texts get none. Texts go to the provider in batches within each task;
    a batch that still fails after its retries fails the task, which Spark repeats."""
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in chunks.schema if f.name not in ("embedding", "model", "dimensions")], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model", T.StringType()), T.StructField("dimensions", T.IntegerType())])
    base = chunks.select(*[f.name for f in schema[:-3]])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list = [None] * len(pdf)
            todo = [i for i, t in enumerate(pdf[text_col]) if t is not None]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                for i, v in zip(part, provider([pdf[text_col].iloc[i] for i in part])):
                    vectors[i] = np.asarray(v, np.float32)
            yield pdf.assign(embedding=vectors, model=model, dimensions=pd.Series([None if v is None else len(v) for v in vectors], dtype="Int32", index=pdf.index))

    return base.mapInPandas(run, schema)


def monitor(requests: DataFrame) -> DataFrame:
    """Health of embedding requests, one row: requests, errors, avg_ms, max_ms, error_pct, health.

    ``requests``: ok (boolean), latency_ms. Averages and maxima are those of successes.
    """
    ok = F.col("ok")
    agg = requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~ok).alias("errors"),
        F.floor(F.coalesce(F.sum(F.when(ok, F.col("latency_ms"))), F.lit(0)) / F.greatest(F.count_if(ok), F.lit(1))).cast("bigint").alias("avg_ms"),
        F.coalesce(F.max(F.when(ok, F.col("latency_ms"))), F.lit(0)).cast("bigint").alias("max_ms"),
    )
    pct = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests") * 100).otherwise(0.0)
    health = F.when(pct > 10, "HIGH ERRORS").when(F.col("avg_ms") > 5000, "SLOW").when(F.col("avg_ms") > 2000, "MODERATE").otherwise("HEALTHY")
    return agg.select("*", F.round(pct, 1).alias("error_pct"), health.alias("health"))


def attach(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with stored vectors by key; a chunk without a vector is left out."""
    return chunks.join(vectors.select(key, "embedding", "model", "dimensions"), key)


def chunk_embed_index(results: DataFrame, persisted: DataFrame, provider: Provider, model: str, **chunking) -> DataFrame:
    """Chunks with vectors of the successful results whose page was stored (grp, url), ready for the store."""
    from skeinery.operators.chunker import chunk_pages

    good = results.join(persisted.select("grp", "url").distinct(), ["grp", "url"], "left_semi")
    chunks = chunk_pages(good, ("grp", "url"), **chunking).withColumnRenamed("url", "page_url")
    return embed(chunks.drop("n_tokens"), provider, model).withColumn("created_at", F.current_timestamp())
