"""The store: tables of pages, links, chunks and postings as parquet, in numbered batches partitioned by group.

A change appends a batch and rewrites nothing: rows of a later batch stand for those of their page in earlier ones, which a read
resolves. A batch counts once its folder is complete, so a change is seen whole or not at all; ``compact`` merges
the batches of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "page": "grp string, url string, title string, content string, depth int, format string, crawled_at timestamp, meta string",
    "discovered": "grp string, src_url string, dst_url string, anchor_text string, discovered_at timestamp",
    "chunk": "grp string, page_url string, chunk_index int, chunk_text string, heading_path array<string>, embedding array<float>, model string, dimensions int, created_at timestamp",
    "posting": "grp string, url string, term string, tf bigint, dl int",
    "db_metadata": "key string, value string, updated_at timestamp",
}

#: What a later batch replaces as a whole: a page, or the chunks or postings of a page.
KEYS = {"page": ["grp", "url"], "chunk": ["grp", "page_url"], "posting": ["grp", "url"]}

#: Schema versions with their tables. Later versions only add columns, which read as null from older files, and tables; no file is rewritten.
MIGRATIONS = (("001", {"page": SCHEMAS["page"].rsplit(", meta", 1)[0], "discovered": SCHEMAS["discovered"]}), ("002", {"chunk": SCHEMAS["chunk"], "db_metadata": SCHEMAS["db_metadata"]}), ("003", {"page": SCHEMAS["page"]}), ("004", {"posting": SCHEMAS["posting"]}))


def latest(rows: DataFrame, keys: Sequence[str] = ("url", "grp"), order: Sequence[str] = ("crawled_at",)) -> DataFrame:
    """One row per key, the last by ``order`` (nulls first); aggregation combines copies before the shuffle."""
    cols = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order])).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("url", "grp"), order: Sequence[str] = ("crawled_at",)) -> DataFrame:
    """The table after a batch: new rows win over old ones of their key, of several new ones the last."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["__batch", *order]).drop("__batch")


def to_page(results: DataFrame, at: str | None = None) -> DataFrame:
    """Page rows of successful results: a null title becomes empty, the crawl time is now where none is given."""
    when = F.col(at) if at else F.current_timestamp()
    good = results.where(F.col("error").isNull())
    return good.select("grp", "url", F.coalesce("title", F.lit("")).alias("title"), "content", "depth", "format", when.alias("crawled_at"), "meta")


class Store:
    """Tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _jpath(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def batches(self, name: str) -> list[int]:
        """Numbers of a table's complete batches."""
        found = self._fs().globStatus(self._jpath(self.path(name) + "/batch=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def exists(self, name: str) -> bool:
        return bool(self.batches(name))

    def _append(self, name: str, df: DataFrame) -> None:
        cols = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        n = max(self.batches(name), default=0) + 1
        w = df.select(*cols).write.mode("overwrite")  # a batch left incomplete by a failure is written anew
        (w.partitionBy("grp") if "grp" in cols else w).parquet(f"{self.path(name)}/batch={n}")

    def raw(self, name: str, grp: str | None = None) -> DataFrame:
        """All rows of all batches with their ``batch``."""
        dirs = [f"{self.path(name)}/batch={n}" for n in self.batches(name)]
        schema = SCHEMAS[name] + ", batch int"
        df = self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)
        return df if grp is None else df.where(F.col("grp") == grp)

    def read(self, name: str, grp: str | None = None) -> DataFrame:
        """A table as it stands, or one group of it by partition pruning; empty if it was never written."""
        df = self.raw(name, grp)
        if name == "db_metadata":
            df = latest(df, ["key"], ["batch"])
        elif len(self.batches(name)) > 1:
            if name == "page":
                df = latest(df, KEYS[name], ["batch", "crawled_at"])
            elif name in KEYS:
                newest = df.groupBy(*[F.col(k).alias(f"__{k}") for k in KEYS[name]]).agg(F.max("batch").alias("__batch"))
                same = F.col("batch") == F.col("__batch")
                for k in KEYS[name]:
                    same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
                df = df.join(newest, same, "left_semi")
        if name == "chunk":
            df = df.where(F.col("chunk_index").isNotNull())
        return df.drop("batch")

    def touched(self, name: str, new: DataFrame) -> DataFrame:
        """Rows of the table in the groups a batch touches."""
        return self.read(name).join(new.select("grp").distinct(), "grp", "left_semi")

    def upsert_pages(self, new: DataFrame) -> None:
        """Insert or update by (url, grp): of several rows in a batch the last one, of several batches the last batch."""
        self._append("page", latest(new))

    def update_meta(self, changes: DataFrame) -> None:
        """Set meta by (url, grp) of existing pages; ``changes``: grp, url, meta."""
        one = latest(changes.select("grp", "url", "meta"), order=("meta",))
        self._append("page", self.touched("page", changes).drop("meta").join(one, ["grp", "url"]))

    def insert_links(self, links: DataFrame) -> None:
        self._append("discovered", links)

    def replace_chunks(self, chunks: DataFrame) -> None:
        """Replace all chunks of the pages in a batch."""
        self._append("chunk", chunks)

    def delete_chunks(self, pages: DataFrame) -> None:
        """Delete the chunks of some pages (grp, url): a row without index stands for none."""
        gone = pages.select("grp", F.col("url").alias("page_url")).distinct()
        fields = [c.split(" ", 1) for c in SCHEMAS["chunk"].split(", ")]
        self._append("chunk", gone.select(*[F.col(n) if n in ("grp", "page_url") else F.lit(None).cast(kind).alias(n) for n, kind in fields]))

    def index_pages(self, pages: DataFrame, stemmed: bool = True) -> None:
        """Replace the postings of some pages (grp, url, content); each posting holds its page's length, so a search reads the query's postings only."""
        from skeinery.operators.search import build_index

        postings, lengths = build_index(pages, stemmed=stemmed)
        rows = postings.unionByName(lengths.select("grp", "url", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf"), "dl"))
        self._append("posting", rows.sortWithinPartitions("grp", "term"))  # row groups hold ranges of terms

    def search(self, query: str, limit: int = 10, group: str | None = None, stemmed: bool = True, operator: str = "and") -> DataFrame:
        """grp, url, score of the best pages by the stored postings."""
        from skeinery.operators.search import search_index

        rows = self.read("posting")
        return search_index((rows.where(F.col("term").isNotNull()), rows.where(F.col("term").isNull())), query, limit, stemmed=stemmed, operator=operator, group=group)

    def compact(self, name: str) -> None:
        """Merge the batches of a table. Readers of the old ones must have finished; a failure in between leaves rows that a read resolves as before."""
        old = self.batches(name)
        if len(old) > 1 and (name in KEYS or name == "db_metadata"):
            self._append(name, self.read(name))
            for n in old:
                self._fs().delete(self._jpath(f"{self.path(name)}/batch={n}"), True)

    def _drop(self, name: str, grp: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fs = self._fs()
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(self.path(name) + "/batch=*/grp=*")) or []:
            p = status.getPath()
            if p.getName() == "grp=" + jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(grp):
                fs.delete(p, True)

    def reset_group(self, grp: str) -> None:
        """Drop a group's partitions of all tables."""
        for name in ("page", "discovered", "chunk", "posting"):
            self._drop(name, grp)

    def reset_all(self) -> None:
        for name in SCHEMAS:
            self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)

    def set_metadata(self, key: str, value: str) -> None:
        row = self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("updated_at", F.current_timestamp())
        self._append("db_metadata", row.coalesce(1))

    def get_metadata(self, key: str) -> str | None:
        row = self.read("db_metadata").where(F.col("key") == key).first()
        return row.value if row else None

    def migrate(self) -> list[str]:
        """Apply the migrations after the stored version, in order; returns those applied."""
        at = self.get_metadata("schema_version") or ""
        todo = [v for v, _ in sorted(MIGRATIONS) if v > at]
        if todo:
            self.set_metadata("schema_version", todo[-1])
        return todo


def group_list(pages: DataFrame) -> DataFrame:
    return pages.select("grp").distinct()


def group_stats(pages: DataFrame, links: DataFrame, chunks: DataFrame, group: str | None = None) -> DataFrame:
    """page_count, link_count, chunk_count, one row; zeros for a group that is not there."""
    kinds = {"page": pages, "link": links, "chunk": chunks}
    counts = [(df if group is None else df.where(F.col("grp") == group)).select(F.lit(k).alias("k")) for k, df in kinds.items()]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return rows.agg(*[F.count_if(F.col("k") == k).cast("bigint").alias(f"{k}_count") for k in kinds])
