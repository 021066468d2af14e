"""Lines repeated across one source's documents, found from incremental line counts.

The state of a corpus is two tables of appended batches: line counts per source and the pages counted. A new partition of
documents is merged as a delta: its lines are counted over pages not seen before and appended. Only for these lines the
earlier counts are looked up, which shows the lines whose count crosses the threshold in this merge;
only documents containing those have to be rebuilt.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.operators.skew import keyed_join
from skeinery.session import cut, shared_dir

#: A line is excessive when it is on at least so many distinct pages of its source.
MIN_PAGES = 5


def line_key(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the line's lower-cased letters; equal keys mean equal letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.xxhash64(letters), F.xxhash64(F.lit("second"), letters)


def page_lines(pages: DataFrame, *more: Column) -> DataFrame:
    """src, page_id, line_no, k1, k2 and ``more`` of every line that has letters.

    Null contents have no lines. A null grp is a source of its own.
    """
    lines = pages.select("grp", "page_id", *more, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"\p{L}"))
    k1, k2 = line_key(F.col("line"))
    return lines.select(F.coalesce(F.concat(F.lit("g"), F.col("grp")), F.lit("")).alias("src"), "page_id", "line_no", k1.alias("k1"), k2.alias("k2"), *lines.columns[2:-2])


class LineCounts:
    """Line counts per source, in a folder: ``counts`` (src, k1, k2, n_pages per batch) and ``seen`` (page_id).

    Batches are only appended. A batch that failed halfway has no entry in ``batches`` and is written anew. Opening
    the folder again goes on with what is there.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, min_pages: int = MIN_PAGES):
        self.spark, self.min_pages = spark, min_pages
        self.root = root or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def batches(self) -> int:
        n = 0
        while self._fs.exists(self._path(f"{self.root}/seen/batch={n}/_SUCCESS")):
            n += 1
        return n

    def _read(self, name: str, schema: str, batches: int) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/batch={i}" for i in range(batches)])

    def counts(self, batches: int | None = None) -> DataFrame:
        return self._read("counts", "src string, k1 bigint, k2 bigint, n_pages bigint", self.batches if batches is None else batches)

    def merge(self, lines: DataFrame) -> DataFrame:
        """Count a new partition in, as lines (src, page_id, k1, k2); return the newly crossed ones: src, k1, k2, n_pages.

        A page_id counts once, however often and in whichever partition it comes.
        """
        n, keys = self.batches, ["src", "k1", "k2"]
        ids = lines.select("page_id").distinct()
        if n:
            seen = self._read("seen", "page_id bigint", n).withColumn("__seen", F.lit(True))
            lines = lines.join(seen, "page_id", "left_anti")
            ids = ids.join(seen, "page_id", "left_anti")
        delta = lines.select(*keys, "page_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pages"))
        for name, rows in (("counts", delta), ("seen", ids)):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/batch={n}")
        new = self.spark.read.schema("src string, k1 bigint, k2 bigint, n_pages bigint").parquet(f"{self.root}/counts/batch={n}")
        if not n:
            return new.where(F.col("n_pages") >= self.min_pages)
        # the old counts of the delta's lines alone: one aggregation over both, combined before the shuffle
        both = self.counts(n).select(*keys, F.col("n_pages").alias("old"), F.lit(0).cast("bigint").alias("new")).unionByName(new.select(*keys, F.lit(0).cast("bigint").alias("old"), F.col("n_pages").alias("new")))
        sums = both.groupBy(*keys).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
        crossed = sums.where((F.col("new") > 0) & (F.col("old") < self.min_pages) & (F.col("old") + F.col("new") >= self.min_pages))
        return crossed.select(*keys, (F.col("old") + F.col("new")).alias("n_pages"))

    def excessive(self) -> DataFrame:
        """All lines at or over the threshold now."""
        return self.counts().groupBy("src", "k1", "k2").agg(F.sum("n_pages").alias("n_pages")).where(F.col("n_pages") >= self.min_pages)


def occurrences(lines: DataFrame, crossed: DataFrame) -> DataFrame:
    """page_id, line_no of every occurrence of the given lines; redelivered pages count once."""
    return keyed_join(lines, crossed, ["src", "k1", "k2"], "n_pages").select("page_id", "line_no").distinct()


def repeated(partitions: Sequence[DataFrame], state: LineCounts) -> DataFrame:
    """page_id, line_no of all excessive lines after merging partitions of lines (see ``page_lines``) one after the other.

    Each merge looks only at its own pages and at the earlier ones that hold a newly crossed line; what was found on other pages stays.
    """
    found, so_far = None, None
    for part in partitions:
        again, hits = update(state, so_far, part)
        kept = None if found is None else found.join(again.select(F.col("page_id").alias("done")), F.col("page_id").eqNullSafe(F.col("done")), "left_anti")
        found = hits if kept is None else kept.unionByName(hits)
        so_far = part if so_far is None else so_far.unionByName(part)
    return found


def update(state: LineCounts, earlier: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge the partition ``new`` of lines into the counts of ``earlier``; return what has to be done again.

    The first result has the page_id of the affected pages: all of the partition and the earlier ones that hold a newly
    crossed line. The second has page_id, line_no of all excessive lines on them, those crossed before too, as
    ``without_lines`` rebuilds them. All other pages stay as they are.
    """
    crossed = state.merge(new)
    if earlier is None:
        return new.select("page_id").distinct(), occurrences(new, crossed)
    affected = cut(occurrences(earlier, crossed).select("page_id").unionByName(new.select("page_id")).distinct())
    again = earlier.unionByName(new).join(affected.select(F.col("page_id").alias("done")), F.col("page_id").eqNullSafe(F.col("done")), "left_semi")
    return affected, occurrences(again, state.excessive())


def without_lines(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """page_id, content without the given lines, n_removed: one row per page_id, pages without such lines unchanged.

    The kept lines stay in order; a page whose lines are all hits gets an empty content, a null content stays null.
    """
    drop = hits.groupBy("page_id").agg(F.collect_set("line_no").alias("__drop"))
    one = pages.select("page_id", "content").groupBy("page_id").agg(F.max("content").alias("content")).join(drop, "page_id", "left")
    drop_of = F.coalesce("__drop", F.array().cast("array<int>"))
    kept = F.filter(F.split("content", "\n"), lambda line, i: ~F.array_contains(drop_of, i))
    return one.select("page_id", F.array_join(kept, "\n").alias("content"), F.size(drop_of).alias("n_removed"))
