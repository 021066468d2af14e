"""Files in and out: URL lists, imports, exports, manifests and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.functions import text
from skeinery.operators.skew import prefix_sum


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """ord, url of a text file of URLs; blank lines and comments are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def _named_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))


def import_output_dir(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a directory with manifest.json: entries whose file exists; a missing url is the file name."""
    manifest = spark.read.schema("url string, file string, depth int, title string, links_found bigint, error string").option("multiLine", True).json(path + "/manifest.json")
    files = _named_texts(spark, path, "*.{md,html,txt}")
    good = manifest.where(F.col("error").isNull()).join(files, "file")
    return good.select(F.coalesce("url", "file").alias("url"), F.coalesce("title", F.lit("")).alias("title"), "content", F.coalesce("depth", F.lit(0)).alias("depth"), text.parse_format(F.regexp_extract("file", r"\.(\w+)$", 1)).alias("format"))


def import_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a flat directory of .md and .txt files; the title is the file's stem."""
    files = _named_texts(spark, path, "*.{md,txt}")
    return files.select(
        F.concat(F.lit("file://"), F.regexp_replace("file_path", "^file:/*", "/")).alias("url"),
        F.regexp_replace("file", r"\.(md|txt)$", "").alias("title"),
        "content",
        F.lit(0).alias("depth"),
        text.parse_format(F.regexp_extract("file", r"\.(\w+)$", 1)).alias("format"),
    )


def import_pages(spark: SparkSession, path: str, group: str) -> DataFrame:
    """Pages of an export, an output directory or a text directory, for a group."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if path.endswith((".json", ".jsonl")):
        df = spark.read.schema("url string, title string, content string, depth int, format string, crawled_at timestamp, meta string").json(path)
    elif fs.exists(jvm.org.apache.hadoop.fs.Path(p, "manifest.json")):
        df = import_output_dir(spark, path)
    elif fs.isDirectory(p):
        df = import_text_dir(spark, path)
    else:
        raise ValueError(f"nothing to import at {path}")
    for name, kind in (("crawled_at", "timestamp"), ("meta", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.current_timestamp() if kind == "timestamp" else F.lit(None).cast("string"))
    return df.select(F.lit(group).alias("grp"), "url", "title", "content", "depth", "format", "crawled_at", "meta")


def export_table(df: DataFrame, path: str, group: str | None = None) -> None:
    """A table, or a group of it, as JSON lines without loss."""
    rows = df if group is None else df.where(F.col("grp") == group)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def numbered(results: DataFrame, order: str = "ord") -> DataFrame:
    """``results`` with a global number from 1 in crawl order and its file name."""
    n = prefix_sum(results, [], F.floor(F.col(order) / 65536), [order, "url"], F.lit(1), "__before")
    return n.withColumn("n", F.col("__before") + 1).drop("__before").withColumn("file", F.concat(F.format_string("%04d", F.col("n")), F.lit("."), text.extension(F.col("format"))))


def manifest(results: DataFrame, order: str = "ord") -> DataFrame:
    """url, file, depth, title, links_found, error of every result, in crawl order."""
    return numbered(results, order).select("url", "file", "depth", "title", "links_found", "error")


def _opened(path: str):
    """File system and path of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_output_dir(results: DataFrame, path: str, order: str = "ord") -> None:
    """One file per result, written by the tasks that hold it, and manifest.json; error rows are empty files.

    ``path`` is a URI (hdfs://, s3://, file://) or path all executors share; a repeated task writes the same files anew.
    """
    import json

    rows = numbered(results, order)
    system, root = _opened(path)
    system.create_dir(root, recursive=True)

    def write(part):
        there, folder = _opened(path)
        for r in part:
            with there.open_output_stream(f"{folder}/{r.file}") as f:
                f.write((r.content or "").encode("utf-8", "surrogatepass"))

    rows.select("file", "content").foreachPartition(write)
    with system.open_output_stream(f"{root}/manifest.json") as f:
        f.write(b"[\n")
        for i, r in enumerate(rows.select("n", "url", "file", "depth", "title", "links_found", "error").orderBy("n").drop("n").toLocalIterator()):
            f.write(((",\n" if i else "") + json.dumps(r.asDict(), ensure_ascii=False)).encode("utf-8", "surrogatepass"))
        f.write(b"\n]\n")


def export_store(store, path: str, group: str | None = None) -> dict[str, int]:
    """Pages, links and chunks of a store, or of a group, as JSON lines below ``path``; the number of rows of each."""
    counts = {}
    for name in ("page", "discovered", "chunk"):
        export_table(store.read(name), f"{path}/{name}", group)
        counts[name] = store.spark.read.text(f"{path}/{name}").count()
    return counts


def import_store(store, path: str, group: str | None = None) -> dict[str, int]:
    """The tables of ``export_store`` back into a store, under another group if one is given; the number of rows of each."""
    from skeinery.operators.store import SCHEMAS

    counts = {}
    for name, put in (("page", store.upsert_pages), ("discovered", store.insert_links), ("chunk", store.replace_chunks)):
        rows = store.spark.read.schema(SCHEMAS[name]).json(f"{path}/{name}")
        put(rows if group is None else rows.withColumn("grp", F.lit(group)))
        counts[name] = rows.count()
    return counts


def write_json_lines(results: DataFrame, path: str) -> None:
    results.write.mode("append").option("ignoreNullFields", False).json(path)


def append_urls(results: DataFrame, path: str) -> None:
    """URLs of successful results, one per line."""
    results.where(F.col("error").isNull()).select("url").write.mode("append").text(path)


def fan_out(results: DataFrame, sinks: list) -> None:
    """Hand the same results to several sinks; they are computed once."""
    from pyspark import StorageLevel

    kept = results.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()
