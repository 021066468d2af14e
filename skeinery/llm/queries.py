"""Queries on training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.llm import boilerplate, encode, line_training, lines, mix, neardup, neighbors, residue, sentences, split
from skeinery.session import prepare, stage, table


def _line_model(pages: DataFrame, results: DataFrame) -> boilerplate.Model:
    return line_training.train(pages.select("content", "title", "url").unionByName(results.select("content", "title", "url")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pages, results = table(prepare(spark), d, "page_records"), table(spark, d, "crawl_results")
    both = pages.select(F.lit("page_records").alias("table_name"), F.col("page_id").alias("rec_id"), "content", "title", "url").unionByName(
        results.select(F.lit("crawl_results").alias("table_name"), F.col("result_id").alias("rec_id"), "content", "title", "url")
    )
    keyed = both.select(F.struct("table_name", "rec_id").alias("key"), "content", "title", "url").where(F.length("content") > 0)
    common = line_training.vocabulary(keyed)
    sheets = stage(line_training.describe(keyed, common, "key"))  # each page is described once, for training and marking
    marked = line_training.mark(sheets, "key", line_training.train_on(sheets, common))
    return marked.where(~F.col("main")).select("key.table_name", "key.rec_id", "line_no").distinct()


def p1_main_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(prepare(spark), d, "page_records")
    return boilerplate.main_text(pages, "page_id", _line_model(pages, table(spark, d, "crawl_results")))


def p1_main_results(spark: SparkSession, d: str) -> DataFrame:
    results = table(prepare(spark), d, "crawl_results")
    return boilerplate.main_text(results, "result_id", _line_model(table(spark, d, "page_records"), results))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.undirected(neighbors.neighbor_pairs(table(prepare(spark), d, "embedding_data")))


def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours, however far, of the query set vec_id % 50 = 0 among all rows."""
    near = neighbors.nearest(table(prepare(spark), d, "embedding_data"), asked=F.col("vec_id") % 50 == 0)
    return near.select("vec_id", "other_id", F.round("cos", 6).alias("cos"), "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_texts(table(prepare(spark), d, "chunks"))
    return pieces.where(F.col("piece_no") == 1).select("chunk_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.rechunk(table(prepare(spark), d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Two partitions by crawl time, merged one after the other into counts kept as tables; the second redoes affected pages only."""
    pages = table(prepare(spark), d, "page_records")
    late = F.coalesce(F.col("crawled_at") >= "2025-06-01", F.lit(True)).alias("late")
    hashed = stage(lines.page_lines(pages, late))
    parts = [hashed.where(~F.col("late")).drop("late"), hashed.where("late").drop("late")]
    return lines.repeated(parts, lines.LineCounts(spark))


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same lines from four partitions that mix all times, so that each merge makes earlier pages affected."""
    pages = table(prepare(spark), d, "page_records")
    hashed = stage(lines.page_lines(pages, F.pmod(F.xxhash64("page_id"), F.lit(4)).alias("part")))
    return lines.repeated([hashed.where(F.col("part") == i).drop("part") for i in range(4)], lines.LineCounts(spark))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_lines(table(prepare(spark), d, "page_records"), p4_found(spark, d))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    results = table(prepare(spark), d, "crawl_results")
    model, _ = residue.train(residue.sample(results))
    return results, residue.judge(results, model)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[1].where("residue").select("result_id")


def p5_real(spark: SparkSession, d: str) -> DataFrame:
    results, judged = _judged(spark, d)
    return residue.without_residue(results.select("result_id", "url", "title", "content", "http_status", "error"), judged, keep_errors=True)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Records labelled by rules, those of unseen hosts among them, and how often the classifier agrees there."""
    _, report = residue.train(residue.sample(table(prepare(spark), d, "crawl_results")))
    return spark.createDataFrame([(report["labelled"], report["held_out"], report["agreement"])], "labelled long, held_out long, agreement double")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(prepare(spark), d, "page_records"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(prepare(spark), d, "page_records"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(prepare(spark), d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(prepare(spark), d, "mix_targets")
    docs = mix.listed(table(spark, d, "documents").select("doc_id", "source", "text"), targets)  # only these are tokenized
    return mix.mix(encode.count_tokens(docs), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_sentences(spark, d).select("doc_id", "start_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(prepare(spark), d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_main_pages": p1_main_pages,
    "p1_main_results": p1_main_results,
    "p2_found": p2_found,
    "p2_neighbors": p2_neighbors,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_cleaned": p4_cleaned,
    "p4_incremental": p4_incremental,
    "p5_found": p5_found,
    "p5_real": p5_real,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}

_LINES = r"""
WITH l AS (
  SELECT grp, page_id, pos - 1 AS line_no, line, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k
  FROM (SELECT DISTINCT grp, page_id, string_split(content, chr(10)) AS ls FROM page_records), UNNEST(ls) WITH ORDINALITY AS t(line, pos)
), often AS (
  SELECT grp, k FROM l WHERE k <> '' GROUP BY grp, k HAVING count(DISTINCT page_id) >= 5
), hit AS (
  SELECT DISTINCT l.page_id, l.line_no FROM l JOIN often o ON o.grp = l.grp AND o.k = l.k
)
"""

_NEIGHBORS = """
WITH v AS (
  SELECT DISTINCT vec_id, model, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embedding_data
  WHERE len(embedding) = dimensions AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS vec_id, b.vec_id AS other_id, list_cosine_similarity(a.e, b.e) AS cos FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(cos, 12) DESC, other_id) AS INTEGER) AS rank FROM p WHERE cos >= {least}
)
"""

_GRAMS = r"""
WITH w AS (
  SELECT DISTINCT page_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM page_records
), g AS (
  SELECT page_id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 3
), n AS (
  SELECT page_id, len(g) AS n FROM g
), e AS (
  SELECT page_id, unnest(g) AS k FROM g
), c AS (
  SELECT a.page_id AS x, b.page_id AS y, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.page_id < b.page_id GROUP BY ALL
)
"""

SQL = {
    "p2_found": _NEIGHBORS.format(least=0.8) + "SELECT DISTINCT least(vec_id, other_id) AS vec_id_a, greatest(vec_id, other_id) AS vec_id_b FROM r WHERE rank <= 5",
    "p2_neighbors": _NEIGHBORS.format(least=-1) + "SELECT vec_id, other_id, round(cos, 6) AS cos, rank FROM r WHERE rank <= 5 AND vec_id % 50 = 0",
    "p6_found": _GRAMS
    + """SELECT x AS page_id_a, y AS page_id_b FROM c JOIN n a ON a.page_id = c.x JOIN n b ON b.page_id = c.y
         WHERE c.c / (a.n + b.n - c.c) >= 0.6 - 1e-12""",
    "p6_groups": _GRAMS.replace("WITH w AS", "WITH RECURSIVE w AS")
    + """, k AS (SELECT page_id, min(page_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM w WHERE len(w) >= 3),
 s AS (SELECT DISTINCT kx.class_id AS a, ky.class_id AS b FROM c JOIN n p ON p.page_id = c.x JOIN n q ON q.page_id = c.y JOIN k kx ON kx.page_id = c.x JOIN k ky ON ky.page_id = c.y
   WHERE c.c / (p.n + q.n - c.c) >= 0.6 - 1e-12 AND kx.class_id <> ky.class_id),
 t AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT DISTINCT class_id AS a, class_id AS b FROM k UNION SELECT r.a, t.b FROM r JOIN t ON t.a = r.b),
 m AS (SELECT a, min(b) AS label FROM r GROUP BY a), d AS (SELECT a, count(DISTINCT b) AS n FROM t GROUP BY a)
 SELECT i.page_id, coalesce(m.label, i.page_id) AS group_id, k.class_id, coalesce(d.n, 0) AS n_links
 FROM (SELECT DISTINCT page_id FROM page_records) i LEFT JOIN k USING (page_id) LEFT JOIN m ON m.a = k.class_id LEFT JOIN d ON d.a = k.class_id""",
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE octet_length(encode(chunk_text)) // 4 + 1 > 512",
    "p4_found": _LINES + "SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM hit",
    "p4_incremental": _LINES + "SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM hit",
    "p4_cleaned": _LINES
    + """, n AS (
  SELECT l.page_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE h.page_id IS NULL), '') AS content, CAST(count(h.page_id) AS INTEGER) AS n_removed
  FROM (SELECT DISTINCT page_id, line_no, line FROM l) l LEFT JOIN hit h ON h.page_id = l.page_id AND h.line_no = l.line_no GROUP BY l.page_id
) SELECT page_id, n.content, coalesce(n_removed, 0) AS n_removed FROM (SELECT DISTINCT page_id FROM page_records) LEFT JOIN n USING (page_id)""",
}
