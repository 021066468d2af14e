"""Queries over the operators of ingestion and retrieval, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinery.functions import analyze, text, urls
from skeinery.functions import html as H
from skeinery.functions.vector import cosine
from skeinery.operators import chunker, embed, graph, search, store, validate
from skeinery.plans import pipeline
from skeinery.session import prepare, shared_dir, table
from skeinery.sources import captures, files

#: Fixed query texts and parameters of the demonstrations.
WORDS = "archive metric"
ANY_WORDS = "zufall museum garten"
GROUP = "harlomenta_docs"
TOP = 10

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(prepare(spark), d)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- tables in the shape of the data model -----------------------------------------------------------------------------


def documents_as_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.coalesce("source", F.lit("unknown")).alias("grp"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title"), F.col("text").alias("content")
    )


DOCS = "d AS (SELECT coalesce(source, 'unknown') AS grp, 'doc://' || doc_id AS url, '' AS title, text AS content FROM documents)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One row per page_id; redelivered rows agree in url and content."""
    cols = ("grp", "url", "title", "content", "depth", "format", "meta", "crawled_at")
    # of redeliveries the last; a struct keeps the columns of one row together
    last = table(spark, d, "page_records").groupBy("page_id").agg(F.max_by(F.struct(*cols), F.struct("crawled_at", F.col("title").isNotNull(), "title", "meta", "depth")).alias("r"))
    return last.select("page_id", "r.*")


PAGES = """p AS (SELECT page_id, grp, url, title, content, depth, format, meta, crawled_at FROM page_records
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY crawled_at DESC NULLS LAST, title IS NOT NULL DESC, title DESC NULLS LAST, meta DESC NULLS LAST, depth DESC NULLS LAST) = 1)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    cols = ("page_id", "grp", "chunk_index", "chunk_text")
    return table(spark, d, "chunks").groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in cols], F.min("heading_path").alias("heading_path"))


CHUNKS = "c AS (SELECT chunk_id, min(page_id) AS page_id, min(grp) AS grp, min(chunk_index) AS chunk_index, min(chunk_text) AS chunk_text FROM chunks GROUP BY chunk_id)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first whole vector of each chunk, 64 long."""
    v = table(spark, d, "embedding_data").where((F.size("embedding") == 64) & (F.col("dimensions") == 64) & F.col("chunk_id").isNotNull())
    v = v.where(~F.exists("embedding", lambda x: F.isnan(x) | x.isNull()) & F.exists("embedding", lambda x: x != 0))
    return v.groupBy("chunk_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))


VECTORS = """v AS (SELECT chunk_id, arg_min(embedding, vec_id) AS embedding FROM embedding_data WHERE len(embedding) = 64 AND dimensions = 64 AND chunk_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id)"""


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with page URL and vector, one per (page, index)."""
    url = pages(spark, d).select("page_id", F.col("url").alias("page_url"))
    c = chunks(spark, d).join(vectors(spark, d), "chunk_id").join(url, "page_id")
    return c.select("grp", "page_url", "chunk_id", "chunk_index", "chunk_text", "heading_path", "embedding")


SEARCH = f"{PAGES}, {CHUNKS}, {VECTORS}, s AS (SELECT c.grp, p.url AS page_url, c.chunk_id, c.chunk_index, c.chunk_text, v.embedding FROM c JOIN v USING (chunk_id) JOIN p USING (page_id))"


def page_html():
    """Markup around a page's title and content."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(
        F.lit("<html><head><title> "), esc(F.col("title")), F.lit('</title><meta name="description" content="About '), F.col("grp"),
        F.lit('"><meta property="og:title" content="'), F.col("url"), F.lit('"></head><body><nav><a href="/">Home</a></nav><h1>'), esc(F.col("title")), F.lit("</h1><p>"), esc(F.col("content")),
        F.lit('</p><a href="next?page=2#top">more</a><a href="mailto:a@b.example">mail</a><a href="HTTPS://Other.example:443//a//b">other</a></body></html>'),
    )


HTML = """(SELECT *, '<html><head><title> ' || replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><meta name="description" content="About ' || grp
 || '"><meta property="og:title" content="' || url || '"></head><body><nav><a href="/">Home</a></nav><h1>' || replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h1><p>'
 || replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
 || '</p><a href="next?page=2#top">more</a><a href="mailto:a@b.example">mail</a><a href="HTTPS://Other.example:443//a//b">other</a></body></html>' AS html FROM p)"""


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).withColumn("html", page_html())


# --- vector search --------------------------------------------------------------------------------------------------------


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_COS = "list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT {TOP}")
def vector_topk(spark, d):
    best = search.knn_scores(table(spark, d, "embeddings"), search.vector_array(_query_vector(spark, d)), 64)
    return best.orderBy(F.desc("score"), "vec_id").limit(TOP).select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding, label FROM embeddings WHERE vec_id = 0) q WHERE e.label = q.label ORDER BY {_COS} DESC, e.vec_id LIMIT {TOP}"
)
def vector_topk_by_label(spark, d):
    e = table(spark, d, "embeddings")
    label = e.where("vec_id = 0").first()["label"]
    best = search.knn_scores(e.where(F.col("label") == label), search.vector_array(_query_vector(spark, d)), 64)
    return best.orderBy(F.desc("score"), "vec_id").limit(TOP).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT model, dimensions, count(*) AS n, count(*) FILTER (WHERE len(embedding) = dimensions) AS n_whole FROM embedding_data GROUP BY model, dimensions")
def dimension_check(spark, d):
    whole = F.coalesce(F.size("embedding") == F.col("dimensions"), F.lit(False))
    return table(spark, d, "embedding_data").groupBy("model", "dimensions").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole & F.col("embedding").isNotNull()).alias("n_whole"))


@query(
    f"WITH {SEARCH}, q AS (SELECT embedding FROM s ORDER BY chunk_id LIMIT 1) SELECT e.page_url, e.chunk_index, e.chunk_text, round({_COS}, 6) AS score FROM s e, q ORDER BY {_COS} DESC NULLS LAST, e.grp, e.page_url, e.chunk_index, e.chunk_id LIMIT {TOP}"
)
def knn_chunks(spark, d):
    s = search_chunks(spark, d)
    q = [float(x) for x in s.orderBy("chunk_id").select("embedding").first()[0]]
    best = search.knn_scores(s, search.vector_array(q), 64).orderBy(F.desc_nulls_last("score"), "grp", "page_url", "chunk_index", "chunk_id").limit(TOP)
    return best.select("page_url", "chunk_index", "chunk_text", F.round("score", 6).alias("score"))


# --- full text ---------------------------------------------------------------------------------------------------------------


def _bm25_sql(terms: list[str], every: bool = True, group: str | None = None) -> str:
    n = len(terms)
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(n))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(n))
    match = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(n))
    return f"""{DOCS}, t AS (SELECT *, list_transform(regexp_extract_all(content, '{analyze.TOKEN_PATTERN}'), lambda x: lower(x)) AS toks FROM d),
 f AS (SELECT grp, url, title, content, coalesce(len(toks), 0) AS dl, {tf} FROM t), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM f),
 b AS (SELECT grp, url, title, content, {score} AS score FROM f, st WHERE ({match}){f" AND grp = '{group}'" if group else ""} ORDER BY score DESC, grp, url LIMIT {TOP})"""


def _best(spark, d, words=WORDS, operator="and", group=None):
    s = search.bm25_scores(documents_as_pages(spark, d), words, "content", False, operator, group)
    return s.orderBy(F.desc("score"), "grp", "url").limit(TOP)


@query("WITH " + _bm25_sql(WORDS.split()) + " SELECT url, round(score, 6) AS score FROM b")
def bm25_search_unstemmed(spark, d):
    return _best(spark, d).select("url", F.round("score", 6).alias("score"))


@query("WITH " + _bm25_sql(ANY_WORDS.split(), False) + " SELECT url, round(score, 6) AS score FROM b")
def bm25_search_any(spark, d):
    return _best(spark, d, ANY_WORDS, "or").select("url", F.round("score", 6).alias("score"))


@query("WITH " + _bm25_sql(WORDS.split(), True, GROUP) + " SELECT grp, url, round(score, 6) AS score FROM b")
def bm25_search_group(spark, d):
    return _best(spark, d, group=GROUP).select("grp", "url", F.round("score", 6).alias("score"))


@query(
    "WITH "
    + _bm25_sql(WORDS.split())
    + """, a AS (SELECT url, content, length(content) AS n, coalesce(list_min(list_filter([instr(lower(content), 'archive'), instr(lower(content), 'metric')], lambda x: x > 0)) - 1, 0) AS pos FROM b),
 w AS (SELECT url, content, n, CASE WHEN least(greatest(pos - 150, 0) + 300, n) - greatest(pos - 150, 0) < 300 AND n > 300 THEN n - 300 ELSE greatest(pos - 150, 0) END AS a, least(greatest(pos - 150, 0) + 300, n) AS e FROM a)
 SELECT url, (CASE WHEN a > 0 THEN '...' ELSE '' END) || substr(content, a + 1, e - a) || (CASE WHEN e < n THEN '...' ELSE '' END) AS snippet FROM w"""
)
def bm25_snippet(spark, d):
    best = search.bm25_search(documents_as_pages(spark, d), WORDS, TOP, stemmed=False)
    return best.select("url", "snippet")


@query()
def bm25_search_stemmed(spark, d):
    return search.bm25_search(documents_as_pages(spark, d), "archives metrics", TOP).select("url", "snippet", F.round("score", 6).alias("score"))


@query("WITH " + _bm25_sql(WORDS.split()) + " SELECT grp, url, round(score, 6) AS score FROM b")
def bm25_from_index(spark, d):
    index = search.build_index(documents_as_pages(spark, d), stemmed=False)
    return search.search_index(index, WORDS, TOP, stemmed=False).select("grp", "url", F.round("score", 6).alias("score"))


@query(
    f"WITH {DOCS}, t AS (SELECT grp, unnest(list_transform(regexp_extract_all(content, '{analyze.TOKEN_PATTERN}'), lambda x: lower(x))) AS term FROM d) SELECT grp, count(*) AS tokens, count(DISTINCT term) AS terms FROM t GROUP BY grp"
)
def corpus_terms(spark, d):
    t = documents_as_pages(spark, d).select("grp", F.explode(analyze.tokens(F.col("content"))).alias("term"))
    per = t.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("grp").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("terms"))


# --- hybrid --------------------------------------------------------------------------------------------------------------------

_PAGE_WORDS = "snapshot dashboard"
_HYBRID = f"""WITH {SEARCH}, t AS (SELECT grp, url, title, list_transform(regexp_extract_all(content, '{analyze.TOKEN_PATTERN}'), lambda x: lower(x)) AS toks FROM p),
 f AS (SELECT grp, url, title, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'snapshot')) AS tf0, len(list_filter(toks, lambda x: x = 'dashboard')) AS tf1 FROM t),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM f),
 b AS (SELECT grp, url, title, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
   FROM f, st WHERE tf0 > 0 AND tf1 > 0 ORDER BY score DESC, grp, url LIMIT 50), q AS (SELECT embedding FROM s ORDER BY chunk_id LIMIT 1),
 h AS (SELECT e.grp, e.page_url, b.title AS page_title, e.chunk_index, e.chunk_text, b.score AS bm25, coalesce({_COS}, 0) AS cos FROM s e JOIN b ON b.grp = e.grp AND b.url = e.page_url, q ORDER BY cos DESC, e.grp, e.page_url, e.chunk_index LIMIT {TOP})
"""


@query(_HYBRID + "SELECT page_url, page_title, chunk_index, chunk_text, round(bm25, 6) AS bm25_score, round(cos, 6) AS vector_score FROM h")
def hybrid_search(spark, d):
    s = search_chunks(spark, d)
    q = [float(x) for x in s.orderBy("chunk_id").select("embedding").first()[0]]
    hits = search.hybrid_search(pages(spark, d), s, _PAGE_WORDS, q, limit=TOP, stemmed=False)
    return hits.select("page_url", "page_title", "chunk_index", "chunk_text", F.round("bm25_score", 6).alias("bm25_score"), F.round("vector_score", 6).alias("vector_score"))


@query(
    _HYBRID
    + """SELECT h.page_url, h.chunk_index, coalesce(string_agg(s.chunk_text, chr(10) || chr(10) ORDER BY s.chunk_index, s.chunk_text), h.chunk_text) AS expanded_text
 FROM h LEFT JOIN s ON s.grp = h.grp AND s.page_url = h.page_url AND s.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY h.page_url, h.chunk_index, h.chunk_text"""
)
def hybrid_expanded(spark, d):
    s = search_chunks(spark, d)
    q = [float(x) for x in s.orderBy("chunk_id").select("embedding").first()[0]]
    return search.hybrid_search(pages(spark, d), s, _PAGE_WORDS, q, limit=TOP, stemmed=False).select("page_url", "chunk_index", "expanded_text")


@query(
    f"WITH {CHUNKS} SELECT a.chunk_id, string_agg(b.chunk_text, chr(10) || chr(10) ORDER BY b.chunk_index, b.chunk_text) AS expanded_text FROM c a LEFT JOIN c b ON b.grp = a.grp AND b.page_id = a.page_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 AND b.chunk_text IS NOT NULL GROUP BY a.chunk_id"
)
def chunk_adjacent_expand(spark, d):
    wide = search.adjacent_text(chunks(spark, d))
    return wide.select("chunk_id", F.nullif("expanded_text", F.lit("")).alias("expanded_text"))


# --- groups, counts -------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT grp FROM page_records")
def list_groups(spark, d):
    return store.group_list(table(spark, d, "page_records"))


@query(
    "SELECT (SELECT count(*) FROM page_records WHERE grp = 'news_howefiba_test') AS page_count, (SELECT count(*) FROM link_records WHERE grp = 'news_howefiba_test') AS link_count, (SELECT count(*) FROM chunks WHERE grp = 'news_howefiba_test') AS chunk_count"
)
def group_stats(spark, d):
    return store.group_stats(table(spark, d, "page_records"), table(spark, d, "link_records"), table(spark, d, "chunks"), "news_howefiba_test")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS successful, count(*) FILTER (WHERE error IS NOT NULL) AS errors FROM crawl_results")
def run_counters(spark, d):
    return validate.run_counters(table(spark, d, "crawl_results"))


@query("SELECT from_page, count(*) AS links, count(DISTINCT to_page) AS targets FROM link_records WHERE from_page IS NOT NULL GROUP BY from_page")
def link_counts(spark, d):
    links = table(spark, d, "link_records").where(F.col("from_page").isNotNull())
    return links.groupBy("from_page").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("to_page").alias("targets"))


@query(f"WITH {CHUNKS} SELECT page_id, count(*) AS chunks, sum(length(chunk_text)) AS chars FROM c GROUP BY page_id")
def chunks_by_page(spark, d):
    return chunks(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("chunk_text")).alias("chars"))


@query(
    """WITH r AS (SELECT event_type <> 'error' AND value > 2 AS ok, CAST(floor(value * 100) AS BIGINT) AS ms FROM events), a AS (SELECT count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS errors,
 CAST(floor(coalesce(sum(ms) FILTER (WHERE ok), 0) / greatest(count(*) FILTER (WHERE ok), 1)) AS BIGINT) AS avg_ms, coalesce(max(ms) FILTER (WHERE ok), 0) AS max_ms FROM r)
 SELECT *, round(errors / requests * 100, 1) AS error_pct, CASE WHEN errors / requests * 100 > 10 THEN 'HIGH ERRORS' WHEN avg_ms > 5000 THEN 'SLOW' WHEN avg_ms > 2000 THEN 'MODERATE' ELSE 'HEALTHY' END AS health FROM a"""
)
def embed_monitor(spark, d):
    e = table(spark, d, "events")
    return embed.monitor(e.select(((F.col("event_type") != "error") & (F.col("value") > 2)).alias("ok"), F.floor(F.col("value") * 100).alias("latency_ms")))


# --- URLs -----------------------------------------------------------------------------------------------------------------------

_VARIANTS = """u AS (SELECT DISTINCT url FROM page_records), x AS (SELECT url FROM u UNION ALL SELECT replace(url, 'https://', 'HTTPS://') || '#part' FROM u
 UNION ALL SELECT regexp_replace(url, '^https://([^/]+)/', 'https://\\1:443//a///b/') FROM u UNION ALL SELECT regexp_replace(url, '^https://([^/]+).*$', 'http://\\1:80?q=A#z') FROM u UNION ALL SELECT substr(url, 9) FROM u)"""


def _variants(spark, d):
    u = table(spark, d, "page_records").select("url").distinct()
    forms = F.array(
        F.col("url"), F.concat(F.replace("url", F.lit("https://"), F.lit("HTTPS://")), F.lit("#part")), F.regexp_replace("url", "^https://([^/]+)/", "https://$1:443//a///b/"),
        F.regexp_replace("url", "^https://([^/]+).*$", "http://$1:80?q=A#z"), F.substring("url", 9, 10000),
    )
    return u.select(F.explode(forms).alias("url"))


_ABS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


@query(
    f"""WITH {_VARIANTS}, g AS (SELECT url, regexp_matches(url, '{_ABS}') AS ok, lower(regexp_extract(url, '{_ABS}', 1)) AS s, lower(regexp_extract(url, '{_ABS}', 2)) AS h,
 regexp_extract(url, '{_ABS}', 3) AS p, regexp_extract(url, '{_ABS}', 4) AS q FROM x)
 SELECT url, CASE WHEN ok THEN s || '://' || regexp_replace(h, CASE s WHEN 'https' THEN ':443$' WHEN 'http' THEN ':80$' ELSE ':$' END, '') || replace(CASE p WHEN '' THEN '/' ELSE p END, '//', '/') || q ELSE url END AS normalized FROM g"""
)
def normalize_url(spark, d):
    return _variants(spark, d).select("url", urls.normalize_url(F.col("url")).alias("normalized"))


_HOST = f"regexp_replace(lower(regexp_extract(url, '{_ABS}', 2)), ':[0-9]*$', '')"


@query(
    f"""WITH {_VARIANTS}, h AS (SELECT url, CASE {_HOST} WHEN '' THEN 'unknown' ELSE {_HOST} END AS h FROM x)
 SELECT url, left(regexp_replace(replace(regexp_replace(lower(h), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), '__', '_'), '^_+|_+$', '', 'g'), 64) AS grp FROM h"""
)
def derive_group(spark, d):
    return _variants(spark, d).select("url", urls.derive_group(F.col("url")).alias("grp"))


@query(
    f"""WITH {PAGES}, e AS (SELECT DISTINCT l.link_id, a.url AS a, b.url AS b FROM link_records l JOIN p a ON a.page_id = l.from_page JOIN p b ON b.page_id = l.to_page)
 SELECT link_id, regexp_extract(a, '^(https?://[^/:]+)', 1) = regexp_extract(b, '^(https?://[^/:]+)', 1) AS same FROM e"""
)
def same_origin_links(spark, d):
    u = pages(spark, d).select("page_id", "url")
    links = table(spark, d, "link_records").select("link_id", "from_page", "to_page").distinct()
    e = links.join(u.select(F.col("page_id").alias("from_page"), F.col("url").alias("a")), "from_page").join(u.select(F.col("page_id").alias("to_page"), F.col("url").alias("b")), "to_page")
    return e.select("link_id", urls.same_origin(F.col("a"), F.col("b")).alias("same"))


@query(
    f"""WITH u AS (SELECT url FROM page_records UNION ALL SELECT url || '#again' FROM crawl_results), n AS (SELECT CASE WHEN regexp_extract(url, '{_ABS}', 1) = '' THEN url ELSE
 lower(regexp_extract(url, '{_ABS}', 1)) || '://' || lower(regexp_extract(url, '{_ABS}', 2)) || replace(CASE regexp_extract(url, '{_ABS}', 3) WHEN '' THEN '/' ELSE regexp_extract(url, '{_ABS}', 3) END, '//', '/') || regexp_extract(url, '{_ABS}', 4) END AS url FROM u)
 SELECT DISTINCT url FROM n WHERE url <> ''"""
)
def url_union_dedup(spark, d):
    a = table(spark, d, "page_records").select("url", F.lit(0).alias("ord"))
    b = table(spark, d, "crawl_results").select(F.concat("url", F.lit("#again")).alias("url"), F.lit(0).alias("ord"))
    return graph.seed_urls(a, b).select("url")


# --- markup ----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {PAGES} SELECT page_id, nullif(trim(title), '') AS title FROM {HTML}")
def extract_title(spark, d):
    return html_pages(spark, d).select("page_id", H.extract_title(F.col("html")).alias("title"))


@query(f"WITH {PAGES} SELECT page_id, nullif(trim(title), '') AS title, 'About ' || grp AS description, CAST(NULL AS VARCHAR) AS canonical, url AS og_title FROM {HTML}")
def extract_metadata(spark, d):
    m = html_pages(spark, d).select("page_id", H.metadata(F.col("html")).alias("m"), H.meta_content(F.col("html"), "property", "og:title").alias("og_title"))
    return m.select("page_id", "m.title", "m.description", "m.canonical", "og_title")


@query(
    """WITH h AS (SELECT DISTINCT result_id, content FROM crawl_results WHERE format = 'html') SELECT result_id, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split(content, '<'), lambda x: contains(x, '>')), lambda x: string_split(x, '>')[2]), ' '), '\\s+', ' ', 'g')) AS plain FROM h"""
)
def strip_html(spark, d):
    h = table(spark, d, "crawl_results").where(F.col("format") == "html").select("result_id", "content").distinct()
    return h.select("result_id", text.strip_html(F.col("content")).alias("plain"))


@query(
    f"""WITH {PAGES}, h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS o, url FROM p) SELECT page_id, 0 AS position, o || '/' AS link FROM h
 UNION ALL SELECT page_id, 1, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'next?page=2' FROM h UNION ALL SELECT page_id, 3, 'https://other.example/a/b' FROM h"""
)
def extract_links(spark, d):
    h = html_pages(spark, d)
    links = graph.page_links(h.select(F.col("url"), "html", "page_id"))
    ids = h.select("url", "page_id")
    return links.distinct().join(ids, "url").select("page_id", "position", "link")


@query(
    """WITH r AS (SELECT DISTINCT result_id, http_status AS s, lower(title) AS t, octet_length(encode(content)) AS n, lower(content) AS c FROM crawl_results)
 SELECT result_id, CASE WHEN s BETWEEN 400 AND 599 THEN 'HTTP ' || s
  WHEN contains(t, 'page not found') THEN 'soft 404 (title contains "page not found")' WHEN contains(t, 'file not found') THEN 'soft 404 (title contains "file not found")' WHEN contains(t, 'not found') THEN 'soft 404 (title contains "not found")'
  WHEN contains(t, 'no such') THEN 'soft 404 (title contains "no such")' WHEN contains(t, '404') THEN 'soft 404 (title contains "404")'
  WHEN n < 50 THEN 'content too short (' || n || ' chars, min 50)' WHEN contains(c, 'noindex') AND contains(c, '<meta') AND contains(c, 'robots') THEN 'robots noindex' END AS reason FROM r"""
)
def validate_results(spark, d):
    r = table(spark, d, "crawl_results").select("result_id", "content", "title", "http_status").distinct()
    return r.select("result_id", validate.reject_reason(F.col("content"), F.col("title"), F.col("http_status")).alias("reason"))


@query("SELECT result_id, count(*) AS copies, max(CAST(contains(lower(content), '<script') AS INTEGER)) = 1 AS settle FROM crawl_results GROUP BY result_id")
def needs_settle(spark, d):
    return table(spark, d, "crawl_results").groupBy("result_id").agg(F.count(F.lit(1)).alias("copies"), F.bool_or(validate.needs_settle(F.col("content"))).alias("settle"))


@query()
def markdown_extract(spark, d):
    return html_pages(spark, d).select("page_id", H.extract(F.col("html"), "markdown").alias("content"))


@query()
def clean_and_collapse(spark, d):
    return html_pages(spark, d).select("page_id", H.extract(F.col("html"), "markdown", True).alias("line"), H.extract(F.col("html"), "text").alias("plain"), H.structured_meta(F.col("html")).alias("meta"))


# --- graph -----------------------------------------------------------------------------------------------------------------------


def _edges(spark, d):
    return table(spark, d, "link_records").select(F.col("from_page").alias("src"), F.col("to_page").alias("dst"))


def _root(spark, d):
    return table(spark, d, "link_records").agg(F.min("from_page").alias("node"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT from_page AS src, to_page AS dst FROM link_records WHERE from_page IS NOT NULL AND to_page IS NOT NULL), w AS (SELECT min(from_page) AS node, 0 AS depth FROM link_records
 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node"""
)
def bfs_levels(spark, d):
    return graph.bfs_levels(_edges(spark, d), _root(spark, d), 3)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT from_page AS src, to_page AS dst FROM link_records WHERE from_page IS NOT NULL AND to_page IS NOT NULL), w AS (SELECT min(from_page) AS node, 0 AS depth FROM link_records
 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 2) SELECT DISTINCT node FROM w"""
)
def graph_two_hop(spark, d):
    return graph.within_hops(_edges(spark, d), _root(spark, d), 2).select("node")


@query(
    "SELECT DISTINCT to_page AS page FROM link_records WHERE to_page IS NOT NULL AND to_page NOT IN (SELECT page_id FROM page_records)"
)
def new_links_anti(spark, d):
    links = table(spark, d, "link_records").where(F.col("to_page").isNotNull()).select(F.col("to_page").alias("link"), F.lit(0).alias("position"))
    return graph.new_links(links, table(spark, d, "page_records").select(F.col("page_id").alias("url"))).select(F.col("link").alias("page"))


_RULES = ((1, "User-agent: OtherBot"), (2, "Disallow: /"), (3, "User-agent: *"), (4, "Disallow: /p/"), (5, "Allow: /p/notes"), (6, "Disallow: /wiki/  # all"), (7, "Disallow:"), (8, "Allow: /wiki/a"))


@query(
    """WITH u AS (SELECT DISTINCT url, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM page_records),
 r(no, p, ok) AS (VALUES (4, '/p/', false), (5, '/p/notes', true), (6, '/wiki/', false), (8, '/wiki/a', true)), m AS (SELECT u.url, arg_max(r.ok, length(r.p) * 100 + r.no) AS ok FROM u LEFT JOIN r ON starts_with(u.path, r.p) GROUP BY u.url)
 SELECT url, coalesce(ok, true) AS allowed FROM m"""
)
def robots_allowed(spark, d):
    u = table(spark, d, "page_records").select("url").distinct()
    origins = u.select(urls.origin(F.col("url")).alias("origin")).distinct()
    lines = origins.select("origin", F.inline(F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(s).alias("line")) for n, s in _RULES])))
    return graph.robots_allowed(u, graph.robots_rules(lines)).select("url", "allowed")


@query("SELECT DISTINCT url FROM page_records")
def sitemap_scan(spark, d):
    u = table(spark, d, "page_records").select("grp", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url")).distinct()
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.col("url"), F.lit("</loc><lastmod>2025-01-01</lastmod></url></urlset>"))
    return captures.sitemap_urls(u.select(F.col("grp").alias("origin"), xml.alias("xml"))).select("url").distinct()


@query(
    """WITH v AS (SELECT DISTINCT grp AS host, page_id AS id, crawled_at AS t FROM page_records), g AS (SELECT *, epoch(t) - epoch(lag(t) OVER (PARTITION BY host ORDER BY t, id)) AS gap FROM v)
 SELECT host, id, round(greatest(0, coalesce(100 - gap, 0)), 3) AS wait_s FROM g"""
)
def rate_limit_gaps(spark, d):
    v = table(spark, d, "page_records").select(F.col("grp").alias("host"), F.col("page_id").alias("id"), F.col("crawled_at").alias("at")).distinct()
    return graph.rate_gaps(v, 0.01).select("host", "id", F.round("wait_s", 3).alias("wait_s"))


# --- store -----------------------------------------------------------------------------------------------------------------------


def fresh_store(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_records").select("grp", "url", "title", "content", "depth", "format", "crawled_at", "meta")


_LATE = "2025-06-01"


@query(
    f"""WITH r AS (SELECT url, grp, crawled_at, CASE WHEN crawled_at >= TIMESTAMP '{_LATE}' THEN 0 ELSE 1 END AS batch FROM page_records),
 n AS (SELECT url, grp, arg_max(crawled_at, struct_pack(b := batch, c := crawled_at)) AS crawled_at FROM r GROUP BY url, grp) SELECT url, grp, crawled_at FROM n"""
)
def upsert_latest(spark, d):
    """Late rows first, early ones as the second batch: the batch wins over the crawl time."""
    s, rows = fresh_store(spark), page_rows(spark, d)
    late = F.coalesce(F.col("crawled_at") >= _LATE, F.lit(False))
    s.upsert_pages(rows.where(late))
    s.upsert_pages(rows.where(~late))
    return s.read("page").select("url", "grp", "crawled_at")


@query(
    """WITH n AS (SELECT grp, url, max(depth) AS depth FROM page_records WHERE grp <> 'news_howefiba_test' GROUP BY ALL)
 SELECT grp, url, CASE WHEN depth = 0 THEN '{"root":true}' END AS root_meta FROM n"""
)
def store_roundtrip(spark, d):
    """Pages stored, metadata of start pages set, one group reset, batches merged and read back."""
    s = fresh_store(spark)
    s.upsert_pages(page_rows(spark, d).groupBy("grp", "url").agg(F.max("depth").alias("depth")).selectExpr("grp", "url", "'' title", "'' content", "depth", "'text' format", "timestamp'2025-01-01' crawled_at", "cast(null as string) meta"))
    s.update_meta(s.read("page").where("depth = 0").select("grp", "url", F.lit('{"root":true}').alias("meta")))
    s.reset_group("news_howefiba_test")
    s.compact("page")
    return s.read("page").select("grp", "url", F.col("meta").alias("root_meta"))


@query("SELECT grp, url FROM page_records WHERE grp <> 'news_howefiba_test' GROUP BY ALL")
def reset_group(spark, d):
    s = fresh_store(spark)
    s.upsert_pages(page_rows(spark, d))
    s.reset_group("news_howefiba_test")
    return s.read("page").select("grp", "url")


@query(
    """SELECT grp, CAST(page_id AS VARCHAR) AS page_url, count(DISTINCT chunk_id) AS n_chunks FROM chunks c WHERE page_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM page_tombstones t WHERE t.page_id = c.page_id AND t.grp = c.grp) GROUP BY ALL"""
)
def delete_chunks(spark, d):
    s = fresh_store(spark)
    rows = chunks(spark, d).where(F.col("page_id").isNotNull()).select("grp", F.col("page_id").cast("string").alias("page_url"), "chunk_index", "chunk_text", "heading_path")
    s.replace_chunks(rows.selectExpr("*", "cast(null as array<float>) embedding", "cast(null as string) model", "cast(null as int) dimensions", "current_timestamp() created_at"))
    s.delete_chunks(table(spark, d, "page_tombstones").select("grp", F.col("page_id").cast("string").alias("url")))
    return s.read("chunk").groupBy("grp", "page_url").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"WITH {PAGES} SELECT grp, url, 32 AS dimensions, 'hash-32' AS model FROM p WHERE trim(coalesce(content, '')) <> '' GROUP BY grp, url")
def chunk_embed_index(spark, d):
    """Pages stored, chunked, embedded and put into the chunk table."""
    s, p = fresh_store(spark), pages(spark, d).withColumn("error", F.lit(None).cast("string"))
    s.upsert_pages(p)
    s.replace_chunks(embed.chunk_embed_index(p, s.read("page").select("grp", "url"), embed.HashProvider(32), "hash-32"))
    return s.read("chunk").where(F.size("embedding") == F.col("dimensions")).select("grp", F.col("page_url").alias("url"), "dimensions", "model").distinct()


@query(
    """WITH r AS (SELECT DISTINCT result_id, url, depth, title, links_found, error, format FROM crawl_results), n AS (SELECT *, row_number() OVER (ORDER BY result_id, url) AS n FROM r)
 SELECT url, (CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END) || CASE lower(format) WHEN 'html' THEN '.html' WHEN 'text' THEN '.txt' ELSE '.md' END AS file, depth, title, links_found, error FROM n"""
)
def manifest(spark, d):
    r = table(spark, d, "crawl_results").select(F.col("result_id").alias("ord"), "url", "depth", "title", "links_found", "error", "format").distinct()
    return files.manifest(r)


@query(f"WITH {PAGES} SELECT grp, url, title, depth, format, meta FROM p WHERE grp = 'news_howefiba_test'")
def export_group(spark, d):
    """A group written as JSON lines and imported again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.jsonl"
    files.export_table(pages(spark, d), path, "news_howefiba_test")
    return files.import_pages(spark, path, "news_howefiba_test").select("grp", "url", "title", "depth", "format", "meta")


@query("SELECT DISTINCT url, coalesce(title, '') AS title, depth, format FROM crawl_results WHERE error IS NULL")
def results_to_pages(spark, d):
    r = table(spark, d, "crawl_results").withColumn("grp", urls.derive_group(F.col("url")))
    return store.to_page(r).select("url", "title", "depth", "format").distinct()


# --- values ----------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT doc_id, CAST(floor(length(text) / 4) + 1 AS INTEGER) AS tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.count_tokens(F.col("text")).alias("tokens")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT DISTINCT result_id, local_storage['theme'] AS theme, cardinality(local_storage) AS entries FROM crawl_results WHERE local_storage IS NOT NULL")
def local_storage_values(spark, d):
    r = table(spark, d, "crawl_results").where(F.col("local_storage").isNotNull())
    return r.select("result_id", F.col("local_storage").getItem("theme").alias("theme"), F.size("local_storage").cast("bigint").alias("entries")).distinct()


@query("SELECT DISTINCT page_id, CASE WHEN length(title) > 20 THEN left(title, 20) || '...' ELSE title END AS short, replace(replace(title, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) AS escaped FROM page_records")
def display_values(spark, d):
    return table(spark, d, "page_records").select("page_id", text.truncate(F.col("title"), 20).alias("short"), text.escape_string(F.col("title")).alias("escaped")).distinct()


@query(
    """SELECT DISTINCT page_id, CASE WHEN meta IS NULL THEN 'null' ELSE '{' || len(json_keys(meta)) || '} keys' END AS shown FROM page_records"""
)
def meta_cells(spark, d):
    return table(spark, d, "page_records").select("page_id", text.cell(F.col("meta")).alias("shown")).distinct()


@query()
def chunk_pages(spark, d):
    return chunker.chunk_pages(pages(spark, d).withColumn("error", F.lit(None).cast("string")), ("grp", "url"))


@query()
def embed_chunks(spark, d):
    e = embed.embed(chunks(spark, d).select("chunk_id", "chunk_text"), embed.HashProvider(32), "hash-32")
    return e.select("chunk_id", "model", "dimensions", "embedding")


@query(
    f"WITH {CHUNKS}, e AS (SELECT chunk_id, count(*) AS vectors FROM embedding_data WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL GROUP BY chunk_id) SELECT c.chunk_id, c.page_id, e.vectors FROM c JOIN e USING (chunk_id)"
)
def chunk_vectors(spark, d):
    v = table(spark, d, "embedding_data").where(F.col("chunk_id").isNotNull() & F.col("embedding").isNotNull())
    return chunks(spark, d).join(v.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("vectors")), "chunk_id").select("chunk_id", "page_id", "vectors")


def linked_site(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Captures whose markup holds the links of link_records (to a page of their site that is missing, if the page is unknown), and a seed of every site."""
    p = pages(spark, d).where(F.col("grp").isNotNull()).select("page_id", "grp", _site_url("grp", F.col("page_id")).alias("url"))
    links = table(spark, d, "link_records").select(F.col("from_page").alias("page_id"), "to_page").where(F.col("to_page").isNotNull()).distinct()
    known = p.select(F.col("page_id").alias("to_page"), F.col("url").alias("known"))
    # popular targets are joined by key with AQE splitting what is skewed; their rows are few columns wide
    aimed = links.join(known, "to_page", "left").join(p.select("page_id", "grp"), "page_id")
    href = F.coalesce("known", F.concat(F.lit("/missing/"), F.col("to_page").cast("string")))
    anchors = aimed.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), href, F.lit('">to</a>')))), " ").alias("a"))
    body = F.concat(F.lit("<html><head><title>Captured page</title></head><body><p>"), F.lit("Words of a captured page. " * 12), F.lit("</p>"), F.coalesce("a", F.lit("")), F.lit("</body></html>"))
    made = p.join(anchors, "page_id", "left").select("url", body.alias("html"), F.lit("Captured page").alias("title"), F.lit(200).alias("http_status"))
    seeds = p.groupBy("grp").agg(F.min("page_id").alias("ord")).select("ord", _site_url("grp", F.col("ord")).alias("url"))
    return made, seeds


def _site_url(grp: str, page_id) -> DataFrame:
    return F.concat(F.lit("https://"), F.replace(grp, F.lit("_"), F.lit("-")), F.lit(".example/page/"), page_id.cast("string"))


_SITE = """p AS (SELECT page_id, min(grp) AS grp, 'https://' || replace(min(grp), '_', '-') || '.example/page/' || page_id AS url FROM page_records WHERE grp IS NOT NULL GROUP BY page_id),
 l AS (SELECT DISTINCT from_page, to_page FROM link_records WHERE to_page IS NOT NULL),
 e AS (SELECT f.url AS src, coalesce(t.url, 'https://' || replace(f.grp, '_', '-') || '.example/missing/' || l.to_page) AS dst, coalesce(t.grp, f.grp) = f.grp AS same
   FROM l JOIN p f ON f.page_id = l.from_page LEFT JOIN p t ON t.page_id = l.to_page),
 b AS (SELECT 'https://' || replace(grp, '_', '-') || '.example/page/' || min(page_id) AS url, 0 AS depth FROM p GROUP BY grp
   UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 2 AND e.same),
 f AS (SELECT url, min(depth) AS depth FROM b GROUP BY url), n AS (SELECT src, count(*) AS n FROM e GROUP BY src)"""


@query(f"WITH RECURSIVE {_SITE} SELECT f.url, f.depth, CASE WHEN p.url IS NULL THEN 'page not captured' END AS error, coalesce(n.n, 0) AS links_found FROM f LEFT JOIN p ON p.url = f.url LEFT JOIN n ON n.src = f.url")
def crawl_pages(spark, d):
    captured, seeds = linked_site(spark, d)
    return graph.crawl(captured, seeds, max_pages=0, max_discovered=None).select("url", "depth", "error", "links_found")


@query(
    f"""WITH RECURSIVE {_SITE} SELECT f.url, CASE WHEN p.url IS NULL THEN '' ELSE trim(repeat('Words of a captured page. ', 12)) END AS first_words, 'markdown' AS format, CASE WHEN p.url IS NULL THEN NULL ELSE 'Captured page' END AS title
 FROM f LEFT JOIN p ON p.url = f.url"""
)
def crawl_results_full(spark, d):
    captured, seeds = linked_site(spark, d)
    got = graph.crawl(captured, seeds, max_pages=0, max_discovered=None)
    return got.select("url", F.regexp_extract("content", r"(?s)((?:Words of a captured page\.\s*)*)", 1).alias("w"), "format", "title").select("url", F.trim(F.regexp_replace("w", r"\s+", " ")).alias("first_words"), "format", "title")


@query(
    f"""WITH RECURSIVE {_SITE}, s AS (SELECT url FROM f LEFT JOIN p USING (url) WHERE p.url IS NOT NULL) SELECT 'page' AS kind, count(*) AS n FROM s
 UNION ALL SELECT 'link', count(*) FROM (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT url FROM s)) UNION ALL SELECT 'chunk pages', count(*) FROM s UNION ALL SELECT 'found', count(*) FROM s"""
)
def crawl_into_store(spark, d):
    """The whole way: crawl, store, edges, chunks with vectors, postings, search."""
    s = fresh_store(spark)
    captured, seeds = linked_site(spark, d)
    pipeline.crawl_into_store(s, captured, seeds, embed.HashProvider(16), "hash-16", max_pages=0, max_discovered=None)
    kinds = {
        "page": s.read("page"), "link": s.read("discovered"), "chunk pages": s.read("chunk").select("grp", "page_url").distinct(),
        "found": s.search("captured words", limit=1 << 30),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_PAIR_COS = "list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"WITH {CHUNKS}, {VECTORS}, x AS (SELECT page_id, chunk_id, embedding FROM c JOIN v USING (chunk_id) WHERE page_id IS NOT NULL) SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, round({_PAIR_COS}, 6) AS cos FROM x a JOIN x b ON a.page_id = b.page_id AND a.chunk_id < b.chunk_id")
def cosine_pairs(spark, d):
    """Cosine of every two chunks of a page."""
    x = chunks(spark, d).where(F.col("page_id").isNotNull()).select("chunk_id", "page_id").join(vectors(spark, d), "chunk_id")
    side = lambda n: x.select("page_id", F.col("chunk_id").alias(f"chunk_{n}"), F.col("embedding").alias(f"e_{n}"))
    both = side("a").join(side("b"), "page_id").where(F.col("chunk_a") < F.col("chunk_b"))
    return both.select("chunk_a", "chunk_b", F.round(cosine(F.col("e_a"), F.col("e_b")), 6).alias("cos"))


@query(
    f"""WITH {SEARCH}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), k AS (SELECT s.*, {_COS.replace("e.embedding", "s.embedding")} AS score FROM s, q ORDER BY score DESC, grp, page_url, chunk_index LIMIT {TOP})
 SELECT k.page_url, p.title AS page_title, k.chunk_text, round(k.score, 6) AS score FROM k LEFT JOIN p ON p.grp = k.grp AND p.url = k.page_url"""
)
def knn_search(spark, d):
    best = search.knn_search(search_chunks(spark, d), pages(spark, d), _query_vector(spark, d), TOP)
    return best.select("page_url", "page_title", "chunk_text", F.round("score", 6).alias("score"))


@query("WITH " + _bm25_sql(WORDS.split()) + " SELECT grp, url, round(score, 6) AS score FROM b")
def bm25_stored_index(spark, d):
    """Postings written to the store in two batches, the second replacing half of the first."""
    s, docs = fresh_store(spark), documents_as_pages(spark, d)
    odd = F.pmod(F.xxhash64("url"), F.lit(2)) == 1
    s.index_pages(docs.where(odd).withColumn("content", F.lit(WORDS * 3)).unionByName(docs.where(~odd)), stemmed=False)
    s.index_pages(docs.where(odd), stemmed=False)
    return s.search(WORDS, TOP, stemmed=False).select("grp", "url", F.round("score", 6).alias("score"))
