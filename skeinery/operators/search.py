"""Full-text, vector and hybrid search as single plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinery.functions import analyze, text
from skeinery.functions.vector import cosine

K1, B = 1.2, 0.75


def _terms(query: str, stemmed: bool) -> list[str]:
    """Distinct analysed tokens of a query, in order."""
    import regex

    found = [t.lower() for t in regex.findall(analyze.TOKEN_PATTERN, query)]
    return list(dict.fromkeys(analyze.stem(t) if stemmed else t for t in found))


def bm25_scores(docs: DataFrame, query: str, content: str = "content", stemmed: bool = False, operator: str = "and", group: str | None = None) -> DataFrame:
    """``docs`` with a match, plus ``score``.

    Lengths and frequencies are those of the whole table; the group restricts the result only. One pass
    counts the terms of each document in place to get the table's statistics (one row, read when the query is built), a second scores, so nothing is shuffled. A query without terms matches nothing.
    """
    terms = _terms(query, stemmed)
    toks = (analyze.stemmed_tokens if stemmed else analyze.tokens)(F.col(content))
    counted = docs.withColumn("__toks", toks)
    if not terms:
        return counted.drop("__toks").where(F.lit(False)).withColumn("score", F.lit(0.0))
    def times(term: str) -> Column:
        return F.coalesce(F.size(F.filter("__toks", lambda x: x == term)), F.lit(0))

    tf = [times(t) for t in terms]
    counted = counted.select(*docs.columns, F.coalesce(F.size("__toks"), F.lit(0)).alias("__dl"), *[c.alias(f"__tf{i}") for i, c in enumerate(tf)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    rows = counted if group is None else counted.where(F.col("grp") == group)
    has = [F.col(f"__tf{i}") > 0 for i in range(len(terms))]
    match = has[0]
    for h in has[1:]:
        match = (match & h) if operator == "and" else (match | h)
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"__tf{i}"), stats[f"df{i}"]
        idf = F.log(F.lit(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.lit(stats["avg"] or 1.0)))
    return rows.where(match).select(*docs.columns, score.alias("score"))


def bm25_search(
    pages: DataFrame, query: str, limit: int = 10, group: str | None = None, stemmed: bool = True, operator: str = "and", ties: Sequence[str] = ("grp", "url")
) -> DataFrame:
    """url, title, snippet, score of the best pages; pages with a null url, title or content are left out."""
    scored = bm25_scores(pages, query, "content", stemmed, operator, group)
    best = scored.orderBy(F.desc("score"), *ties).limit(limit)
    found = best.dropna(subset=["url", "title", "content"])
    return found.select("url", "title", text.snippet(F.col("content"), text.query_terms(query)).alias("snippet"), "score")


def build_index(pages: DataFrame, keys: Sequence[str] = ("grp", "url"), stemmed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings, document lengths) of a page table, to be written once and searched often.

    postings: keys, term, tf, dl; document lengths: keys, dl. A page's terms are counted where it lies, so nothing is shuffled.
    """
    toks = (analyze.stemmed_tokens if stemmed else analyze.tokens)(F.col("content"))
    counted = pages.select(*keys, toks.alias("toks")).select(*keys, "toks", F.coalesce(F.size("toks"), F.lit(0)).alias("dl"))
    sorted_toks = counted.withColumn("toks", F.array_sort("toks"))
    distinct = sorted_toks.select(*keys, "dl", "toks", F.explode(F.array_distinct("toks")).alias("term"))
    first = F.array_position("toks", F.col("term"))
    tf = F.when(first > 0, F.array_position(F.reverse("toks"), F.col("term")))
    postings = distinct.select(*keys, "term", (F.size("toks") - first - tf + 2).cast("bigint").alias("tf"), "dl")
    return postings, counted.select(*keys, "dl")


def search_index(
    index: tuple[DataFrame, DataFrame], query: str, limit: int = 10, keys: Sequence[str] = ("grp", "url"), stemmed: bool = True, operator: str = "and", group: str | None = None
) -> DataFrame:
    """keys and score of the best documents of a written index; only the query's postings are read.

    As in ``bm25_scores`` the group restricts the result, not the statistics.
    """
    postings, lengths = index
    terms = _terms(query, stemmed)
    hit = postings.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row per term of the query
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    rows = (hit if group is None else hit.where(F.col("grp") == group)).join(F.broadcast(df), "term")
    idf = F.log(1 + (F.lit(whole["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(whole["avgdl"] or 1.0)))
    scored = rows.groupBy(*keys).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms"))
    if operator == "and":
        scored = scored.where(F.col("terms") == len(terms))
    return scored.drop("terms").orderBy(F.desc("score"), *keys).limit(limit)


def vector_array(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def knn_scores(chunks: DataFrame, query: Column, dimensions: int, group: str | None = None) -> DataFrame:
    """Chunks of the query's dimension with ``score``, their cosine to it; null scores are kept."""
    rows = chunks if group is None else chunks.where(F.col("grp") == group)
    return rows.where(F.size("embedding") == dimensions).withColumn("score", cosine(F.col("embedding"), query))


def knn_search(chunks: DataFrame, pages: DataFrame, query: Sequence[float], limit: int = 10, group: str | None = None) -> DataFrame:
    """page_url, page_title, chunk_text, heading_path, score of the most similar chunks; pages may be missing.

    The chunk table is reduced to ``limit`` rows before it meets the pages.
    """
    best = knn_scores(chunks, vector_array(query), len(query), group).orderBy(F.desc_nulls_last("score"), "grp", "page_url", "chunk_index").limit(limit)
    titles = pages.select("grp", F.col("url").alias("page_url"), F.col("title").alias("page_title"))
    return titles.join(F.broadcast(best), ["grp", "page_url"], "right").select("page_url", "page_title", "chunk_text", "heading_path", "score")


def expand_chunks(chunks: DataFrame, hits: DataFrame, keys: Sequence[str] = ("grp", "page_url"), reach: int = 1) -> DataFrame:
    """``hits`` with ``expanded_text``: the texts of the neighbouring chunks of the page in order, joined by blank lines.

    The hits (a bounded list) are broadcast as (key, index) pairs, so the chunk table is filtered where it lies.
    """
    around = hits.select(*keys, F.col("chunk_index").alias("__hit"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index")).distinct()
    near = chunks.select(*keys, "chunk_index", "chunk_text").join(F.broadcast(around), [*keys, "chunk_index"])
    texts = near.groupBy(*keys, "__hit").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    joined = texts.select(*keys, F.col("__hit").alias("chunk_index"), F.array_join(F.transform("c", lambda x: x["chunk_text"]), "\n\n").alias("expanded_text"))
    return hits.join(joined, [*keys, "chunk_index"], "left").withColumn("expanded_text", F.coalesce("expanded_text", "chunk_text"))


def adjacent_text(chunks: DataFrame, keys: Sequence[str] = ("grp", "page_id"), reach: int = 1) -> DataFrame:
    """Every chunk with the text of itself and its neighbours, by a range frame over the index."""
    w = W.partitionBy(*keys).orderBy("chunk_index").rangeBetween(-reach, reach)
    return chunks.withColumn("expanded_text", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")).over(w)), lambda x: x["chunk_text"]), "\n\n"))


def hybrid_search(
    pages: DataFrame, chunks: DataFrame, text_query: str, query: Sequence[float], bm25_limit: int = 50, limit: int = 10, group: str | None = None, stemmed: bool = True
) -> DataFrame:
    """page_url, page_title, chunk_text, heading_path, chunk_index, bm25_score, vector_score, expanded_text.

    The best pages by words are candidates (at most ``bm25_limit``, broadcast), their chunks are ranked by cosine; a null cosine counts as 0. Without a
    candidate the result is empty.
    """
    cand = bm25_scores(pages, text_query, "content", stemmed, "and", group).orderBy(F.desc("score"), "grp", "url").limit(bm25_limit)
    cand = cand.select("grp", F.col("url").alias("page_url"), F.col("title").alias("page_title"), F.col("score").alias("bm25_score"))
    own = chunks.join(F.broadcast(cand), ["grp", "page_url"])
    scored = knn_scores(own, vector_array(query), len(query)).withColumn("vector_score", F.coalesce("score", F.lit(0.0))).drop("score")
    hits = scored.orderBy(F.desc("vector_score"), "grp", "page_url", "chunk_index").limit(limit)
    return expand_chunks(chunks, hits).select("page_url", "page_title", "chunk_text", "heading_path", "chunk_index", "bm25_score", "vector_score", "expanded_text")
