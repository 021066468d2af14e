"""The link graph: robots rules, frontier expansion and breadth-first crawling of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinery.functions import html as H
from skeinery.functions import urls
from skeinery.operators.skew import prefix_sum
from skeinery.session import cut
from skeinery.sources.captures import results

#: URLs a crawl discovers at most.
MAX_DISCOVERED = 5000


def robots_rules(lines: DataFrame, compat: bool = False) -> DataFrame:
    """origin, rule_no, path, allowed of the rules that hold for every agent.

    ``lines``: origin, line_no, line of robots files. Only blocks of ``User-agent: *`` count. An empty Disallow allows all, unless
    ``compat`` takes it as a rule that matches every path.
    """
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    key, value = F.lower(F.trim(F.split_part(bare, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(bare, "^[^:]*:", ""))
    fields = lines.where(bare.contains(":")).select("origin", "line_no", key.alias("k"), value.alias("v"))
    w = W.partitionBy("origin").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    agent = F.last(F.when(F.col("k") == "user-agent", F.col("v")), ignorenulls=True).over(w)
    rules = fields.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("k").isin("allow", "disallow"))
    if not compat:
        rules = rules.where((F.col("v") != "") | (F.col("k") == "allow"))
    return rules.select("origin", F.col("line_no").alias("rule_no"), F.col("v").alias("path"), (F.col("k") == "allow").alias("allowed"))


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``allowed``: the longest matching rule of the origin decides, of equals the last; none allows.

    Rules are gathered per origin (a robots file is small by nature) and joined by origin, so URLs are matched without a
    product of the two tables.
    """
    listed = rules.groupBy("origin").agg(F.collect_list(F.struct("rule_no", "path", "allowed")).alias("__rules"))
    path = urls.path(F.col(url))
    joined = pages.withColumn("__origin", urls.origin(F.col(url))).join(listed.withColumnRenamed("origin", "__origin"), "__origin", "left")
    matching = F.filter("__rules", lambda r: F.startswith(path, r["path"]))
    ranked = F.array_max(F.transform(matching, lambda r: F.struct(F.char_length(r["path"]).alias("n"), r["rule_no"].alias("no"), r["allowed"].alias("allowed"))))
    return joined.withColumn("allowed", F.coalesce(ranked["allowed"], F.lit(True))).drop("__origin", "__rules")


def page_links(pages: DataFrame) -> DataFrame:
    """url, position, link: every navigable link of each page's markup in order, resolved and normalized."""
    raw = pages.select("url", F.posexplode(H.link_hrefs(F.col("html"))).alias("position", "href"))
    return raw.select("url", "position", urls.resolve_link(F.col("href"), F.col("url")).alias("link")).where(F.col("link").isNotNull())


def new_links(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links not visited before, each once, with the earliest place they were found."""
    return links.groupBy("link").agg(F.min("position").alias("position")).join(visited.select(F.col("url").alias("link")), "link", "left_anti")


def seed_urls(sitemap: DataFrame, seeds: DataFrame) -> DataFrame:
    """url, ord of the start URLs, normalized; those of the sitemap come first, repeated ones once."""
    both = sitemap.select("url", "ord", F.lit(0).alias("src")).unionByName(seeds.select("url", "ord", F.lit(1).alias("src")))
    first = both.select(urls.normalize_url(F.trim("url")).alias("url"), F.struct("src", "ord").alias("o")).where(F.col("url") != "").groupBy("url").agg(F.min("o").alias("o"))
    return first.select("url", "o.src", "o.ord")


#: Columns of a crawl's result.
CRAWL_SCHEMA = "ord bigint, url string, depth int, error string, title string, links_found bigint, content string, format string, http_status int, meta string, start_s double"


def crawl(
    captures: DataFrame,
    seeds: list[str] | DataFrame,
    max_depth: int = 2,
    max_pages: int = 100,
    same_origin: bool = True,
    rules: DataFrame | None = None,
    max_discovered: int | None = MAX_DISCOVERED,
    fmt: str = "markdown",
    sitemap: DataFrame | None = None,
    redirects: DataFrame | None = None,
    requests_per_second: float = 2.0,
    with_links: bool = False,
) -> DataFrame:
    """Breadth-first crawl over captured pages; one row per fetched page, as ``CRAWL_SCHEMA`` names them, in ``ord`` order.

    ``captures``: url, html, title, http_status. ``seeds`` are URLs, or a table (url, ord) of any size; those of ``sitemap`` (url, ord) come before
    them. URLs forbidden by ``rules`` (see ``robots_rules``) are not fetched; ``redirects`` (url, final_url) lead to the page that is read in a URL's place. One round per depth joins the
    frontier with the captures and deduplicates the few hits; a rejected or missing page is an error row and is not expanded.
    ``max_pages`` counts fetched pages with errors (0: no limit). With ``max_discovered`` the frontier is bounded and
    broadcast, so the captures are not moved; without (None) it is joined by shuffle. ``start_s`` tells when
    a request to its host may start at ``requests_per_second``. Each round is cut in the shared folder. ``with_links`` adds each page's references (``hrefs``) and the address they are relative to (``final``).
    """
    spark = captures.sparkSession
    start = spark.createDataFrame([(i, u) for i, u in enumerate(seeds)], "ord bigint, url string") if isinstance(seeds, list) else seeds.select(F.col("ord").cast("bigint").alias("ord"), "url")
    first = seed_urls(sitemap if sitemap is not None else start.limit(0), start)
    frontier = cut(prefix_sum(first, [], F.col("src") * 1_000_000 + F.floor(F.col("ord") / 4096), ["src", "ord", "url"], F.lit(1).cast("bigint"), "n").select("url", F.col("n").alias("ord")))
    small = (lambda df: df) if max_discovered is None else F.broadcast
    pages = captures.withColumn("url", urls.normalize_url(F.col("url"))).where(F.col("url").isNotNull())
    if redirects is not None:
        to = redirects.select(urls.normalize_url(F.col("url")).alias("url"), urls.normalize_url(F.col("final_url")).alias("final")).groupBy("url").agg(F.min("final").alias("final"))
    visited = frontier.select("url")
    done, fetched = None, 0
    for depth in range(max_depth + 1):
        ready = frontier
        if rules is not None:
            ready = robots_allowed(ready, rules).where("allowed").drop("allowed")
        if max_pages:
            ready = ready.orderBy("ord").limit(max(0, max_pages - fetched))
        ready = ready.withColumn("final", F.col("url"))
        if redirects is not None:
            ready = ready.drop("final").join(to, "url", "left").withColumn("final", F.coalesce("final", "url"))
        ready = cut(ready)
        n = ready.count()
        if not n:
            break
        found = pages.withColumnRenamed("url", "final").join(small(ready), "final")
        found = found.groupBy("url", "ord").agg(F.max_by(F.struct("html", "title", "http_status"), F.struct(F.col("html").isNotNull(), F.length("html"))).alias("c"))
        level = ready.join(found, ["url", "ord"], "left").select("url", "final", "ord", "c.*")
        # references first: one generated method for them and the results would grow too large to compile
        level = cut(level.withColumn("depth", F.lit(depth)).withColumn("hrefs", H.link_hrefs(F.col("html"))))
        level = cut(results(level, fmt, collapse=False, keep=("ord", "final", "hrefs")))
        fetched += n
        keep = ["ord", "url", "depth", "error", "title", "links_found", "content", "format", "http_status", "meta"]
        row = level.select(*keep, *([F.when(F.col("error").isNull(), F.col("hrefs")).alias("hrefs"), "final"] if with_links else []))
        done = row if done is None else done.unionByName(row)
        if depth == max_depth:
            break
        raw = level.where(F.col("error").isNull()).select(F.col("final").alias("url"), "ord", F.posexplode("hrefs").alias("position", "href"))
        out = raw.select("url", "ord", "position", urls.resolve_link(F.col("href"), F.col("url")).alias("link")).where(F.col("link").isNotNull())
        if same_origin:
            out = out.where(urls.origin(F.col("link")) == urls.origin(F.col("url")))
        fresh = out.groupBy("link").agg(F.min(F.struct("ord", "position")).alias("o")).join(small(visited.withColumnRenamed("url", "link")), "link", "left_anti")
        if max_discovered is not None:
            fresh = fresh.orderBy("o.ord", "o.position", "link").limit(max(0, max_discovered - visited.count()))
        base = fetched + (visited.count() if max_pages else 0)
        fresh = fresh.select(F.col("link").alias("url"), F.col("o.ord").alias("parent"), F.col("o.position").alias("position"))
        numbered = prefix_sum(fresh, [], F.floor(F.col("parent") / 256), ["parent", "position", "url"], F.lit(1).cast("bigint"), "n")
        frontier = cut(numbered.select("url", (F.col("n") + base).alias("ord")))
        visited = cut(visited.unionByName(frontier.select("url")))
    if done is None:
        return spark.createDataFrame([], CRAWL_SCHEMA)
    placed = prefix_sum(done, [], F.col("depth") * 1_000_000 + F.floor(F.col("ord") / 4096), ["depth", "ord", "url"], F.lit(1).cast("bigint"), "place").withColumn("ord", F.col("place") + 1)
    by_host = prefix_sum(placed.withColumn("host", urls.host(F.col("url"))), ["host"], F.floor(F.col("ord") / 4096), ["ord"], F.lit(1).cast("bigint"), "turn")
    out = by_host.withColumn("start_s", F.col("turn") / F.lit(max(requests_per_second, 0.01)))
    return out.select(*[c.split(" ")[0] for c in CRAWL_SCHEMA.split(", ")], *(["hrefs", "final"] if with_links else []))


def bfs_levels(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: the fewest hops from any root, up to ``max_depth``.

    Rounds join the frontier with the edges by key (``edges``: src, dst; distinct edges suffice) and are cut in the shared folder.
    """
    pairs = cut(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct())
    seen = cut(roots.select("node").where(F.col("node").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(pairs, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def within_hops(edges: DataFrame, hits: DataFrame, hops: int = 2) -> DataFrame:
    """node of everything within so many hops of the hits, with the fewest hops."""
    return bfs_levels(edges, hits, hops)


def rate_gaps(visits: DataFrame, requests_per_second: Column | float) -> DataFrame:
    """host, at, wait_s: seconds a request must still wait after the host's previous one."""
    least = 1 / F.greatest(F.lit(requests_per_second), F.lit(0.01))
    w = W.partitionBy("host").orderBy("at", "id")
    gap = F.col("at").cast("double") - F.lag("at").over(w).cast("double")
    return visits.select("host", "id", "at", F.greatest(F.lit(0.0), F.coalesce(least - gap, F.lit(0.0))).alias("wait_s"))
