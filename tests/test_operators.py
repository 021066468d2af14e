"""Core operators on small tables, with nulls, empty tables, ties and further columns."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinery.operators import chunker, config, embed, graph, orphans, output, registry, search, skew, store, validate
from skeinery.plans import commands, pipeline
from skeinery.sources import captures, files


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


T0 = datetime(2025, 1, 1)


def orphan_tables(spark, links=None, pages=None, stones=None):
    links = [(1, "g", 10, 20, T0), (1, "g", 10, 20, T0), (2, "g", None, 30, T0), (3, "g", 40, 10, T0), (4, "g", 50, 10, None), (None, "g", 60, None, T0)] if links is None else links
    pages = [(10, T0), (20, T0 + timedelta(days=8)), (20, T0 + timedelta(days=9)), (50, T0 + timedelta(days=99)), (None, T0)] if pages is None else pages
    stones = [(40,), (40,), (10,), (None,)] if stones is None else stones
    return (
        spark.createDataFrame(links, "link_id long, grp string, from_page long, to_page long, discovered_at timestamp").withColumn("kind", F.lit("x")),
        spark.createDataFrame(pages, "page_id long, crawled_at timestamp"),
        spark.createDataFrame(stones, "page_id long"),
    )


def test_orphans(spark):
    found = orphans.orphan_references(*orphan_tables(spark))
    got = {(r.link_id, r.ref_field, r.kind) for r in found.collect()}
    assert got == {(1, "to_page", "late"), (2, "to_page", "missing"), (3, "from_page", "deleted"), (None, "from_page", "missing")}
    report = orphans.orphan_report(found)
    assert {(r.ref_field, r.month, r.kind, r.n_orphans) for r in report.collect()} == {("to_page", "2025-01", "late", 1), ("to_page", "2025-01", "missing", 1), ("from_page", "2025-01", "deleted", 1), ("from_page", "2025-01", "missing", 1)}


def test_orphans_without_link_id(spark):
    links = [(None, "g", 60, 61, T0), (None, "g", 60, 61, T0), (None, "g", 62, None, T0), (None, "g", 60, None, T0 + timedelta(days=1))]
    got = orphans.orphan_references(*orphan_tables(spark, links, [], []))
    assert sorted((r.ref_field, r.key) for r in got.collect()) == [("from_page", 60), ("from_page", 60), ("from_page", 62), ("to_page", 61)]


def test_orphans_empty(spark):
    assert orphans.orphan_references(*orphan_tables(spark, [], [], [])).count() == 0
    assert orphans.orphan_references(*orphan_tables(spark, pages=[], stones=[])).where("kind = 'missing'").count() == 8


def test_orphans_hot_key(spark):
    links = [(i, "g", 7 if i % 3 else i, 1, T0) for i in range(3000)]
    got = orphans.orphan_references(*orphan_tables(spark, links, [(1, T0)], [(7,)]))
    assert got.count() == 3000 and got.where("kind = 'deleted'").count() == sum(1 for i in range(3000) if i % 3 or i == 7)


def test_keyed_join_and_prefix_sum(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    keys = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    for share in (0.0, 0.1, 2.0):
        assert skew.keyed_join(big, keys, ["k"], "n", share).agg(F.count("*"), F.sum("v")).first() == (1000, sum(2 * (i % 7) for i in range(1000)))
    s = skew.prefix_sum(big, ["k"], F.floor(F.col("id") / 100), ["id"], F.col("id"), "before")
    for k in range(7):
        total = 0
        for r in s.where(F.col("k") == k).orderBy("id").collect():
            assert r.before == total
            total += r.id


def test_validator(spark):
    df = spark.createDataFrame(
        [("h" * 60, "t", 404), ("h" * 60, "t", 500), ("h" * 60, "Page not found · X", 200), ("hi", "t", 200), ('<meta name="robots" content="noindex">' + "x" * 40, "t", 200), ("h" * 60, None, None)],
        "html string, title string, status int",
    )
    got = [r.r for r in df.select(validate.reject_reason(F.col("html"), F.col("title"), F.col("status")).alias("r")).collect()]
    assert got == ["HTTP 404", "HTTP 500", 'soft 404 (title contains "page not found")', "content too short (2 chars, min 50)", "robots noindex", None]


def test_chunker():
    c = chunker.Chunker(100, 10)
    assert [p for _, _, p in c.chunk("# Harbor\n\nBoats lie here.\n\n## Tides\n\nTwice a day.\n\n### Spring\n\nHigher ones.\n\n## Cranes\n\nFour.")] == [["Harbor"], ["Harbor", "Tides"], ["Harbor", "Tides", "Spring"], ["Harbor", "Cranes"]]
    assert [len(t) for _, t, _ in c.chunk(("This is a test. " * 100).strip())] == [318, 312, 312, 312, 312, 233]
    assert [t for _, t, _ in chunker.Chunker(5, 0).chunk("A" * 50 + "\n\nb")] == ["A" * 50, "b"]
    assert [t for _, t, _ in chunker.Chunker(5, 0, compat=True).chunk("A" * 50 + "\n\nb")] == ["", "A" * 50, "b"]
    for budget, overlap in ((10, 0), (10, 2)):
        got = [t for _, t, _ in chunker.Chunker(budget, overlap).chunk("x" * 100)]
        assert all(len(t) <= 40 for t in got) and len(got[0]) == 40 and sum(map(len, got)) - 4 * overlap * (len(got) - 1) == 100


def test_long_pages_keep_all_chunks(spark):
    text = "\n\n".join(f"paragraph {i} of the page" for i in range(1500))
    df = spark.createDataFrame([("u", text)], "url string, content string")
    got = [r.chunk_text for r in chunker.chunk_pages(df, ("url",), 8, 0).orderBy("chunk_index").collect()]
    assert len(got) > 1000 and got[-1] == "paragraph 1499 of the page"
    assert chunker.chunk_pages(df, ("url",), 8, 0, chunker.MAX_CHUNKS).count() == 1000


def test_chunk_pages(spark):
    df = spark.createDataFrame([("g", "u", "# A\nbody", None), ("g", "v", None, None), ("g", "w", "  ", None), ("g", "e", "x", "HTTP 404")], "grp string, url string, content string, error string")
    assert rows(chunker.chunk_pages(df), "url", "chunk_index", "chunk_text") == [("u", 0, "body")]


def pages(spark):
    data = [
        ("birds", "https://n/1", "Heron", "A grey heron fishes beside the weir"),
        ("birds", "https://n/2", "Weirs", "Every weir attracts herons; this weir is old"),
        ("maps", "https://m/1", "River", "Charts of the weir and of both locks"),
        ("maps", "https://m/2", None, "grey nothing"),
    ]
    return spark.createDataFrame(data, "grp string, url string, title string, content string")


def test_bm25(spark, tmp_path):
    p = pages(spark)
    assert [r.url for r in search.bm25_search(p, "grey", group="birds").collect()] == ["https://n/1"]
    assert len(search.bm25_search(p, "weir", group="birds").collect()) == 2
    assert len(search.bm25_search(p, "weirs heron").collect()) == 2  # stems
    assert len(search.bm25_search(p, "grey weir", operator="or", stemmed=False).collect()) == 3
    assert search.bm25_search(p, "?!").count() == 0
    assert search.bm25_search(p.limit(0), "grey").count() == 0
    direct = {r.url: pytest.approx(r.score) for r in search.bm25_scores(p, "the weir", stemmed=False).collect()}
    index = search.search_index(search.build_index(p, stemmed=False), "the weir", stemmed=False)
    assert {r.url: r.score for r in index.collect()} == direct and len(direct) == 2
    # the stored index, with a page indexed again
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.index_pages(p.withColumn("content", F.when(F.col("url") == "https://n/2", "weir " * 9).otherwise(F.col("content"))), stemmed=False)
    s.index_pages(p.where("url = 'https://n/2'"), stemmed=False)
    assert {r.url: r.score for r in s.search("the weir", stemmed=False).collect()} == direct
    s.compact("posting")
    assert len(s.batches("posting")) == 1 and {r.url: r.score for r in s.search("the weir", stemmed=False).collect()} == direct
    assert [r.url for r in s.search("the weir", group="maps", stemmed=False).collect()] == ["https://m/1"]


def chunk_table(spark):
    data = [("g", "u", i, f"t{i}", ["h"], [float(i == 0), float(i == 1), 1.0]) for i in range(4)] + [("g", "v", 0, "other", None, [1.0, 0.0]), ("g", "w", 0, "none", None, None)]
    return spark.createDataFrame(data, "grp string, page_url string, chunk_index int, chunk_text string, heading_path array<string>, embedding array<float>")


def test_vector_and_hybrid(spark):
    c = chunk_table(spark)
    p = spark.createDataFrame([("g", "u", "U", "alpha beta")], "grp string, url string, title string, content string")
    near = search.knn_search(c, p, [1.0, 0.0, 1.0], limit=2).orderBy(F.desc("score")).collect()
    assert [(r.page_url, r.page_title, r.chunk_text) for r in near][0] == ("u", "U", "t0") and len(near) == 2
    assert search.knn_search(c, p, [1.0, 0.0], limit=5).count() == 1
    hits = search.hybrid_search(p, c, "alpha", [0.0, 1.0, 1.0], limit=1).collect()
    assert [(h.chunk_index, h.expanded_text) for h in hits] == [(1, "t0\n\nt1\n\nt2")]
    assert search.hybrid_search(p, c, "gamma", [0.0, 1.0, 1.0]).count() == 0
    wide = {r.chunk_index: r.expanded_text for r in search.adjacent_text(c.where("page_url = 'u'"), ("grp", "page_url")).collect()}
    assert wide[0] == "t0\n\nt1" and wide[3] == "t2\n\nt3"


def test_robots(spark):
    def decide(lines, path, compat=False):
        df = spark.createDataFrame([("https://e", i, s) for i, s in enumerate(lines)], "origin string, line_no int, line string")
        u = spark.createDataFrame([("https://e" + path,)], "url string")
        return graph.robots_allowed(u, graph.robots_rules(df, compat)).first().allowed

    a = ["User-agent: *", "Disallow: /private/", "Disallow: /admin"]
    assert [decide(a, p) for p in ("/private/page", "/admin", "/public")] == [False, False, True]
    b = ["User-agent: *", "Disallow: /", "Allow: /public/"]
    assert [decide(b, p) for p in ("/secret", "/public/page")] == [False, True]
    assert decide(["User-agent: BotA", "Disallow: /", "User-agent: *", "Disallow: /x"], "/y")
    assert decide(["User-agent: *", "Disallow:"], "/y") and not decide(["User-agent: *", "Disallow:"], "/y", True)


def site(spark, **links):
    filler = "<p>" + "text " * 20 + "</p>"
    data = [(f"https://e.x/{k}", f"<title>{k}</title>" + "".join(f'<a href="{h}">.</a>' for h in v) + filler, k, 200) for k, v in links.items()]
    return spark.createDataFrame(data, "url string, html string, title string, http_status int")


def test_crawl(spark):
    s = site(spark, a=["/b", "/b", "https://other.y/", "/gone"], b=["/c"], c=["/d"], d=[])
    got = graph.crawl(s, ["https://e.x/a"], max_depth=2).orderBy("ord").collect()
    assert [(r.ord, r.url[-1:], r.depth, r.error) for r in got] == [(1, "a", 0, None), (2, "b", 1, None), (3, "e", 1, "page not captured"), (4, "c", 2, None)]
    assert [r.start_s for r in got] == [0.0, 0.5, 1.0, 1.5] and "text text" in got[1].content
    assert (got[0].http_status, got[0].links_found, got[2].content, got[0].format) == (200, 4, "", "markdown")
    wide = graph.crawl(s, spark.createDataFrame([("https://e.x/a", 0), ("https://e.x/d", 1)], "url string, ord long"), max_depth=2, max_pages=0, max_discovered=None)
    assert [(r.url[-1:], r.depth) for r in wide.orderBy("ord").collect()] == [("a", 0), ("d", 0), ("b", 1), ("e", 1), ("c", 2)]
    assert graph.crawl(s, ["https://e.x/a"], max_depth=2, same_origin=False).count() == 5
    assert graph.crawl(s, ["https://e.x/a"], max_pages=1).count() == 1
    assert graph.crawl(s, ["https://e.x/a"], max_depth=0).count() == 1
    assert graph.crawl(s, []).count() == 0


def test_crawl_rules_sitemap_redirects(spark):
    s = site(spark, a=["/b", "/old"], b=[], c=[], new=["/c"])
    rules = graph.robots_rules(spark.createDataFrame([("https://e.x", 1, "User-agent: *"), ("https://e.x", 2, "Disallow: /b")], "origin string, line_no int, line string"))
    sitemap = spark.createDataFrame([("https://e.x/c", 0)], "url string, ord long")
    moved = spark.createDataFrame([("https://e.x/old", "https://e.x/new")], "url string, final_url string")
    got = graph.crawl(s, ["https://e.x/a"], rules=rules, sitemap=sitemap, redirects=moved).orderBy("ord").collect()
    assert [(r.url, r.title) for r in got] == [("https://e.x/c", "c"), ("https://e.x/a", "a"), ("https://e.x/old", "new")]


def test_crawl_into_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    captured = site(spark, a=["/b", "https://other.y/", "/gone"], b=["/a"])
    got = pipeline.crawl_into_store(s, captured, ["https://e.x/a"], embed.HashProvider(8), "hash-8")
    assert got.count() == 3
    assert rows(s.read("page"), "grp", "url", "title") == [("e_x", "https://e.x/a", "a"), ("e_x", "https://e.x/b", "b")]
    assert rows(s.read("discovered"), "src_url", "dst_url") == [("https://e.x/a", "https://e.x/b"), ("https://e.x/a", "https://e.x/gone"), ("https://e.x/a", "https://other.y/"), ("https://e.x/b", "https://e.x/a")]
    chunks = s.read("chunk").collect()
    assert {c.page_url for c in chunks} == {"https://e.x/a", "https://e.x/b"} and all(c.dimensions == 8 and len(c.embedding) == 8 for c in chunks)
    assert s.search("text").count() == 2 and s.search("nothing").count() == 0
    pipeline.crawl_into_store(s, captured, ["https://e.x/a"], embed.HashProvider(8), "hash-8")  # again: nothing doubles
    assert s.read("page").count() == 2 and s.read("chunk").count() == len(chunks)


def test_bfs_and_links(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src long, dst long")
    r = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.bfs_levels(e, r, 9)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.within_hops(e, r, 1)) == [(1, 0), (2, 1)]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    cols = "grp string, url string, title string, content string, depth int, format string, crawled_at timestamp, meta string"
    page = lambda g, u, t, at=T0: (g, u, t, "c", 0, "text", at, None)
    s.upsert_pages(spark.createDataFrame([page("blog", "u", "1"), page("docs", "v", "1")], cols))
    s.upsert_pages(spark.createDataFrame([page("blog", "u", "2", T0 + timedelta(1)), page("blog", "u", "old"), page("blog", "w", "1")], cols))
    assert rows(s.read("page"), "grp", "url", "title") == [("blog", "u", "2"), ("blog", "w", "1"), ("docs", "v", "1")]
    s.update_meta(spark.createDataFrame([("blog", "u", '{"a":1}')], "grp string, url string, meta string"))
    assert s.read("page", "blog").where("url = 'u'").first().meta == '{"a":1}'
    s.insert_links(spark.createDataFrame([("blog", "u", "w", None, T0)], store.SCHEMAS["discovered"]))
    chunk = lambda g, u, i: (g, u, i, f"{i}", None, None, "m", None, T0)
    s.replace_chunks(spark.createDataFrame([chunk("blog", "u", 0), chunk("blog", "u", 1), chunk("blog", "w", 0)], store.SCHEMAS["chunk"]))
    s.replace_chunks(spark.createDataFrame([chunk("blog", "u", 7)], store.SCHEMAS["chunk"]))
    assert rows(s.read("chunk"), "page_url", "chunk_index") == [("u", 7), ("w", 0)]
    assert tuple(store.group_stats(s.read("page"), s.read("discovered"), s.read("chunk"), "blog").first()) == (2, 1, 2)
    s.delete_chunks(spark.createDataFrame([("blog", "u"), ("blog", "w")], "grp string, url string"))
    assert s.read("chunk").count() == 0
    s.compact("page")
    assert s.batches("page") == [4] and s.read("page", "blog").where("url = 'u'").first().meta == '{"a":1}'
    s.reset_group("blog")
    assert rows(store.group_list(s.read("page"))) == [("docs",)]
    assert s.migrate() == ["001", "002", "003", "004"] and s.migrate() == [] and s.get_metadata("schema_version") == "004"
    s.reset_all()
    assert s.read("page").count() == 0 and s.get_metadata("schema_version") is None


def test_files(spark, tmp_path):
    r = spark.createDataFrame([(i, f"u{i}", 0, f"c{i}" if i != 2 else None, "markdown", f"t{i}", 1, None if i != 2 else "HTTP 404") for i in range(60)], "ord long, url string, depth int, content string, format string, title string, links_found long, error string")
    files.write_output_dir(r, str(tmp_path / "out"))
    listed = json.load(open(tmp_path / "out/manifest.json"))
    assert [x["file"] for x in listed] == [f"{i:04d}.md" for i in range(1, 61)] and listed[59]["url"] == "u59"
    back = files.import_pages(spark, str(tmp_path / "out"), "g")
    assert back.count() == 59 and back.where("url = 'u5'").first().content == "c5"
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.md").write_text("# A")
    (tmp_path / "texts/b.bin").write_text("no")
    assert rows(files.import_pages(spark, str(tmp_path / "texts"), "g"), "title", "content", "format") == [("a", "# A", "markdown")]
    files.export_table(back, str(tmp_path / "dump"), "g")
    assert spark.read.json(str(tmp_path / "dump")).count() == 59
    (tmp_path / "seeds.txt").write_text("# c\n\nhttps://a\n https://b \n")
    assert rows(files.read_url_list(spark, str(tmp_path / "seeds.txt")), "url") == [("https://a",), ("https://b",)]
    files.fan_out(r, [lambda d: files.append_urls(d, str(tmp_path / "urls")), lambda d: files.write_json_lines(d, str(tmp_path / "lines"))])
    assert spark.read.text(str(tmp_path / "urls")).count() == 59 and spark.read.json(str(tmp_path / "lines")).count() == 60
    with pytest.raises(ValueError):
        files.import_pages(spark, str(tmp_path / "nothing"), "g")


def test_captures(spark):
    s = site(spark, a=["/b"], b=[])
    got = {r.url: r for r in captures.batch(spark.createDataFrame([("https://e.x/a#x",), ("https://e.x/zzz",)], "url string"), s).collect()}
    assert got["https://e.x/a"].links_found == 1 and got["https://e.x/a"].error is None
    assert got["https://e.x/zzz"].error == "page not captured" and got["https://e.x/zzz"].content == ""
    assert captures.navigate(s, "https://e.x/b").first().title == "b" and captures.snapshot(s, "https://e.x/b").first().content.startswith("b text")
    red = captures.with_redirects(s.select("url"), spark.createDataFrame([("https://e.x/a", "https://e.x/b")], "url string, final_url string"))
    assert rows(red, "final_url") == [("https://e.x/b",), ("https://e.x/b",)]
    xml = '<urlset xmlns="n"><url><loc> https://a/?x=1&amp;y </loc><lastmod>1</lastmod></url><url><loc>https://b</loc></url></urlset>'
    assert rows(captures.sitemap_urls(spark.createDataFrame([("o", xml), ("p", "<urlset/>"), ("q", None)], "origin string, xml string")), "ord", "url") == [(0, "https://a/?x=1&y"), (1, "https://b")]


def test_embed(spark):
    c = spark.createDataFrame([(i, "g", f"text {i}" if i else None) for i in range(250)], "chunk_id long, grp string, chunk_text string")
    e = embed.embed(c, embed.HashProvider(8), "m", batch=100)
    assert e.where("embedding is null").count() == 1 and e.where("dimensions = 8 and model = 'm'").count() == 249
    m = embed.monitor(spark.createDataFrame([(True, 100)] * 8 + [(False, 9)], "ok boolean, latency_ms long")).first()
    assert (m.requests, m.errors, m.avg_ms, m.max_ms, m.error_pct, m.health) == (9, 1, 100, 100, 11.1, "HIGH ERRORS")
    assert embed.monitor(spark.createDataFrame([], "ok boolean, latency_ms long")).first().health == "HEALTHY"
    assert [embed.retry_delay(i) for i in (1, 2, 3)] == [5, 10, 20]


def test_http_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            bad = body["model"] == "bad"
            out = b"broken" if bad else json.dumps({"data": [{"embedding": [1 + 2 * i, 2 + 2 * i]} for i in range(len(body["input"]))]}).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a): ...

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert embed.HttpProvider([url], "m")(["a", "b"]) == [[1, 2], [3, 4]] and embed.HttpProvider([url], "m")([]) == []
    calls.clear()
    with pytest.raises(RuntimeError, match="broken"):
        embed.HttpProvider([url], "bad", first_delay=0.001)(["a"])
    assert len(calls) == 4
    server.shutdown()


def test_config():
    c = {"global": {"requests_per_second": 2}, "domains": {"e.com": {"requests_per_second": 3, "subdomains": {"docs": {"requests_per_second": 5, "use_sitemap": True}}}}}
    assert config.resolve(c, "x.org")["requests_per_second"] == 2
    assert config.resolve(c, "www.e.com")["requests_per_second"] == 3
    assert (config.resolve(c, "docs.e.com")["requests_per_second"], config.resolve(c, "docs.e.com")["use_sitemap"]) == (5, True)
    assert config.interpolate_env("Bearer ${A}, $B, $C!", {"A": "x", "B": "y"}) == "Bearer x, y, !"
    assert config.embedding_config({"endpoint": "http://$H/", "endpoints": None}, {"H": "h"})["endpoints"] == ["http://h/"]
    assert config.store_url({}, {"db_path": "p"}) == "p" and config.store_url({"SKEIN_STORE": "e"}, {"db_url": "u"}) == "e"
    assert config.load("/nowhere") == {}


def test_registry(spark):
    r = registry.default_registry({"db list": lambda: ["g"]})
    assert r.call("db list") == ["g"] and r.listing(spark).count() == len(registry.COMMANDS)
    assert set(r.tree(1)) >= {"crawl", "db"} and "list" in r.tree()["db"] and "db" not in r.tree(ignore=frozenset(["db"]))
    with pytest.raises(KeyError):
        r.call("none")
    with pytest.raises(TypeError):
        r.call("db list", '{"x": 1}')
    with pytest.raises(NotImplementedError):
        r.call("db status")


def test_commands_run(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    r = commands.bound(s, site(spark, a=["/b"], b=[]), embed.HashProvider(8), "hash-8")
    assert r.call("navigate", {"url": "https://e.x/a"}).first().title == "a"
    assert r.call("extract", {"url": "https://e.x/b", "format": "text"}).first().error is None
    assert r.call("crawl", {"url": "https://e.x/a"}).count() == 2
    assert rows(r.call("db list")) == [("e_x",)] and tuple(r.call("db status").first())[:2] == (2, 1)
    assert sorted(x.title for x in r.call("db query", {"query": "text"}).collect()) == ["a", "b"]
    assert r.call("db vector", {"query": "text", "limit": 1}).count() == 1 and r.call("db hybrid", {"query": "text"}).count() >= 2
    sizes = r.call("export", {"path": f"file://{tmp_path}/dump"})
    other = store.Store(spark, f"file://{tmp_path}/other")
    assert files.import_store(other, f"file://{tmp_path}/dump") == sizes and sizes["page"] == 2
    assert other.read("chunk").count() == s.read("chunk").count() and other.read("discovered").count() == 1
    r.call("db reset", {"group": "e_x"})
    assert s.read("page").count() == 0 and all(t.name in registry.COMMANDS[i] for i, t in enumerate(r.tools.values()))


def test_render(spark):
    df = output.ranked(spark.createDataFrame([("u|1", 0.5, None), ("u2", 0.9, "x" * 60)], "url string, score double, title string"), "score", "url").orderBy("rank")
    lines = [r.line for r in output.render(df, "markdown", "rank").orderBy("line_no").collect()]
    assert lines[:2] == ["| url | score | title | rank |", "| --- | --- | --- | --- |"] and lines[2] == f"| u2 | 0.9 | {'x' * 40}... | 1 |" and lines[3] == "| u\\|1 | 0.5 | null | 2 |"
    assert json.loads(output.render(df, "json", "rank").orderBy("line_no").collect()[1].line) == {"url": "u|1", "score": 0.5, "rank": 2}
    assert [r.line.split()[0] for r in output.render(df, "table", "rank").orderBy("line_no").collect()] == ["url", "u2", "u|1"]
    with pytest.raises(ValueError):
        output.render(df, "xml")
