"""Functions against fixed cases."""

import pytest
from pyspark.sql import functions as F

from skeinery.functions import analyze, text, urls
from skeinery.functions import html as H
from skeinery.functions.vector import cosine


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("r")).first().r


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://example.com/page#section", "https://example.com/page"),
        ("https://example.com//foo//bar", "https://example.com/foo/bar"),
        ("HTTPS://Example.COM/Page", "https://example.com/Page"),
        ("https://example.com/search?q=rust&lang=en", "https://example.com/search?q=rust&lang=en"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:443/a", "https://example.com/a"),
        ("http://example.com:8080/a", "http://example.com:8080/a"),
        ("https://example.com///a", "https://example.com//a"),
        ("no url", "no url"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("b,want", [("https://example.com/page", True), ("https://example.com:443/page", True), ("https://other.com/page", False), ("http://example.com/page", False), (None, False)])
def test_same_origin(spark, b, want):
    assert one(spark, urls.same_origin(F.lit("https://example.com"), F.col("b")), b=b) is want


@pytest.mark.parametrize("s,want", [("Hello World", "hello_world"), ("a--b__c", "a_b_c"), ("___test___", "test"), ("", "default"), ("a---b", "a__b"), (None, "default")])
def test_sanitize(spark, s, want):
    assert one(spark, urls.sanitize_identifier(F.col("s")), s=s) == want


def test_derive_group(spark):
    assert one(spark, urls.derive_group(F.lit("https://streamdb.example/docs"))) == "streamdb_example"
    assert one(spark, urls.derive_group(F.lit("https://docs.rs/tokio/1.0"))) == "docs_rs"
    assert one(spark, urls.derive_group(F.lit("x"), F.lit("docs-v2"))) == "docs_v2"
    assert one(spark, urls.derive_group(F.lit("x"))) == "unknown"


def test_resolve_links(spark):
    hrefs = ["/page1", "https://example.com/page2", "//other.com/page3", "#fragment", "mailto:a@b.c", "JavaScript:void(0)", "../up?x=1#y", "", None]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = [r.r for r in df.select(urls.resolve_link(F.col("h"), F.lit("https://example.com/a/b")).alias("r")).collect()]
    assert got == ["https://example.com/page1", "https://example.com/page2", "https://other.com/page3", None, None, None, "https://example.com/up?x=1", None, None]


def test_strip_html(spark):
    assert one(spark, text.strip_html(F.col("h")), h="pre<p>a > b</p>tail<br>x") == "a tail x"
    assert one(spark, text.strip_html(F.col("h")), h="") == ""
    assert one(spark, text.strip_html(F.col("h")), h=None) is None


def test_page_noise(spark):
    assert one(spark, text.remove_page_noise(F.col("s")), s="Body  text Edit page on x Previous Next") == "Body text Edit page on x"
    assert one(spark, text.remove_page_noise(F.col("s")), s="a (https://analytics.x/y) b") == "a (https:// b"
    assert one(spark, text.remove_page_noise(F.col("s")), s="a analytics.x/y") == "a"


@pytest.mark.parametrize("n,at,want", [(100, 0, (0, 100)), (1000, 0, (0, 300)), (1000, 500, (350, 650)), (1000, 980, (700, 1000))])
def test_snippet(spark, n, at, want):
    body = "." * at + "Q" + "." * (n - at - 1)
    got = one(spark, text.snippet(F.col("s"), ["q"]), s=body)
    a, e = want
    assert got == ("..." if a else "") + body[a:e] + ("..." if e < n else "")


def test_values(spark):
    assert one(spark, text.truncate(F.col("s"), 3), s="aé🙂bc") == "aé🙂..."
    assert one(spark, text.escape_string(F.col("s")), s="it's a\\b") == "it\\'s a\\\\b"
    assert one(spark, text.count_tokens(F.col("s")), s="x" * 9) == 3
    for json, want in [("42", "42"), ("true", "true"), (None, "null"), ("[1,2,3]", "[3 items]"), ('{"a":1}', "{1} keys"), ('"s"', "s")]:
        assert one(spark, text.cell(F.col("s")), s=json) == want
    assert text.query_terms(' "Hello," wörld! -- ') == ["hello", "wörld"]
    for name, want in [("md", "markdown"), ("TXT", "text"), ("html", "html"), ("?", "markdown")]:
        assert one(spark, text.parse_format(F.col("s")), s=name) == want


def test_html(spark):
    html = '<html><head><title> A &amp; B </title><meta property="og:title" content="T"><meta property="og:image" content="i.png"><script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{bad</script></head><body><a href="/x">x</a><script>"<a href=\'/no\'>"</script></body></html>'
    m = one(spark, H.metadata(F.col("h")), h=html)
    assert (m.title, m.description, m.og_image) == ("A & B", None, "i.png")
    assert one(spark, H.structured_meta(F.col("h")), h=html) == '{"json_ld":[{"a":1}],"open_graph":{"og:title":"T","og:image":"i.png"}}'
    assert one(spark, H.link_hrefs(F.col("h")), h=html) == ["/x"]
    assert one(spark, H.extract_title(F.col("h")), h="<p>no title</p>") is None
    md = one(spark, H.html_to_markdown(F.col("h")), h='<h1>Hello</h1><p>World <a href="https://example.com">click me</a></p><ul><li>one</li><li>two</li></ul><pre><code>x = 1\ny</code></pre>')
    for part in ("# Hello", "[click me](https://example.com)", "- one\n- two", "```\nx = 1\ny\n```"):
        assert part in md
    clean = one(spark, H.clean_html(F.col("h")), h='<div><nav>menu</nav><p class="x">a &amp; b</p><img src="https://t.co/x"><a rel="next" href="/n">n</a></div>')
    assert clean == '<div><p class="x">a &amp; b</p></div>'
    assert one(spark, H.extract(F.col("h"), "text"), h="<div><script>x</script><p>body</p></div>") == "body"


def test_analyze(spark):
    assert one(spark, analyze.tokens(F.col("s")), s="StreamDB v2 日本語") == ["stream", "db", "v", "2", "日本語"]
    words = {"running": "run", "flies": "fli", "consistency": "consist", "generalization": "general", "relational": "relat", "hopping": "hop", "hoped": "hope", "happily": "happili", "sky": "sky", "national": "nation", "skies": "sky", "troubled": "troubl", "succeeding": "succeed"}
    assert {w: analyze.stem(w) for w in words} == words


def test_cosine(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678)
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) is None
