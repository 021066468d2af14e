"""HTML functions: native patterns for titles and links, Arrow UDFs on the standard parser for cleaning and Markdown."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinery.functions import text

# Elements and classes that never hold content.
NOISE_TAGS = frozenset("script style svg nav header footer aside noscript iframe canvas template".split())
NOISE_CLASSES = frozenset("pagination page-nav article-nav prev-next _page-navigation".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _noise(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOISE_TAGS or NOISE_CLASSES & set(attrs.get("class", "").split()):
        return True
    src, href = attrs.get("src", ""), attrs.get("href", "")
    if tag == "img":
        return src.startswith("data:image/svg+xml") or any(m in src for m in ("analytics", "t.co", "twitter.com"))
    return tag == "a" and (attrs.get("rel") in ("prev", "next") or "/edit/" in href or "/issues/new" in href)


class _Walker(HTMLParser):
    """Feeds open, close and text events to callbacks, leaving noise elements out."""

    def __init__(self, clean: bool):
        super().__init__(convert_charrefs=True)
        self.clean = clean
        self.skipping: list[str] = []

    def handle_starttag(self, tag, attrs):
        known = {k: v or "" for k, v in attrs}
        if self.skipping:
            if tag not in VOID_TAGS:
                self.skipping.append(tag)
        elif self.clean and _noise(tag, known):
            if tag not in VOID_TAGS:
                self.skipping.append(tag)
        else:
            self.opened(tag, known)

    def handle_startendtag(self, tag, attrs):
        known = {k: v or "" for k, v in attrs}
        if not self.skipping and not (self.clean and _noise(tag, known)):
            self.opened(tag, known)
            if tag not in VOID_TAGS:
                self.closed(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
        elif tag not in VOID_TAGS:
            self.closed(tag)

    def handle_data(self, data):
        if not self.skipping:
            self.words(data)

    def opened(self, tag, attrs): ...

    def closed(self, tag): ...

    def words(self, data): ...


class _Cleaner(_Walker):
    def __init__(self):
        super().__init__(True)
        self.out: list[str] = []

    def opened(self, tag, attrs):
        self.out.append("<" + tag + "".join(f' {k}="{_html.escape(v)}"' for k, v in attrs.items()) + ">")

    def closed(self, tag):
        self.out.append(f"</{tag}>")

    def words(self, data):
        self.out.append(_html.escape(data, quote=False))


class _Markdown(_Walker):
    """Headings, paragraphs, links, emphasis, lists, quotes, code and tables as Markdown."""

    def __init__(self, clean: bool):
        super().__init__(clean)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.href: list[str] = []
        self.pre = 0
        self.hidden = 0
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.header_done = False

    def put(self, s: str) -> None:
        (self.out if self.cell is None else self.cell).append(s)

    def opened(self, tag, attrs):
        if tag in ("script", "style", "head", "title"):
            self.hidden += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "main", "figure"):
            self.put("\n\n")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. "
            else:
                mark = "- "
            self.put("\n" + "  " * depth + mark)
        elif tag == "blockquote":
            self.put("\n\n> ")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "a":
            self.href.append(attrs.get("href", ""))
            self.put("[")
        elif tag == "img":
            self.put(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
        elif tag == "table":
            self.header_done = False
            self.put("\n\n")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []

    def closed(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.put("" if self.lists else "\n\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "a" and self.href:
            self.put(f"]({self.href.pop()})")
        elif tag in ("td", "th") and self.cell is not None:
            done, self.cell = " ".join("".join(self.cell).split()), None
            if self.row is not None:
                self.row.append(done.replace("|", "\\|"))
        elif tag == "tr" and self.row is not None:
            self.put("| " + " | ".join(self.row) + " |\n")
            if not self.header_done:
                self.put("|" + " --- |" * len(self.row) + "\n")
                self.header_done = True
            self.row = None
        elif tag in ("p", "div", "section", "article", "main", "figure", "blockquote") or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
            self.put("\n\n")

    def words(self, data):
        if not self.hidden:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        done, fenced = [], False
        for line in "".join(self.out).split("\n"):
            if line.strip() == "```":
                fenced = not fenced
            done.append(line if fenced else line.rstrip() if re.match(r" +(?:-|\d+\.) ", line) else line.strip())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(done)).strip()


def clean_html_text(html: str) -> str:
    """The document without noise elements."""
    w = _Cleaner()
    w.feed(html)
    w.close()
    return "".join(w.out)


def markdown_text(html: str, clean: bool = False) -> str:
    """The document as Markdown."""
    w = _Markdown(clean)
    w.feed(html)
    w.close()
    return w.text()


def _udf(f: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run


def clean_html(html: Column) -> Column:
    """Markup without scripts, styles, navigation and other elements that never are content; null stays null."""
    return _udf(clean_html_text)(html)


def html_to_markdown(html: Column) -> Column:
    """Markdown of the markup; line breaks are kept."""
    return _udf(markdown_text)(html)


def extract(html: Column, fmt: str, collapse: bool = False) -> Column:
    """Content in a format: html as captured, text stripped of cleaned markup, markdown of cleaned markup.

    ``collapse`` puts markdown on one line, without navigation tails and trackers.
    """
    if fmt == "html":
        return html
    if fmt == "text":
        return text.strip_html(clean_html(html))
    md = _udf(lambda h: markdown_text(h, True))(html)
    return text.remove_page_noise(md) if collapse else text.drop_trackers(text.cut_navigation(md))


def unescape(s: Column) -> Column:
    """The common character references resolved; the ampersand last."""
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(ref), F.lit(ch))
    return s


def extract_title(html: Column) -> Column:
    """Text of the first title element; null if missing or empty."""
    t = F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(t != "", t)


def _attribute(tag: Column, name: str) -> Column:
    v = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.when(F.trim(v) != "", F.trim(unescape(v)))


def meta_tags(html: Column) -> Column:
    """All meta elements of the markup."""
    return F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)


def meta_content(html: Column, attr: str, name: str) -> Column:
    """Content of the first meta element with this name; null if missing or empty."""
    tag = F.get(F.filter(meta_tags(html), lambda t: F.lower(_attribute(t, attr)) == name), F.lit(0))
    return _attribute(tag, "content")


def metadata(html: Column) -> Column:
    """Struct of title, description, canonical and og_image."""
    canonical = F.get(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), 1), lambda t: F.lower(_attribute(t, "rel")) == "canonical"), F.lit(0))
    return F.struct(
        extract_title(html).alias("title"),
        meta_content(html, "name", "description").alias("description"),
        _attribute(canonical, "href").alias("canonical"),
        meta_content(html, "property", "og:image").alias("og_image"),
    )


def structured_meta(html: Column) -> Column:
    """JSON of the page's valid JSON-LD blocks and its Open Graph properties."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    valid = F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())
    tags = F.filter(meta_tags(html), lambda t: F.coalesce(_attribute(t, "property").startswith("og:"), F.lit(False)))
    pairs = F.transform(tags, lambda t: F.struct(_attribute(t, "property").alias("k"), F.coalesce(_attribute(t, "content"), F.lit("")).alias("v")))
    # the pairs and then their keys are bound to lambda variables, so that each is computed once
    of_key = lambda ps, k: F.element_at(F.transform(F.filter(ps, lambda p: p["k"] == k), lambda p: p["v"]), -1)
    bound = F.transform(F.array(pairs), lambda ps: F.struct(ps.alias("ps"), F.array_distinct(F.transform(ps, lambda p: p["k"])).alias("keys")))
    graph = F.transform(bound, lambda b: F.map_from_arrays(b["keys"], F.transform(b["keys"], lambda k: of_key(b["ps"], k)))).getItem(0)
    return F.concat(F.lit('{"json_ld":['), F.array_join(valid, ","), F.lit('],"open_graph":'), F.to_json(graph), F.lit("}"))


def link_hrefs(html: Column) -> Column:
    """href of every anchor in document order, repeated ones kept; anchors inside scripts and comments do not count."""
    visible = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<!--.*?-->", "")
    return F.transform(
        F.regexp_extract_all(visible, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), 1), lambda h: unescape(F.regexp_replace(h, "^[\"']|[\"']$", ""))
    )
