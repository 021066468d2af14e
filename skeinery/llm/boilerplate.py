"""Main content of web pages by minimum-cut labelling of their lines.

A linear classifier gives each line the costs of being content or boilerplate; they become
terminal capacities of a graph whose other edges join neighbouring lines, the items
of a list and a caption with its list. A minimum cut separates content from boilerplate.

The classifier is trained without labels given by hand: lines that recur in the same words on pages about
different things are boilerplate, unique prose is content. ``train_model`` takes pages in memory, ``line_training.train`` whole tables.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm.linear import Features, fit
from skeinery.llm.maxflow import minimum_cut

#: A word on at least so many hosts is common vocabulary; others are names.
COMMON_HOSTS = 4

#: Pages on which a line must recur to be taken as boilerplate in training.
RECUR = 3

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ENTITY = {"&gt;": ">", "&lt;": "<", "&amp;": "&", "&quot;": '"', "&nbsp;": " ", "&#39;": "'"}
_MARKER = re.compile(r"(?:(#{1,6})|([-*+•‣◦·–])|(\d{1,3}[.)])|(>))\s+")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[©|·›>»/:?!&→…]")
_ASCII_TOKEN = re.compile(r"[a-z]+|[0-9]+|[|>/:?!&]")  # the same in lower-case ASCII, where it is faster
# ASCII in lower case with spaces for what is in no token; zero for what is in one but no letter
_PLAIN = bytes(ord(c.lower()) if c.isalpha() else 0 if c.isdigit() or c in "|>/:?!&" else 32 for c in map(chr, range(128))) + bytes(128)
#: Marks of an unfilled template field.
PLACEHOLDER = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[$#]\{[^}]*\}|%%\w+%%|@@\w+@@|__[A-Z][A-Z_]+__|\[\[\w+\]\]|\{\w*\}|\[[A-Z][A-Z_ ]+\]|%\(\w+\)s|\b[A-Z]+(?:_[A-Z]+)+\b|\[(?i:insert|your)\b[^\]]{0,80}\]|\bTODO:")
_SENTENCE_END = re.compile(r"[.!?。！？।…:]['\"”’»)\]“]*(?:\s|\Z)")
_SUFFIX = re.compile(r"\s+[|·–—-]\s+[^|·–—]+$")
_TRAIL = re.compile(r" [>›»→/] ")


def tokens_of(text: str) -> list[str]:
    """The tokens of a text in lower case."""
    if not text.isascii():
        return _TOKEN.findall(text.lower())
    plain = text.encode().translate(_PLAIN)
    return _ASCII_TOKEN.findall(text.lower()) if 0 in plain else plain.decode().split()


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower().rpartition("@")[2].partition(":")[0]


def site_name(host: str) -> str:
    """The label of a host that names the site."""
    labels = [x for x in host.split(".") if x]
    return labels[-2] if len(labels) > 1 else (labels[0] if labels else "")


@dataclass(slots=True)
class Line:
    no: int
    text: str  # without tags and markers
    marker: str  # "", "h", "l", "n", "q", "t", "f", "c"
    words: list[str]
    link: int  # 0 none, 1 the whole line, 2 part
    blank_before: bool
    ids: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    own: bool = False
    foreign: bool = False
    site: bool = False
    title: bool = False
    twin: bool = False
    ends: int = 0

    @property
    def tokens(self) -> list[str]:
        """The line's words, names and numbers replaced by their kinds."""
        return [self.names[i] for i in self.ids]


def _parse(s: str) -> tuple[str, str, list[str], int, int]:
    """(text, marker, words, link, sentence ends) of a stripped line outside code."""
    marker, link = "", 0
    head = s[0]
    if head == "<" and ("</" in s or s[-1] == ">"):
        opened = s[1:3].lower()
        if len(opened) == 2 and opened[0] == "h" and opened[1].isdigit():
            marker = "h"
        elif s.startswith(("<pre", "<code")):
            marker = "c"
        elif s.startswith("<blockquote"):
            marker = "q"
        elif s.startswith(("<tr", "<td", "<th", "<table")):
            marker = "t"
        bare = _TAG.sub(" ", s).strip()
        if bare:
            s = bare
    if "&" in s:
        for a, b in _ENTITY.items():
            s = s.replace(a, b)
    if not s[0].isalpha():
        m = _MARKER.match(s)
        if m:
            marker = "h" if m.group(1) else "l" if m.group(2) else "n" if m.group(3) else "q"
            s = s[m.end() :].strip()
        elif s[0] == "|" and s[-1] == "|" and len(s) > 1:
            marker = "t"
    if "](" in s:
        link = 1 if _LINK.fullmatch(s) else 2
        s = _LINK.sub(r"\1", s)
    return s, marker, tokens_of(s), link, len(_SENTENCE_END.findall(s))


def _key(text: str) -> str:
    return " ".join(_TOKEN.findall(text.lower()))


# Kinds that stand for words outside the vocabulary, and a line's ends; their numbers are their places.
KINDS = ("<own>", "<site>", "<new>", "<name>", "<n>", "^", "$")
_OWN, _SITE, _NEW, _NAME, _N, _BEGIN, _END = range(7)
_PUNCTUATION = tuple("©|·›>»/:?!&→…")


class Reader:
    """Reads pages into described lines, given the common vocabulary.

    Words outside it are names: ``<own>`` for the page's subject, ``<site>`` for its site, ``<new>`` for
    one that stands on this line only, ``<name>`` for others; numbers are ``<n>``.
    """

    def __init__(self, common: set[str]):
        self.common = common
        self.names = [*KINDS, *_PUNCTUATION, *sorted(common)]
        self.ids = {w: i for i, w in enumerate(self.names)}
        self._short = lru_cache(1 << 16)(self._numbered)

    def _number(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The words' numbers, and the places of those to be told from the page."""
        ids, rare = list(map(self.ids.get, words)), []
        if None in ids:
            for i, n in enumerate(ids):
                if n is None:
                    if words[i][0].isalpha():
                        rare.append(i)
                    else:
                        ids[i] = _N
        return ids, rare

    def _numbered(self, s: str) -> tuple:
        """Of a line outside code, what does not depend on its page."""
        t, marker, words, link, ends = _parse(s)
        return t, marker, words, link, ends, *self._number(words), " ".join(words) if len(words) < 30 else t

    def _read(self, content: str) -> tuple[list[Line], list[list[int]], list[str]]:
        """The non-blank lines of a page with their kind of mark-up, the places of their rare words, and what makes lines twins."""
        lines, rare, keys = [], [], []
        fenced = blank = False
        short, numbered, names = self._short, self._numbered, self.names
        for no, raw in enumerate(content.split("\n")):
            s = raw.strip()
            if not s:
                blank = True
                continue
            if s.startswith(("```", "~~~")):
                t, marker, words, link, ends, ids, places, key = s, "f", [], 0, 0, [], (), ""
                fenced = not fenced
            elif fenced:
                t, marker, words, link, ends = s, "c", tokens_of(s), 0, 0
                (ids, places), key = self._number(words), " ".join(words) if len(words) < 30 else s
            else:
                t, marker, words, link, ends, ids, places, key = short(s) if len(s) < 100 else numbered(s)
            lines.append(Line(no, t, marker, words, link, blank, ids, names, False, False, False, False, False, ends))
            rare.append(places)
            keys.append(key)
            blank = False
        return lines, rare, keys

    def describe(self, content: str, title: str | None, url: str | None) -> list[Line]:
        lines, places, keys = self._read(content)
        site = site_name(host_of(url))
        common = self.common
        # the few words outside the vocabulary, with their lines
        prose: dict[str, int] = {}
        spread: dict[str, int] = {}  # lines that have the name
        for x, at in zip(lines, places):
            if at:
                told = x.ends and len(x.words) > 7 or x.marker == "h" or x.marker == "c"
                words = x.words
                for w in dict.fromkeys([words[i] for i in at]) if len(at) > 1 else (words[at[0]],):
                    spread[w] = spread.get(w, 0) + 1
                    if told:
                        prose[w] = prose.get(w, 0) + 1
        prose.pop(site, None)
        subject = {w for w in _TOKEN.findall((title or "").lower()) if w not in common and w[0].isalpha() and w != site}
        top = max(prose, key=prose.__getitem__, default=None)
        own = {w for w in subject if w in prose} or ({top} if top and prose[top] > 1 else set()) or subject
        for x, at in zip(lines, places):
            if at:
                words, ids = x.words, x.ids.copy()  # those of short lines are shared
                for i in at:
                    w = words[i]
                    if w == site:
                        ids[i] = _SITE
                        x.site = True
                    elif w in own:
                        ids[i] = _OWN
                        x.own = True
                    elif spread[w] < 2 or w not in prose:
                        ids[i] = _NEW
                        x.foreign = True
                    else:
                        ids[i] = _NAME
                x.ids = ids
        if site and site in common:
            for x in lines:
                if site in x.words:
                    x.site = True
                    x.ids = [_SITE if w == site else i for w, i in zip(x.words, x.ids)]
        if len(set(keys)) < len(keys):
            heads = Counter(keys)
            for x, key in zip(lines, keys):
                x.twin = heads[key] > 1 and bool(key)
        wanted = {_key(title), _key(_SUFFIX.sub("", title))} - {""} if title else ()
        if wanted:
            for x, key in zip(lines, keys):
                if len(x.words) < 30:
                    x.title = key in wanted or x.site and x.marker in ("", "h") and _key(_SUFFIX.sub("", x.text)) in wanted
        return lines


def structure(lines: list[Line]) -> list[tuple]:
    """What every line of a page is beside its words."""
    n = len(lines)
    body = [i for i, x in enumerate(lines) if x.ends and len(x.words) > 11 and not x.site and not x.foreign]
    first, last = (body[0], body[-1]) if body else (n, -1)
    out = []
    for i, x in enumerate(lines):
        k = len(x.words)
        size = 0 if k == 0 else 1 if k == 1 else 2 if k <= 3 else 3 if k <= 6 else 4 if k <= 11 else 5 if k <= 24 else 6
        place = "in" if first <= i <= last else "before" if i < first else "after"
        trail = x.ends == 0 and k < 12 and _TRAIL.search(x.text) is not None
        out.append((size, x.marker, place, x.own, x.foreign, x.site, min(x.ends, 3), x.link, x.title, x.twin, i < 3, n - i <= 4, trail))
    return out


def structure_names(key: tuple) -> list[str]:
    """Feature names of a line's structure."""
    size, marker, place, own, foreign, site, ends, link, title, twin, top, bottom, trail = key
    who = ("o" if own else "") + ("f" if foreign else "") + ("s" if site else "")
    end = "e" if ends else ""
    names = ["bias", f"w{size}{end}", "m" + marker, "p" + place, "who" + who, f"k{marker}{size}{end}{who}", f"ends{ends}"]
    if link:
        names.append(f"link{link}{who}")
    names += [x for x, on in (("title", title), ("twin" + marker, twin), ("top", top), ("bottom", bottom), ("trail", trail)) if on]
    return names


def word_names(tokens: list[str]) -> list[str]:
    """Feature names of a line's words."""
    names, prev = [], "^"
    for t in tokens:
        names.append("u " + t)
        names.append("b " + prev + " " + t)
        prev = t
    names.append("b " + prev + " $")
    return names


def _labels(pages: list[tuple[str, list[Line]]]) -> list[list[float]]:
    """Weak labels per line: 1 boilerplate, 0 content, nan none; no line of a page without prose has one."""
    with_prose = [_has_prose(lines) for _, lines in pages]
    seen: dict[str, dict[str, set]] = defaultdict(lambda: defaultdict(set))
    lead: dict[str, set] = defaultdict(set)  # common word and colon at a line's start, by host
    for (host, lines), good in zip(pages, with_prose):
        if not good:
            continue
        topic = _topic(lines)
        for x in lines:
            if x.tokens and not x.own:
                seen[" ".join(x.tokens)][host].add(topic)
            if len(x.tokens) > 2 and x.tokens[1] == ":" and x.tokens[0][0] != "<":
                lead[x.tokens[0]].add(host)
    out = []
    for (host, lines), good in zip(pages, with_prose):
        got = []
        for x in lines:
            hosts = seen.get(" ".join(x.tokens), {})
            again = not x.own and (len(hosts.get(host, ())) >= RECUR or (len(hosts) >= RECUR and sum(map(len, hosts.values())) >= 2 * RECUR))
            led = len(x.tokens) > 2 and x.tokens[1] == ":" and len(lead.get(x.tokens[0], ())) >= RECUR
            got.append(_label(x, again or led, _is_trail(x)) if good else np.nan)
        out.append(got)
    return out


def _has_prose(lines: list[Line]) -> bool:
    return any(x.ends and len(x.words) > 11 and x.own for x in lines)


def _topic(lines: list[Line]) -> str:
    """What a page is about: its title line, or else its first words."""
    return next((" ".join(x.words) for x in lines if x.title), None) or " ".join(w for x in lines for w in x.words)[:200]


def _is_trail(x: Line) -> bool:
    return not x.ends and len(x.words) < 12 and _TRAIL.search(x.text) is not None


def _label(x: Line, again: bool, trail: bool) -> float:
    """Weak label of a line of a page with prose; ``again`` if its words, or its first word and colon, recur."""
    k = len(x.words)
    if x.marker in ("f", "c"):
        return 0.0
    if x.marker == "t" and (x.own or not any(t[0].isalpha() for t in x.words)):
        return 0.0
    if x.title or (x.marker == "h" and not trail):
        return 0.0
    if again or x.site or trail:
        return 1.0
    if x.twin and x.marker in ("l", "n"):
        return 1.0
    if x.foreign and not x.own and (k <= 20 or x.tokens[0][0] == "<"):
        return 1.0
    if x.ends and k > 11 and not x.foreign:
        return 0.0
    if x.own and (x.marker in ("l", "n", "q") or (not x.ends and k <= 11)):
        return 0.0
    return np.nan


@dataclass
class Model:
    """Common vocabulary and feature weights by name; of bounded size."""

    common: set[str]
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.reader = Reader(self.common)
        size, ids = len(self.reader.names), self.reader.ids
        self.double = {tuple(n[2:].split(" ")) for n in self.weights if n.startswith("b ")}
        self.single = np.zeros(size)
        pairs: dict[int, float] = {}
        for n, w in self.weights.items():
            if n.startswith("u "):
                self.single[ids[n[2:]]] = w
        for n, w in self.weights.items():
            if n.startswith("b ") and n != "b ^ $":
                a, b = (ids[t] for t in n[2:].split(" "))
                pairs[a * size + b] = w + self.single[b]
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_weights = np.array([pairs.get(k, 0.0) for k in self.pair_keys.tolist()])
        self.shapes: dict[tuple, float] = {}

    def __getstate__(self):
        return self.common, self.weights

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def odds(self, lines: list[Line]) -> list[float]:
        """Log odds of boilerplate of every line of a page."""
        return self.odds_of([lines])[0]

    def odds_of(self, pages: list[list[Line]]) -> list[list[float]]:
        """The same for several pages, scored together."""
        lines = [x for page in pages for x in page]
        if not lines:
            return [[] for _ in pages]
        shapes = self.shapes
        out = []
        for page in pages:
            for key in structure(page):
                z = shapes.get(key)
                if z is None:
                    z = shapes[key] = sum(self.weights.get(n, 0.0) for n in structure_names(key))
                out.append(z)
        # pairs of neighbouring words of all lines at once, each line between its two ends
        lengths = np.fromiter((len(x.ids) for x in lines), np.int64, len(lines))
        tokens = np.fromiter(chain.from_iterable([x.ids for x in lines]), np.int64, int(lengths.sum()))
        starts = np.cumsum(lengths + 1) - lengths - 1
        place = np.arange(len(tokens)) + np.repeat(np.arange(len(lines)), lengths)
        left = np.full(len(tokens) + len(lines), _BEGIN, np.int64)
        right = np.full(len(tokens) + len(lines), _END, np.int64)
        right[place] = tokens
        left[place + 1] = tokens
        left[starts] = _BEGIN
        keys = left * len(self.reader.names) + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        w = np.where(self.pair_keys[at] == keys, self.pair_weights[at], self.single[right])
        sums = iter((np.array(out) + np.add.reduceat(w, starts)).tolist())
        return [list(islice(sums, len(page))) for page in pages]

    def novelty(self, x: Line) -> float:
        """How little of a line's wording the model knows: the share of unknown pairs of common words; 0 if there are too few."""
        known = total = 0
        tokens = x.tokens
        first = tokens[:3]
        if len(first) > 1 and first[1] == ":" and ("^", first[0]) in self.double:
            return 0.0  # a known label
        if len(first) == 3 and "<" not in {t[0] for t in first} and all(q in self.double for q in zip(("^", *first), first)):
            return 0.0  # begins like boilerplate
        raw = _TOKEN.findall(x.text) if x.foreign else ()
        if first[:2] == ["<new>", "<new>"] and len(raw) == len(tokens) and raw[0].istitle() and raw[1].istitle():
            return 0.0  # begins with a person's name
        prev = "^"
        for i, t in enumerate((*tokens, "$")):
            if t[0] == "<" or prev[0] == "<":
                # a small-lettered word outside the vocabulary is as good as an unknown pair
                if t == "<new>" and len(raw) == len(tokens) and not raw[i].istitle() and not raw[i].isupper():
                    total += 3 if raw[i].lower() == raw[i].upper() else 1
            else:
                total += 1
                known += (prev, t) in self.double
            prev = t
        return 1 - known / total if total > 2 else 0.0

    def label(self, content: str, title: str | None, url: str | None) -> tuple[list[Line], list[bool]]:
        """The page's non-blank lines and whether each is main content."""
        return next(self.label_all([(content, title, url)]))

    def label_all(self, pages: Iterable[tuple[str, str | None, str | None]], together: int = 64) -> Iterator[tuple[list[Line], list[bool]]]:
        """Lines and labels of many pages in order, ``together`` of them scored at once."""
        pages = iter(pages)
        while part := [self.reader.describe(*p) for p in islice(pages, together)]:
            for lines, odds in zip(part, self.odds_of(part)):
                yield lines, self.cut(lines, odds)

    def cut(self, lines: list[Line], odds: list[float]) -> list[bool]:
        """The minimum-cut labelling of a page whose lines have these odds of boilerplate."""
        gain = [6.0 if z < -6.0 else -6.0 if z > 6.0 else -z for z in odds]
        head = next((i for i, x in enumerate(lines) if x.title and x.marker in ("", "h")), None)
        if head is not None:
            gain[head] = 6.0
        # wording that no boilerplate of the training has stands where the article should be: errors, fillers, placeholders
        prose = any(g > 0 and x.ends and len(x.words) > 7 for g, x in zip(gain, lines))
        for i, x in enumerate(lines):
            if gain[i] > 0 or x.marker in ("l", "n") or x.link:
                continue
            if PLACEHOLDER.search(x.text) or not _TRAIL.search(x.text) and not x.site and self.novelty(x) >= (0.6 if prose else 0.45):
                gain[i] = 3.0
        return minimum_cut(gain, smoothness(lines))


def smoothness(lines: list[Line]) -> list[tuple[int, int, float]]:
    """Edges between lines that belong together: neighbours, list items, captions, code blocks."""
    edges = []
    for i in range(1, len(lines)):
        a, b = lines[i - 1], lines[i]
        item_a, item_b = a.marker in ("l", "n"), b.marker in ("l", "n")
        if a.marker in ("f", "c") and b.marker in ("f", "c"):
            c = 4.0
        elif a.marker == "t" and b.marker == "t":
            c = 4.0
        elif item_a and item_b and not b.blank_before and a.own == b.own:
            c = 2.5 if a.foreign == b.foreign else 1.0
        elif item_b and not item_a and not b.blank_before and not a.ends and len(a.words) < 8 and not a.title and a.marker != "h":
            c = 2.5  # a caption and its list
        elif b.blank_before:
            c = 0.25
        else:
            c = 0.4
        edges.append((i - 1, i, c))
        if i > 1 and item_b and lines[i - 2].marker in ("l", "n") and item_a and not b.blank_before and not a.blank_before:
            edges.append((i - 2, i, 1.0))
    return edges


def train_model(pages: list[tuple[str | None, str | None, str | None]]) -> Model:
    """A model from (content, title, url) held in memory."""
    hosts: dict[str, set[str]] = defaultdict(set)
    pages = [(c, t, u) for c, t, u in pages if c]
    for content, _, url in pages:
        h = host_of(url)
        for w in set(_TOKEN.findall(content.lower())):
            if w[0].isalpha() and len(hosts[w]) < COMMON_HOSTS:
                hosts[w].add(h)
    enough = min(COMMON_HOSTS, max(1, len({host_of(u) for _, _, u in pages})))
    common = {w for w, s in hosts.items() if len(s) >= enough}
    reader = Reader(common)
    f = Features()
    described = [(host_of(u), reader.describe(c, t, u)) for c, t, u in pages]
    rows, labels = [], []
    for (_, lines), ys in zip(described, _labels(described)):
        for x, key, y in zip(lines, structure(lines), ys):
            if y == y:
                rows.append([f[n] for n in structure_names(key)] + [f[n] for n in word_names(x.tokens)])
                labels.append(y)
    w = fit(rows, labels)
    return Model(common, {n: round(float(w[i]), 4) for n, i in f.known.items() if abs(w[i]) > 0.01})


def main_lines(pages: DataFrame, id_col: str, model: Model, spark_model=None) -> DataFrame:
    """id, line_no, main of every non-blank line of every page.

    Null and blank contents have no lines; redelivered rows repeat their lines; titles and urls may be null; contents are
    read whole; further columns are ignored.
    """
    shared = spark_model or pages.sparkSession.sparkContext.broadcast(model)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            ids, nos, mains = [], [], []
            for key, (lines, main) in zip(pdf[id_col], m.label_all(zip(pdf["content"], pdf["title"], pdf["url"]))):
                ids += [key] * len(lines)
                nos += [x.no for x in lines]
                mains += main
            yield pd.DataFrame({id_col: ids, "line_no": nos, "main": mains})

    rows = pages.where(F.col("content").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "content", "title", "url")
    return rows.mapInPandas(run, f"`{id_col}` {kind}, line_no int, main boolean")


def main_text(pages: DataFrame, id_col: str, model: Model) -> DataFrame:
    """id, content: the main lines of every page in order, one row per id; empty where none is left."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = []
            contents = ["" if c is None else c for c in pdf["content"]]
            for content, (lines, main) in zip(contents, m.label_all(zip(contents, pdf["title"], pdf["url"]))):
                raw = content.split("\n")
                texts.append("\n".join(raw[x.no] for x, keep in zip(lines, main) if keep))
            yield pd.DataFrame({id_col: pdf[id_col], "content": texts})

    rows = pages.where(F.col(id_col).isNotNull()).select(id_col, "content", "title", "url").dropDuplicates([id_col])
    return rows.mapInPandas(run, f"`{id_col}` {kind}, content string")
