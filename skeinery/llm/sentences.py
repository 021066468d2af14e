"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model.

Between the words of a paragraph stand hidden events: boundary or none. The model is an n-gram model of words and
boundary tokens, with back-off: the probability of a boundary after a word and its mark, of a word after a boundary,
and of a word after another without one. Sentence lengths make the probability of a boundary depend on where
the last one was, so a forward-backward pass over the paragraph gives the posteriors that decide.

The counts come from all documents without labels: paragraph ends are sure boundaries and show which words
end sentences, paragraph starts show which words begin them, and a mark followed by a small letter
is surely none. Words before full stops are plain words or abbreviations, before names or within a sentence; a mixture of these
types fitted to the counts of every word tells them apart.

Candidates are final marks with what closes after them. A paragraph without marks has candidates between all its words
(at its spaces, in scripts that need none). Blank lines, heading lines and list items delimit units for certain; no
boundary lies inside brackets or quotations. In scripts of South-East Asia a space is a boundary unless digits, Latin letters or a repeat mark stand beside it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import stage

#: Of each kind of n-gram the model keeps those with more than this share of all counts, at most 2^20; the others are left to back-off.
LEAST_SHARE = 2.0**-20

#: A boundary needs at least this posterior.
POSTERIOR = 0.5

#: Words that a paragraph without marks needs to have candidates between them.
UNMARKED_WORDS = 12

#: Distances from the last boundary are counted in steps of so many characters, up to so many steps.
STEP, FAR = 6, 64

# Marks that may end a sentence, closing and opening signs, and pairs.
FULL = "。！？।॥؟۔｡．։።།༎។៕။"
ELLIPSIS = "…"
CLOSE = "\"'”’»›」』）)]】〉》“"
OPEN = "\"'“‘„«‹「『（([【〈《¿¡"
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "«": "»", "„": "“", "“": "”", "《": "》"}

_MARK = regex.compile(rf"(?:[.!?{FULL}{ELLIPSIS}]+)(?:\s?»|[{regex.escape(CLOSE)}])*")
_HEADING = regex.compile(r"\s*#{1,6}\s+\S")
_ITEM = regex.compile(r"\s*(?:[-*+•‣◦·–—]|\p{Nd}{1,3}[.)]|[a-z]\))\s+\S")
_NUMBERED = regex.compile(r"\s*\p{Nd}")
_ENDS = regex.compile(rf"[.!?{FULL}{ELLIPSIS}:][{regex.escape(CLOSE)}]*\s*\Z")
_LEFT = regex.compile(r"(?r)[\p{L}\p{M}\p{N}’'.\-]*")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
_HAN = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
_HAN_GAP = regex.compile(rf"(?<={_HAN})[^\S\n]+(?={_HAN})")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])[^\S\n]+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
_MID = regex.compile(r"(?<=[\p{Ll},] )\p{Lu}[\p{L}\p{M}]*")
_SIGNS = regex.compile(r"[(（\[【「『«„“《)）\]】」』»”》\"]")
_REPEAT_MARK = "ๆ"

#: Kinds of counts. By word before a full stop: at a paragraph's end, before a small letter or digit, at an open place. By word:
#: at a paragraph's start, as a capital within a sentence. By class of mark: sure boundaries and none. Lengths of paragraphs of one
#: sentence. By token: all, last ones, first ones; pairs of tokens in a row.
ENDS, NONE, OPEN_PLACE, STARTS, WITHIN, MARK_ENDS, MARK_NONE, LENGTHS, TOKENS, LAST, FIRST, PAIRS_OF = range(12)

#: Classes of marks, and the log odds that stand for them before any counts.
STOP, CALL, FULL_MARK, OTHER, GAP, HAN_SPACE = range(6)
MARK_PRIOR = (0.0, 4.0, 6.0, 1.5, 0.0, 2.0)

#: Codes of what follows a place.
CASES = "Uldc-t"

PLACE = np.dtype([("para", "i4"), ("at", "i4"), ("left", "u8"), ("right", "u8"), ("case", "u1"), ("mark", "u1"), ("size", "u1"), ("space", "u1"), ("closed", "u1"), ("sure", "i1")])
PARA = np.dtype([("start", "i4"), ("end", "i4"), ("whole", "u1"), ("mark", "u1"), ("left", "u8"), ("right", "u8"), ("case", "u1")])
_U64 = np.uint64


def word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


@dataclass(slots=True)
class Place:
    """A candidate: where the next unit would start, and the evidence."""

    at: int
    end: int
    mark: str
    left: str
    right: str
    case: str  # of what follows: U, l, d(igit), c(aseless), o(ther), - (nothing)
    space: bool
    closed: bool  # closing signs follow the mark
    sure: int | None  # 1 or 0 if structure decides


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the paragraphs, headings and list items; ``whole`` units are not split.

    A numbered line in the middle of a running sentence is no list item.
    """
    at, start, end, whole, open_line = 0, -1, -1, False, ""
    for line in text.split("\n"):
        stop = at + len(line)
        blank = not line.strip()
        heading = not blank and _HEADING.match(line) is not None
        item = not blank and not heading and _ITEM.match(line) is not None
        if item and start >= 0 and not whole and _NUMBERED.match(line) and not _ENDS.search(open_line):
            item = False
        if start >= 0 and (blank or heading or item):
            yield start, end, whole
            start = -1
        if heading:
            yield at, stop, True
        elif not blank:
            if start < 0:
                start, whole = at, item
            end, open_line = stop, line
        at = stop + 1
    if start >= 0:
        yield start, end, whole


def _spans(p: str) -> list[tuple[int, int]]:
    """Outermost bracketed and quoted stretches (positions of both signs) of a paragraph."""
    out, stack = [], []
    for m in _SIGNS.finditer(p):
        i, ch = m.start(), m.group()
        if stack and ch == stack[-1][1]:
            begin, _ = stack.pop()
            if not stack:
                out.append((begin, i))
        elif ch == '"':
            before = p[i - 1] if i else " "
            if before.isspace() or before in OPEN:
                stack.append((i, '"'))
        elif ch in PAIRS:
            if not (ch == "“" and stack and stack[-1][1] == "“"):
                stack.append((i, PAIRS[ch]))
        elif any(ch == s[1] for s in stack):
            while stack[-1][1] != ch:
                stack.pop()
            begin, _ = stack.pop()
            if not stack:
                out.append((begin, i))
    return out


def _case(p: str, i: int) -> tuple[str, str]:
    """Kind and first word of what follows at ``i``, opening signs skipped."""
    n = len(p)
    while i < n and not p[i].isalnum():  # opening signs, symbols, format characters
        i += 1
    if i >= n:
        return "-", ""
    ch = p[i]
    m = _WORD.match(p, i)
    word = m.group() if m else ""
    if ch.isupper() or ch.istitle():
        return "U", word
    if ch.islower():
        return "l", word
    if ch.isdigit():
        return "d", word
    return "c", word


def places(p: str) -> list[Place]:
    """The candidates of a paragraph, in order."""
    spans = _spans(p)
    out: list[Place] = []
    k, n = 0, len(p)
    last_end = 0  # end of the text that surely or possibly closed the previous sentence
    for m in _MARK.finditer(p):
        a, b = m.span()
        mark = m.group().rstrip(CLOSE + "  ")
        while k < len(spans) and spans[k][1] < a:
            k += 1
        span = spans[k] if k < len(spans) and spans[k][0] < a else None
        if span:
            # a closing sign within the match ends the stretch; further inside there is no boundary
            if span[1] >= b:
                continue
        elif k < len(spans) and a < spans[k][0] < b:
            b = spans[k][0]  # the sign opens the next quotation
        nxt = b
        while nxt < n and p[nxt].isspace():
            nxt += 1
        if nxt >= n:
            continue
        space = nxt > b
        case, right = _case(p, nxt)
        full = any(c in FULL for c in mark)
        left = _LEFT.search(p, 0, a).group().strip(".'’")
        sure: int | None = None
        if not space and not full:
            # no space: only a mark glued between a word and a capital may end a sentence
            glued = case == "U" and len(left) > 1 and left[-1].islower() and mark in (".", "!", "?") and p[nxt].isupper()
            if not glued and not (b > a + len(mark) and case == "U"):
                continue
        if p[nxt] in ",;:，、；：،؛)）]】」』»”–—-/" and not p[nxt:].startswith(("- ", "– ", "— ")):
            sure = 0
        elif span:
            alone = not p[last_end : span[0]].strip() or (out and out[-1].at == span[0] and out[-1].sure != 0)
            if p[span[0]] in "(（[【":
                sure = 1 if alone else (0 if case == "c" else None)
            elif case == "d":
                sure = 0
            elif case == "c":
                particle = p[nxt] in "とってのはがを" if full else False
                sure = 0 if not alone or particle else None
        if mark and mark.strip(ELLIPSIS) == "" and (case == "c" or not space):
            sure = 0
        out.append(Place(nxt, a, mark, left, right, case, space, b > a + len(mark), sure))
    for m in _THAI_GAP.finditer(p):
        a, b = m.span()
        inside = any(s < a < e for s, e in spans)
        beside = p[a - 1] == _REPEAT_MARK or p[b] == _REPEAT_MARK or p[a - 1].isdigit() or p[b].isdigit()
        out.append(Place(b, a, " ", "", "", "t", True, False, 0 if inside or beside else None))
    out.sort(key=lambda x: x.at)
    return out


def _left_key(left: str) -> str:
    if left and left[-1].isdigit():
        return "<number>"
    if len(left) == 1 and left.isupper():
        return "<initial>"
    return left.lower()


def _size(key: str) -> int:
    """Class of a word before a full stop: number, initial, or by length."""
    return 0 if key == "<number>" else 1 if key == "<initial>" else 2 if len(key) <= 2 else 3 if len(key) <= 4 else 4


def _class_of(mark: str) -> int:
    if any(c in FULL for c in mark):
        return FULL_MARK
    if mark == ".":
        return STOP
    return CALL if mark.strip("!?") == "" else OTHER


def gaps(p: str) -> Iterator[tuple[int, str, str, int]]:
    """(start of what follows, token before, token after, class) of the candidates of a paragraph without marks."""
    tokens = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(p)]
    spans = _spans(p)
    spaced = [(x, y) for x, y in zip(tokens, tokens[1:]) if p[x[1] : y[0]].isspace()]
    han = {m.end() for m in _HAN_GAP.finditer(p)}
    if len(spaced) + 1 < UNMARKED_WORDS:
        spaced = [(x, y) for x, y in spaced if y[0] in han]
    for x, y in spaced:
        if not any(a < y[0] <= b for a, b in spans):
            yield y[0], x[2], y[2], HAN_SPACE if y[0] in han else GAP


def parse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs of a text and their candidates, as far as the text alone shows them."""
    paras, found = [], []
    for start, end, whole in blocks(text or ""):
        if whole:
            paras.append((start, end, 1, OTHER, 0, 0, 4))
            continue
        p = text[start:end]
        bare = p.rstrip().rstrip(CLOSE)
        ends = _ENDS.search(bare)
        mark = (OTHER if bare.endswith("..") else _class_of(bare[-1])) if ends and bare[-1] != ":" else GAP
        left = _left_key(_LEFT.search(bare, 0, len(bare) - 1).group().strip(".'’")) if mark == STOP else ""
        case, right = _case(p, 0)
        n = len(paras)
        xs = places(p)
        for x in xs:
            key = _left_key(x.left)
            found.append((n, start + x.at, word_key(key), word_key(x.right), CASES.index(x.case), GAP if x.case == "t" else _class_of(x.mark), _size(key), x.space, x.closed, -1 if x.sure is None else x.sure))
        if not xs and not ends:
            for at, before, after, kind in gaps(p):
                found.append((n, start + at, word_key(before), word_key(after), 3, kind, 4, 1, 0, -1))
        paras.append((start, end, 0, mark, word_key(left) if left else 0, word_key(right), CASES.index(case)))
    return np.array(paras, PARA), np.array(found, PLACE)


def observe(texts: Iterable[str | None], parsed: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, counts) of some parsed documents."""
    parts: dict[int, list[np.ndarray]] = {}

    def add(kind: int, keys: np.ndarray) -> None:
        parts.setdefault(kind, []).append(np.asarray(keys, _U64))

    texts, parsed = list(texts), list(parsed)
    if not texts:
        return
    paras = np.concatenate([p for p, _ in parsed])
    found = np.concatenate([f for _, f in parsed])
    found["para"] += np.repeat(np.cumsum([0, *(len(p) for p, _ in parsed[:-1])]), [len(f) for _, f in parsed]).astype(np.int32)
    open_ = paras[paras["whole"] == 0]
    add(ENDS, open_["left"][open_["mark"] == STOP])
    add(STARTS, open_["right"][(open_["case"] < 2) & (open_["mark"] < GAP)])
    add(MARK_ENDS, open_["mark"][open_["mark"] < GAP])
    add(MARK_NONE, found["mark"][(found["case"] == 1) & (found["closed"] == 0)])
    stop = found["mark"] == STOP
    none = stop & ((found["case"] == 1) | (found["case"] == 2)) & (found["closed"] == 0)
    add(NONE, found["left"][none])
    add(OPEN_PLACE, found["left"][stop & ~none & (found["sure"] < 0)])
    alone = np.ones(len(paras), bool)
    alone[found["para"]] = False
    alone &= (paras["whole"] == 0) & (paras["mark"] < GAP)
    add(LENGTHS, np.minimum((paras["end"] - paras["start"])[alone] // STEP, FAR - 1))
    middles, words, owner = [], [], []
    for text, (own, _) in zip(texts, parsed):
        for start, end, whole in own[["start", "end", "whole"]].tolist():
            if not whole:
                p = text[start:end]
                middles += _MID.findall(p)
                tokens = _TOKEN.findall(p.lower())
                words += tokens
                owner.append(len(tokens))
    number, names = pd.factorize(np.array(middles, object))
    add(WITHIN, np.array([word_key(w) for w in names], _U64)[number])
    number, names = pd.factorize(np.array(words, object))
    keys = np.array([word_key(w) for w in names], _U64)[number]
    size = np.array([n for n in owner if n], np.int64)
    lasts = np.cumsum(size) - 1
    add(TOKENS, keys)
    add(LAST, keys[lasts])
    add(FIRST, keys[lasts - size + 1])
    inner = np.ones(len(keys), bool)
    inner[lasts] = False
    at = np.flatnonzero(inner)
    add(PAIRS_OF, pair_key(keys[at], keys[at + 1]))
    for kind, some in parts.items():
        yield kind, *np.unique(np.concatenate(some), return_counts=True)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * _U64(0x9E3779B97F4A7C15)) ^ right
    return (x ^ (x >> _U64(31))) * _U64(0xC2B2AE3D27D4EB4F)


class Table:
    """Counts by key, and their sum over all keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: float):
        order = np.argsort(keys)
        self.keys, self.counts, self.total = keys[order], counts[order].astype(np.float64), float(total)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


def tables(rows: Iterable[tuple[int, np.ndarray, np.ndarray, float]]) -> list[Table]:
    """The model's count tables from (kind, keys, counts, total)."""
    made = {kind: Table(keys, counts, total) for kind, keys, counts, total in rows}
    empty = Table(np.empty(0, _U64), np.empty(0), 0)
    return [made.get(k, empty) for k in range(12)]


class Model:
    """The hidden-event model from its count tables."""

    # before any counts: shares of (paragraph end, open place, small letter or digit) of the full stops after plain words, after abbreviations
    # before names and after those within a sentence; pseudo-counts of these; share of plain words among numbers, initials and words by length
    SHAPES, PSEUDO = ((0.2, 0.79, 0.01), (0.004, 0.986, 0.01), (0.01, 0.5, 0.49)), 200.0
    SHARE = (0.38, 0.38, 0.38, 0.8, 0.982)

    def __init__(self, counts: list[Table], events: bool = True):
        self.t = counts
        self.events = events
        self._types()
        ends, none = counts[MARK_ENDS].of(np.arange(6, dtype=_U64)), counts[MARK_NONE].of(np.arange(6, dtype=_U64))
        p = 1 / (1 + np.exp(-np.array(MARK_PRIOR)))
        # of the boundaries after plain words this share stands at the end of a paragraph
        self.mark = np.log((ends / self.shapes[0, 0] + 50 * p) / (none + 50 * (1 - p)))
        # a capital after a boundary against one within a sentence
        self.capital = float(np.log((counts[STARTS].total + 9) / (counts[FIRST].total + 10)) - np.log((counts[WITHIN].total + 1) / (counts[TOKENS].total + 20)))
        # log odds of a boundary between any two tokens
        self.every = self.mark[GAP] = float(np.log((counts[LAST].total + 1) / (counts[TOKENS].total + 19)))
        # length of sentences: how much likelier than on average a boundary is at a distance
        n = counts[LENGTHS].of(np.arange(FAR, dtype=_U64))
        left = n[::-1].cumsum()[::-1]
        mean = max(n.sum(), 1.0) / max((n * (np.arange(FAR) + 1)).sum(), 1.0)
        hazard = (n + 50 * mean) / (left + 50)
        odds = hazard / np.maximum(1 - hazard, 1e-3)
        self.length = np.clip(odds / (mean / max(1 - mean, 1e-3)), 0.15, 2.0) if n.sum() else np.ones(FAR)

    def _types(self) -> None:
        """Fit the types of words before full stops by expectation-maximization; the counts of every word are one draw."""
        keys = np.unique(np.concatenate([self.t[k].keys for k in (ENDS, OPEN_PLACE, NONE)]))
        keys = keys[~np.isin(keys, np.array([word_key("<number>"), word_key("<initial>")], _U64))]  # not words
        c = np.stack([self.t[k].of(keys) for k in (ENDS, OPEN_PLACE, NONE)], 1)
        start = np.array(self.SHAPES)
        self.shapes, share = start, np.array([0.6, 0.2, 0.2])
        for _ in range(10 if len(keys) else 0):
            like = c @ np.log(self.shapes).T + np.log(share)
            own = np.exp(like - like.max(1, keepdims=True))
            own /= own.sum(1, keepdims=True)
            share = (own.sum(0) + 20) / (len(keys) + 60)
            # every word counts alike beyond PSEUDO / 10 occurrences, so that a frequent one does not bend its type
            light = c * np.minimum(1, self.PSEUDO / 10 / np.maximum(c.sum(1, keepdims=True), 1))
            sums = own.T @ light
            self.shapes = (self.PSEUDO * start + sums) / (self.PSEUDO + sums.sum(1, keepdims=True))
        self.size_odds = np.log(np.array(self.SHARE) / (1 - np.array(self.SHARE)))

    def plain(self, left: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log odds of a plain word against either kind of abbreviation."""
        c = np.stack([self.t[k].of(left) for k in (ENDS, OPEN_PLACE, NONE)], 1)
        like = c @ np.log(self.shapes).T
        return self.size_odds[size] + like[:, 0] - np.logaddexp(like[:, 1], like[:, 2]) + np.log(2)

    def lift(self, right: np.ndarray) -> np.ndarray:
        """log P(word | boundary) / P(word | none), smoothed alike."""
        s, w = self.t[STARTS], self.t[WITHIN]
        return np.log((s.of(right) + 0.5) / (s.total + 250)) - np.log((w.of(right) + 0.5) / (w.total + 250))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a boundary at the places, from their words alone."""
        case = x["case"]
        base = self.mark[x["mark"]].copy()
        stop = x["mark"] == STOP
        base[stop] = np.clip(self.plain(x["left"][stop], x["size"][stop]), -8, 8) - np.where(x["space"][stop] > 0, 0.0, 1.0)
        other = x["mark"] == OTHER
        base[other] += np.where(case[other] == 0, self.capital, -0.5)
        worded = (case < 2) & (x["mark"] != FULL_MARK)
        right = np.zeros(len(x))
        right[worded] = 0.7 * np.clip(self.lift(x["right"][worded]), -2.5, 2.5)
        small = worded & (case == 1)  # a name in small letters may begin a sentence if it begins paragraphs
        right[small] += np.where(self.t[STARTS].of(x["right"][small]) < 3, -12.0, -0.5)
        right[(case == 2) & (x["mark"] != FULL_MARK)] -= 3.0
        out = base + right
        gap = (x["mark"] >= GAP) & (case != 5)
        if gap.any():
            out[gap] = base[gap] + self.between(x["left"][gap], x["right"][gap])
        out[case == 5] = 5.0
        out[x["sure"] == 1], out[x["sure"] == 0] = 30.0, -30.0
        return out

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log odds that the tokens add to those of any gap: P(boundary | left) P(right | boundary) / P(none | left) P(right | left), backing off to single tokens."""
        all_, last, first, pairs = self.t[TOKENS], self.t[LAST], self.t[FIRST], self.t[PAIRS_OF]
        one = (all_.of(right) + 0.5) / (all_.total + 500)
        n = all_.of(left)
        mean = 1 / (1 + np.exp(-self.every))
        event = (last.of(left) + 4 * mean) / (n + 4)
        event = np.minimum(event, 0.99)
        start = (first.of(right) + 20 * one) / (first.total + 20)
        follow = (pairs.of(pair_key(left, right)) + 20 * one) / (n + 20)
        return np.log(event / (1 - event)) - self.every + np.log(start / follow)

    def posteriors(self, paras: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Posterior of a boundary at every place, by forward-backward passes over all paragraphs at once.

        The state is the distance from the last boundary.
        """
        local = np.clip(self.odds(x), -30, 30)
        if not self.events or not len(x):
            return 1 / (1 + np.exp(-local))
        begin = paras["start"][x["para"]]
        new = np.ones(len(x), bool)
        new[1:] = x["para"][1:] != x["para"][:-1]
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(x)))
        prev = np.where(new, begin, np.concatenate([[0], x["at"][:-1]]))
        step = np.minimum((x["at"] - prev) // STEP, FAR - 1)
        closing = np.minimum((paras["end"][x["para"][starts]] - x["at"][starts + n - 1]) // STEP, FAR - 1)
        order = np.argsort(-n, kind="stable")
        starts, n, closing = starts[order], n[order], closing[order]
        weight = np.exp(local)
        ahead = np.zeros((len(starts), FAR))
        ahead[:, 0] = 1
        before = np.empty((len(x), FAR), np.float32) if len(x) <= 1 << 21 else None
        if before is None:
            half = int(np.searchsorted(x["para"], x["para"][len(x) // 2]))
            if 0 < half < len(x):
                return np.concatenate([self.posteriors(paras, x[:half]), self.posteriors(paras, x[half:])])
            before = np.empty((len(x), FAR), np.float32)
        cols = np.arange(FAR)
        for i in range(int(n[0])):
            m = int(np.searchsorted(-n, -i, "left"))  # paragraphs with more than i places
            at = starts[:m] + i
            here = self._shift(ahead[:m], step[at])
            before[at] = here
            event = (here * self.length).sum(1) * weight[at]
            here = here.copy()
            here[:, 0] += event
            ahead[:m] = here / here.sum(1, keepdims=True)
        out = np.empty(len(x))
        behind = self.length[np.minimum(cols[None, :] + closing[:, None], FAR - 1)]
        for i in range(int(n[0]) - 1, -1, -1):
            m = int(np.searchsorted(-n, -i, "left"))
            at = starts[:m] + i
            here, later = before[at], behind[:m]
            event = (here * self.length).sum(1) * weight[at] * later[:, 0]
            out[at] = event / (event + (here * later).sum(1))
            total = later + self.length * (weight[at] * later[:, 0])[:, None]
            # seen from before the step that leads here
            back = np.take_along_axis(total, np.minimum(cols[None, :] + step[at][:, None], FAR - 1), 1)
            behind[:m] = back / back.max(1, keepdims=True)
        return out

    @staticmethod
    def _shift(state: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The state after ``step`` further steps; the last one stands for all beyond."""
        col = np.arange(FAR)[None, :] - step[:, None]
        out = np.where(col >= 0, np.take_along_axis(state, np.maximum(col, 0), 1), 0.0)
        beyond = state.sum(1) - out.sum(1)
        out[:, FAR - 1] += np.maximum(beyond, 0)
        return out

    def starts(self, parsed: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Per document the places that are boundaries."""
        sizes = [len(p) for p, _ in parsed]
        paras = np.concatenate([p for p, _ in parsed]) if parsed else np.empty(0, PARA)
        # positions of documents do not meet, as every paragraph is of one document
        shift = np.cumsum([0, *sizes])
        found = [f.copy() for _, f in parsed]
        for f, by in zip(found, shift):
            f["para"] += by
        x = np.concatenate(found) if found else np.empty(0, PLACE)
        chosen = self.posteriors(paras, x) > POSTERIOR
        ends = np.cumsum([len(f) for f in found])
        return [f["at"][chosen[e - len(f) : e]] for f, e in zip(found, ends)]

    def units_of(self, texts: list[str | None], parsed: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[int, int]]]:
        for text, (paras, _), at in zip(texts, parsed, self.starts(parsed)):
            out = []
            borders = np.unique(np.concatenate([paras["start"], paras["end"], at])).tolist()
            inside = dict(zip(paras["start"].tolist(), paras["end"].tolist()))
            stop = -1
            for a, b in zip(borders, borders[1:]):
                if a in inside:
                    stop = inside[a]
                if a >= stop:
                    continue
                piece = text[a:b]
                bare = piece.strip()
                if bare:
                    lead = len(piece) - len(piece.lstrip())
                    out.append((a + lead, a + lead + len(bare)))
            yield out

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) code-point positions of the text's sentences, without white space around."""
        return next(self.units_of([text], [parse(text)]))


def _parsed(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, PARA), np.frombuffer(b, PLACE)) for a, b in zip(pdf["paras"], pdf["places"])]


def parsed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, paras, places of the documents with text, one row per id and text, as a table in the shared folder."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse(t) for t in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], text_col: pdf[text_col], "paras": [p.tobytes() for p, _ in parsed], "places": [f.tobytes() for _, f in parsed]})

    some = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).distinct()
    return stage(some.mapInPandas(run, f"`{id_col}` {kind}, `{text_col}` string, paras binary, places binary"))


def train(parsed: DataFrame, text_col: str = "text") -> list[Table]:
    """The model's count tables over all documents; each holds at most 2^20 n-grams."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, keys, n in observe(pdf[text_col], _parsed(pdf)):
                yield pd.DataFrame({"kind": kind, "key": keys.view(np.int64), "n": n})

    sums = parsed.select(text_col, "paras", "places").mapInPandas(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    sums = stage(sums)
    totals = {r["kind"]: r["n"] for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    kept = sums.where(F.col("n") > F.element_at(F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, n * LEAST_SHARE)]), F.col("kind"))) if totals else sums
    rows = kept.toPandas()
    return tables((k, g["key"].to_numpy(np.int64).view(_U64), g["n"].to_numpy(), totals[k]) for k, g in rows.groupby("kind"))


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence_no (from 0), start_pos, end_pos, sentence of every document, in order.

    Positions are 0-based code points; null, empty and blank texts have no row; texts of any
    length are read whole. Rows that repeat id and text give their sentences once; different texts under one id, or without
    an id, are all split. Further columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    parsed = parsed_documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(parsed, text_col))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or Model(shared.value)
            texts = pdf[text_col].tolist()
            rows = [(key, i, a, b, text[a:b]) for key, text, units in zip(pdf[id_col], texts, model.units_of(texts, _parsed(pdf))) for i, (a, b) in enumerate(units)]
            yield pd.DataFrame(rows, columns=[id_col, "sentence_no", "start_pos", "end_pos", "sentence"])

    return parsed.mapInPandas(run, f"`{id_col}` {kind}, sentence_no int, start_pos int, end_pos int, sentence string")
