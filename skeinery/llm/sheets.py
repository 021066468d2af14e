"""Described lines of pages as arrays ("sheets"): what training and marking need of them, so that a page is described once.

``mark`` labels the lines of many sheets at once, as ``boilerplate.Model.cut`` does those of one page.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from skeinery.llm.boilerplate import _BEGIN, _END, _NEW, _TOKEN, _TRAIL, PLACEHOLDER, Line, Model, structure_names
from skeinery.llm.maxflow import minimum_cut

_MARKERS, _PLACES = ("", "h", "l", "n", "q", "t", "f", "c"), ("in", "before", "after")
_SIZES = (7, len(_MARKERS), len(_PLACES), 2, 2, 2, 4, 3, 2, 2, 2, 2, 2)
_HEAD, _ITEMS, _TABLE, _CODE = _MARKERS.index("h"), (_MARKERS.index("l"), _MARKERS.index("n")), _MARKERS.index("t"), (_MARKERS.index("f"), _MARKERS.index("c"))

#: Facts of a line that its words and structure don't have; above them, what its small-lettered rare words add to its wording.
_BLANK, _PLACEHOLDER, _TRAILS, _PERSON, _EXTRA = 1, 2, 4, 8, 4


def pack(key: tuple) -> int:
    """A line's structure as a number."""
    n = 0
    for size, v in zip(_SIZES, (key[0], _MARKERS.index(key[1]), _PLACES.index(key[2]), *key[3:])):
        n = n * size + int(v)
    return n


def unpack(n: int) -> tuple:
    values = []
    for size in reversed(_SIZES):
        n, v = divmod(n, size)
        values.append(v)
    size, marker, place, own, foreign, site, ends, link, *rest = reversed(values)
    return size, _MARKERS[marker], _PLACES[place], bool(own), bool(foreign), bool(site), ends, link, *map(bool, rest)


def facts(x: Line) -> int:
    t = x.text
    n = _BLANK if x.blank_before else 0
    if x.marker in ("l", "n") or x.link:
        return n  # their wording is not looked at
    if ("{" in t or "%" in t or "_" in t or "[" in t or "@" in t or "TODO:" in t) and PLACEHOLDER.search(t):
        n |= _PLACEHOLDER
    if (">" in t or "/" in t or "›" in t or "»" in t or "→" in t) and _TRAIL.search(t):
        n |= _TRAILS
    if x.foreign:
        raw, ids = _TOKEN.findall(t), x.ids
        if len(raw) == len(ids):
            if len(ids) > 1 and ids[0] == ids[1] == _NEW and raw[0].istitle() and raw[1].istitle():
                n |= _PERSON
            extra = 0
            for w, i in zip(raw, ids):
                if i == _NEW and not w.istitle() and not w.isupper():
                    extra += 3 if w.lower() == w.upper() else 1
            n |= extra << _EXTRA
    return n


class Sheets(NamedTuple):
    sizes: np.ndarray  # lines of every page
    shapes: np.ndarray  # packed structure of every line
    facts: np.ndarray
    lengths: np.ndarray  # words of every line
    words: np.ndarray  # their numbers, line after line


class Marker:
    """A model's weights by pair of word numbers and by packed structure."""

    def __init__(self, model: Model):
        self.weights, size = model.weights, len(model.reader.names)
        self.size, self.single = size, model.single
        known = {model.reader.ids[a] * size + model.reader.ids[b] for a, b in model.double}
        weights = dict(zip(model.pair_keys.tolist(), model.pair_weights.tolist()))
        self.keys = np.array(sorted(known) or [-1], np.int64)
        self.pairs = np.array([weights.get(k, 0.0) for k in self.keys.tolist()])  # an empty line's pair has none
        self.colon = model.reader.ids[":"]
        self.shapes: dict[int, tuple] = {}

    def _shapes(self, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and structure of every line."""
        distinct, at = np.unique(shapes, return_inverse=True)
        rows = []
        for n in distinct.tolist():
            got = self.shapes.get(n)
            if got is None:
                _, marker, _, own, foreign, site, ends, link, title, *_ = key = unpack(n)
                got = self.shapes[n] = sum(self.weights.get(x, 0.0) for x in structure_names(key)), (_MARKERS.index(marker), own, foreign, site, ends > 0, link > 0, title)
            rows.append(got)
        return np.array([z for z, _ in rows], float)[at], np.array([x for _, x in rows], np.int8)[at].T

    def mark(self, s: Sheets) -> np.ndarray:
        """Whether each line is main content."""
        n = len(s.shapes)
        if not n:
            return np.zeros(0, bool)
        shape_score, (marker, own, foreign, site, ends, link, title) = self._shapes(s.shapes)
        lengths = s.lengths.astype(np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        left = np.full(len(s.words) + n, _BEGIN, np.int64)
        right = np.full(len(s.words) + n, _END, np.int64)
        place = np.arange(len(s.words)) + np.repeat(np.arange(n), lengths)
        right[place] = s.words
        left[place + 1] = s.words
        left[starts] = _BEGIN
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys
        z = shape_score + np.add.reduceat(np.where(known, self.pairs[at], self.single[right]), starts)
        gain = np.where(z < -6.0, 6.0, np.where(z > 6.0, -6.0, -z))

        page = np.repeat(np.arange(len(s.sizes)), s.sizes)
        first = np.cumsum(s.sizes) - s.sizes
        heads = np.flatnonzero(title.astype(bool) & (marker <= _HEAD))
        gain[heads[np.unique(page[heads], return_index=True)[1]]] = 6.0
        prose = np.bincount(page[(gain > 0) & (ends > 0) & (lengths > 7)], minlength=len(s.sizes)) > 0
        item = (marker == _ITEMS[0]) | (marker == _ITEMS[1])

        # wording that no boilerplate of the training has
        asked = (gain <= 0) & ~item & (link == 0)
        common = (left > 4) & (right > 4)  # neither is a kind of rare words
        total = np.add.reduceat(common.astype(np.int64), starts) + (s.facts >> _EXTRA)
        of_known = np.add.reduceat((known & common).astype(np.int64), starts)
        last = len(keys) - 1
        second, third = np.minimum(starts + 1, last), np.minimum(starts + 2, last)
        label = (lengths > 1) & (right[second] == self.colon) & known[starts]
        plain = (right[starts] > 4) & (right[second] > 4) & (right[third] > 4)
        begins = (lengths > 2) & plain & known[starts] & known[second] & known[third]
        person = (s.facts & _PERSON) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            novelty = np.where((total > 2) & ~label & ~begins & ~person, 1 - of_known / total, 0.0)
        new = (s.facts & _TRAILS == 0) & (site == 0) & (novelty >= np.where(prose[page], 0.6, 0.45))
        gain[asked & ((s.facts & _PLACEHOLDER > 0) | new)] = 3.0

        near, over = self._edges(marker, item, own, foreign, ends > 0, title > 0, lengths, s.facts & _BLANK > 0, np.arange(n) - first[page])
        total = near + over
        total[:-1] += near[1:]
        total[:-2] += over[2:]
        main = gain > 0  # the cut of pages whose lines all are certain
        unsure = np.bincount(page[np.abs(gain) <= total + 1e-6], minlength=len(s.sizes)) > 0
        for a, size in zip(first[unsure].tolist(), s.sizes[unsure].tolist()):
            c, d = near[a : a + size].tolist(), over[a : a + size].tolist()
            edges = []
            for i in range(1, size):
                edges.append((i - 1, i, c[i]))
                if d[i]:
                    edges.append((i - 2, i, d[i]))
            main[a : a + size] = minimum_cut(gain[a : a + size].tolist(), edges)
        return main

    @staticmethod
    def _edges(marker, item, own, foreign, ends, title, lengths, blank, no) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Capacity between every line and the one before it, and the one before that, as in ``boilerplate.smoothness``."""
        code = (marker == _CODE[0]) | (marker == _CODE[1])
        table = marker == _TABLE

        def before(x: np.ndarray, k: int = 1) -> np.ndarray:
            return np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[:-k]])

        cases = [
            code & before(code),
            table & before(table),
            item & before(item) & ~blank & (own == before(own)),
            item & ~before(item) & ~blank & before(~ends & (lengths < 8) & ~title & (marker != _HEAD)),
            blank,
        ]
        near = np.select(cases, [4.0, 4.0, np.where(foreign == before(foreign), 2.5, 1.0), 2.5, 0.25], 0.4)
        over = item & before(item, 2) & before(item) & ~blank & before(~blank)
        return np.where(no > 0, near, 0.0), np.where((no > 1) & over, 1.0, 0.0)


def of_pages(pages: Sequence[Sequence[Line]], shapes: Sequence[int]) -> Sheets:
    """The sheets of described pages, whose lines have these packed structures."""
    lines = [x for page in pages for x in page]
    words = [i for x in lines for i in x.ids]
    return Sheets(
        np.array([len(p) for p in pages], np.int64), np.array(shapes, np.int32), np.array([facts(x) for x in lines], np.int32),
        np.array([len(x.ids) for x in lines], np.int32), np.array(words, np.int32),
    )
