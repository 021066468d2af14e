"""Encoding of whole texts with a public byte-level BPE tokenizer, by reuse of content-defined chunks.

A rolling hash over the last characters places chunk ends by content alone, so two
documents with a passage in common get equal chunks inside it. A chunk's *body*, the part between
its first and last position where every tokenization must have a break, is encoded
once per task and reused for all documents. The rest, from the last such position
of one chunk to the first of the next, is a *join*: joins are re-encoded, growing over as many
chunks as needed until both ends are certain, which makes the ids equal to those
of encoding the whole text.

Certain positions follow from the pre-tokenizer's pattern: a run of letters, numbers or
other marks never continues across a change of class, only white space attaches to
what follows it, and only an apostrophe may take letters with it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the public vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"

#: Name, rank file and pre-tokenizer pattern of the byte-level vocabulary.
TOKENIZER = "byte_bpe_50k"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters the rolling hash covers, and the mean chunk length in characters (a power of two).
WINDOW = 16
MEAN_CHUNK = 64

#: Bytes of text and ids a task keeps for reuse; the older half is dropped beyond it.
CACHE_BYTES = 64 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of every code point in the sense of the pattern."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = kind
    return table


class ChunkEncoder:
    """Encodes texts to the exact ids of the vocabulary, reusing bodies of equal chunks."""

    def __init__(self, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        with open(os.path.join(tokenizer_dir, name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        rng = np.random.default_rng(20240229)
        self.gear = rng.integers(0, 1 << 32, 1 << 16, dtype=np.uint64)
        self.cache_bytes, self.used = cache_bytes, 0
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.reused = self.encoded = 0

    def _ids(self, piece: str) -> list[int]:
        """Ids of a piece of text whose ends are certain breaks; cached."""
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self.bpe.encode_ordinary(piece)
                self.encoded += len(piece)
            else:
                self.reused += len(piece)
            self.used += 200 + 2 * len(piece) + 8 * len(ids)
            if self.used > self.cache_bytes // 2:
                self.old, self.young, self.used = self.young, {}, 0
            self.young[piece] = ids
        else:
            self.reused += len(piece)
        return ids

    def breaks(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every position, whether a chunk ends before it and whether a break is certain there."""
        n = len(codes)
        kind = self.classes[codes]
        certain = np.zeros(n, bool)
        if n > 1:
            before, after = kind[:-1], kind[1:]
            certain[1:] = (before != _SPACE) & (before != after) & ~((codes[:-1] == 39) & (after == _LETTER))
        value = self.gear[codes & 0xFFFF]
        rolled = np.zeros(n, np.uint64)
        for k in range(min(WINDOW, n)):
            rolled[k:] += value[: n - k] << np.uint64(k)
        ends = np.zeros(n, bool)
        mask = np.uint64((MEAN_CHUNK - 1) << 20)
        if n > 1:
            ends[1:] = (rolled[:-1] & mask) == 0
        return ends, certain

    def pieces(self, text: str) -> Iterator[str]:
        """Bodies and joins of the text's chunks, in order; together they are the text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends, certain = self.breaks(codes)
        sure = np.flatnonzero(certain)
        at = 0
        if len(sure):
            cuts = np.flatnonzero(ends)
            right = np.searchsorted(sure, cuts)  # first certain break at or after each chunk end
            left = np.searchsorted(sure, cuts, "right") - 1  # last one at or before it
            for a, b in zip(left.tolist(), right.tolist()):
                # join of two chunks: from the last certain break before the cut to the first after it
                lo = int(sure[a]) if a >= 0 else 0
                hi = int(sure[b]) if b < len(sure) else len(text)
                if lo > at:
                    yield text[at:lo]
                    at = lo
                if hi > at and hi > lo:
                    yield text[at:hi]
                    at = hi
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for piece in self.pieces(text):
            out += self._ids(piece)
        return out


@lru_cache(2)
def encoder(tokenizer_dir: str, name: str) -> ChunkEncoder:
    """The process's encoder of a vocabulary; tasks that a worker runs one after another share it."""
    return ChunkEncoder(tokenizer_dir, name)


def encode_corpus(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>), one row per input row, in one pass without a shuffle.

    Null and empty texts give an empty list; repeated rows give repeated rows; texts of any
    length are encoded whole; other columns are ignored. Reuse is per task, within a
    bounded cache; ids are the same whatever the partitioning.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_dir, name)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "ids": [enc.encode(t) for t in pdf[text_col]]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` but the text, plus the number of its tokens; 0 for null and empty texts."""
    keep = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_dir, name)
        for pdf in batches:
            got = pdf[keep].copy()
            got[out] = [len(enc.encode(t)) for t in pdf[text_col]]
            yield got

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", `{out}` bigint"
    return docs.select(*keep, text_col).mapInPandas(run, schema)
