"""Heading-aware chunking of page content within a token budget."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Budget and overlap of a chunk in tokens, and the most chunks of a page.
CHUNK_TOKENS, OVERLAP_TOKENS, MAX_CHUNKS = 512, 50, 1000

DELIMITERS = ("\n\n", ". ", " ")


def tokens_of(s: str) -> int:
    return len(s) // 4 + 1


def sections(content: str) -> list[tuple[list[str], str]]:
    """(heading path, body) of every section with a body; headings of three levels count."""
    out: list[tuple[list[str], str]] = []
    path: list[str] = []
    body: list[str] = []

    def flush() -> None:
        joined = "\n".join(body).strip()
        if joined:
            out.append((list(path), joined))
        body.clear()

    for line in content.split("\n"):
        bare = line.strip()
        level = next((n for n in (1, 2, 3) if bare.startswith("#" * n + " ")), 0)
        if level:
            flush()
            path = path[: level - 1] if level > 1 else []
            path.append(bare[level + 1 :].strip())
        else:
            body.append(line)
    flush()
    return out or [([], content)]


@dataclass
class Chunker:
    """Splits sections over the budget at paragraphs, sentences, words, or by length; ``compat`` keeps the empty
    first chunk that an oversized first piece leaves behind."""

    budget: int = CHUNK_TOKENS
    overlap: int = OVERLAP_TOKENS
    compat: bool = False

    def pack(self, pieces: list[str]) -> list[str]:
        """Pieces gathered up to the budget; each new chunk begins with the tail of the one before."""
        out, held, used = [], "", 0
        for piece in pieces:
            n = tokens_of(piece)
            if used + n > self.budget and (held or self.compat):
                out.append(held.strip())
                held = held[-4 * self.overlap :] if self.overlap else ""
                used = tokens_of(held) if held else 0
            held += piece
            used += n
        if held.strip():
            out.append(held.strip())
        return out

    def windows(self, s: str) -> list[str]:
        """Windows of the budget's length; always advances and ends at the end of the text."""
        size = 4 * self.budget
        step = max(1, size - 4 * self.overlap)
        out, at = [], 0
        while True:
            out.append(s[at : at + size])
            if at + size >= len(s):
                return out
            at += step

    def split(self, s: str) -> list[str]:
        if tokens_of(s) <= self.budget:
            return [s]
        for d in DELIMITERS:
            parts = s.split(d)
            if len(parts) > 1:
                out = self.pack([parts[0], *(d + p for p in parts[1:])])
                return out if self.compat else [c for c in out if c]
        return self.windows(s)

    def chunk(self, content: str) -> list[tuple[int, str, list[str]]]:
        """(index, text, heading path) of a page's chunks."""
        flat = [(piece, path) for path, body in sections(content) for piece in self.split(body)]
        return [(i, piece, path) for i, (piece, path) in enumerate(flat)]


def chunk_pages(pages: DataFrame, keys: tuple[str, ...] = ("grp", "url"), budget: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, max_chunks: int | None = None, compat: bool = False) -> DataFrame:
    """keys, chunk_index, chunk_text, heading_path, n_tokens of every page without an error and with content.

    A page gives all its chunks, or the first ``max_chunks`` (``MAX_CHUNKS`` in the original pipeline); null and blank contents give none; repeated rows are chunked
    each. One narrow pass, no shuffle.
    """
    good = pages.where(F.col("content").isNotNull() & (F.trim("content") != ""))
    if "error" in pages.columns:
        good = good.where(F.col("error").isNull())
    cols = good.select(*keys, "content")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Chunker(budget, overlap, compat)
        for pdf in batches:
            rows = []
            for *key, content in pdf.itertuples(index=False):
                for i, piece, path in c.chunk(content)[:max_chunks]:
                    rows.append((*key, i, piece, path, tokens_of(piece)))
            yield pd.DataFrame(rows, columns=[*keys, "chunk_index", "chunk_text", "heading_path", "n_tokens"])

    return cols.mapInPandas(run, f"{fields}, chunk_index int, chunk_text string, heading_path array<string>, n_tokens int")
