"""Cutting oversized texts into ordered pieces at their strongest natural boundaries.

Every byte position of a text gets a boundary strength. A sparse table over these
strengths answers "strongest, and of equals the rightmost, boundary in the window
of permissible lengths" in constant time; each piece ends there, and the next one
starts a fixed overlap earlier.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinery.operators.skew import prefix_sum

#: Limit and overlap in tokens, a token being floor(bytes / 4) + 1 for a text.
MAX_TOKENS = 512
OVERLAP_TOKENS = 50

#: Pieces are cut no earlier than this share of the longest permissible length.
LEAST_SHARE = 0.5

#: Positions one sparse table covers; a longer text is indexed block by block.
BLOCK = 1 << 16

# Strengths, from no boundary at all to the start of a heading.
_INSIDE, _CHARACTER, _SPACE, _CLAUSE, _SENTENCE, _LINE, _PARAGRAPH, _HEADING = range(8)

_MARKS = (
    (_SPACE, regex.compile(r"\s+")),
    (_CLAUSE, regex.compile(r"[,;:،、，；：)\]»”]\s*")),
    (_SENTENCE, regex.compile(r"(?:[.!?…؟]+[\"'”’»)\]]*\s+|[。！？।]+[」』”’）)]*\s*)")),
    (_LINE, regex.compile(r"[^\S\n]*\n[^\S\n]*")),
    (_PARAGRAPH, regex.compile(r"\n[^\S\n]*\n\s*")),
    (_HEADING, regex.compile(r"\n\s*(?=#{1,6}[ \t])")),
)


def tokens_of(n_bytes: int) -> int:
    """Tokens of a text of so many UTF-8 bytes."""
    return n_bytes // 4 + 1


def most_bytes(tokens: int) -> int:
    """The longest text in bytes that has at most so many tokens."""
    return 4 * tokens - 1


def token_count(text: Column) -> Column:
    """The same measure as a Spark expression; null for null texts."""
    return F.floor(F.octet_length(text) / 4).cast("long") + 1


def strengths(text: str) -> tuple[bytes, np.ndarray]:
    """The text's UTF-8 bytes and the strength of a cut before each byte, and at the end."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(data) + 1, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    out[starts] = _CHARACTER
    out[len(data)] = _HEADING
    place = np.append(starts, len(data))
    for strength, pattern in _MARKS:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        if len(ends):
            np.maximum.at(out, place[ends], np.uint8(strength))
    # a character's combining marks and joiners stay with it
    inside = np.fromiter((m.start() for m in regex.finditer(r"(?<!^)[\p{M}‍️]|(?<=‍).|(?<=\r)\n", text)), np.int64)
    if len(inside):
        out[place[inside]] = _INSIDE
    return raw, out


class StrongestCut:
    """Sparse-table range maximum over boundary strengths; equals are decided to the right."""

    def __init__(self, strength: np.ndarray):
        level = (strength.astype(np.int64) << 32) | np.arange(len(strength), dtype=np.int64)
        self.levels = [level]
        span = 1
        while 2 * span <= len(strength):
            level = np.maximum(level[:-span], level[span:])
            self.levels.append(level)
            span *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position of the strongest cut in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo], row[hi - (1 << k) + 1])) & 0xFFFFFFFF


def cut_positions(text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> tuple[bytes, list[tuple[int, int]]]:
    """The text's bytes and its pieces as (start, end) byte positions.

    Each piece has at most ``max_tokens``; neighbours share as much text as
    ``overlap_tokens`` allow at a character boundary. A text within the limit is one piece.
    """
    if overlap_tokens < 0 or max_tokens < 8 or most_bytes(overlap_tokens) + 8 >= LEAST_SHARE * most_bytes(max_tokens):
        raise ValueError("the overlap must be well under half the limit")
    longest = most_bytes(max_tokens)
    back = most_bytes(overlap_tokens) if overlap_tokens else 0
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= longest:
        return raw, [(0, len(raw))]
    raw, strength = strengths(text)
    least = int(LEAST_SHARE * longest)
    pieces, start, base, table = [], 0, 0, None
    while len(raw) - start > longest:
        lo, hi = start + least, start + longest
        if table is None or hi >= base + BLOCK:
            base = start
            table = StrongestCut(strength[base : base + BLOCK + 1])
        end = base + table.query(lo - base, hi - base)
        if strength[end] == _INSIDE:  # one cluster longer than the window: fall back to any whole character
            end = hi
            while (raw[end] & 0xC0) == 0x80:
                end -= 1
        pieces.append((start, end))
        start = end - back
        while start < end and (raw[start] & 0xC0) == 0x80:
            start += 1
    pieces.append((start, len(raw)))
    return raw, pieces


def split_texts(
    chunks: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    id_col: str = "chunk_id",
    text_col: str = "chunk_text",
) -> DataFrame:
    """Pieces of every oversized text: id, piece_no (from 0), start_byte, end_byte, piece_text, piece_tokens.

    Only rows over the limit leave the JVM. Rows with the same id and text are one case.
    Null, empty and short texts give no row; a text without any boundary is cut between
    characters; other columns are ignored.
    """
    kind = dict(chunks.dtypes)[id_col]
    over = chunks.where(token_count(F.col(text_col)) > max_tokens).select(F.col(id_col), F.col(text_col)).dropDuplicates([id_col])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                raw, pieces = cut_positions(text, max_tokens, overlap_tokens)
                for no, (a, b) in enumerate(pieces):
                    rows.append((key, no, a, b, raw[a:b].decode("utf-8", "surrogatepass"), tokens_of(b - a)))
            yield pd.DataFrame(rows, columns=[id_col, "piece_no", "start_byte", "end_byte", "piece_text", "piece_tokens"])

    return over.mapInPandas(run, f"`{id_col}` {kind}, piece_no int, start_byte bigint, end_byte bigint, piece_text string, piece_tokens int")


def rechunk(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """The chunk table with oversized chunks replaced by their pieces and ``chunk_index`` counted anew per page.

    One row per piece: chunk_id, page_id, grp, chunk_index, piece_no, chunk_text, heading_path,
    n_tokens. Chunks within the limit (null and empty ones too) stay whole as piece 0.
    A redelivered chunk counts once. The order within a page is (old chunk_index, chunk_id,
    piece_no), null indexes last; the count runs by prefix sums over ranges of chunk_index,
    so a page of any size is spread over many tasks. Further columns are dropped.
    """
    base = chunks.select("chunk_id", "page_id", "grp", "chunk_index", "chunk_text", "heading_path").dropDuplicates(["chunk_id"])
    big = F.coalesce(token_count(F.col("chunk_text")) > max_tokens, F.lit(False))
    pieces = split_texts(base, max_tokens, overlap_tokens)
    whole = base.where(~big).select(
        "chunk_id", "page_id", "grp", "chunk_index", "heading_path", F.lit(0).alias("piece_no"), "chunk_text", F.coalesce(token_count(F.col("chunk_text")), F.lit(0)).alias("n_tokens")
    )
    cut = base.where(big).drop("chunk_text").join(pieces, "chunk_id").select(
        "chunk_id", "page_id", "grp", "chunk_index", "heading_path", "piece_no", F.col("piece_text").alias("chunk_text"), F.col("piece_tokens").cast("long").alias("n_tokens")
    )
    rows = whole.unionByName(cut)
    order = [F.col("chunk_index").asc_nulls_last(), F.col("chunk_id"), F.col("piece_no")]
    bucket = F.coalesce(F.floor(F.col("chunk_index") / 256), F.lit((1 << 31) - 1))
    numbered = prefix_sum(rows, ["page_id"], bucket, order, F.lit(1), "new_index")
    return numbered.select("chunk_id", "page_id", "grp", F.col("new_index").cast("int").alias("chunk_index"), "piece_no", "chunk_text", "heading_path", "n_tokens")
