"""Blocks of texts, their sets of word n-grams and exact frequencies of these over a corpus of any size.

A block packs a bounded number of texts, compressed, into one row. Frequencies are
counted by range of hash: each block sends its distinct n-grams with local counts to the range's task
and gets the totals back in the same order, so neither the driver nor any one task sees all
n-grams. Sorted hashes are compressed to about four bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.session import stage

#: Texts and characters of a block; a longer text is a block of its own.
BLOCK_TEXTS = 2000
BLOCK_CHARS = 16 << 20

#: N-grams that one range of hashes holds, about.
RANGE = 1 << 20

#: Counts up to EXACT stand for themselves, larger ones go up in steps of a ninth of a doubling.
EXACT = 32
STEPS = 8

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)


def gram_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the distinct n-grams of texts whose words are parted by single spaces, sorted by both."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    size = pc.list_value_length(parts).to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
    n = len(h) - words + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(words):
        g = (g ^ h[i : i + n]) * _MIX[i % len(_MIX)]
        g ^= g >> np.uint64(31)
    start = np.repeat(np.arange(len(size)), size)
    own = start[:n] == start[words - 1 :]  # n-grams within one text
    who, g = start[:n][own], g[own]
    order = np.lexsort((g, who))
    who, g = who[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (who[1:] != who[:-1]) | (g[1:] != g[:-1])
    return who[new], g[new]


def pack(texts: Iterable[str]) -> bytes:
    return zstandard.compress("\n".join(texts).encode("utf-8", "surrogatepass"))


def unpack(block: bytes) -> list[str]:
    return zstandard.decompress(block).decode("utf-8", "surrogatepass").split("\n")


def squeeze(a: np.ndarray) -> bytes:
    """Compressed numbers, byte by byte: sorted and small ones shrink to little more than what differs."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def stretch(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pieces(pdf: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most BLOCK_TEXTS texts and about BLOCK_CHARS characters."""
    long = pdf[text].str.len().cumsum().to_numpy()
    at = 0
    while at < len(pdf):
        upto = int(np.searchsorted(long, (long[at - 1] if at else 0) + BLOCK_CHARS, "right"))
        upto = min(max(upto, at + 1), at + BLOCK_TEXTS, len(pdf))
        yield pdf.iloc[at:upto]
        at = upto


def step_of(counts: np.ndarray) -> np.ndarray:
    """Monotone one-byte step of a count."""
    c = np.maximum(counts, 1).astype(np.float64)
    return np.minimum(255, np.where(c <= EXACT, c, EXACT + STEPS * np.log2(np.maximum(c / EXACT, 1)))).astype(np.uint8)


def most_of(steps: np.ndarray) -> np.ndarray:
    """The largest count of a step."""
    s = steps.astype(np.float64)
    return np.where(s < EXACT, s, EXACT * 2.0 ** ((s - EXACT + 1) / STEPS)).astype(np.int64)


def borders(u: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted hashes pass from one of equal ranges to the next."""
    edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(u, edges), [len(u)]]).astype(np.int64)


def frequencies(blocks: DataFrame, words: int, ranges: int) -> DataFrame:
    """block, steps: for the sorted distinct n-grams of every block the step of their number of texts in all blocks.

    Blocks are rows (block, texts). N-grams that agree in the upper 48 bits of their hash are counted as one, which
    can only raise a count.
    """

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, texts in zip(pdf["block"], pdf["texts"]):
                u, n = np.unique(gram_sets(unpack(texts), words)[1], return_counts=True)
                at = borders(u, ranges)
                full = np.flatnonzero(at[1:] > at[:-1])
                yield pd.DataFrame(
                    {"rng": full, "block": block, "keys": [squeeze(u[at[r] : at[r + 1]] >> np.uint64(16)) for r in full], "n": [squeeze(n[at[r] : at[r + 1]].astype(np.uint16)) for r in full]}
                )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [stretch(k, np.uint64) for k in pdf["keys"]]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([stretch(x, np.uint16) for x in pdf["n"]])
        steps = step_of(np.bincount(inverse, n))[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": pdf["block"], "rng": pdf["rng"], "steps": [squeeze(steps[e - len(k) : e]) for e, k in zip(ends, keys)]})

    sent = blocks.select("block", "texts").mapInPandas(send, "rng bigint, block bigint, keys binary, n binary")
    back = sent.groupBy("rng").applyInPandas(total, "block bigint, rng bigint, steps binary")
    parts = F.array_sort(F.collect_list(F.struct("rng", "steps")))
    return back.groupBy("block").agg(F.transform(parts, lambda p: p["steps"]).alias("steps"))


def staged_blocks(texts: DataFrame, columns) -> DataFrame:
    """Blocks of texts (rep, text) as a table in the shared folder: block, texts, n_grams and what ``columns`` adds.

    ``columns`` is a function of the batch (pandas) that gives a row's further columns, with their schema.
    """
    make, schema = columns

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pieces(pdf, "text"):
                row = {"block": int(part["rep"].iloc[0]), "reps": part["rep"].to_numpy(np.int64).tobytes(), "texts": pack(part["text"])} | make(part)
                yield pd.DataFrame({k: [v] for k, v in row.items()})

    return stage(texts.select("rep", "text").mapInPandas(run, f"block bigint, reps binary, texts binary, {schema}"))
