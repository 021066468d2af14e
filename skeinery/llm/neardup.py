"""Near-duplicate pages by an exact prefix-tree join of their word n-gram sets.

Every content is a set of hashed word n-grams in one global order, rare ones first by their exact
number of records. Two sets similar enough share an element in their prefixes, so the records are grouped by
prefix elements; elements of one record only are left out. Inside a group the records that can be the smaller of
a pair form a trie of their lengths and of the elements that follow. A record's walk
through it counts overlaps once for all records below a node and leaves a subtree as soon as
the elements left on either side cannot bring the overlap to the threshold. Walks of many records go through
the trie level by level together. What stays is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm import grams
from skeinery.operators.skew import keyed_join
from skeinery.session import cut, stage

#: Words in a row that make an element, and the least Jaccard similarity of a pair.
WORDS = 3
THRESHOLD = 0.6

#: Elements after the shared one that a trie path holds.
DEPTH = 6

#: Records of one prefix element that a single group may hold; fuller ones are split into pairs of blocks.
BLOCK = 2048

#: Bits of the parity sketch that thins pairs before the exact comparison.
SKETCH_BITS = 512

#: Prefix elements that one part of the join holds, about, and pairs that are in memory at a time.
PART = 1 << 20
AT_ONCE = 1 << 19

#: Members of a class that one task pairs with those of another class.
SALT = 1 << 12


def need(a: int, b: int, t: float) -> int:
    """Least common elements of two sets of these sizes for a Jaccard similarity of ``t``."""
    return math.ceil(t / (1 + t) * (a + b) - 1e-9)


def prefix_length(n, t: float):
    """Elements of the ordered set of size ``n`` of which a similar set must contain one."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def index_length(n, t: float):
    """The same for similar sets that are not smaller: elements under which the smaller set of a pair is stored."""
    return n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + 1


def word_texts(pages: DataFrame, words: int = WORDS, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """id, c1, c2 (hashes of the word sequence), text (the words, parted by spaces), of texts with at least one gram.

    Words are runs of letters and digits of the lower-cased text. Null, empty and shorter texts have no row.
    The rows are a table in the shared folder, as several steps read parts of it.
    """
    text = F.trim(F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}]+", " "))
    base = pages.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"))
    rows = stage(base.select("id", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit("second"), "text").alias("c2"), "text"))
    return rows.where(F.size(F.split("text", " ")) >= words)


def _parity(who: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH_BITS / 8) sketches whose bits tell whether an odd number of elements fell there; differing bits bound the symmetric difference."""
    cell = who * SKETCH_BITS + ((g >> np.uint64(24)).astype(np.int64) % SKETCH_BITS)
    return np.packbits((np.bincount(cell, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, -1), axis=1)


class Corpus:
    """Classes of equal word sequences: their members, and their texts in blocks."""

    def __init__(self, pages: DataFrame, words: int = WORDS):
        self.words = words
        rows = word_texts(pages, words)
        classes = rows.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("text").alias("text"))

        def sizes(part: pd.DataFrame) -> dict:
            who, g = grams.gram_sets(part["text"].tolist(), words)
            n = np.bincount(who, minlength=len(part))
            return {"sizes": n.astype(np.int32).tobytes(), "bits": _parity(who, g, len(part)).tobytes(), "n_grams": int(n.sum())}

        self.blocks = grams.staged_blocks(classes, (sizes, "sizes binary, bits binary, n_grams bigint"))
        self.n_grams = self.blocks.agg(F.sum("n_grams")).first()[0] or 0
        ids = rows.select("id", "c1", "c2").distinct()
        keys = ids.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        #: id, rep of every page with grams; a class may be as large as the corpus, so it is joined by ``keyed_join``
        self.members = cut(keyed_join(ids, keys, ["c1", "c2"], "n").select("id", "rep").distinct())

    def each(self) -> DataFrame:
        """rep, n, bits of every class."""

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for reps, sizes, bits in zip(pdf["reps"], pdf["sizes"], pdf["bits"]):
                    r, w = np.frombuffer(reps, np.int64), SKETCH_BITS // 8
                    yield pd.DataFrame({"rep": r, "n": np.frombuffer(sizes, np.int32), "bits": [bits[i * w : (i + 1) * w] for i in range(len(r))]})

        return self.blocks.select("reps", "sizes", "bits").mapInPandas(run, "rep bigint, n int, bits binary")

    def texts(self) -> DataFrame:
        """rep, text of every class."""

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for reps, texts in zip(pdf["reps"], pdf["texts"]):
                    yield pd.DataFrame({"rep": np.frombuffer(reps, np.int64), "text": grams.unpack(texts)})

        return self.blocks.select("reps", "texts").mapInPandas(run, "rep bigint, text string")


#: A posting: the group's key, record, size, place of the shared element, the record's side of a pair of blocks (0 if one
#: block meets itself) and the elements that follow.
POSTING = np.dtype([("key", "u8"), ("rep", "i8"), ("n", "i4"), ("pos", "i4"), ("side", "u1"), ("path", "u2", (DEPTH,))])


#: The columns in which the postings of a block go to a part; ``who`` numbers the records in ``reps`` (a block has fewer than 2^16).
_PACKED = (("key", "u8"), ("who", "u2"), ("pos", "i4"), ("side", "u1"), ("path", "u2"), ("reps", "i8"), ("n", "i4"))


def _mixed(g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    x = (g + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def block_postings(reps: np.ndarray, who: np.ndarray, g: np.ndarray, steps: np.ndarray, t: float, block: int = BLOCK) -> np.ndarray:
    """The postings of a block's records: every element of a prefix that other records have, too.

    ``who`` and ``g`` are the records' sorted sets, ``steps`` the frequency steps of the distinct elements. A
    frequent element is split into blocks of records, so that each pair of records meets exactly once.
    """
    u, inverse = np.unique(g, return_inverse=True)
    order = np.argsort(steps, kind="stable")  # u is sorted: by step, then hash
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    place = np.sort((who << 32) | rank[inverse])
    at = order[place & 0xFFFFFFFF]
    who, g, step = place >> 32, u[at], steps[at]
    n = np.bincount(who, minlength=len(reps))
    first = np.cumsum(n) - n
    pos = np.arange(len(g)) - first[who]
    # in the order of the elements; those that share a value count as met, so that no overlap is underestimated
    value = (step.astype(np.uint16) << np.uint16(8)) | (g >> np.uint64(56)).astype(np.uint16)
    chosen = np.flatnonzero((pos < prefix_length(n, t)[who]) & (step > 1))
    n_blocks = -(-grams.most_of(step[chosen]) // block)
    copies = np.repeat(np.arange(len(chosen)), n_blocks)
    other = np.arange(len(copies)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    row = chosen[copies]
    own = (reps[who[row]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_blocks[copies]
    out = np.empty(len(row), POSTING)
    out["key"] = _mixed(g[row], np.minimum(own, other), np.maximum(own, other))
    out["rep"], out["n"], out["pos"] = reps[who[row]], n[who[row]], pos[row]
    out["side"] = np.sign(own - other) % 3
    ends = (first + n)[who[row]]
    padded = np.append(value, np.uint16(0xFFFF))
    for i in range(DEPTH):
        out["path"][:, i] = padded[np.where(row + 1 + i < ends, row + 1 + i, len(value))]
    return out


def postings(corpus: Corpus, t: float, block: int = BLOCK) -> tuple[DataFrame, int]:
    """part, and the columns of one block's postings for this part, compressed: key (sorted), who (numbers in reps), pos, side, path; reps and n."""
    words = corpus.words
    frequent = grams.frequencies(corpus.blocks, words, max(1, -(-corpus.n_grams // grams.RANGE)))
    parts = max(1, -(-corpus.n_grams // PART))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for reps, texts, steps in zip(pdf["reps"], pdf["texts"], pdf["steps"]):
                who, g = grams.gram_sets(grams.unpack(texts), words)
                rows = block_postings(np.frombuffer(reps, np.int64), who, g, np.concatenate([grams.stretch(x, np.uint8) for x in steps]), t, block)
                rows = rows[np.argsort(rows["key"])]
                at = grams.borders(rows["key"], parts)
                full = np.flatnonzero(at[1:] > at[:-1])
                packed = []
                for p in full:
                    x = rows[at[p] : at[p + 1]]
                    own, first, number = np.unique(x["rep"], return_index=True, return_inverse=True)
                    path = np.ascontiguousarray(x["path"]).reshape(-1)
                    packed.append([grams.squeeze(c) for c in (x["key"], number.astype(np.uint16), x["pos"], x["side"], path, own, x["n"][first])])
                yield pd.DataFrame({"part": full} | {f: [row[i] for row in packed] for i, (f, _) in enumerate(_PACKED)})

    schema = "part bigint, " + ", ".join(f"{f} binary" for f, _ in _PACKED)
    return corpus.blocks.select("block", "reps", "texts").join(frequent, "block").mapInPandas(run, schema), parts


class Trie:
    """The records of many groups that can be the smaller of a pair, level by level: group, band of lengths, elements that follow.

    A node of a level is a run of the sorted records. It knows its records' least and greatest size and the
    greatest ``n - pos - share * n``, from which follows what their overlap can still come to.
    """

    def __init__(self, rows: np.ndarray, share: float):
        path = rows["path"].astype(np.uint64)
        words = [sum(path[:, j] << np.uint64(16 * (3 - j % 4)) for j in range(i, min(i + 4, DEPTH))) for i in range(0, DEPTH, 4)]
        band = (np.log2(rows["n"].astype(np.float64)) * 8).astype(np.int16)
        order = np.lexsort((*words[::-1], band, rows["key"]))
        self.rows = rows = rows[order]
        band = band[order]
        slack = rows["n"] - rows["pos"] - share * rows["n"]
        slack[rows["n"] - rows["pos"] - 1 < DEPTH] = np.inf  # the set ends within its path
        new = np.ones(len(rows), bool)
        new[1:] = rows["key"][1:] != rows["key"][:-1]
        self.starts, self.least, self.most, self.slack, self.steps = [], [], [], [], []
        node = []
        for level in range(DEPTH + 2):
            if level:
                column = band if level == 1 else rows["path"][:, level - 2]
                new[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(new)
            self.starts.append(np.append(starts, len(rows)))
            node.append(np.cumsum(new) - 1)
            self.least.append(np.minimum.reduceat(rows["n"], starts))
            self.most.append(np.maximum.reduceat(rows["n"], starts))
            self.slack.append(np.maximum.reduceat(slack, starts))
            self.steps.append(rows["path"][starts, level - 2] if level > 1 else None)
        # the children of a node are the next level's nodes between those of its first and last row
        self.first = [np.append(node[i + 1][self.starts[i][:-1]], len(self.starts[i + 1]) - 1) for i in range(DEPTH + 1)]

    def walk(self, x: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows of ``x`` and of stored rows that may reach the threshold together, the shared element counted."""
        share = t / (1 + t)
        keys = self.rows["key"][self.starts[0][:-1]]
        node = np.searchsorted(keys, x["key"])
        i = np.flatnonzero(keys[np.minimum(node, len(keys) - 1)] == x["key"])
        node = node[i]
        size, left = x["n"].astype(np.float64), (x["n"] - x["pos"] - 1).astype(np.float64)
        passed = np.zeros(len(i), np.int64)  # elements of x's path that lie behind
        depth = np.zeros(len(i), np.int64)  # elements of the node's path that cannot be met any more
        common = np.ones(len(i), np.int64)
        for level in range(DEPTH + 2):
            wanted = share * size[i] - 1e-6
            ok = (common + left[i] - passed >= wanted + share * self.least[level][node]) & (common + self.slack[level][node] - 1 - depth >= wanted)
            ok &= (self.least[level][node] <= size[i]) & (self.most[level][node] >= t * size[i] - 1e-6)
            i, node, passed, depth, common = i[ok], node[ok], passed[ok], depth[ok], common[ok]
            ends = level == DEPTH + 1
            from_ = (self.starts[level] if ends else self.first[level])[node]
            n = (self.starts[level] if ends else self.first[level])[node + 1] - from_
            of = np.repeat(np.arange(len(i)), n)
            node = from_[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i, passed, depth, common = i[of], passed[of], depth[of], common[of]
            if 0 < level <= DEPTH:
                step = self.steps[level + 1][node]
                path = x["path"][i]
                before = (path < step[:, None]).sum(1)
                met = (path == step[:, None]).any(1)
                inside = before < DEPTH  # beyond x's path the element may be common
                passed = np.maximum(passed, before + met)
                common += met
                depth += inside
        y = self.rows[node]
        a, b = x[i], y
        rest = np.minimum(left[i] - passed, np.maximum(b["n"] - b["pos"] - 1 - depth, 0))
        ok = (common + rest >= share * (a["n"] + b["n"]) - 1e-6) & (b["n"] >= t * a["n"] - 1e-6)
        ok &= (b["n"] < a["n"]) | ((b["n"] == a["n"]) & (b["rep"] < a["rep"]))
        ok &= (a["side"] == 0) | (a["side"] != b["side"])
        return i[ok], node[ok]


def _similar(batches: Iterable[pd.DataFrame], t: float) -> Iterator[pd.DataFrame]:
    """Candidate pairs of every part; its rows come one after the other."""

    def pairs(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        rows = rows[np.argsort(rows["key"], kind="stable")]
        stored = rows[rows["pos"] < index_length(rows["n"].astype(np.int64), t)]
        if not len(stored):
            return
        trie = Trie(stored, t / (1 + t))
        starts = trie.starts[0]
        keys = stored_keys = trie.rows["key"][starts[:-1]]
        at = np.minimum(np.searchsorted(keys, rows["key"]), len(keys) - 1)
        weight = np.where(stored_keys[at] == rows["key"], starts[at + 1] - starts[at], 0)
        rows, weight = rows[weight > 0], weight[weight > 0]
        ends = np.cumsum(weight)
        done = 0
        while done < len(rows):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
            i, j = trie.walk(rows[done:upto], t)
            a, b = rows["rep"][done:upto][i], trie.rows["rep"][j]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            if len(found):
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})
            done = upto

    part, parts = None, []
    for pdf in batches:
        for p, *columns in zip(pdf["part"], *(pdf[f] for f, _ in _PACKED)):
            if p != part:
                if parts:
                    yield from pairs(np.concatenate(parts))
                part, parts = p, []
            key, who, pos, side, path, reps, n = (grams.stretch(c, kind) for c, (_, kind) in zip(columns, _PACKED))
            rows = np.empty(len(key), POSTING)
            rows["key"], rows["rep"], rows["n"], rows["pos"], rows["side"] = key, reps[who], n[who], pos, side
            rows["path"] = path.reshape(-1, DEPTH)
            parts.append(rows)
    if parts:
        yield from pairs(np.concatenate(parts))


def similar_classes(corpus: Corpus, t: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a < b, jaccard: all pairs of class representatives with a similarity of at least ``t``."""
    words = corpus.words
    rows, parts = postings(corpus, t, block)
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.repartition(max(parts, at_least), "part").sortWithinPartitions("part").mapInPandas(lambda it: _similar(it, t), "a bigint, b bigint").distinct()
    small = corpus.each()
    thin = pairs.join(small.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a").join(
        small.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b"
    )

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["ba"]), np.uint64).reshape(len(pdf), -1)
            y = np.frombuffer(b"".join(pdf["bb"]), np.uint64).reshape(len(pdf), -1)
            total = (pdf["na"] + pdf["nb"]).to_numpy(np.int64)
            most = total - 2 * np.ceil(t / (1 + t) * total - 1e-9)
            yield pdf.loc[np.bitwise_count(x ^ y).sum(1) <= most, ["a", "b"]]

    close = stage(thin.mapInPandas(near, "a bigint, b bigint"))
    texts = corpus.texts()
    both = close.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")

    def exact(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in grams.pieces(pdf.assign(text=pdf["x"]), "text"):
                m = len(part)
                who, g = grams.gram_sets([*part["x"], *part["y"]], words)
                n = np.bincount(who, minlength=2 * m)
                pair = who % m
                order = np.lexsort((g, pair))
                same = (pair[order][1:] == pair[order][:-1]) & (g[order][1:] == g[order][:-1])
                c = np.bincount(pair[order][1:][same], minlength=m)
                j = c / (n[:m] + n[m:] - c)
                ok = j >= t - 1e-12
                yield pd.DataFrame({"a": part["a"][ok], "b": part["b"][ok], "jaccard": j[ok]})

    return both.mapInPandas(exact, "a bigint, b bigint, jaccard double")


def near_pairs(pages: DataFrame, t: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """page_id_a < page_id_b: all pairs of different page_ids whose contents reach the similarity.

    Copies are one class while searching and are expanded at the end, as the pairs of all
    page_ids are asked for; ``near_groups`` gives classes instead. Null, empty and too short contents are in no pair;
    redelivered rows change nothing; further columns are ignored.
    """
    corpus = Corpus(pages, words)
    links = similar_classes(corpus, t, block).select("a", "b")
    members = corpus.members
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    own = size.where(F.col("n") > 1).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    # each member meets the others of its own and of linked classes: salted, so that a large class is spread over tasks
    salts = F.ceil(F.col("n") / SALT).cast("int")
    sized = cut(links.unionByName(own).join(size.select(F.col("rep").alias("a"), salts.alias("na")), "a").join(size.select(F.col("rep").alias("b"), salts.alias("nb")), "b"))
    cells = sized.withColumn("sa", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    salted = keyed_join(members, size.select("rep", "n", salts.alias("k")), ["rep"], "n").select("rep", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("salt"), "id")
    met = cells.join(salted.select(F.col("rep").alias("a"), F.col("salt").alias("sa"), F.col("id").alias("x")), ["a", "sa"]).join(
        salted.select(F.col("rep").alias("b"), F.col("salt").alias("sb"), F.col("id").alias("y")), ["b", "sb"]
    )
    met = met.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).where(F.col("x") != F.col("y"))
    return met.select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label: the least node of each connected component, by alternating star contractions.

    Every round links a node's larger, then its smaller neighbours to the least one and is cut in the
    shared folder; the number of rounds grows with the logarithm of the diameter. Nodes with very many neighbours
    are joined without moving these. Only the number of links and a checksum reach the driver.
    """

    def known(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = known(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = keyed_join(both.where(F.col("v") > F.col("u")), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = keyed_join(large, down, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        e = cut(small)
        after = known(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    label = e.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.select("node").join(label.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_groups(pages: DataFrame, t: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """page_id, group_id, class_id, n_links of every page: group_id is the least page_id of its group of near-copies.

    ``class_id`` is the least page_id with the same words, ``n_links`` the number of other classes
    that are similar to it. Pages without a gram are groups of their own with null class_id. One row per page_id.
    """
    corpus = Corpus(pages, words)
    links = cut(similar_classes(corpus, t, block).select("a", "b"))
    labels = components(corpus.each().select(F.col("rep").alias("node")), links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    size = corpus.members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    classes = labels.withColumnRenamed("node", "rep").join(degree, "rep", "left").join(size, "rep")
    known = keyed_join(corpus.members, classes, ["rep"], "n")
    ids = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").alias("id")).distinct()
    return ids.join(known.groupBy("id").agg(F.min_by(F.struct("label", "rep", "n_links"), "rep").alias("k")), "id", "left").select(
        F.col("id").alias("page_id"), F.coalesce("k.label", "id").alias("group_id"), F.col("k.rep").alias("class_id"), F.coalesce("k.n_links", F.lit(0)).alias("n_links")
    )
