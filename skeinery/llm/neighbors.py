"""Nearest vectors for every vector, by multi-probe p-stable hashing.

Each table hashes a unit vector with K projections onto lines cut into intervals.
Close vectors fall into the same or adjoining intervals, so a query visits its own
bucket and those reached by the perturbations most likely to succeed, judged by its
distance to the interval borders. The number of projections follows from the number of vectors (a
bucket holds the same number of unrelated ones at any size), the number of tables from the recall that is wanted
at the least cosine.

A vector travels once to each of a few parts per table, where all buckets it visits lie together; there it is compared with
the stored vectors of these buckets, and only its best few go on to the exact ranking, however full a bucket is.

``nearest`` is the exact search: it compares stated queries with all vectors, block by block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinery.llm.grams import squeeze, stretch
from skeinery.operators.skew import keyed_join
from skeinery.session import stage


@dataclass(frozen=True)
class Index:
    """Parameters of the index; recall at these values is measured in the tests, per band of cosines from 0.80 on."""

    width: float = 2.4
    probes: int = 64
    #: Unrelated vectors that a bucket holds on average.
    fill: int = 16
    #: Share of the true neighbours at the least cosine that the tables together find.
    recall: float = 0.98
    #: The cosine that stands for the least one where there is none.
    reach: float = 0.5
    #: Stored vectors of one part; fuller parts are split and visited piece by piece.
    part: int = 1 << 18
    #: Best candidates of a vector in a bucket, besides the k wanted ones, that are ranked exactly.
    spare: int = 3
    seed: int = 12345


#: Parts with more than this share of all stored rows are split: at most 1 / SPLIT_SHARE rows reach the driver to tell which.
SPLIT_SHARE = 1e-5


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The sets of border ranks to perturb, in order of expected success.

    Rank j of 2K stands for a query's j-th nearest border. The expected squared distance of
    that border orders the sets; a set may not cross both borders of one projection (ranks j and
    2K-1-j). Sets are grown from a heap by moving or adding the largest rank.
    """
    k = hashes
    expected = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) for j in range(k)]
    expected += [1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(k, 2 * k)]
    out: list[tuple[int, ...]] = []
    heap = [(expected[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * k - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*ranks, last + 1)))
    return out


def chance(hashes: int, width: float, probes: int, cos: float, n: int = 4000) -> float:
    """Probability that one table brings together two unit vectors of this cosine, one visiting the other, by simulation."""
    rng = np.random.default_rng(hashes)
    u, v = rng.standard_normal((2, n, hashes))
    shift = rng.uniform(0, 1, (n, hashes))
    f = [u / width + shift, (cos * u + math.sqrt(1 - cos * cos) * v) / width + shift]
    sets, met = perturbations(hashes, probes), np.zeros(n, bool)
    for x, y in (f, f[::-1]):
        step = np.floor(y) - np.floor(x)
        low = x - np.floor(x)
        order = np.argsort(np.concatenate([low, 1 - low], 1), 1)
        wanted = np.take_along_axis(np.concatenate([step == -1, step == 1], 1), order, 1)
        near = (np.abs(step) <= 1).all(1)
        met |= near & (wanted.sum(1) == 0)
        for ranks in sets:
            met |= near & (wanted.sum(1) == len(ranks)) & wanted[:, list(ranks)].all(1)
    return float(met.mean())


def _collide(cos: float, width: float) -> float:
    """Probability that one hash puts two unit vectors of this cosine into the same interval."""
    c = math.sqrt(2 - 2 * cos) / width
    return math.erf(1 / c / math.sqrt(2)) - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))


@dataclass(frozen=True)
class Plan:
    """What follows for one model: hashes per table, tables, and lines along which buckets are dealt to parts."""

    n: int
    hashes: int
    tables: int
    lines: int


def plan(n: int, least: float, index: Index) -> Plan:
    shrink = -math.log(_collide(0.0, index.width))
    hashes = max(1, round(math.log(max(n / index.fill, 1)) / shrink))
    p = chance(hashes, index.width, index.probes, least)
    tables = 1 if p >= index.recall else math.ceil(math.log(1 - index.recall) / math.log(1 - max(p, 1e-3)))
    return Plan(n, hashes, tables, max(0, math.ceil(math.log(n / index.part, 4))) if n else 0)


class Hasher:
    """Bucket keys and parts of unit vectors of one model and dimension."""

    def __init__(self, dim: int, model: str, index: Index, plan: Plan):
        rng = np.random.default_rng([index.seed, dim, *model.encode()])
        t, k = plan.tables, plan.hashes
        self.index, self.plan = index, plan
        self.lines = rng.standard_normal((t, dim, k)).astype(np.float32)
        self.shift = rng.uniform(0, index.width, (t, k)).astype(np.float32)
        self.mix = (rng.integers(0, 1 << 62, (t, k), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, t, dtype=np.uint64)
        # buckets whose labels differ in few places mostly lie in the same interval of these lines
        self.across = rng.standard_normal((t, k, plan.lines))
        self.start = rng.uniform(0, 1, (t, plan.lines))
        self.sets = perturbations(k, index.probes)

    def visits(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, 1 + probes) keys of the buckets to visit, the own one first, and of the parts they lie in."""
        at = (x @ self.lines[table] + self.shift[table]) / np.float32(self.index.width)
        floor = np.floor(at)
        mix = self.mix[table]
        low = at - floor
        order = np.argsort(np.concatenate([low, 1 - low], 1), 1)  # nearest border first; below, then above
        key = np.empty((len(x), 1 + len(self.sets)), np.uint64)
        key[:, 0] = (floor.astype(np.int64).view(np.uint64) * mix).sum(1, dtype=np.uint64) + self.salt[table]
        step = np.concatenate([np.zeros_like(mix) - mix, mix])[order]
        for i, ranks in enumerate(self.sets):
            key[:, i + 1] = key[:, 0] + step[:, list(ranks)].sum(1, dtype=np.uint64)
        part = np.full(key.shape, self.salt[table] >> np.uint64(1), np.uint64)
        if self.plan.lines:
            across = self.across[table] / 3
            home = floor @ across + self.start[table]
            change = np.concatenate([-across, across])[order]
            place = np.empty((*key.shape, self.plan.lines), np.int64)
            place[:, 0] = np.floor(home)
            for i, ranks in enumerate(self.sets):
                place[:, i + 1] = np.floor(home + change[:, list(ranks)].sum(1))
            for j in range(self.plan.lines):
                part = (part + place[..., j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return key.view(np.int64), part.view(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, model, embedding of the vectors that count, one row per vec_id.

    Left out: null vectors or ids, a length other than ``dimensions``, null or non-finite
    elements, all zeros.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == F.col("dimensions")))
        .where(~bad & F.exists(e, lambda v: v != 0))
        .select("vec_id", F.coalesce("model", F.lit("")).alias("model"), e.cast("array<float>").alias("embedding"))
        .dropDuplicates(["vec_id"])
    )


def _unit(pdf: pd.DataFrame, kind: type = np.float32) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per model and length in a batch: ids and unit vectors."""
    size = pdf["embedding"].map(len)
    for (model, _), part in pdf.groupby([pdf["model"], size], sort=False):
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield model, part["vec_id"].to_numpy(np.int64), x.astype(kind)


def _hashers(index: Index, plans: dict[tuple[str, int], Plan]):
    made: dict[tuple[str, int], Hasher] = {}

    def get(model: str, dim: int) -> Hasher:
        if (model, dim) not in made:
            made[model, dim] = Hasher(dim, model, index, plans[model, dim])
        return made[model, dim]

    return get


def _batches(batches: Iterable[pd.DataFrame], hashers) -> Iterator[tuple]:
    """Per batch, model and table: hasher, table, model, ids, unit vectors, parts of the visited buckets."""
    for pdf in batches:
        for model, ids, x in _unit(pdf):
            h = hashers(model, x.shape[1])
            for t in range(h.plan.tables):
                yield t, model, ids, x, h.visits(x, t)[1]


def shipments(reps: DataFrame, index: Index, plans: dict[tuple[str, int], Plan]) -> DataFrame:
    """part, piece, role (0 stored and visiting, 1 visiting), model, dim, tab, ids, vectors: packed vectors of a batch for a part."""
    cols = reps.select("vec_id", "model", "embedding")

    def homes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, part in _batches(batches, _hashers(index, plans)):
            own, n = np.unique(part[:, 0], return_counts=True)
            yield pd.DataFrame({"part": own, "n": n})

    stored = sum(p.n * p.tables for p in plans.values())
    limit = max(index.part, int(stored * SPLIT_SHARE))
    full = {}
    if stored > limit:
        counts = cols.mapInPandas(homes, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        full = {r["part"]: -(-r["n"] // index.part) for r in counts.toLocalIterator()}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, model, ids, x, part in _batches(batches, _hashers(index, plans)):
            who, at = np.nonzero(np.ones(part.shape, bool))
            pairs = pd.DataFrame({"who": who, "part": part.reshape(-1), "home": at == 0}).groupby(["part", "who"], sort=True)["home"].any().reset_index()
            pieces = pairs["part"].map(full).fillna(1).to_numpy(np.int64)
            row = np.repeat(np.arange(len(pairs)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            who = pairs["who"].to_numpy()[row]
            role = 1 - (pairs["home"].to_numpy()[row] & (ids[who] % pieces[row] == piece))
            out = pd.DataFrame({"part": pairs["part"].to_numpy()[row], "piece": piece, "role": role, "who": who})
            for (p, i, r), own in out.groupby(["part", "piece", "role"]):
                w = own["who"].to_numpy()
                yield pd.DataFrame(
                    {"part": [p], "piece": [i], "role": [r], "model": [model], "dim": [x.shape[1]], "tab": [t], "ids": [squeeze(ids[w])], "vectors": [np.ascontiguousarray(x[w]).tobytes()]}
                )

    return cols.mapInPandas(run, "part bigint, piece bigint, role int, model string, dim int, tab int, ids binary, vectors binary")


class Buckets:
    """The stored vectors of a part by bucket."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(keys))

    def best(self, ids: np.ndarray, x: np.ndarray, keys: np.ndarray, least: float, keep: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of visitors and of the stored vectors that are their ``keep`` best over the visited buckets, from ``least`` on."""
        flat = keys.reshape(-1)
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == flat)
        hit = hit[np.argsort(at[hit], kind="stable")]
        buckets, first = np.unique(at[hit], return_index=True)
        who, lasts = hit // keys.shape[1], np.append(first[1:], len(hit))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b, lo, hi in zip(buckets.tolist(), first.tolist(), lasts.tolist()):
            s, e = int(self.starts[b]), int(self.ends[b])
            y, own = self.x[s:e].T, self.ids[s:e]
            for i in range(lo, hi, step := max(1, most // (e - s))):
                w = who[i : min(i + step, hi)]
                cos = x[w] @ y
                cos[ids[w][:, None] == own] = -2
                ok = cos >= least
                if e - s > keep:
                    many = np.flatnonzero(ok.sum(1) > keep)
                    if len(many):  # distances from the bucket's middle tell apart what cosines in single precision cannot
                        middle = y.mean(1)
                        u, v = x[w[many]] - middle, y - middle[:, None]
                        far = (v * v).sum(0) - 2 * (u @ v)
                        far[~ok[many]] = np.inf
                        ok[many] &= far <= np.partition(far, keep - 1, 1)[:, keep - 1, None]
                r, c = np.nonzero(ok)
                found.append((w[r], s + c))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w, s = (np.concatenate(c) for c in zip(*found))
        w, s = np.divmod(np.unique(w * np.int64(len(self.ids)) + s), len(self.ids))
        far = np.concatenate([((x[w[i : i + 65536]] - self.x[s[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(w), 65536)] or [np.empty(0, np.float32)])
        order = np.lexsort((far, w))
        w, s = w[order], s[order]
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        rank = np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        return w[rank < keep], s[rank < keep]


def _meet(batches: Iterable[pd.DataFrame], index: Index, plans: dict, least: float, keep: int, most: int = 8192) -> Iterator[pd.DataFrame]:
    """Candidate pairs of every piece of a part; its rows come together, the stored ones first."""
    hashers = _hashers(index, plans)
    last, stored, buckets = None, [], None

    def candidates(ids: np.ndarray, x: np.ndarray, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        w, s = buckets.best(ids, x, keys, least, keep)
        a, b = ids[w], buckets.ids[s]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        if len(pairs):
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def settle() -> Iterator[pd.DataFrame]:
        nonlocal buckets
        if stored:
            ids, x, keys = (np.concatenate(c) for c in zip(*stored))
            stored.clear()
            buckets = Buckets(ids, x, keys[:, 0])
            for i in range(0, len(ids), most):
                yield from candidates(ids[i : i + most], x[i : i + most], keys[i : i + most])

    for pdf in batches:
        for part, piece, role, model, dim, tab, ids, vectors in pdf.itertuples(index=False):
            if (part, piece) != last:
                yield from settle()
                last, buckets = (part, piece), None
            ids = stretch(ids, np.int64)
            x = np.frombuffer(vectors, np.float32).reshape(-1, dim)
            keys = hashers(model, dim).visits(x, tab)[0]
            if role == 0:
                stored.append((ids, x, keys))
                continue
            yield from settle()
            if buckets is not None:
                yield from candidates(ids, x, keys)
    yield from settle()


def neighbor_pairs(vectors: DataFrame, min_cos: float | None = 0.8, k: int = 5, index: Index | None = None) -> DataFrame:
    """Directed neighbours: vec_id, other_id, cos, rank (1..k), for every usable vector.

    ``other_id`` is among the k most similar vectors of the same model that reach ``min_cos``;
    equals are ranked by id. Without ``min_cos`` the index is laid out for ``index.reach`` and finds fewer of the
    neighbours beyond that; ``nearest`` is exact. Equal vectors are searched once as a class and expanded to
    the k first members only, so that copies cost no pairs. An empty table gives an empty result.
    """
    index = index or Index()
    members, reps = _classes(vectors)
    sizes = reps.groupBy("model", F.size("embedding").alias("dim")).count().collect()  # one row per model and length
    plans = {(r["model"], r["dim"]): plan(r["count"], index.reach if min_cos is None else min_cos, index) for r in sizes}
    rows = shipments(reps, index, plans).repartition("part", "piece").sortWithinPartitions("part", "piece", "role")
    least, keep = -1.0 if min_cos is None else min_cos - 2e-3, k + index.spare
    pairs = rows.mapInPandas(lambda it: _meet(it, index, plans, least, keep), "a bigint, b bigint").distinct()
    vec = reps.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scored = (
        pairs.join(vec.select(F.col("vec_id").alias("a"), F.col("e").alias("ea")), "a")
        .join(vec.select(F.col("vec_id").alias("b"), F.col("e").alias("eb")), "b")
        .select("a", "b", (dot(F.col("ea"), F.col("eb")) / F.sqrt(dot(F.col("ea"), F.col("ea")) * dot(F.col("eb"), F.col("eb")))).alias("cos"))
    )
    if min_cos is not None:
        scored = scored.where(F.col("cos") >= min_cos)
    both = scored.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other"), "cos"), F.struct(F.col("b").alias("rep"), F.col("a").alias("other"), "cos"))).alias("p")).select("p.*")
    best = W.partitionBy("rep").orderBy(F.desc("cos"), "other")
    return _expanded(members, members, reps, both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), k)


def _scan(batches: Iterable[pd.DataFrame], k: int, most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """The k most similar stored rows of each visiting row of a cell, with equals by id; rows come sorted."""
    last, ids, parts = None, [], []
    x = own = None
    for pdf in batches:
        for (cell, probe), rows in pdf.groupby(["cell", "probe"], sort=False):
            if cell != last:
                last, ids, parts, x = cell, [], [], None
            ((_, some, y),) = _unit(rows, np.float64)
            if probe == 0:
                ids.append(some)
                parts.append(y)
                continue
            if x is None and not parts:  # an empty block
                continue
            if x is None:
                x, own = np.concatenate(parts), np.concatenate(ids)
                ids, parts = [], []
            for at in range(0, len(y), step := max(1, most // len(x))):
                cos = y[at : at + step] @ x.T
                me = some[at : at + step]
                cos[me[:, None] == own] = -2
                n = min(k, len(own))
                least = np.partition(cos, len(own) - n, 1)[:, len(own) - n]
                i, j = np.nonzero((cos >= least[:, None] - 1e-11) & (cos > -2))
                found = pd.DataFrame({"rep": me[i], "other": own[j], "cos": cos[i, j]})
                found["near"] = -found["cos"].round(12)
                yield found.sort_values(["rep", "near", "other"]).groupby("rep").head(k)[["rep", "other", "cos"]]


def nearest(vectors: DataFrame, k: int = 5, block: int = 8192, asked: Column | None = None) -> DataFrame:
    """Directed neighbours: vec_id, other_id, cos, rank (1..k), exact and however far, for the usable vectors that ``asked`` picks by vec_id (all, if none).

    ``other_id`` is among the k most similar vectors of the same model and length; equals (to 12
    digits) are ranked by id. A vector has fewer than k only if there are no more. The rows of a model are
    dealt into blocks of about ``block``; every block of queries meets every block of vectors in a cell of its own, so the time grows with
    queries times rows and no task holds more than one block. Meant for a stated set of queries; ``neighbor_pairs`` is the index for all.
    """
    asked = F.lit(True) if asked is None else asked
    members, reps = _classes(vectors, asked)
    rows = reps.select("model", F.size("embedding").alias("dim"), "vec_id", "embedding", "asked")
    sizes = rows.groupBy("model", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    dealt = rows.join(F.broadcast(sizes), ["model", "dim"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("n")))
    each = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = lambda probe, visiting, stored: each.select(F.concat_ws("-", visiting, stored, "dim", "model").alias("cell"), F.lit(probe).alias("probe"), "vec_id", "model", "embedding", "asked")
    cells = side(0, "met", "own").unionByName(side(1, "own", "met").where("asked")).drop("asked").repartition("cell").sortWithinPartitions("cell", "probe")
    found = cells.mapInPandas(lambda it: _scan(it, k), "rep bigint, other bigint, cos double")
    best = W.partitionBy("rep").orderBy(F.desc(F.round("cos", 12)), "other")
    return _expanded(members.where(asked), members, reps.where("asked"), found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), k)


def _classes(vectors: DataFrame, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The usable vectors with their class of equal vectors, and the first of every class with the class's size n and whether ``asked`` picks a member."""
    asked = F.lit(True) if asked is None else asked
    good = usable(vectors).withColumn("cls", F.concat_ws("-", F.xxhash64("model", F.size("embedding"), "embedding"), F.xxhash64(F.lit("second"), "embedding", "model")))
    members = stage(good)
    reps = stage(members.groupBy("cls").agg(F.min("vec_id").alias("vec_id"), F.min_by(F.struct("model", "embedding"), "vec_id").alias("r"), F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked")).select("cls", "vec_id", "r.model", "r.embedding", "n", "asked"))
    return members, reps


def _expanded(visiting: DataFrame, members: DataFrame, reps: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """Neighbours of the visiting members from the k nearest classes of every class (rep, other, cos)."""
    by_class = W.partitionBy("cls")
    # the first members of a class stand for all of them as neighbours; one more, as none is its own
    first = (
        members.withColumn("r", F.row_number().over(by_class.orderBy("vec_id"))).where(F.col("r") <= k + 1)
        .groupBy("cls").agg(F.collect_list("vec_id").alias("ids"), F.min("vec_id").alias("rep"))
    )
    near = top.join(first.select(F.col("rep").alias("other"), "ids"), "other").select("rep", F.explode("ids").alias("other_id"), "cos")
    own = first.where(F.size("ids") > 1).select("rep", F.explode("ids").alias("other_id"), F.lit(1.0).alias("cos"))
    lists = near.unionByName(own).withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc(F.round("cos", 12)), "other_id"))).where(F.col("r") <= k + 1)
    listed = lists.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("r", "other_id", "cos"))).alias("found"))
    of_class = reps.select("cls", F.col("vec_id").alias("rep"), "n").join(listed, "rep")
    out = keyed_join(visiting.select("vec_id", "cls"), of_class, ["cls"], "n").select("vec_id", F.slice(F.filter("found", lambda s: s["other_id"] != F.col("vec_id")), 1, k).alias("found"))
    return out.select("vec_id", F.posexplode("found").alias("pos", "f")).select("vec_id", "f.other_id", "f.cos", (F.col("pos") + 1).alias("rank"))


def undirected(neighbors: DataFrame) -> DataFrame:
    """vec_id_a < vec_id_b of the pairs in which one is a neighbour of the other."""
    return neighbors.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()
