"""Neighbours, near-duplicates, mixing and the queries over the test tables."""

import os
import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinery.llm import grams, mix, neardup, neighbors, queries

DATA = "/root/testdata/sf0.001"


# --- neighbours -------------------------------------------------------------------------------------------


def brute_neighbors(rows, k, floor):
    out = {}
    for key, model, x in rows:
        near = []
        for other, m2, y in rows:
            if other != key and m2 == model and len(x) == len(y):
                c = float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
                if c >= floor:
                    near.append((-round(c, 9), other))
        out[key] = [o for _, o in sorted(near)[:k]]
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 6, dim))
    return np.float32(np.repeat(centers, 6, 0) + rng.standard_normal((n // 6 * 6, dim)) * 0.25)


def test_neighbor_recall(spark):
    rows = [(i, "m", x.astype(float)) for i, x in enumerate(clustered(600, 64, 1))]
    rows += [(1000 + i, "m", rows[0][2]) for i in range(9)] + [(2000 + i, "s", x.astype(float)) for i, x in enumerate(clustered(120, 48, 2))]
    df = spark.createDataFrame([(i, m, len(x), x.tolist()) for i, m, x in rows], "vec_id long, model string, dimensions int, embedding array<float>")
    want = brute_neighbors([(i, m, np.float32(x).astype(float)) for i, m, x in rows], 5, 0.8)
    got: dict = {}
    for r in neighbors.neighbor_pairs(df).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.other_id)
    true = {(a, b) for a, v in want.items() for b in v}
    mine = {(a, b) for a, v in got.items() for b in v}
    assert len(true & mine) / len(true) >= 0.97
    assert got[1003] == want[1003] and got[0] == want[0]  # copies are ranked by id


def test_recall_per_band(spark):
    """Planted pairs in each band, from the floor itself on; one seed of pairs, all among vectors far from each other."""
    rng = np.random.default_rng(11)
    bands = [(0.8, 0.8001), (0.8, 0.82), (0.82, 0.85), (0.85, 0.88), (0.88, 0.92)]
    rows, band = [], {}
    for n, (low, high) in enumerate(bands):
        for i in range(400):
            a, b = rng.standard_normal((2, 64))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            c = rng.uniform(low + 1e-5, high)
            at = 2 * (n * 400 + i)
            rows += [(at, "m", 64, a.tolist()), (at + 1, "m", 64, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
            band[at, at + 1] = n
    df = spark.createDataFrame(rows, "vec_id long, model string, dimensions int, embedding array<float>")
    found = {tuple(r) for r in neighbors.undirected(neighbors.neighbor_pairs(df)).collect()}
    recall = [sum(n == m and p in found for p, m in band.items()) / 400 for n in range(len(bands))]
    assert min(recall) >= 0.9, recall


@pytest.mark.parametrize("block", [8192, 70])
def test_nearest_have_no_floor(spark, block):
    rng = np.random.default_rng(3)
    far = [(i, "m", np.float32(x).astype(float)) for i, x in enumerate(rng.standard_normal((300, 64)))]
    rows = far + [(1000 + i, "m", far[0][2]) for i in range(9)] + [(1100 + i, "m", far[1][2] * 2) for i in range(3)]
    rows += [(2000 + i, "s", np.float32(x).astype(float)) for i, x in enumerate(rng.standard_normal((4, 48)))] + [(3000, "alone", far[0][2])]
    df = spark.createDataFrame([(i, m, len(x), x.tolist()) for i, m, x in rows], "vec_id long, model string, dimensions int, embedding array<float>")
    got: dict = {}
    for r in neighbors.nearest(df, block=block).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.other_id)
    want = brute_neighbors(rows, 5, -1)
    assert want.pop(3000) == [] and got == want
    assert {len(got[i]) for i, m, _ in rows if m == "m"} == {5} and {len(got[2000 + i]) for i in range(4)} == {3}


def test_asked_queries_only(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "m", np.float32(x).astype(float)) for i, x in enumerate(rng.standard_normal((120, 16)))]
    rows += [(200 + i, "m", rows[7][2]) for i in range(8)]  # a class of copies of which only 200 is asked
    df = spark.createDataFrame([(i, m, len(x), x.tolist()) for i, m, x in rows], "vec_id long, model string, dimensions int, embedding array<float>")
    got: dict = {}
    for r in neighbors.nearest(df, block=50, asked=F.col("vec_id") % 50 == 0).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.other_id)
    want = brute_neighbors(rows, 5, -1)
    assert got == {i: want[i] for i in (0, 50, 100, 200)}


def test_recall_without_floor(spark):
    """Top 5 of clustered vectors whose neighbours lie at cosines from about 0.5 up; vectors far from all others are left to the exact search."""
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((150, 64))
    x = np.repeat(centers, 8, 0) + rng.standard_normal((1200, 64)) * np.repeat(rng.uniform(0.3, 0.85, 150), 8)[:, None]
    rows = [(i, "m", np.float32(v).astype(float)) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, m, len(v), v.tolist()) for i, m, v in rows], "vec_id long, model string, dimensions int, embedding array<float>")
    got = {(r.vec_id, r.other_id) for r in neighbors.neighbor_pairs(df, min_cos=None).collect()}
    want = {(a, b) for a, v in brute_neighbors(rows, 5, -1).items() for b in v}
    assert len(got & want) / len(want) >= 0.9


def test_candidates_grow_with_the_cluster(spark):
    """Vectors of one dense cluster share all buckets; candidates stay in proportion to their number."""
    per_row = []
    for n in (1000, 2000, 4000):
        rng = np.random.default_rng(n)
        x = rng.standard_normal(64) + rng.standard_normal((n, 64)) * 0.01
        df = spark.createDataFrame([(i, "m", 64, v.tolist()) for i, v in enumerate(x)], "vec_id long, model string, dimensions int, embedding array<float>")
        index = neighbors.Index()
        reps = neighbors._classes(df)[1]
        plans = {("m", 64): neighbors.plan(n, 0.8, index)}
        rows = neighbors.shipments(reps, index, plans).repartition("part", "piece").sortWithinPartitions("part", "piece", "role")
        pairs = rows.mapInPandas(lambda it: neighbors._meet(it, index, plans, 0.798, 8), "a bigint, b bigint")
        per_row.append(pairs.count() / n / plans["m", 64].tables)
    assert max(per_row) <= 8 and per_row[2] < 1.3 * per_row[0]


def test_full_buckets_are_split(spark):
    base = np.random.default_rng(5).standard_normal(64)
    near = np.random.default_rng(6).standard_normal((300, 64)) * 1e-3
    rows = [(i, "m", 64, (base + v).tolist()) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "vec_id long, model string, dimensions int, embedding array<float>")
    whole = {tuple(r) for r in neighbors.undirected(neighbors.neighbor_pairs(df)).collect()}
    parts = {tuple(r) for r in neighbors.undirected(neighbors.neighbor_pairs(df, index=neighbors.Index(part=64))).collect()}
    assert whole == parts and len(whole) >= 750


def test_neighbor_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "m", 2, [1.0, 0.0]), (2, "m", 2, [2.0, 0.0]), (3, "m", 2, [1.0]), (4, "m", 2, None), (5, "m", 2, [0.0, 0.0]), (6, "m", 2, [nan, 1.0]), (7, "m", 2, [inf, 1.0]), (8, None, 2, [1.0, 0.0]), (None, "m", 2, [1.0, 0.0]), (9, "m", None, [1.0, 0.0]), (1, "m", 2, [1.0, 0.0]), (10, "m", 2, [1.0, None])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, model string, dimensions int, embedding array<float>, cls string")
    assert {tuple(r) for r in neighbors.undirected(neighbors.neighbor_pairs(df)).collect()} == {(1, 2)}
    assert neighbors.neighbor_pairs(df.limit(0)).count() == 0


def test_probe_order():
    sets = neighbors.perturbations(6, 20)
    assert sets[0] == (0,) and len(set(sets)) == 20
    assert all(11 - a != b for s in sets for a, b in combinations(s, 2))


# --- near-duplicates ------------------------------------------------------------------------------------------


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary)]
        out.append((i, " ".join(words)))
    return out


def brute_pairs(rows, t, words=3):
    import re

    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        s = set(zip(*[w[j:] for j in range(words)]))
        if s and key is not None:
            sets[key] = s
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("t,block", [(0.6, 2048), (0.6, 3), (0.8, 2048), (0.45, 5)])
def test_near_pairs_against_brute_force(spark, t, block):
    rows = texts(160, 7)
    df = spark.createDataFrame(rows, "page_id long, content string")
    got = {tuple(r) for r in neardup.near_pairs(df, t, block=block).collect()}
    assert got == brute_pairs(rows, t)


def test_one_text_copied_many_times(spark):
    """50,000 copies and 200 edits of one text: one class, every copy in the group, no pairs of copies anywhere."""
    words = [f"w{i}" for i in range(60)]
    copies = spark.range(50_000).select(F.col("id").alias("page_id"), F.lit(" ".join(words)).alias("content"))
    edits = spark.createDataFrame([(100_000 + i, " ".join([*words[:50], f"own{i}", *words[51:]])) for i in range(200)], "page_id long, content string")
    groups = neardup.near_groups(copies.unionByName(edits))
    got = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_id").alias("classes"), F.min("n_links").alias("least"), F.max("n_links").alias("most")).collect()
    assert [tuple(r) for r in got] == [(0, 50_200, 201, 200, 200)]


def test_frequency_steps():
    n = np.array([1, 2, 31, 32, 33, 1000, 10**6])
    steps = grams.step_of(n)
    assert (np.diff(steps.astype(int)) >= 0).all() and (grams.most_of(steps) >= n).all() and steps[0] == 1
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000)).astype(np.uint64)
    assert (grams.stretch(grams.squeeze(a), np.uint64) == a).all()


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_trie_loses_no_similar_pair(t):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 400, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.3), rng.integers(0, 400, 60), base)) for _ in range(120)]
    who = np.repeat(np.arange(120), [len(x) for x in sets])
    g = (np.concatenate(sets).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(5)
    order = np.lexsort((g, who))
    who, g = who[order], g[order]
    steps = grams.step_of(np.unique(g, return_counts=True)[1])
    rows = neardup.block_postings(np.arange(120), who, g, steps, t, 16)
    packed = {"part": [0]} | {f: [grams.squeeze(c)] for (f, _), c in zip(neardup._PACKED, (rows["key"], rows["rep"].astype(np.uint16), rows["pos"], rows["side"], np.ascontiguousarray(rows["path"]).reshape(-1), np.arange(120), np.bincount(who).astype(np.int32)))}
    got = {tuple(p) for df in neardup._similar([pd.DataFrame(packed)], t) for p in df.to_numpy().tolist()}
    want = {(i, j) for i, j in combinations(range(120), 2) if len(np.intersect1d(sets[i], sets[j])) >= t * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert want and want <= got


def test_near_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One, two three!"), (5, "one two three"), (4, "One, two three!"), (None, "one two three"), (6, long), (7, long + " more"), (8, "different words here")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, content string, rep long")
    assert {tuple(r) for r in neardup.near_pairs(df).collect()} == {(4, 5), (6, 7)}
    groups = {r.page_id: (r.group_id, r.class_id, r.n_links) for r in neardup.near_groups(df).collect()}
    assert groups == {1: (1, None, 0), 2: (2, None, 0), 3: (3, None, 0), 4: (4, 4, 0), 5: (4, 4, 0), 6: (6, 6, 1), 7: (6, 7, 1), 8: (8, 8, 0)}
    assert neardup.near_pairs(df.limit(0)).count() == 0 and neardup.near_groups(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    parent = {i: i for i in range(170)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = spark.range(170).select(F.col("id").alias("node"))
    got = neardup.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: root(i) for i in range(170)}


# --- mixing ------------------------------------------------------------------------------------------------------


def test_schedule_keeps_within_one_block():
    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}
    got = mix.schedule(weights, 600)
    count = dict.fromkeys(weights, 0)
    for slot, (s, block, at) in enumerate(sorted(got, key=lambda r: r[2])):
        assert at == slot and block == count[s]
        count[s] += 1
        assert all(abs(count[k] - w * (slot + 1)) < 1 for k, w in weights.items())
    assert mix.schedule({}, 10) == []


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, "big" if i % 3 else "small", rng.randint(5, 50)) for i in range(900)] + [(900 + i, None, 10) for i in range(5)] + [(910, "other", 10), (911, "big", 0), (912, "big", None), (1, "big", 10)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n_tokens int, slot string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed = mix.mix(df, targets, slots=200)
    got = mixed.collect()
    used = {}
    for r in got:
        used[r.doc_id] = used.get(r.doc_id, 0) + 1
    assert max(used.values()) <= 3 and all(used[r.doc_id] == 1 for r in got if r.source == "big")
    assert {r.source for r in got} == {"big", "small"}
    s = {r.source: r for r in mix.shares(mixed, targets).collect()}
    total = s["big"].tokens + s["small"].tokens
    assert abs(s["big"].tokens / total - 5 / 9) < 50 / total and s["none"].reached_share == 0
    # interleaved: at any point each source is within a block and a document of its share
    run = {"big": 0, "small": 0}
    for r in sorted(got, key=lambda r: (r.slot, r.source, r.place)):
        run[r.source] += r.n_tokens
        assert abs(run["big"] - 5 / 9 * sum(run.values())) < total / 200 + 100
    assert mix.mix(df.limit(0), targets).count() == 0 and mix.mix(df, targets.limit(0)).count() == 0


# --- queries over the tables ---------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.endswith(("_found", "_ids", "_mix", "_shares", "_groups", "_pieces"))])
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() == df.dropDuplicates([c for c, k in df.dtypes if not k.startswith("array")]).count()
