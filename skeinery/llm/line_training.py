"""The line classifier of ``boilerplate`` trained on every page of a table, and pages marked by it.

All pages are read twice: for the vocabulary, and to describe their lines into a staged table (``sheets``), from which they are also marked.
Recurrence and weak labels come from aggregations over it. The labelled lines, each different one once with its number, are packed into
blocks of arrays; each round of the fit is a job that sums their gradients, so the weights are those of one fit over all lines, however they are partitioned.
"""

from __future__ import annotations

import gc
import os
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm import boilerplate
from skeinery.llm.boilerplate import _BEGIN, _END, COMMON_HOSTS, KINDS, RECUR, Line, Model, Reader, host_of, structure, structure_names, tokens_of
from skeinery.llm.linear import DIMENSIONS, Features, descend
from skeinery.llm.sheets import Marker, Sheets, facts, pack, unpack
from skeinery.session import shared_dir, stage

#: Of many hosts, a common word stands on at least this share.
COMMON_SHARE = 0.01

#: Word pairs of a smaller share of all pairs take part in the fit, but are not listed in the model, whose size is thus bounded.
PAIR_SHARE = 2.0**-20

#: Lines of a block, and at most so many partial gradients a round.
BLOCK, PARTS = 1 << 15, 64


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the search for reference cycles, of which described lines have none: it takes a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _hash(b: bytes | str) -> int:
    return xxhash.xxh64_intdigest(b) - (1 << 63)


def vocabulary(pages: DataFrame) -> set[str]:
    """The words on enough hosts of the whole table."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, set[str]] = defaultdict(set)

        def flush() -> pd.DataFrame:
            # no token goes over white space, so those of the distinct pieces are all
            pieces = ((h, " ".join(set("\n".join(lines).lower().split()))) for h, lines in seen.items())
            pairs = [(w, _hash(h)) for h, text in pieces for w in {"", *tokens_of(text)} if not w or w[0].isalpha()]
            seen.clear()
            return pd.DataFrame(pairs, columns=["word", "host"])  # the empty word counts the hosts

        held = 0
        for pdf in batches:
            for content, url in zip(pdf["content"], pdf["url"]):
                seen[host_of(url)].update(content.split("\n"))
                held += len(content)
                if held > 1 << 25:
                    yield flush()
                    held = 0
        yield flush()

    counts = stage(pages.select("content", "url").mapInPandas(run, "word string, host long").distinct().groupBy("word").count())
    hosts = next((r["count"] for r in counts.where(F.col("word") == "").collect()), 0)
    enough = max(min(COMMON_HOSTS, max(1, hosts)), int(COMMON_SHARE * hosts))
    return {r.word for r in counts.where((F.col("word") != "") & (F.col("count") >= enough)).collect()}


#: Labels of described lines: known, or open (1 if the line recurs, else content or none).
_CONTENT, _BOILERPLATE, _OPEN, _OPEN_NONE, _NONE = range(5)
#: Word numbers below are kinds of rare words, whose names begin with "<".
_SPECIAL = sum(x[0] == "<" for x in KINDS)


def _state(x: Line, trail: bool, lead: int) -> int:
    y = boilerplate._label(x, False, trail)
    if y == 1:
        return _BOILERPLATE
    can = bool(x.ids) and not x.own or lead >= 0
    if y == 0:
        return _OPEN if can and boilerplate._label(x, True, trail) == 1 else _CONTENT
    return _OPEN_NONE if can else _NONE


def _lead(x: Line) -> int:
    """The common word before a colon at a line's start, or -1."""
    return x.ids[0] if len(x.ids) > 2 and x.names[x.ids[1]] == ":" and x.ids[0] >= len(KINDS) else -1


_LINE = {"no": pa.int32(), "shape": pa.int32(), "state": pa.int8(), "seen": pa.bool_(), "lead": pa.int32(), "facts": pa.int32(), "words": pa.binary()}
_LINE_SQL = "no int, shape int, state byte, seen boolean, lead int, facts int, words binary"


def describe(pages: DataFrame, common: set[str], key: str | None = None) -> DataFrame:
    """Every page of (key,) content, title, url as a sheet: host and topic (hashes), and of each line its number, structure, label so far, whether it may recur,
    first word before a colon, facts for marking and word numbers. Lines of pages without prose have no label."""
    shared = pages.sparkSession.sparkContext.broadcast(common)

    def sheet(reader: Reader, packed: dict, states: dict, ids: array, page: tuple) -> tuple[int, int, list[tuple]]:
        content, title, url = page
        lines = reader.describe(content, title, url)
        prose = boilerplate._has_prose(lines)
        rows = []
        for x, form in zip(lines, structure(lines)):
            shape = packed.get(form)
            if shape is None:
                shape = packed[form] = pack(form)
            ids.fromlist(x.ids)
            if not prose:
                rows.append((x.no, shape, _NONE, False, -1, facts(x), len(x.ids)))
                continue
            lead = _lead(x)
            kind = shape, lead >= 0, len(x.words) <= 20, x.ids[0] < _SPECIAL if x.ids else None, x.marker == "t" and any(t[0].isalpha() for t in x.words)
            state = states.get(kind)
            if state is None:
                state = states[kind] = _state(x, form[-1], lead)
            rows.append((x.no, shape, state, bool(x.ids) and not x.own and not x.site, lead, facts(x), len(x.ids)))
        return _hash(host_of(url)), _hash(boilerplate._topic(lines)), rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        packed: dict[tuple, int] = {}
        states: dict[tuple, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                with _no_cycles():
                    ids = array("i")
                    got = [sheet(reader, packed, states, ids, page) for page in zip(*(batch.column(c).to_pylist() for c in ("content", "title", "url")))]
                    hosts, topics, rows = zip(*got)
                    fields = list(zip(*(r for x in rows for r in x))) or [()] * len(_LINE)
                    *fields, lengths = fields
                    words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.cumsum([0, *lengths], dtype=np.int32) * np.int32(4)), pa.py_buffer(ids.tobytes())])
                    lines = pa.StructArray.from_arrays([*(pa.array(v, t) for v, t in zip(fields, _LINE.values())), words], list(_LINE))
                    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                    out = {"host": pa.array(hosts, pa.int64()), "topic": pa.array(topics, pa.int64()), "lines": pa.ListArray.from_arrays(offsets, lines)}
                    del got, rows, fields
                yield pa.RecordBatch.from_pydict(({key: batch.column(key)} if key else {}) | out)

    kept = f"`{key}` {pages.schema[key].dataType.simpleString()}, " if key else ""
    return pages.where(F.length("content") > 0).select(*[key] * bool(key), "content", "title", "url").mapInArrow(run, f"{kept}host long, topic long, lines array<struct<{_LINE_SQL.replace(' ', ':').replace(',:', ',')}>>")


def labelled(sheets: DataFrame) -> DataFrame:
    """shape, y, n, words: the different lines with a weak label and their number, recurring ones found over the whole table."""
    lines = sheets.select("host", "topic", F.explode("lines").alias("x"))
    x = {k: F.col(f"x.{k}").alias(k) for k in _LINE}
    words_hash = F.xxhash64("x.words").alias("words_hash")
    known = lines.where(F.col("x.state") < _OPEN).select(words_hash, x["shape"], F.col("x.state").cast("double").alias("y"), F.lit(1).cast("long").alias("n"), x["words"])
    maybe = lines.where(F.col("x.state").isin(_OPEN, _OPEN_NONE)).select(words_hash, "host", x["shape"], x["state"], x["seen"], x["lead"], x["words"])
    maybe = maybe.groupBy("words_hash", "host", "shape", "state", "seen", "lead").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    at_host = lines.where("x.seen").select(words_hash, "host", "topic").distinct().groupBy("words_hash", "host").agg(F.count("*").alias("topics"))
    anywhere = at_host.groupBy("words_hash").agg(F.count("*").alias("hosts"), F.sum("topics").alias("topics"), F.max("topics").alias("most"))
    anywhere = anywhere.where(((F.col("hosts") >= RECUR) & (F.col("topics") >= 2 * RECUR)) | (F.col("most") >= RECUR))
    anywhere = anywhere.select("words_hash", ((F.col("hosts") >= RECUR) & (F.col("topics") >= 2 * RECUR)).alias("anywhere"))
    at_host = at_host.where(F.col("topics") >= RECUR).select("words_hash", "host", F.lit(True).alias("here"))
    leads = lines.where("x.lead >= 0").select(x["lead"], "host").distinct().groupBy("lead").count().where(F.col("count") >= RECUR).select("lead", F.lit(True).alias("led"))
    no = F.lit(False)
    found = maybe.join(anywhere, "words_hash", "left").join(at_host, ["words_hash", "host"], "left").join(F.broadcast(leads), "lead", "left")  # leads are common words
    again = (F.col("seen") & (F.coalesce("anywhere", no) | F.coalesce("here", no))) | F.coalesce("led", no)
    y = F.when(again, 1.0).when(F.col("state") == _OPEN, 0.0)
    every = known.unionByName(found.select("words_hash", "shape", y.alias("y"), "n", "words").where("y IS NOT NULL"))
    return every.groupBy("words_hash", "shape", "y").agg(F.sum("n").alias("n"), F.first("words").alias("words")).drop("words_hash")


_ARRAYS = {"y": np.float64, "n": np.float64, "lengths": np.int32, "pair_at": np.int32, "pairs": np.int64, "pair_dims": np.int32, "word_dims": np.int32, "shape_at": np.int32, "shapes": np.int32, "shape_lengths": np.int32, "shape_dims": np.int32}


def blocks(rows: DataFrame, common: set[str]) -> DataFrame:
    """Labelled lines as blocks of arrays: word pairs and structures, each once a block, with their dimensions."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Reader(shared.value).names
        size, f = len(names), Features()
        word_dims = np.array([f["u " + x] for x in names], np.int32)
        word_dims[_END] = DIMENSIONS
        known_pairs: dict[int, int] = {}
        known_shapes: dict[int, list[int]] = {}

        def dimension(pair: int) -> int:
            i = known_pairs.get(pair)
            if i is None:
                if len(known_pairs) > 1 << 20:
                    known_pairs.clear()
                a, b = divmod(pair, size)
                i = known_pairs[pair] = Features.dimension(f"b {names[a]} {names[b]}", DIMENSIONS)
            return i

        def block(held: list[tuple]) -> pa.RecordBatch:
            shape, y, n, words = zip(*held)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) // 4
            tokens = np.frombuffer(b"".join(words), np.int32)
            left = np.full(len(tokens) + len(words), _BEGIN, np.int64)
            right = np.full(len(tokens) + len(words), _END, np.int64)
            place = np.arange(len(tokens)) + np.repeat(np.arange(len(words)), lengths)
            right[place], left[place + 1] = tokens, tokens
            left[np.cumsum(lengths + 1) - lengths - 1] = _BEGIN
            pairs, pair_at = np.unique(left * size + right, return_inverse=True)
            shapes, shape_at = np.unique(np.array(shape, np.int32), return_inverse=True)
            dims = []
            for s in shapes.tolist():
                if s not in known_shapes:
                    known_shapes[s] = [f[x] for x in structure_names(unpack(s))]
                dims.append(known_shapes[s])
            got = {
                "y": y, "n": n, "lengths": lengths + 1, "pair_at": pair_at, "pairs": pairs, "pair_dims": [dimension(p) for p in pairs.tolist()], "word_dims": word_dims[pairs % size],
                "shape_at": shape_at, "shapes": shapes, "shape_lengths": [len(x) for x in dims], "shape_dims": [i for x in dims for i in x],
            }
            return pa.RecordBatch.from_pydict({k: pa.array([np.asarray(v, _ARRAYS[k]).tobytes()], pa.binary()) for k, v in got.items()})

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("shape", "y", "n", "words")))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                del held[:BLOCK]
        if held:
            yield block(held)

    return rows.mapInArrow(run, ", ".join(f"{k} binary" for k in _ARRAYS))


def _stored(packed: DataFrame) -> DataFrame:
    """Blocks in the shared folder: where Python can open it, as files that each round maps into memory; else as a table, in row groups that hold few of them.

    The rows of the result are files or blocks."""
    spark = packed.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not path.startswith("file:"):
        packed.write.options(compression="lz4", **{"parquet.block.size": 16 << 20}).parquet(path)
        return spark.read.schema(packed.schema).parquet(path)
    folder = unquote(urlsplit(path).path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = f"{folder}/{uuid.uuid4().hex}.arrow", None  # another if the task is repeated
        for batch in batches:
            if file is None:
                os.makedirs(folder, exist_ok=True)
                file = pa.ipc.new_file(name, batch.schema)
            for i in range(batch.num_rows):
                file.write_batch(pa.RecordBatch.from_pydict({k: pa.array([batch.column(k)[i].as_buffer().to_pybytes()], pa.binary()) for k in batch.schema.names}, schema=batch.schema))
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return spark.createDataFrame(packed.mapInArrow(run, "file string").collect(), "file string")


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that are files or blocks."""
    for batch in batches:
        if batch.schema.names != ["file"]:
            yield batch
            continue
        for name in batch.column("file").to_pylist():
            yield from _mapped(name)


def _mapped(name: str) -> Iterator[pa.RecordBatch]:
    with pa.memory_map(name) as m:
        file = pa.ipc.open_file(m)
        for i in range(file.num_record_batches):
            yield file.get_batch(i)


def _read(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[list[np.ndarray]]:
    for batch in _batches(batches):
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(k)[i].as_buffer(), _ARRAYS[k]) for k in names]


def fit(packed: DataFrame) -> np.ndarray:
    """Weights of the logistic regression over all lines of the blocks, as ``linear.fit`` has them."""
    sc = packed.sparkSession.sparkContext
    names = ("y", "n", "lengths", "pair_at", "pair_dims", "word_dims", "shape_at", "shape_lengths", "shape_dims")
    parts = min(PARTS, max(1, sc.defaultParallelism))
    if packed.columns == ["file"]:
        files = [r.file for r in packed.collect()]
        held = sc.parallelize(files, max(1, min(parts, len(files)))).flatMap(lambda f: _read(_mapped(f), names))  # nothing of them goes through Spark
    else:
        held = packed.select(*names).coalesce(parts).rdd.map(lambda r: [np.frombuffer(v, _ARRAYS[k]) for k, v in zip(names, r)])
        held.persist(StorageLevel.MEMORY_AND_DISK)  # read once a round
    pos, total = held.map(lambda r: (float(r[0] @ r[1]), float(r[1].sum()))).fold((0.0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    pos, neg = max(1.0, pos), max(1.0, total - pos)

    def gradient(w: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(np.append(w, 0.0))  # the last is for line ends, which are no word

        def run(rows: Iterable[list[np.ndarray]]) -> Iterator[np.ndarray]:
            gc.freeze()  # else the worker searches all it has imported for cycles after each of many short tasks
            w = shared.value
            g = np.zeros(DIMENSIONS + 1)
            place, score = np.zeros(0, np.intp), np.zeros(0)  # kept from block to block: fresh memory costs more than the sums
            for y, n, lengths, pair_at, pair_dims, word_dims, shape_at, shape_lengths, shape_dims in rows:
                if len(place) < len(pair_at):
                    place, score = np.empty(len(pair_at), np.intp), np.empty(len(pair_at))
                at, z = place[: len(pair_at)], score[: len(pair_at)]
                at[:] = pair_at
                shape_owner = np.repeat(np.arange(len(shape_lengths)), shape_lengths)
                of_shape = np.bincount(shape_owner, w[shape_dims], len(shape_lengths))
                of_pair = w[pair_dims] + w[word_dims]
                np.take(of_pair, at, out=z, mode="clip")
                z = np.add.reduceat(z, np.cumsum(lengths) - lengths) + of_shape[shape_at]
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * n * np.where(y > 0.5, 0.5 / pos, 0.5 / neg)
                of_pair = np.bincount(at, np.repeat(e, lengths), len(pair_dims))
                of_shape = np.bincount(shape_at, e, len(shape_lengths))[shape_owner]
                g += np.bincount(np.concatenate([pair_dims, word_dims, shape_dims]), np.concatenate([of_pair, of_pair, of_shape]), DIMENSIONS + 1)
            yield g[:-1]

        got = sum(held.mapPartitions(run).collect(), np.zeros(DIMENSIONS))
        shared.destroy()
        return got

    try:
        return descend(gradient) if total else np.zeros(DIMENSIONS)
    finally:
        held.unpersist()


def train(pages: DataFrame) -> Model:
    """The model of every (content, title, url) of ``pages``."""
    pages = pages.where(F.length("content") > 0)
    common = vocabulary(pages)
    return train_on(stage(describe(pages, common)), common)


def train_on(sheets: DataFrame, common: set[str]) -> Model:
    """The model of staged sheets."""
    packed = _stored(blocks(labelled(sheets), common))
    w = fit(packed)
    names = Reader(common).names
    size = len(names)
    columns = ["n", "lengths", "pair_at", "pairs", "shapes"]

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, lengths, pair_at, pairs, shapes in _read(batches, columns):
            often = np.bincount(pair_at, np.repeat(n, lengths), len(pairs))
            yield pa.RecordBatch.from_pydict({"feature": np.concatenate([pairs, -1 - shapes.astype(np.int64)]), "n": np.concatenate([often, np.zeros(len(shapes))])})

    seen = stage(packed.select(*(packed.columns if packed.columns == ["file"] else columns)).mapInArrow(counts, "feature long, n double").groupBy("feature").agg(F.sum("n").alias("n")))
    pair = F.col("feature") >= 0
    total = seen.where(pair).agg(F.sum("n")).first()[0] or 0.0
    listed = {n for r in seen.where(~pair).toLocalIterator() for n in structure_names(unpack(-1 - r.feature))}
    listed |= {f"u {names[r[0]]}" for r in seen.where(pair).select(F.col("feature") % size).distinct().toLocalIterator() if r[0] != _END}
    often = seen.where(pair & (F.col("n") >= total * PAIR_SHARE)).select("feature").toPandas()["feature"].tolist()
    listed |= {f"b {names[p // size]} {names[p % size]}" for p in often}
    weights = {n: round(float(w[Features.dimension(n, DIMENSIONS)]), 4) for n in sorted(listed)}
    return Model(common, {n: x for n, x in weights.items() if abs(x) > 0.01})


def mark(sheets: DataFrame, key: str, model: Model) -> DataFrame:
    """key, line_no, main of every line of the sheets, as ``boilerplate.main_lines`` has them of their pages."""
    shared = sheets.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column("lines")
                lines, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                no, shape, fact, words = lines.flatten()
                ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
                ids = np.frombuffer(words.buffers()[2] or b"", np.int32, (int(ends[-1]) - int(ends[0])) // 4, int(ends[0]))
                main = marker.mark(Sheets(sizes, shape.to_numpy(), fact.to_numpy(), np.diff(ends) // 4, ids))
                keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_pydict({key: keys, "line_no": no, "main": pa.array(main)})

    kind = sheets.schema[key].dataType.simpleString()
    fields = F.transform("lines", lambda x: F.struct(x["no"].alias("no"), x["shape"].alias("shape"), x["facts"].alias("facts"), x["words"].alias("words")))
    return sheets.select(key, fields.alias("lines")).mapInArrow(run, f"`{key}` {kind}, line_no int, main boolean")
