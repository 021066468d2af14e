"""Boilerplate, splitting, repeated lines, residue, encoding and sentences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinery.llm import boilerplate, encode, line_training, lines, maxflow, queries, residue, sentences, split
from skeinery.session import stage


# --- minimum cut -----------------------------------------------------------------------------------------


def cut_cost(gain, edges, side):
    return sum(-g for g, s in zip(gain, side) if not s and g > 0) * -1 + sum(-g for g, s in zip(gain, side) if s and g < 0) + sum(c for a, b, c in edges if side[a] != side[b])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 5)), max_size=14))
def test_minimum_cut_is_minimal(gain, edges):
    n = len(gain)
    edges = [(a % n, b % n, c) for a, b, c in edges]
    got = maxflow.minimum_cut(gain, edges)
    best = min(cut_cost(gain, edges, [bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
    assert cut_cost(gain, edges, got) == pytest.approx(best)


# --- main content ------------------------------------------------------------------------------------------


def made_pages(hosts=12, per_host=8, seed=1):
    """Pages of invented sites: menu, notice, article of an own subject, related titles, footer."""
    rng = random.Random(seed)
    nouns = "garden engine river market letter window signal planet kettle bridge lantern harbor ticket mirror".split()
    verbs = "moves holds finds keeps turns draws counts".split()
    out = []
    for h in range(hosts):
        site = f"sitename{h:02d}x".replace("0", "o").replace("1", "i").replace("2", "e")
        for i in range(per_host):
            topic = "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize()
            prose = [" ".join(f"The {rng.choice(nouns)} of {topic} {rng.choice(verbs)} the {rng.choice(nouns)} near a {rng.choice(nouns)}." for _ in range(3)) for _ in range(4)]
            other = "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize()
            top = ["Home | News | Contact | Sign in", f"We store cookies on {site.capitalize()} to count visits"]
            body = [f"# The {topic} handbook", *prose[:2], f"## More about {topic}", *prose[2:]]
            end = ["Related articles", f"- The {other} handbook", f"- Notes on {other}", "Share this page with your friends", f"Copyright 20{i:02d} by {site.capitalize()}"]
            all_lines = top + body + end
            truth = [False] * len(top) + [True] * len(body) + [False] * len(end)
            out.append(("\n".join(all_lines), f"The {topic} handbook", f"https://www.{site}.test/{topic.lower()}", truth))
    return out


def test_main_lines_of_unseen_sites(spark):
    pages = made_pages()
    model = boilerplate.train_model([(c, t, u) for c, t, u, _ in pages[:64]])
    right = total = 0
    for c, t, u, truth in pages[64:]:
        _, main = model.label(c, t, u)
        right += sum(a == b for a, b in zip(main, truth))
        total += len(truth)
    assert right / total > 0.95


def test_main_lines_edge_cases(spark):
    model = boilerplate.train_model([(c, t, u) for c, t, u, _ in made_pages(4, 4)])
    df = spark.createDataFrame(
        [(1, None, None, None, "x"), (2, "", "t", "u", "x"), (3, " \n\n ", "t", "u", "x"), (4, "word", None, None, "x"), (5, "a " * 200_000, "t", "", "x"), (4, "word", None, None, "x"), (None, "text", "t", "u", "x")],
        "page_id long, content string, title string, url string, main string",
    )
    got = boilerplate.main_lines(df, "page_id", model).collect()
    assert {r.page_id for r in got} == {4, 5} and all(r.line_no == 0 for r in got)
    texts = {r.page_id: r.content for r in boilerplate.main_text(df, "page_id", model).collect()}
    assert set(texts) == {1, 2, 3, 4, 5} and texts[1] == texts[2] == ""
    assert boilerplate.main_lines(df.limit(0), "page_id", model).count() == 0
    assert boilerplate.train_model([]).label("any text", None, None)[1] in ([True], [False])


def same_model(got, want):
    assert got.common == want.common
    assert set(got.weights) ^ set(want.weights) <= {n for m in (got, want) for n, x in m.weights.items() if abs(x) < 0.02}
    assert all(abs(x - want.weights.get(n, x)) < 0.01 for n, x in got.weights.items())


def test_whole_table_training_equals_one_fit(spark):
    pages = [(c, t, u) for c, t, u, _ in made_pages()]
    df = spark.createDataFrame([*pages, (None, "t", "u"), ("", None, None)], "content string, title string, url string")
    want = boilerplate.train_model(pages)
    same_model(line_training.train(df.repartition(5)), want)
    assert line_training.train(df.limit(0)).label("any text", None, None)[1] in ([True], [False])


def odd_pages():
    pages = [(c, t, u) for c, t, u, _ in made_pages(12, 8)]
    rng = random.Random(3)
    mixed = []
    for (c, t, u), (d, t2, u2) in zip(pages, reversed(pages)):
        ls = c.split("\n") + d.split("\n")[:5] + ["TODO: {{name}}", "| a | b |", "1. one", "2. two", "Home > News > Day", "[all](x)", "Größe ΑΣ Σ 12h 中文。", ""]
        rng.shuffle(ls)
        mixed.append(("\n".join(["```", *ls[:3], "```", *ls[3:]]), rng.choice([t, t2, None, ""]), rng.choice([u, u2, None])))
    return pages, mixed + [("word", None, None), (" \n\n ", "t", "u"), ("", "t", "u"), (None, "t", "u"), ("a " * 70_000, "t", "")]


def test_pages_are_described_once(spark, monkeypatch):
    """Marking reads the sheets that training was made of, and marks as the lines themselves are marked."""
    pages, odd = odd_pages()
    model = boilerplate.train_model(pages)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages + odd)], "id long, content string, title string, url string").repartition(3)
    described = line_training.describe(df, model.common, "id").persist()
    want = {tuple(r) for r in boilerplate.main_lines(df, "id", model).collect()}
    got = line_training.mark(described, "id", model).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    monkeypatch.setattr(line_training, "describe", None)
    assert line_training.train_on(described, model.common).common == model.common


def test_equal_lines_are_packed_once(spark):
    """Copies of a table add no lines to the fit but weigh in it; blocks are the same as files and as a table."""
    pages, _ = odd_pages()
    df = spark.createDataFrame(pages, "content string, title string, url string")
    common = line_training.vocabulary(df)
    once, thrice = (line_training.labelled(stage(line_training.describe(x, common))) for x in (df, df.unionByName(df).unionByName(df)))
    key = ["shape", "y", "words"]
    assert once.groupBy(key).count().where("count > 1").count() == 0
    assert {(*r[:2], bytes(r.words), 3 * r.n) for r in once.select(*key, "n").collect()} == {(*r[:2], bytes(r.words), r.n) for r in thrice.select(*key, "n").collect()}
    packed = line_training.blocks(once, common)
    files = line_training._stored(packed)
    assert files.columns == ["file"]
    assert abs(line_training.fit(files) - line_training.fit(packed)).max() < 1e-9


def test_tokens_of_ascii():
    for text in ("", "a B", "x1y22 : /a?b", "\x00\x1c\tA_b-c's {d}", "é a", "A" * 300 + " 7"):
        assert boilerplate.tokens_of(text) == boilerplate._TOKEN.findall(text.lower())


def test_every_page_has_a_say(spark, tmp_path):
    """A notice on few pages of a large table is known only if none is left out of the training."""
    pages = [(c, t, u) for c, t, u, _ in made_pages(hosts=40, per_host=75)]
    notice = "Window a near letter the keeps garden"
    rare = [c.replace("Share this page", f"{notice}\nShare this page") for c, _, _ in pages[:3]]
    pages = [(r, t, u) for r, (_, t, u) in zip(rare, pages)] + pages[3:]
    rows = [(i, *p) for i, p in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, content string, title string, url string").write.parquet(f"{tmp_path}/page_records.parquet")
    spark.createDataFrame([], "result_id long, content string, title string, url string").write.parquet(f"{tmp_path}/crawl_results.parquet")
    model = queries._line_model(spark.read.parquet(f"{tmp_path}/page_records.parquet"), spark.read.parquet(f"{tmp_path}/crawl_results.parquet"))
    tokens = next(x for x in model.reader.describe(*pages[0]) if x.text == notice).tokens
    assert set(zip(tokens, tokens[1:])) <= model.double


# --- splitting ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,!?\n#é中🙂́‍ ", min_size=0, max_size=3000), st.integers(40, 200), st.integers(0, 12))
def test_split_covers_text(text, limit, overlap):
    raw, pieces = split.cut_positions(text, limit, overlap)
    assert raw == text.encode()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)
    for a, b in pieces:
        assert split.tokens_of(b - a) <= limit
        raw[a:b].decode()
    for (_, b), (c, _) in zip(pieces, pieces[1:]):
        assert c <= b and (not overlap or overlap - 1 <= split.tokens_of(b - c) <= overlap)


def test_split_prefers_strong_boundaries():
    text = "word " * 300 + "\n\n" + "word " * 400
    raw, pieces = split.cut_positions(text)
    assert pieces[0][1] == 1502
    flat = "x" * 5000
    assert [b - a for a, b in split.cut_positions(flat)[1]] == [2047, 2047, 5000 - 2 * 2047 + 2 * 199]
    heading = "a. " * 400 + "\n# Part\n" + "b. " * 400
    assert split.cut_positions(heading)[1][0][1] == 1201


def test_strongest_cut_index():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 5, 1000).astype(np.uint8)
    index = split.StrongestCut(s)
    for _ in range(300):
        lo, hi = sorted(rng.integers(0, 1000, 2))
        window = s[lo : hi + 1]
        assert index.query(int(lo), int(hi)) == lo + np.flatnonzero(window == window.max())[-1]


def test_long_text_over_blocks():
    text = "Sentence number one. " * 20_000
    _, pieces = split.cut_positions(text)
    assert all(b - a <= 2047 for a, b in pieces) and all(text[b - 1] == " " for _, b in pieces[:-1])


def test_split_edge_cases(spark):
    big = "para one. " * 300
    df = spark.createDataFrame(
        [(1, 1, "g", 0, None, None, "x"), (2, 1, "g", 1, "", [], "x"), (3, 1, "g", 2, big, ["H"], "x"), (3, 1, "g", 2, big, ["H"], "x"), (4, 1, "g", None, "s", None, "x"), (5, None, None, 0, "a" * 2047, None, "x"), (6, 2, "g", 0, "a" * 2048, None, "x")],
        "chunk_id long, page_id long, grp string, chunk_index int, chunk_text string, heading_path array<string>, piece_no string",
    )
    assert {r.chunk_id for r in split.split_texts(df).collect()} == {3, 6}
    got = split.rechunk(df).orderBy("page_id", "chunk_index").collect()
    page = [(r.chunk_index, r.chunk_id, r.piece_no) for r in got if r.page_id == 1]
    assert page == [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 3, 1), (4, 4, 0)]
    assert all(r.heading_path == ["H"] for r in got if r.chunk_id == 3)
    assert split.rechunk(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.cut_positions("x", 60, 50)


# --- repeated lines --------------------------------------------------------------------------------------------


def line_pages(spark):
    rows = [(i, "a" if i < 8 else "b", f"Unique words {'abcdefghijklm'[i]}\nShare NOW! {i}\n\n***\nshare now", "x") for i in range(12)]
    rows += [(0, "a", rows[0][2], "y"), (20, None, None, "x"), (21, "a", "", "x"), (22, None, "Share now", "x")]
    return spark.createDataFrame(rows, "page_id long, grp string, content string, line string")


def brute_lines(rows, least):
    found = {}
    for r in rows:
        for no, line in enumerate((r.content or "").split("\n") if r.content is not None else []):
            key = "".join(c for c in line.lower() if c.isalpha())
            if key:
                found.setdefault((r.grp, key), {}).setdefault(r.page_id, set()).add(no)
    return {(p, n) for v in found.values() if len(v) >= least for p, ns in v.items() for n in ns}


def found_lines(spark, df, least=5, parts=1):
    cut = [df.where(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(parts)) == i) for i in range(parts)]
    return {tuple(r) for r in lines.repeated([lines.page_lines(p) for p in cut], lines.LineCounts(spark, min_pages=least)).collect()}


def test_lines_against_brute_force(spark):
    df = line_pages(spark)
    for least, parts in ((2, 1), (5, 1), (5, 3), (9, 2)):
        assert found_lines(spark, df, least, parts) == brute_lines(df.collect(), least)
    assert found_lines(spark, df.limit(0)) == set()


def test_lines_incremental_equals_whole(spark, tmp_path):
    df = line_pages(spark)
    parts = [df.where("page_id < 3"), df.where("page_id between 2 and 6"), df.where("page_id > 6"), df.where("page_id < 3")]
    root = f"file://{tmp_path}/counts"
    # the folder is opened anew for every merge: the state is in its tables
    crossings = [lines.LineCounts(spark, root, 5).merge(lines.page_lines(p)).count() for p in parts]
    assert crossings == [0, 1, 0, 0]
    state, whole = lines.LineCounts(spark, root, 5), lines.LineCounts(spark, min_pages=5)
    whole.merge(lines.page_lines(df))
    key = lambda s: sorted(tuple(r) for r in s.counts().groupBy("src", "k1", "k2").agg(F.sum("n_pages")).collect())
    assert key(state) == key(whole)
    hits = lines.occurrences(lines.page_lines(df), state.excessive())
    kept = {r.page_id: (r.content, r.n_removed) for r in lines.without_lines(df, hits).collect()}
    assert kept[3] == ("Unique words d\n\n***", 2) and kept[20] == (None, 0) and kept[21] == ("", 0) and kept[9][1] == 0 and len(kept) == df.select("page_id").distinct().count()


def test_update_rebuilds_affected_pages_only(spark):
    at = lambda i, *more: "\n".join([f"Words of page {'abcdefghijklmnop'[i]} alone", *more])
    parts = [
        [("g", i, at(i, "early line", "late line")) for i in range(3)] + [("g", 3, at(3, "early line")), ("g", 4, at(4, "early line")), ("g", 5, at(5)), ("h", 6, at(6, "late line"))],
        [("g", 7, at(7, "late line")), ("g", 8, at(8, "late line")), ("g", 9, at(9, "early line")), ("g", 0, at(0, "early line", "late line")), ("g", 10, at(10)), (None, 11, None)],
        [("g", 12, at(12, "early line", "late line", "new"))],
    ]
    state, found, earlier, seen, rows = lines.LineCounts(spark, min_pages=5), set(), None, [], []
    for part in parts:
        new = lines.page_lines(spark.createDataFrame(part, "grp string, page_id long, content string"))
        affected, hits = lines.update(state, earlier, new)
        done = {r.page_id for r in affected.collect()}
        found = {h for h in found if h[0] not in done} | {tuple(r) for r in hits.collect()}
        earlier = new if earlier is None else earlier.unionByName(new)
        seen.append(done)
        rows += part
    whole = spark.createDataFrame(rows, "grp string, page_id long, content string")
    assert found == brute_lines(whole.collect(), 5)
    assert seen == [set(range(7)), {0, 1, 2, 7, 8, 9, 10}, {12}]  # 11 has no line


# --- residue ------------------------------------------------------------------------------------------------------


def made_results(n=400, seed=5):
    rng = random.Random(seed)
    pages = made_pages(20, 20, seed)
    errors = ["The page you asked for does not exist.", "We could not find anything here.", "Access denied by the server.", "Please enable JavaScript to run this app.", "Lorem ipsum dolor amet quis nunc velit tellus felis purus.", "Dear {{ name }}, welcome to {{ place }}."]
    out = []
    for i, (c, t, u, _) in enumerate(pages[:n]):
        if i % 5 == 0:
            parts = c.split("\n")
            bad = rng.choice(errors)
            out.append(("\n".join(parts[:2] + [bad] + parts[8:]), rng.choice([None, "Not found", t]), u, rng.choice([200, 404, None]), True))
        else:
            out.append((c, t, u, rng.choice([200, 200, 500, None]), False))
    return out


def test_residue_on_unseen_hosts(spark):
    made = made_results()
    train, test = made[:300], made[300:]
    model, report = residue.train([r[:4] for r in train])
    assert report["held_out"] > 20 and report["agreement"] > 0.9
    right = sum((model.score(residue.examine(c, t, u, s, model.lines)) > 0) == y for c, t, u, s, y in test)
    assert right / len(test) > 0.9


PLANTED = {  # title, body lines, whether it is residue; judged by hand
    "field in body": ("A quiet harbor", ["Price: {{price|currency}} / [UNIT]"], True),
    "field in title": ("{{ title }}", ["The harbor was quiet all morning and the boats of the town lay still."], True),
    "asks for scripts": (None, ["Please turn on JavaScript to see the page."], True),
    "error": ("Oops", ["The page you asked for does not exist."], True),
    "article on fields": ("Writing {{ name }} tags", ["The engine replaces `{{ name }}` by the value of the name before the page is sent, and that took years.", "Writers of the engine asked why the name follows so many tags in the end."], False),
    "short page": ("A short note on Velmora", ["The boats of Velmora lay still in the quiet harbor until noon."], False),
}


@pytest.mark.parametrize("case", PLANTED)
def test_residue_planted(residue_model, case):
    title, body, want = PLANTED[case]
    text = "\n".join(([title] if title else []) + body)
    got = residue_model.score(residue.examine(text, title, "https://unseen.example/a", 200, residue_model.lines)) > 0
    assert got == want


def test_labelling_marks_are_no_features(residue_model):
    r = residue.examine("A note\nDear {{ name }}, welcome to {{ place }}.", "A note", "https://unseen.example/a", 200, residue_model.lines)
    assert r.label == 1.0 and not any("marks" in f or f == "filler" for f in r.features)


@pytest.fixture(scope="module")
def residue_model():
    return residue.train([r[:4] for r in made_results()])[0]


def test_content_is_judged_under_an_error(spark):
    made = made_results(100)
    model, _ = residue.train([r[:4] for r in made])
    c, t, u, _, _ = made[1]
    bad = "Lorem ipsum dolor amet quis nunc velit. " * 20
    rows = [(1, c, t, u, 200, "timeout"), (2, bad, None, u, 200, "timeout"), (3, bad, None, u, 200, None), (4, " ", t, u, None, "timeout"), (5, None, None, u, None, "timeout")]
    df = spark.createDataFrame(rows, "result_id long, content string, title string, url string, http_status int, error string")
    judged = residue.judge(df, model)
    assert {r.result_id: r.residue for r in judged.collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert {r.result_id for r in residue.without_residue(df, judged, keep_errors=True).collect()} == {1}


def test_residue_edge_cases(spark):
    made = made_results(100)
    model, _ = residue.train([r[:4] for r in made])
    c, t, u, _, _ = made[1]
    rows = [(1, None, None, None, None, None), (2, "", t, u, 404, None), (3, c, t, u, 200, "timeout"), (4, c, t, u, None, None), (4, c, t, u, None, None), (5, "Lorem ipsum dolor amet quis nunc velit. " * 20_000, None, u, 200, None), (None, c, t, u, 200, None)]
    df = spark.createDataFrame([(*r, True) for r in rows], "result_id long, content string, title string, url string, http_status int, error string, residue boolean")
    got = {r.result_id: r.residue for r in residue.judge(df, model).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert {r.result_id for r in residue.without_residue(df, residue.judge(df, model)).collect()} == {4, None}
    assert residue.judge(df.limit(0), model).count() == 0


# --- encoding -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return encode.ChunkEncoder()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_encode_any_text(text):
    e = encode.encoder(encode.TOKENIZER_DIR, encode.TOKENIZER)
    text = text.encode("utf-8", "replace").decode()
    assert e.encode(text) == e.bpe.encode_ordinary(text)
    assert "".join(e.pieces(text)) == text


def test_encode_mixtures_and_reuse(encoder):
    rng = random.Random(2)
    for alphabet in ("ab'srevml d\n\t 1²٣中ไ้é🚀.,! 　​", "a", " ", "'s", "\n x"):
        for _ in range(300):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 600)))
            assert encoder.encode(s) == encoder.bpe.encode_ordinary(s)
    long = "".join(rng.choice("abc defg. ") for _ in range(300_000))
    encoder.reused = encoder.encoded = 0
    ids = encoder.encode(long)
    shifted = encoder.encode("new start " + long)
    assert ids == encoder.bpe.encode_ordinary(long) and shifted == encoder.bpe.encode_ordinary("new start " + long)
    assert encoder.reused > 0.8 * len(long)


def test_cache_is_bounded():
    e = encode.ChunkEncoder(cache_bytes=200_000)
    for i in range(3000):
        e.encode(f"text {i} with number {i * 7919} and more words to keep {i}")
    assert len(e.young) + len(e.old) < 2000


def test_encode_against_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.TOKENIZER_DIR + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = encode.ChunkEncoder()
    for s in ("Hello, world!  <|endoftext|> it's", "日本語の文。 ภาษาไทย", "a\n\n b\t c", "naïve café 🚀👩‍💻"):
        assert e.encode(s) == t.encode(s, add_special_tokens=False).ids


def test_encode_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hi", "x"), (3, "Hi", "x"), (None, " ", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode.encode_corpus(df).collect()), key=str)
    assert got == [(1, []), (2, []), (3, [17250]), (3, [17250]), (None, [220])]
    assert encode.encode_corpus(df.limit(0)).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in encode.count_tokens(df).collect()} == {(1, 0), (2, 0), (3, 1), (None, 1)}


# --- sentences -----------------------------------------------------------------------------------------------------

TRAINING = ["The machine works. Dr. Smith came at 6 p.m. yesterday. It ended.", "Dr. Jones left. He slept, etc. The end came.", "Prices rose by 3.5 percent. We bought tea, milk, etc.", "Dr. Brown said no.", "They left.", "It works.", "The tea was 2.50 each.", "Who left? He did."] * 20


def trained(texts, events=True):
    rows = [(k, keys, n, n.sum()) for k, keys, n in sentences.observe(texts, [sentences.parse(t) for t in texts])]
    return sentences.Model(sentences.tables(rows), events)


@pytest.fixture(scope="module")
def sentence_model():
    return trained(TRAINING)


EMPTY_MODEL = trained([])

CASES = {
    "Dr. Smith left. The machine works.": ["Dr. Smith left.", "The machine works."],
    "It costs 3.14 or so. The end.": ["It costs 3.14 or so.", "The end."],
    'He said "Stop. Wait." and went on. The end.': ['He said "Stop. Wait." and went on.', "The end."],
    "(It works. Really.) The end came.": ["(It works. Really.)", "The end came."],
    "It works (see above. Yes) and stops. The end.": ["It works (see above. Yes) and stops.", "The end."],
    "What?! The end... and more.": ["What?!", "The end... and more."],
    "# Head line. Yes\nText one. Text two\ngoes on.\n\nNew": ["# Head line. Yes", "Text one.", "Text two\ngoes on.", "New"],
    "- one. Two\n- three\n2. four": ["- one. Two", "- three", "2. four"],
    "今日は。「待て。行け。」と言った。終わり": ["今日は。", "「待て。行け。」と言った。", "終わり"],
    "（见第2章。）在这里。他停了……然后走了。": ["（见第2章。）", "在这里。", "他停了……然后走了。"],
    "แมวกินปลา หมานอน มี 5 ตัว บ่อยๆ ไป": ["แมวกินปลา", "หมานอน", "มี 5 ตัว", "บ่อยๆ ไป"],
    "यह घर है। वह गया।": ["यह घर है।", "वह गया।"],
    "« Attends. Viens. » dit-il. Puis la fin !  Oui ?": ["« Attends. Viens. » dit-il.", "Puis la fin !", "Oui ?"],
    "no end": ["no end"],
    "": [],
    " \n \t": [],
}


@pytest.mark.parametrize("text", CASES)
def test_sentences(sentence_model, text):
    assert [text[a:b] for a, b in sentence_model.units(text)] == CASES[text]


def unmarked_corpus():
    """Sentences of a small grammar, ended by full stops, and their words run on without any mark."""
    rng = random.Random(9)
    subject, verb, thing, when = ["we", "they", "the visitors", "our guests"], ["painted", "carried", "bought", "found"], ["a lamp", "the old boat", "two chairs", "some bread"], ["yesterday", "in spring", "at noon"]
    made = [f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} {rng.choice(when)}" for _ in range(900)]
    texts = [" ".join(x[0].upper() + x[1:] + "." for x in made[i : i + 1 + i % 4]) for i in range(0, 800, 4)]
    return texts, [made[i : i + 5] for i in range(800, 900, 5)]


def test_unmarked_text_is_split():
    texts, runs = unmarked_corpus()
    model, without = trained(texts), trained(texts, events=False)
    good = total = changed = 0
    for run in runs:
        text = " ".join(run)
        want = {text.index(" ".join(run[i:])) for i in range(len(run))}
        got = {a for a, _ in model.units(text)}
        good, total = good + len(want & got), total + len(want | got)
        changed += got != {a for a, _ in without.units(text)}
    assert good / total >= 0.9
    none = trained([])
    assert sum(len(none.units(" ".join(run))) == 1 for run in runs) >= len(runs) // 2  # the counts decide


def test_events_and_counts_decide():
    """A boundary so close to another that the sentence between them would be shorter than any seen is left out by the forward-backward pass only."""
    texts = [f"The {a} engine of the old mill near the {b} river stopped for good at noon." for a in ("large", "small", "green", "heavy") for b in ("long", "cold", "wide", "deep")] * 10
    model, without = trained(texts), trained(texts, events=False)
    p = "The large engine of the old mill stopped! Oh? The small engine of the old mill stopped for good."
    paras, x = sentences.parse(p)
    a, b = model.posteriors(paras, x), without.posteriors(paras, x)
    assert (a < b - 0.001).any() and len(x) == 2
    assert trained([]).units("It was approx. Ten of us.") != trained(["It was approx. ten. We saw approx. ten of them, approx. 3."] * 30).units("It was approx. Ten of us.")


def test_han_clauses_parted_by_spaces():
    assert len(EMPTY_MODEL.units("今天天气很好 我们去公园 他在家看书 明天再见")) == 4


def test_long_word_before_a_mark():
    assert sentences.places("x" * 5000 + ". Next")[0].left == "x" * 5000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\"'()“”«»。「」1#-…ก ๆ", max_size=120))
def test_sentences_cover_text(text):
    m = EMPTY_MODEL
    units = m.units(text)
    assert all(a < b for a, b in units) and all(b <= c for (_, b), (c, _) in zip(units, units[1:]))
    assert "".join(text[a:b] for a, b in units).replace(" ", "").replace("\n", "") == "".join(text.split())
    assert all(not text[a].isspace() for a, _ in units)


def test_sentences_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "One line. Two lines.", "x"), (3, "One line. Two lines.", "x"), (4, "word. " * 50_000, "x"), (None, "x", "x")], "doc_id long, text string, sentence string")
    got = sentences.split_sentences(df)
    assert [(r.sentence_no, r.start_pos, r.end_pos) for r in got.where("doc_id = 3").orderBy("sentence_no").collect()] == [(0, 0, 9), (1, 10, 20)]
    assert got.where("doc_id is null").count() == 1 and got.where("doc_id < 3").count() == 0
    assert sentences.split_sentences(df.limit(0)).count() == 0
