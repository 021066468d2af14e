"""Template residue, filler and error messages standing in place of content.

A regularized linear classifier over hashed word n-grams, length, title and status features
decides for each record. It is trained without labels given by hand: response status, phrases and the marks of
unfilled fields label part of a bounded sample. These rules give labels only, never features: n-grams, lengths, title and status decide, also
where no rule applies. The main lines of a record come from the minimum-cut labelling, so notices in the page frame have no say.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm import boilerplate
from skeinery.llm.boilerplate import PLACEHOLDER, Line, host_of
from skeinery.llm.linear import Features, fit

#: Records the classifier is trained on, at most about this many of the whole table.
TRAIN_RECORDS = 6000

#: Share of hosts kept out of training to measure it.
HELD_OUT = 5

# Seed phrases (lower case) for weak labels, in some languages.
ERROR_SEEDS = re.compile(
    r"not found|does not exist|no longer (?:here|exists|available)|could not find|has been (?:removed|deleted|blocked|suspended)|is suspended|access denied|forbidden|"
    r"do not have permission|are human|too many requests|maintenance|planned work|try again later|may be for sale|link (?:seems|is) (?:to be )?broken|wrong turn|internal error|"
    r"nicht gefunden|gibt es nicht|liegt (?:leider )?nichts|verweis ist veraltet|gleich zurück|introuvable|n'existe pas|ne trouvons rien|no encontrada|no existe|no hay nada|"
    r"не найден|больше нет|見つかりません|削除されました|不存在|已经被删除"
)
SCRIPT_SEEDS = re.compile(r"(?:enable|activer|active|activate|aktivieren|requires?|turn on|need) (?:sie )?(?:javascript|scripts?)|javascript (?:is|ist|est|está) (?:disabled|required|deaktiviert)|scripting must be|requires scripts|javascript aktivieren")
FILLER_SEEDS = re.compile(
    r"lorem ipsum|(?:\btext\b ?){3}|your (?:text|title|content)\b.{0,12}\bhere|content goes here|click to edit|sample (?:paragraph|text)|replace it with|beispieltext|texte de remplissage|texto de (?:relleno|ejemplo)|"
    r"blindtext|platzhalter|\btodo:|\[insert |placeholder"
)
LATIN_FILLER = frozenset("lorem ipsum dolor amet consectetur adipiscing elit sed tempor labore magna aliqua quis nunc velit tellus felis purus vitae mauris justo augue odio donec porta cras".split())
EMPTY_VALUES = re.compile(r"\[object object\]|\bundefined\b|\bnull\b|\bnan\b")

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CODE = re.compile(r"`[^`]*`|<code>.*?</code>|[\"“„«][^\"”“»]{0,80}[\"”“»]")


@dataclass
class Record:
    """What a decision rests on."""

    features: list[str]
    label: float  # weak: 1 residue, 0 content, nan unknown


def _filler(words: list[str]) -> bool:
    return len(words) > 4 and sum(w in LATIN_FILLER for w in words) >= 0.5 * len(words)


def ngrams(text: str, common: set[str]) -> list[str]:
    """Names of the word and sign n-grams of a line, up to two in a row; what it quotes or sets as code is left out, rare words are names."""
    tokens = [w if w in common or not w[0].isalpha() else "<name>" for w in _TOKEN.findall(_CODE.sub(" ", text).lower())]
    return boilerplate.word_names(["<n>" if t[0].isdigit() else t for t in tokens])


def examine_all(records: list[tuple], model: boilerplate.Model) -> Iterator[Record]:
    """Features and weak labels of (content, title, url, status) in order; their lines are labelled together."""
    for (_, title, _, status), (lines, main) in zip(records, model.label_all((c, t, u) for c, t, u, _ in records)):
        yield _examine(lines, main, title, status, model)


def examine(content: str, title: str | None, url: str | None, status: int | None, model: boilerplate.Model) -> Record:
    """Features and weak label of one record."""
    return next(examine_all([(content, title, url, status)], model))


def _examine(lines: list[Line], main: list[bool], title: str | None, status: int | None, model: boilerplate.Model) -> Record:
    head = (title or "").strip()
    body = [x for x, keep in zip(lines, main) if keep and not x.title and x.marker not in ("f", "c")]
    prose = [x for x in body if x.own and x.ends and len(x.words) > 7]
    plain = [x for x in body if x.ends and len(x.words) > 7 and model.novelty(x) < 0.35 and not _filler(x.words)]
    content_like = len(prose) + len(plain)
    words = sum(len(x.words) for x in body)
    head_line = next((x for x in lines if x.title and x.marker in ("", "h")), None)
    heads = [head] + ([head_line.text] if head_line is not None else [])
    bare_head = boilerplate._SUFFIX.sub("", head)
    head_words = boilerplate._TOKEN.findall(bare_head.lower())
    known_head = sum(w in model.common and w[0].isalpha() for w in head_words)
    in_body = {w for x in body for w in x.words}
    own_head = known_head > 0 and any(w[0].isalpha() and w not in model.common and w in in_body for w in head_words)
    # the marks below only label; the features hold no rule's outcome but the record's words, lengths and status
    marks_head = any(PLACEHOLDER.search(_CODE.sub(" ", h)) or EMPTY_VALUES.search(h.lower()) or FILLER_SEEDS.search(_CODE.sub(" ", h.lower())) for h in heads) and not (own_head and content_like)
    marks_body = any(PLACEHOLDER.search(_CODE.sub(" ", x.text)) for x in body)
    filler = any(_filler(x.words) or FILLER_SEEDS.search(_CODE.sub(" ", x.text.lower())) for x in body)
    where = "full" if content_like > 1 else "one" if content_like else "none"
    f = ["bias", f"prose {where}", f"words {where} {min(words, 400).bit_length()}", f"lines {min(len(body), 4)}"]
    group = "none" if status is None else f"{status // 100}xx"
    f += [f"status {group}", f"status {group} {where}"]
    running = {id(x) for x in chain(prose, plain)}
    side = "x" if not content_like else "y"
    seeds = False
    for x in body:
        text = x.text.lower()
        if content_like < 2 or marks_body or filler:
            seeds |= bool(ERROR_SEEDS.search(text) or SCRIPT_SEEDS.search(text)) and not x.own
        if id(x) not in running and not (x.own and len(x.words) > 7):
            f += [side + n for n in ngrams(x.text, model.common)]
    for h in {h for h in heads if h}:
        f += [("o" if own_head and content_like else "t") + n for n in ngrams(h, model.common)]
    if not content_like:
        f.append(f"title known {min(known_head, 3)}")
    short = words < 80 and not content_like
    if marks_head or marks_body or filler:
        y = 1.0
    elif short and seeds:
        y = 1.0
    elif short and status is not None and status >= 400 and body:
        y = 1.0
    elif content_like:
        y = 0.0
    else:
        y = np.nan
    return Record(f, y)


@dataclass
class Model:
    """Line model and record weights by feature name."""

    lines: boilerplate.Model
    weights: dict[str, float]

    def score(self, r: Record) -> float:
        """Log odds of residue."""
        get = self.weights.get
        return sum(get(n, 0.0) for n in set(r.features))


def train(records: list[tuple]) -> tuple[Model, dict[str, float]]:
    """A model from sampled (content, title, url, status), and its agreement with the weak labels on hosts not trained on."""
    lines = boilerplate.train_model([(c, t, u) for c, t, u, _ in records])
    records = [r for r in records if r[0] and r[0].strip()]
    seen = [(host_of(r[2]), x) for r, x in zip(records, examine_all(records, lines))]
    known = [(h, r) for h, r in seen if r.label == r.label]

    def weights(rows: list[Record]) -> dict[str, float]:
        f = Features()
        w = fit([[f[n] for n in set(r.features)] for r in rows], [r.label for r in rows], l2=1e-4)
        return {n: round(float(w[i]), 4) for n, i in f.known.items() if abs(w[i]) > 1e-3}

    held = [hash_of(h) % HELD_OUT == 0 for h, _ in known]
    trial = Model(lines, weights([r for (_, r), out in zip(known, held) if not out]))
    right = [(trial.score(r) > 0) == (r.label > 0.5) for (_, r), out in zip(known, held) if out]
    report = {"labelled": len(known), "held_out": len(right), "agreement": float(np.mean(right)) if right else float("nan")}
    return Model(lines, weights([r for _, r in known])), report


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def sample(records: DataFrame, most: int = TRAIN_RECORDS) -> list[tuple]:
    """About ``most`` records (content, title, url, status), spread evenly over the table by the hash of their id."""
    good = records.where(F.col("error").isNull() & (F.length("content") > 0))
    step = max(1, -(-good.count() // most))
    rows = good.where(F.pmod(F.xxhash64("result_id"), F.lit(step)) == 0).select("content", "title", "url", "http_status").dropDuplicates(["content", "title"])
    return [tuple(r) for r in rows.limit(2 * most).toLocalIterator()]


def judge(records: DataFrame, model: Model) -> DataFrame:
    """result_id, residue (boolean), score of every record, one row per result_id.

    Blank or null contents (failed fetches) are no residue; content is judged whatever ``error`` says; a null status, title or
    url is no evidence; redelivered rows count once; further columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = [(c, t, u, None if s is None or s != s else int(s)) for c, t, u, s in zip(pdf["content"], pdf["title"], pdf["url"], pdf["http_status"])]
            full = [i for i, r in enumerate(rows) if r[0] and r[0].strip()]
            scores = np.full(len(rows), -99.0)
            scores[full] = [m.score(x) for x in examine_all([rows[i] for i in full], m.lines)]
            yield pd.DataFrame({"result_id": pdf["result_id"], "score": scores})

    rows = records.where(F.col("result_id").isNotNull()).select("result_id", "content", "title", "url", "http_status")
    judged = rows.mapInPandas(run, "result_id bigint, score double")
    return judged.groupBy("result_id").agg(F.max("score").alias("score")).select("result_id", (F.col("score") > 0).alias("residue"), "score")


def without_residue(records: DataFrame, judged: DataFrame, keep_errors: bool = False) -> DataFrame:
    """The real records, one row per result_id, with all their columns; blank contents are none.

    Records with ``error`` set are left out unless ``keep_errors``, which goes by their content alone.
    """
    bad = judged.where("residue").select("result_id")
    good = records.where((F.lit(keep_errors) | F.col("error").isNull()) & (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0))
    return good.join(bad, "result_id", "left_anti").dropDuplicates(["result_id"])
