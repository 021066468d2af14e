"""Text analysis for search: tokens by character class and English stems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of one character class; a capital letter begins a new token within a word.
TOKEN_PATTERN = r"\p{Lu}+[\p{Ll}\p{M}]*|[\p{Ll}\p{M}]+|\p{Lo}+|\p{N}+"


def tokens(s: Column) -> Column:
    """Lower-cased tokens of a text."""
    return F.transform(F.regexp_extract_all(s, F.lit(f"({TOKEN_PATTERN})"), 1), lambda t: F.lower(t))


_VOWELS = frozenset("aeiouy")

# Fixed values of the published Porter2 algorithm: exceptional words, endings and their replacements.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        r1 = after(0)
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """Porter2 stem of a lower-case English word; others come back unchanged."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = w.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end in ("eedly", "eed"):
                if len(base) >= r1:
                    w = base + "ee"
            elif any(c in _VOWELS for c in base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                    w = w[:-1]
                elif len(w) <= r1 and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in tuple("cdeghkmnrt")):
                w = base + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= (r2 if end == "ative" else r1):
                w = base + new
            break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r2 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(s: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(t: str) -> str:
        r = known.get(t)
        if r is None:
            r = known[t] = stem(t)
        return r

    return pd.Series([None if x is None else [one(t) for t in x] for x in s], dtype=object)


def stemmed_tokens(s: Column) -> Column:
    """Stems of the tokens of a text."""
    return _stems(tokens(s))
