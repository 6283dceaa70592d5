"""Porter's second stemmer for English, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = sorted(
    {
        "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
        "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
        "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
    }.items(),
    key=lambda x: -len(x[0]),
)
_STEP3 = sorted({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}.items(), key=lambda x: -len(x[0]))
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=lambda x: -len(x))


def _regions(w: str) -> tuple[int, int]:
    def after(at: int) -> int:
        m = re.compile(f"[{_V}][^{_V}]").search(w, at)
        return m.end() if m else len(w)

    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w)) or bool(re.fullmatch(f"[{_V}][^{_V}]", w))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.lstrip("'")
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if w.endswith(("eed", "eedly")):
        k = 5 if w.endswith("eedly") else 3
        if len(w) - k >= r1:
            w = w[:-k] + "ee"
    else:
        m = re.search("(ed|edly|ing|ingly)$", w)
        m = max((x for x in ("ingly", "edly", "ing", "ed") if w.endswith(x)), key=len, default=None) if m else None
        if m and re.search(f"[{_V}]", w[: -len(m)]):
            w = w[: -len(m)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for a, b in _STEP2:
        if w.endswith(a):
            if len(w) - len(a) >= r1:
                w = w[: -len(a)] + b
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    for a, b in _STEP3:
        if w.endswith(a):
            if len(w) - len(a) >= r1:
                w = w[: -len(a)] + b
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for a in _STEP4:
        if w.endswith(a):
            if len(w) - len(a) >= r2:
                w = w[: -len(a)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(terms: Column) -> Column:
    """The stems of an array of words, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: [stem(w) for w in ws] if ws is not None else None)

    return run(terms)
