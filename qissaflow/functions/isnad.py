"""Splitting a narrative from the chain of its transmitters.

A marker of speech between 3 % and 70 % of the text, with at least two tokens before it, ends the chain if the tokens before it
look like a chain (mean score of at least the threshold) and clearly more so than the ``window`` tokens after it; fewer tokens than that after it
count as no chain. The last such marker wins. What follows must have 30 characters, or nothing is split off.

Places of markers, and tokens cut by them, are beyond built-in functions, so this is one Arrow UDF; prefix sums of the
scores make it linear in the length of the text. Null gives null; short texts are narrative throughout.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from qissaflow.functions.lexicons import ISNAD, MATN_MARKERS, SMALL

WINDOW, THRESHOLD, LEAST_TEXT, LEAST_TOKENS, LEAST_MATN = 8, 0.25, 20, 4, 30
_TOKEN = re.compile("[؀-ۿ]+")
_MARKER = re.compile(rf"(?<!\w){MATN_MARKERS}(?!\w)")
_KUNYA = re.compile(r"أب[وياُ]\b|أم\b|ابن\b|بن\b|بنت\b")
_MARKS = re.compile("[ً-ٰٟ]")
_FOLD = str.maketrans("أإآةى", "اااهي")
_VERBS, _LINKS, _INITIALS = set(ISNAD["TRANSMISSION_VERBS"]), set(ISNAD["ISNAD_CONNECTORS"]), set(SMALL["NAME_INITIALS"])


@lru_cache(1 << 16)
def token_score(token: str) -> float:
    """How much a token looks like part of a chain: verb of transmission, link, by-name, other name."""
    both = {token, _MARKS.sub("", token).translate(_FOLD)}
    if both & _VERBS:
        return 1.5
    if both & _LINKS:
        return 0.8
    if _KUNYA.match(token):
        return 0.7
    named = len(token) >= 4 and token[0] in _INITIALS and not token.startswith(("ال", "وال"))
    return 0.3 if named else 0.0


def split_isnad(text: str, window: int = WINDOW, threshold: float = THRESHOLD) -> tuple[str, str]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(text) < LEAST_TEXT or len(spans) < LEAST_TOKENS:
        return "", text
    starts = [a for a, _ in spans]
    scores = [token_score(text[a:b]) for a, b in spans]
    sums = [0.0, *accumulate(scores)]
    cut = None
    for m in _MARKER.finditer(text):
        at = m.start()
        if not 0.03 <= at / len(text) <= 0.7:
            continue
        k = bisect_left(starts, at)  # tokens that begin before the marker
        before, count = sums[k], k
        rest, first = scores[k : k + window], k
        if k and spans[k - 1][1] > at:  # the marker cuts this token
            a, b = spans[k - 1]
            before += token_score(text[a:at]) - scores[k - 1]
            rest, first = [token_score(text[at:b]), *scores[k : k + window - 1]], k - 1
        if count < 2:
            continue
        after = sum(rest) / window if len(spans) - first >= window else 0.0
        if before / count >= threshold and before / count - after > 0.05:
            cut = m.end()
    if cut is None or len(text[cut:].strip()) < LEAST_MATN:
        return "", text
    return text[:cut].strip(), text[cut:].strip()


def _split(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else split_isnad(t) for t in texts]
    return pd.DataFrame(rows, columns=["isnad", "matn"])


def isnad_matn(text: Column | str) -> Column:
    """A struct of ``isnad`` and ``matn``."""
    return F.pandas_udf(_split, "struct<isnad string, matn string>")(text)
