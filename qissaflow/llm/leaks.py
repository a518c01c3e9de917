"""Documents that hold a stretch of a held-out item (problem 7), by a prefix-filtered join of word shingles.

A document matches an item if it holds ``words`` consecutive words of it, which is a window of the item all of whose shingles of
``SHINGLE`` words it holds in a row. Shingles are put in one order, the rarest in the documents first. Since all shingles of a window must
be there, the necessary prefix of each window is its rarest shingle alone; windows and documents are joined on these. What remains must
have room for the window around the shingle (positions, lengths), and is then compared word by word.

Before the join a document keeps only its stretches of at least ``words`` words in which every shingle is one of the items'. Tasks
hold the items' shingles for that, up to ``HELD`` of them (8 bytes each); a larger evaluation set is joined without this step.

Words are named by 64-bit hashes; that a different run of 15 words has all names alike is beyond any number of documents.

Defined results: items of fewer than ``words`` words, null and empty items and documents have no matches; items that are versions
of one another all match; every row of a document delivered twice is found; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qissaflow.llm.charform import skeleton
from qissaflow.llm.scratch import spread, written

WORDS, SHINGLE, HELD = 15, 5, 1_000_000
# What is left out before texts are compared; hamza and madda (0653..0655) are no vowel signs and stay.
_MARKUP = re.compile(r"PageV\w*?P\d+|(?<![A-Za-z])ms\d+(?![A-Za-z])")
_MARKS = re.compile(r"[̀-ͯؐ-ؚـً-ْٖ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ࣓-ࣿ]")
_WORD = re.compile(r"(?:[^\W_]|[ٓ-ٕ])+")
U = np.uint64


def bare_words(text: str) -> list[str]:
    """The words apart from vowel signs, stretching, punctuation, blanks, markup and look-alike characters."""
    return _WORD.findall(_MARKS.sub("", _MARKUP.sub(" ", skeleton(text))))


@lru_cache(1 << 18)
def _name(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def names(text: str) -> np.ndarray:
    return np.array([_name(w) for w in bare_words(text)], np.int64)


def shingles(own: np.ndarray) -> np.ndarray:
    """A name of the ``SHINGLE`` words that begin at each word."""
    n = len(own) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, U)
    for k in range(SHINGLE):
        out = (out ^ own[k : k + n].view(U)) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return out.view(np.int64)


def _stretches(own: np.ndarray, known: np.ndarray | None, words: int) -> list[tuple[int, int]]:
    """Words from and to of the stretches that may match."""
    if len(own) < words:
        return []
    if known is None:
        return [(0, len(own))]
    if not len(known):
        return []
    found = shingles(own)
    inside = np.concatenate([[False], known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b) + SHINGLE - 1) for a, b in zip(edge[::2], edge[1::2]) if b - a + SHINGLE - 1 >= words]


def _runs(df: DataFrame, known: np.ndarray | None, words: int) -> DataFrame:
    """id, number of the stretch, its words and their shingles; ``df`` has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = names(text)
                rows += [(i, k, own[a:b], shingles(own[a:b])) for k, (a, b) in enumerate(_stretches(own, known, words))]
            longs = pa.list_(pa.int64())
            kinds = (batch.schema.field(0).type, pa.int32(), longs, longs)
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "stretch", "own", "shingles"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, stretch int, own array<bigint>, shingles array<bigint>")


def leaked_items(documents: DataFrame, id_column: str, text_column: str, items: DataFrame, item_column: str, item_text: str, words: int = WORDS) -> DataFrame:
    """Distinct pairs of a document and an item of which it holds at least ``words`` consecutive words."""
    texts = lambda df, i, t: df.where(f"{t} <> ''").select(F.col(i).alias("id"), F.col(t).alias("text"))
    own_items = written(_runs(texts(items, item_column, item_text), None, words), "items")
    distinct = own_items.select(F.explode("shingles").alias("shingle")).distinct()
    held = distinct.limit(HELD + 1).toArrow().column(0).to_numpy()
    known = np.sort(held) if len(held) <= HELD else None
    runs = written(_runs(spread(texts(documents, id_column, text_column)), known, words), "runs")
    places = runs.select("id", "stretch", F.posexplode("shingles").alias("at", "shingle"))
    rarity = places.groupBy("shingle").agg(F.count("*").alias("often"))
    per_window = words - SHINGLE + 1
    of_items = own_items.select(F.col("id").alias("item"), F.posexplode("shingles").alias("place", "shingle"), F.size("own").alias("length")).join(rarity, "shingle")
    # every shingle is in the windows that begin up to per_window - 1 before it
    first, last = F.greatest(F.lit(0), F.col("place") - per_window + 1), F.least(F.col("place"), F.col("length") - words)
    in_windows = of_items.select("item", "place", "shingle", "often", F.explode(F.sequence(first, last)).alias("window"))
    ordered = F.min(F.struct("often", "shingle", "place"))
    whole = in_windows.groupBy("item", "window").agg(ordered.alias("rare"), F.count("*").alias("n")).where(f"n = {per_window}")
    prefixes = whole.select("item", "window", F.col("rare.shingle").alias("shingle"), (F.col("rare.place") - F.col("window")).alias("offset"))
    candidates = places.join(prefixes, "shingle").withColumn("begin", F.col("at") - F.col("offset")).where("begin >= 0").select("id", "stretch", "begin", "item", "window")
    sides = candidates.join(runs.select("id", "stretch", F.col("own").alias("words")), ["id", "stretch"]).where(f"begin + {words} <= size(words)")
    both = sides.join(own_items.select(F.col("id").alias("item"), F.col("own").alias("item_words")), "item")
    equal = both.where(f"slice(words, begin + 1, {words}) = slice(item_words, window + 1, {words})")
    return equal.select(F.col("id").alias(id_column), F.col("item").alias("item_id")).distinct()
