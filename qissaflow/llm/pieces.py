"""Long texts as pieces that begin and end at natural boundaries (problem 2), by balanced targets.

A text over the limit gets as few pieces as the overlap allows, all aimed at the same length; each end goes to the strongest
boundary near its target, else to any boundary within the limit. Where a piece comes out short, the rest is balanced anew, with one more
piece if the limit needs it. Only where the whole reach of a piece is letters and digits is it cut inside a word, which the piece says
(``forced``). The next piece begins ``overlap`` characters before, at a boundary near there; less is repeated only where a word that reaches over
the limit would else be cut. Pieces together hold every character. Positions count code points from 0.

Defined results: null texts and those within the limit have no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 100
# The kinds of boundaries, strongest first; a piece ends, and another begins, where one of these matches ends.
BOUNDARIES = [re.compile(x) for x in (r"\n\s*", r"[.!?؟…۔]+[\"»)\]]*\s+", r"[؛;:،,|%]+\s*", r"\s+")]


def _plain(char: str) -> bool:
    return unicodedata.category(char)[0] in "LN"


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece; a text within the limit is one piece."""
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    ends = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    # last of all, beside any other sign, but not between a letter and its mark
    word = [_plain(c) for c in text]
    ends.append([k for k in range(1, n) if not (word[k - 1] and word[k]) and unicodedata.category(text[k])[0] != "M"])
    ends.append([k for k in range(1, n) if not (word[k - 1] and word[k])])

    def near(at: int, low: int, high: int) -> int | None:
        """The strongest kind of boundary in low..high, of these the nearest to ``at``."""
        for kind in ends:
            a, b = bisect_left(kind, low), bisect_right(kind, high)
            if a < b:
                k = bisect_left(kind, at, a, b)
                return min(kind[max(a, k - 1) : min(b, k + 1)], key=lambda x: abs(x - at))
        return None

    out: list[tuple[int, int, bool]] = []
    start = done = 0
    while n - start > limit:
        rest = n - start
        count = -(-(rest - overlap) // (limit - overlap))
        target = start + -(-(rest + (count - 1) * overlap) // count)
        low, high = max(done + 1, start + limit // 2), start + limit
        end = near(target, max(low, target - limit // 10), high) or near(target, low, high) or near(high, done + 1, high)
        forced = end is None
        if forced:
            if start < done and not out[-1][2]:  # the word may fit, if the piece begins with it
                start = done
                continue
            end = min(target, high)
        out.append((start, end, forced))
        done, at = end, end - overlap
        again = near(at, max(start + 1, at - overlap // 2), min(end, at + overlap // 2))
        if again is None and not forced:
            again = near(at, max(start + 1, at - overlap), end)
        start = max(at, start + 1) if again is None else again
    return [*out, (start, n, False)]


def text_pieces(df: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The id, the number of the piece, its first position, the position after its last, its text, and whether its end had to
    cut a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, a, b, t[a:b], forced) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (a, b, forced) in enumerate(pieces(t, limit, overlap))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "piece_start", "piece_end", "piece_text", "forced"])

    long = df.where(F.length(text_column) > limit).select(F.col(id_column).alias("id"), F.col(text_column))
    kind = long.schema["id"].dataType.simpleString()
    return long.mapInArrow(run, f"id {kind}, piece int, piece_start int, piece_end int, piece_text string, forced boolean").withColumnRenamed("id", id_column)


def long_texts(df: DataFrame, id_column: str, text_column: str, limit: int = LIMIT) -> DataFrame:
    """The texts that had to be cut; ``unbroken`` is 1 where a cut inside a stretch of letters and digits could not be avoided."""
    cut = text_pieces(df, id_column, text_column, limit)
    return cut.groupBy(id_column).agg(F.max(F.col("forced").cast("int")).alias("unbroken"))
