"""Long exact spans shared between records (problem 3), by recompression.

Each text is parsed in rounds. The first cuts it into tokens at places that two neighbouring characters decide; every
further round names runs of equal symbols and then pairs of a left and a right symbol, which side a symbol is on being
decided by its name. A name is a hash of what it stands for, so all tasks give equal strings equal names without asking
one another. Beside its name a symbol carries the stretch of text that decided it. Two equal stretches of text are parsed
alike but for the symbols whose deciding stretch reaches over their ends.

A window of ``least`` characters is shared if another record has it too, and the shared spans of a record are the union of
its shared windows. Each window picks an anchor from what it holds itself: of the symbols that it decides alone, those of the
highest level, and of these the one with the smallest name; a window that decides no symbol is its own anchor. Windows
in a row with one anchor are a block, and go on as one row: a key, which is the hash of the anchor and the half of
the window that lies at its side, and the hash of the whole block. Only blocks with a key that two records have are looked at
again: equal blocks are shared whole, and of different blocks with one key, one of each kind is compared window by window.
No step depends on the number of copies of a text, and none pairs records.

Defined results: null and short texts have no spans; a text that several records have is one span in each of them; spans
repeated in one record only don't count; columns other than the id and the text are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qissaflow.llm.scratch import spread, written

LEAST, ROUNDS, LOW = 100, 3, 1
#: Characters parsed at a time; a longer text is parsed alone.
CHUNK = 1_000_000
U = np.uint64
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """A hash of every code point, and whether it belongs to words (letters, digits and marks)."""
    kinds = np.zeros(0x110000, bool)
    kinds[:0x40000] = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x40000)), bool, 0x40000)
    return _mix(np.arange(1, 0x110001, dtype=U)), kinds


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hashes:
    """Hashes of any stretch of one long text, in constant time each."""

    def __init__(self, code: np.ndarray, base: int):
        size = 1 << max(20, int(len(code) + 1).bit_length())
        self.back = _powers(pow(base, -1, 1 << 64), size)
        self.sums = np.zeros(len(code) + 1, U)
        np.cumsum(_codes()[0][code] * _powers(base, size)[: len(code)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


class _Symbols:
    """The symbols of one level: name, first position and the one after the last, the stretch that decided them, and
    whether they begin a text (with a last entry after all)."""

    def __init__(self, name, start, end, seen_from, seen_to, first):
        self.name, self.start, self.end, self.seen_from, self.seen_to, self.first = name, start, end, seen_from, seen_to, first

    def runs(self) -> _Symbols:
        """Name runs of equal symbols. That a run ends is decided by its neighbours."""
        m = len(self.name)
        head = np.ones(m, bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | self.first[1:m]
        at = np.flatnonzero(head)
        last = np.append(at[1:], m) - 1
        length = last - at + 1
        first, ends = self.first[at], self.first[last + 1]
        name = self.name[at]
        several = length > 1
        name[several] = _mix(name[several] * U(BASE) + length[several].astype(U))
        return _Symbols(
            name,
            self.start[at],
            self.end[last],
            np.where(first, self.start[at] - 1, self.seen_from[np.maximum(at - 1, 0)]),
            np.where(ends, self.end[last] + 1, self.seen_to[np.minimum(last + 1, m - 1)]),
            np.append(first, True),
        )

    def pairs(self, level: int) -> _Symbols:
        """Name pairs of a left and a right symbol. A symbol without a partner is decided by the one on its other side, too."""
        m = len(self.name)
        left = (_mix(self.name + U((level + 7) * BASE & _MASK)) & U(1)).astype(bool)
        pair = np.zeros(m, bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~self.first[1:m]
        head = np.ones(m, bool)
        head[1:] = ~pair[:-1]
        at = np.flatnonzero(head)
        paired, on_left, after = pair[at], left[at], np.minimum(at + 1, m - 1)
        first, ends = self.first[at], self.first[at + 1]
        name = self.name[at]
        name[paired] = _mix(name[paired] * U(OTHER) + _mix(self.name[after[paired]]) + U(level))
        return _Symbols(
            name,
            self.start[at],
            np.where(paired, self.end[after], self.end[at]),
            np.where(paired | on_left, self.seen_from[at], np.where(first, self.start[at] - 1, self.seen_from[np.maximum(at - 1, 0)])),
            np.where(paired, self.seen_to[after], np.where(on_left, np.where(ends, self.end[at] + 1, self.seen_to[after]), self.seen_to[at])),
            np.append(first, True),
        )


def _tokens(code: np.ndarray, offsets: np.ndarray, hashes: _Hashes) -> _Symbols:
    """Round 0: a token begins where a word begins, and inside words at about every 16th pair of characters."""
    size = len(code)
    word = _codes()[1][code]
    head = np.ones(size, bool)
    head[1:] = word[1:] & ~word[:-1]
    head[1:] |= (code[1:] * np.uint32(0x9E3779B1) + code[:-1] * np.uint32(0x85EBCA77)) >> np.uint32(28) == 0
    begins = np.zeros(size + 1, bool)
    begins[offsets] = True
    head |= begins[:-1]
    start = np.flatnonzero(head)
    end = np.append(start[1:], size)
    return _Symbols(hashes(start, end), start, end, start - 1, end + 1, np.append(begins[start], True))


def _windows(symbols: _Symbols, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol that is some window's anchor its number and the first and last start of these windows."""
    m, name, seen_from, seen_to = len(symbols.name), symbols.name, symbols.seen_from, symbols.seen_to
    text = np.searchsorted(offsets, symbols.start, "right") - 1
    low, high = np.maximum(seen_to - least, offsets[text]), np.minimum(seen_from, offsets[text + 1] - least)
    able = np.flatnonzero(low <= high)
    for step in (-1, 1):
        todo, other = able, able + step
        while len(todo):
            inside = (other >= 0) & (other < m)
            todo, other = todo[inside], other[inside]
            near = text[other] == text[todo]
            near &= seen_from[other] >= low[todo] if step < 0 else seen_to[other] - least <= high[todo]
            todo, other = todo[near], other[near]
            stops = name[other] <= name[todo] if step < 0 else name[other] < name[todo]
            hit, by = todo[stops], other[stops]
            if step < 0:
                low[hit] = np.maximum(low[hit], seen_from[by] + 1)
            else:
                high[hit] = np.minimum(high[hit], seen_to[by] - least - 1)
            todo, other = todo[~stops], other[~stops] + step
    own = np.flatnonzero(low <= high)
    return own, low[own], high[own]


def blocks(texts: list[str], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Key, number of the text, first and last start of the windows (within the text) and hash of every block."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    hashes = _Hashes(code, BASE)
    symbols = _tokens(code, offsets, hashes)
    levels = []
    for level in range(1, ROUNDS + 1):
        symbols = (symbols.runs() if level == 1 else symbols).pairs(level)
        if level in (LOW, ROUNDS):
            levels.append(symbols)
    label = np.full(len(code), -1, np.int64)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    known = 0
    for symbols in levels:  # the highest level comes last and wins
        own, low, high = _windows(symbols, offsets, least)
        count = high - low + 1
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        label[at] = np.repeat(np.arange(known, known + len(own)), count)
        known += len(own)
        starts.append(symbols.start[own])
        ends.append(symbols.end[own])
    begin, end = np.concatenate(starts), np.concatenate(ends)
    window = np.arange(len(code))
    whole = np.zeros(len(code), bool)
    full = lengths >= least
    marks = np.zeros(len(code) + 1, np.int64)
    np.add.at(marks, offsets[:-1][full], 1)
    np.add.at(marks, offsets[1:][full] - least + 1, -1)
    whole = np.cumsum(marks[:-1]) > 0
    alone = window[whole & (label < 0)]
    change = np.ones(len(code), bool)
    change[1:] = label[1:] != label[:-1]
    change[offsets[:-1][lengths > 0]] = True
    at = np.flatnonzero(change)
    till = np.append(at[1:], len(code)) - 1
    kept = label[at] >= 0
    at, till, who = at[kept], till[kept], label[at[kept]]
    half = (least - (end[who] - begin[who])) // 2
    out = [(hashes(alone, alone + least), alone, alone)]
    middle = begin[who] - half  # windows that start here or before hold half a window on the left
    for right in (False, True):
        low, high = (np.maximum(at, middle + 1), till) if right else (at, np.minimum(till, middle))
        some = low <= high
        core = (begin[who], end[who] + half - 1) if right else (middle, end[who])
        key = hashes(core[0][some], core[1][some]) + U(1 + right)
        out.append((key, low[some], high[some]))
    key, low, high = (np.concatenate(x) for x in zip(*out))
    text = np.searchsorted(offsets, low, "right") - 1
    return key, text, low - offsets[text], high - offsets[text], hashes(low, high + least)


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    own, held, size = [], [], 0
    for i, t in zip(ids, texts):
        if own and size + len(t) > CHUNK:
            yield own, held
            own, held, size = [], [], 0
        own.append(i)
        held.append(t)
        size += len(t)
    if own:
        yield own, held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_spans(df: DataFrame, id_column: str, text_column: str, least: int = LEAST) -> DataFrame:
    """id, span_start and span_end of every stretch of at least ``least`` characters that another record has too; stretches
    that overlap or touch are one. Ids are bigint and unique."""
    texts = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).where(F.length("text") >= least)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held in _chunks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()):
                key, text, low, high, whole = blocks(held, least)
                columns = [_signed(key), pa.array(np.array(ids)[text]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _signed(whole)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "low", "high", "whole"])

    rows = written(spread(texts).mapInArrow(parsed, "key bigint, id bigint, low int, high int, whole bigint"), "blocks")
    keys = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    held = written(rows.join(keys, "key", "left_semi"), "held")
    kinds = held.groupBy("key", "whole").agg(F.min(F.struct("id", "low", "high")).alias("one"), F.max("id").alias("last"))
    kinds = written(kinds.select("key", "whole", "one.id", "one.low", "one.high", "last"), "kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mixed = kinds.join(several, "key", "left_semi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, whole, first, last, low, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            texts_of = batch.column(6).to_pylist()
            for k, text in enumerate(texts_of):
                code = np.frombuffer(text[: int(high[k]) - int(low[k]) + least].encode("utf-32-le", "surrogatepass"), np.uint32)
                at = np.arange(len(code) - least + 1)
                one, two = _Hashes(code, BASE)(at, at + least), _Hashes(code, OTHER)(at, at + least)
                same = [pa.array(np.full(len(at), x[k])) for x in (key, whole, first, last)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), _signed(one), _signed(two)], ["key", "whole", "first", "last", "at", "h1", "h2"])

    cut = F.expr(f"substring(text, low + 1, high - low + {least})")
    asked = mixed.join(texts, "id").select("key", "whole", F.col("id").alias("first"), "last", "low", "high", cut.alias("text"))
    looked = written(asked.mapInArrow(windows, "key bigint, whole bigint, first bigint, last bigint, at int, h1 bigint, h2 bigint"), "windows")
    equal = looked.groupBy("h1", "h2").agg(F.min("first").alias("a"), F.max("last").alias("b")).where("a < b").select("h1", "h2")
    found = looked.where("first = last").join(equal, ["h1", "h2"], "left_semi").select("key", "whole", "at")
    part = held.join(found, ["key", "whole"]).select("id", (F.col("low") + F.col("at")).alias("a"), (F.col("low") + F.col("at") + least).alias("b"))
    copies = kinds.where("id < last").select("key", "whole")
    full = held.join(copies, ["key", "whole"], "left_semi").select("id", F.col("low").alias("a"), (F.col("high") + least).alias("b"))
    in_order = Window.partitionBy("id").orderBy("a", "b")
    ordered = full.unionByName(part).withColumn("before", F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = ordered.withColumn("island", F.sum(F.expr("CASE WHEN before >= a THEN 0 ELSE 1 END")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("id", "island").agg(F.min("a").cast("int").alias("span_start"), F.max("b").cast("int").alias("span_end"))
    return spans.select(F.col("id").alias(id_column), "span_start", "span_end")


def shared_shares(df: DataFrame, id_column: str, text_column: str, least: int = LEAST) -> DataFrame:
    """For each record with a text: how many of its characters lie in shared spans, and what share of it they are (0 for an
    empty text)."""
    spans = shared_spans(df, id_column, text_column, least).groupBy(id_column).agg(F.sum(F.expr("span_end - span_start")).alias("n"))
    sized = df.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias(id_column), F.length(text_column).alias("n_chars"))
    shared = F.coalesce("n", F.lit(0)).cast("int")
    return sized.join(spans, id_column, "left").select(id_column, "n_chars", shared.alias("shared_chars"), F.expr("coalesce(coalesce(n, 0) / nullif(n_chars, 0), 0D)").alias("shared_share"))
