"""Slightly edited, extended or rearranged copies (problem 1): pairs of texts that share four fifths of their words.

The words of a text, each with the number of its occurrence, are a set of names. Pigeonhole blocks, in two steps: if a text of n words may lack
d = n - ceil(0.8 n) of its words in the other one, then of its d + c rarest words the other has c, and has them among its own rarest. Hashes
deal the words to g groups; with c = g + 1 some group holds two of the shared words, with c = 2 g + 1 three. So each two (three in
longer texts) of a text's rarest words that are in one group are a block; each shared word beyond c adds one more shared block. Blocks of one
word would be fewer, but they grow with the number of texts, as the vocabulary hardly does. What is shuffled is a row for each word with those
that follow it in its group; blocks are built from them in a task. Texts are compared in bands of length, a text near the lower
end of its band in the one below, too. (Which words are rare in a band is taken from a sample of the texts; that decides the speed only, any order
gives the same pairs.)

Hamming distance: the parities of the sets in 256 bits are a fingerprint whose distance is at most the number of words that only one of
the two has; candidates beyond that leave where they arise. The rest are compared whole, word by word.

Texts with equal words are one class throughout, so copies don't multiply work.

Defined results: null texts and those of fewer than ``least`` words are in no pair; order and punctuation don't count; a word counts as often
as it occurs in both; columns other than the id and the text are not read.
"""

from __future__ import annotations

import gc
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qissaflow.llm.charform import char_class, skeleton
from qissaflow.llm.scratch import spread, written
from qissaflow.llm.splits import components

#: Ids that are broadcast at most.
FEW_TWINS = 1_000_000
#: Sampled texts of each power of two of length, words whose frequency is known, characters for each task that compares, rows compared at once.
LEAST_WORDS, SAMPLE, KNOWN, TASK_CHARS, AT_ONCE = 20, 1000, 100_000, 6_000_000, 1 << 20
#: Fewest words of the bands of length; from the band TRIPLES on, blocks are of three words and texts that share more than one are candidates.
EDGES, TRIPLES, EXTRA = np.array([0, 20, *(int(64 * 2.5**k) for k in range(24))]), 3, 40
_BAGS = "id bigint, n int, bag array<bigint>, s1 bigint, s2 bigint, s3 bigint, s4 bigint"
_ROWS = "key bigint, id bigint, size bigint, s1 bigint, s2 bigint, s3 bigint, s4 bigint, rest array<int>"
U = np.uint64


@lru_cache(1)
def _word() -> re.Pattern[str]:
    marks = char_class(c for c in range(0x300, min(sys.maxunicode, 0x1FFFF) + 1) if unicodedata.category(chr(c))[0] == "M")
    return re.compile(rf"[\w{marks[1:]}+")


def words(text: str) -> list[str]:
    """Runs of letters, digits and their marks of the consistent form."""
    return _word().findall(skeleton(text).replace("_", " "))


class _Names(dict):
    """64-bit names of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = name = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return name


_NAMES = _Names()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def named(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, and of every word, by text and name, its text and its name with the number of its
    occurrence."""
    found = [words(t) for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(texts))
    name = np.fromiter((_NAMES[w] for own in found for w in own), U, int(n.sum()))
    text = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((name, text))
    name, text = name[order], text[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    at = np.arange(len(name))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return n, text, _mix(name + occurrence.astype(U) * U(0x9E3779B97F4A7C15))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _need(n: np.ndarray) -> np.ndarray:
    return (4 * n + 4) // 5


def _band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, n, side="right") - 1


def _groups(band: int) -> int:
    """Number of groups, about in proportion to the words that a text of the band may lack."""
    lacks = 0.2 * float(EDGES[band] * EDGES[band + 1]) ** 0.5 + 1
    return max(1, round((0.7 if band >= TRIPLES else 0.4) * lacks))


def _frequent(texts: DataFrame, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By band: words that several texts of a sample hold, sorted, and in how many."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, text, name = named(batch.column(0).to_pylist())
            own = np.stack([_band(n)[text], name.view(np.int64)], 1)
            own, count = np.unique(own, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, own.T.copy()), pa.array(count)], ["band", "word", "n"])

    some = texts.sampleBy(F.expr(_LENGTH), {size: min(1.0, SAMPLE / count) for size, count in sizes.items()}, seed=1)
    counted = some.select("text").mapInArrow(sampled, "band bigint, word bigint, n bigint").groupBy("band", "word").agg(F.sum("n").alias("n")).where("n > 1")
    often = counted.orderBy(F.desc("n"), "band", "word").limit(KNOWN).toArrow()
    band, word, count = (often.column(k).to_numpy() for k in range(3))
    order = np.lexsort((word, band))
    return {int(b): (word[own], count[own]) for b in np.unique(band) for own in [order[band[order] == b]]}


_LENGTH = "cast(log2(length(text)) AS int)"


def _bags(texts: DataFrame, least: int) -> DataFrame:
    """A row for each text of at least ``least`` words; texts has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            n, text, name = named(batch.column(1).to_pylist())
            kept = n >= least
            inside = kept[text]
            text, name = text[inside], name[inside].view(np.int64)
            n, ids = n[kept], ids[kept]
            start = np.concatenate([[0], np.cumsum(n)])
            bits = (name & 255).astype(np.int64)
            lanes = []
            for lane in range(4):
                bit = np.where(bits >> 6 == lane, U(1) << (bits & 63).astype(U), U(0))
                lanes.append(np.bitwise_xor.reduceat(bit, start[:-1]).view(np.int64) if len(n) else np.zeros(0, np.int64))
            bag = name[np.lexsort((name, text))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int32)), _lists(bag, n), *map(pa.array, lanes)], ["id", "n", "bag", "s1", "s2", "s3", "s4"])

    return spread(texts).mapInArrow(run, _BAGS)


def _rows(bags: DataFrame, frequent: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """A row for each of a text's rarest words that others follow in its group: a key of the word and the band, the text's id, its number of
    words and band as one number, its fingerprint, and names of the words that follow."""

    def of_band(b: int, text: np.ndarray, n: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text and key of each row, how many words follow, and these."""
        word, count = frequent.get(b, (np.zeros(0, np.int64),) * 2)
        rarity = np.zeros(len(name), np.int64)
        if len(word):
            at = np.minimum(np.searchsorted(word, name), len(word) - 1)
            rarity = np.where(word[at] == name, count[at], 0)
        order = np.lexsort((name, rarity, text))
        text, name = text[order], name[order]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        groups, others = _groups(b), 2 if b >= TRIPLES else 1
        size = n - _need(n) + 1 + others * groups + (n // EXTRA if b >= TRIPLES else 0)
        rare = np.arange(len(name)) - first[text] < size[text]
        text, name = text[rare], _mix(name[rare].view(U) ^ U(b + 1))
        own = text * groups + (name % U(groups)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        text, name, own = text[order], name[order], own[order]
        ends = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]]))
        follow = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(own))
        head = np.flatnonzero(follow >= others)
        follow = follow[head]
        taken = np.repeat(head + 1 - np.cumsum(follow) + follow, follow) + np.arange(follow.sum())
        return text[head], name[head].view(np.int64), follow, (_mix(name[taken]) >> U(32)).astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.int64)
            bag = batch.column(2)
            name, text, band = bag.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), _band(n)
            below = np.where(_need(n) < EDGES[band], band - 1, band)
            for b in np.unique(np.concatenate([band, below])):
                here = (band == b) | (below == b)
                inside = here[text]
                at = np.flatnonzero(here)
                row, key, follow, rest = of_band(int(b), (np.cumsum(here) - 1)[text[inside]], n[here], name[inside])
                row = at[row]
                columns = [pa.array(key), batch.column(0).take(pa.array(row)), pa.array(n[row] << 6 | b)]
                columns += [batch.column(k).take(pa.array(row)) for k in range(3, 7)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(rest, follow)], ["key", "id", "size", "s1", "s2", "s3", "s4", "rest"])

    return bags.select("id", "n", "bag", "s1", "s2", "s3", "s4").mapInArrow(run, _ROWS)


def _blocks(key: np.ndarray, band: np.ndarray, rest: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of rows: a name and a row each."""
    row = np.repeat(np.arange(len(key)), follow)
    two = _mix(key[row] + rest)
    pair = band[row] < TRIPLES
    names, rows = [two[pair]], [row[pair]]
    one, step = np.flatnonzero(~pair), 0
    while len(one):
        step += 1
        one = one[one + step < len(row)]
        one = one[row[one + step] == row[one]]
        names.append(_mix(two[one] + rest[one + step]))
        rows.append(row[one])
    return np.concatenate(names), np.concatenate(rows)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near fingerprints that share a block, how many blocks they share here and how many they must share; takes all rows
    of the keys of a task."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    key, ids, size, *lanes = (table.column(k).to_numpy() for k in range(7))
    own = table.column(7).combine_chunks()
    follow, rest = own.value_lengths().to_numpy(), own.flatten().to_numpy().view(np.uint32).astype(U)
    n, band = size >> 6, size & 63
    name, row = _blocks(key.view(U), band, rest, follow)
    order = np.argsort(name)
    name, row = name[order], row[order]
    lanes = [lane.view(U) for lane in lanes]
    found, waiting = [], 0

    def said() -> pa.RecordBatch:
        pair, count = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*map(pa.array, pair.T.copy()), pa.array(count)], ["x", "y", "few", "n"])

    start, step = np.arange(len(name)), 0
    while len(start):
        step += 1
        start = start[start + step < len(name)]
        start = start[name[start + step] == name[start]]
        for some in np.split(start, range(AT_ONCE, len(start), AT_ONCE)):
            a, b = row[some], row[some + step]
            least, need = np.minimum(n[a], n[b]), _need(np.maximum(n[a], n[b]))
            # a band compares the texts that begin in it; two that only reach down to it meet in the next
            near = (least >= need) & (ids[a] != ids[b]) & (least < EDGES[band[a] + 1])
            a, b, least, need = a[near], b[near], least[near], need[near]
            apart = sum(np.bitwise_count(lane[a] ^ lane[b]).astype(np.int64) for lane in lanes)
            near = apart <= n[a] + n[b] - 2 * need
            a, b, least = a[near], b[near], least[near]
            few = np.where(band[a] >= TRIPLES, 1 + least // EXTRA, 1)
            found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), few], 1))
            waiting += len(a)
            if waiting > AT_ONCE:
                yield said()
                found, waiting = [], 0
    if waiting:
        yield said()


def _pairs(df: DataFrame, id_column: str, text_column: str, least: int) -> tuple[DataFrame, DataFrame]:
    """The records with their bag (the smallest id of those with the same words), and the pairs of different bags."""
    plain = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    texts = plain.where("text <> ''")
    lengths = texts.groupBy(F.expr(_LENGTH)).agg(F.count("*"), F.sum(F.length("text"))).collect()
    frequent = _frequent(texts, {r[0]: r[1] for r in lengths})
    all_ = written(_bags(texts, least).withColumns({"k1": F.xxhash64("bag"), "k2": F.xxhash64(F.lit(1), "bag")}), "bags")
    same = all_.groupBy("k1", "k2").agg(F.min("id").alias("bag_id"))
    members = written(all_.select("id", "k1", "k2").join(same, ["k1", "k2"]).select("id", "bag_id"), "classes")
    # only texts that have a smaller twin leave the table; while they are few, the others need no shuffle for that
    twins = members.where("bag_id <> id").select("id")
    bags = all_.drop("k1", "k2").join(F.broadcast(twins) if twins.count() <= FEW_TWINS else twins, "id", "left_anti")
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r[2] for r in lengths) // TASK_CHARS))
    shared = _rows(bags, frequent).repartition(tasks, "key").mapInArrow(_compared, "x bigint, y bigint, few bigint, n bigint")
    candidates = written(shared.groupBy("x", "y", "few").agg(F.sum("n").alias("n")).where("n >= few").select("x", "y"), "candidates")
    # the files of that shuffle stay until the driver collects its garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    x = bags.select(F.col("id").alias("x"), F.col("bag").alias("bag_x"))
    y = bags.select(F.col("id").alias("y"), F.col("bag").alias("bag_y"))
    enough = F.expr("5 * size(array_intersect(bag_x, bag_y)) >= 4 * greatest(size(bag_x), size(bag_y))")
    return members, candidates.join(x, "x").join(y, "y").where(enough).select("x", "y")


def copied_pairs(df: DataFrame, id_column: str, text_column: str, least: int = LEAST_WORDS) -> DataFrame:
    """All pairs (id_a < id_b) of texts of at least ``least`` words that share four fifths of the longer one's words."""
    members, pairs = _pairs(df, id_column, text_column, least)
    a, b = members.selectExpr("bag_id AS x", "id AS i"), members.selectExpr("bag_id AS y", "id AS j")
    across = pairs.join(a, "x").join(b, "y").select("i", "j")
    within = a.join(b, F.col("x") == F.col("y")).where("i < j").select("i", "j")
    return across.union(within).selectExpr("least(i, j) AS id_a", "greatest(i, j) AS id_b")


def copy_groups(df: DataFrame, id_column: str, text_column: str, least: int = LEAST_WORDS) -> DataFrame:
    """``id`` and ``group_id`` (the group's smallest id) of all records that have a copy, also by way of others."""
    members, pairs = _pairs(df, id_column, text_column, least)
    labels = components(pairs.selectExpr("x AS a", "y AS b"))
    own = members.join(labels, F.col("bag_id") == F.col("v"), "left").select("id", F.coalesce("label", "bag_id").alias("label"))
    groups = own.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("rows")).where("rows > 1")
    return own.join(groups, "label").select("id", "group_id")
