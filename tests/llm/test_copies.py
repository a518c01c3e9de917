"""Blocks of several words (problem 1)."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from qissaflow.llm import copies


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, text string").repartition(3)


def test_pairs_at_the_bound_within_and_across_bands(spark):
    pick = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for n in (20, 25, 51, 63, 64, 79, 80, 128, 159, 160, 200, 320, 399, 400, 499, 500, 800, 1000):
        own = [vocabulary[int(900 * pick.random() ** 3)] for _ in range(n)]
        rows.append(own)
        for size in sorted({n, n + n // 8, n * 5 // 4, -(-n * 5 // 4)}):
            need = -(-4 * size // 5)
            for shared in (need, need - 1):
                rows.append(pick.sample(own, min(shared, n)) + [f"x{len(rows)}n{k}" for k in range(size - min(shared, n))])
    bags = [Counter(r) for r in rows]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if 5 * (bags[a] & bags[b]).total() >= 4 * max(len(rows[a]), len(rows[b]))}
    got = [tuple(r) for r in copies.copied_pairs(texts(spark, map(" ".join, rows)), "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    # across the edges of bands, and in blocks of three words
    assert {(len(rows[a]) < 64 <= len(rows[b]), len(rows[a]) < 160 <= len(rows[b]), len(rows[a]) >= 400) for a, b in want} >= {(True, False, False), (False, True, False), (False, False, True)}


def test_texts_of_few_words_where_they_are_asked_for(spark):
    rows = ["a", "a b", "b a", "a b c d", "a b c d e", "e d c b x", "a b c d e f g h i", "a b c d e f g h j", "a a b c d"]
    bags = [Counter(r.split()) for r in rows]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if 5 * (bags[a] & bags[b]).total() >= 4 * max(bags[a].total(), bags[b].total())}
    assert set(map(tuple, copies.copied_pairs(texts(spark, rows), "id", "text", 1).collect())) == want


def test_unrelated_texts_of_one_vocabulary_are_hardly_compared(spark):
    pick = np.random.default_rng(5)
    rows = [" ".join(f"w{k}" for k in (2000 * pick.random(45) ** 2).astype(int)) for _ in range(2000)]
    df = texts(spark, rows)
    lengths = dict(df.groupBy(F.expr(copies._LENGTH)).count().collect())
    table = copies._rows(copies._bags(df, 20), copies._frequent(df, lengths)).toArrow()
    key, size, rest = (table.column(k).combine_chunks() for k in ("key", "size", "rest"))
    band = size.to_numpy() & 63
    name, _ = copies._blocks(key.to_numpy().view(np.uint64), band, rest.flatten().to_numpy().view(np.uint32).astype(np.uint64), rest.value_lengths().to_numpy())
    held = np.unique(name, return_counts=True)[1]
    # blocks of one word, the twelve rarest of each text
    often = Counter(w for r in rows for w in set(r.split()))
    single = Counter(w for r in rows for w in sorted(set(r.split()), key=lambda w: (often[w], w))[:12])
    assert (band == 1).all() and (held * (held - 1) // 2).sum() * 20 < sum(n * (n - 1) // 2 for n in single.values())
