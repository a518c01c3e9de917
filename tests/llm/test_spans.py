"""Shared spans against brute force."""

import random

import numpy as np
from qissaflow.llm import spans


def brute(rows, least):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(i)
    out = []
    for i, t in rows:
        own = []
        for k in range(len(t or "") - least + 1):
            if len(seen[t[k : k + least]]) > 1:
                if own and own[-1][1] >= k:
                    own[-1][1] = k + least
                else:
                    own.append([k, k + least])
        out += [(i, a, b) for a, b in own]
    return sorted(out)


def cases(seed):
    rng = random.Random(seed)
    words = ["من", "قال", "في", "ثم", "كان", "والمجنون", "a", "bb", "حدثنا", "العاقل،", "\n", "😀", "١٢"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [text(rng.randrange(1, 150)) for _ in range(30)]
    for _ in range(40):
        a, b = rng.choice(rows), text(rng.randrange(0, 40))
        k, n = rng.randrange(len(a)), rng.choice((90, 99, 100, 101, 150, 400))
        rows.append(b + a[k : k + n] + text(rng.randrange(0, 40)))
    rows += ["ا" * 250, "ا" * 130 + " ب", "اب" * 120, "ب" + "اب" * 60, "ا" * 99, "", None, rows[0], rows[0]]
    once = "".join(chr(0x5000 + k) for k in range(150))
    rows += [once + " " + once, "".join(rng.choice("ابتثجح") for _ in range(3000)), "x" * 100]
    rows.append(rows[-2][700:1900])
    return list(enumerate(rows, 1))


def test_spans_are_those_of_brute_force(spark):
    for seed in (1, 2):
        rows = cases(seed)
        df = spark.createDataFrame([(i, t, i) for i, t in rows], "pred_id bigint, text string, id bigint").repartition(3)
        got = sorted(map(tuple, spans.shared_spans(df, "pred_id", "text").collect()))
        assert got == brute(rows, 100) and len(got) > 30


def test_shares_cover_every_record_with_a_text(spark):
    rows = [(1, "ا" * 100 + "ب" * 100), (2, "ج" + "ا" * 100), (3, ""), (4, None), (5, "قال")]
    out = {r.id: (r.n_chars, r.shared_chars, r.shared_share) for r in spans.shared_shares(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert out == {1: (200, 100, 0.5), 2: (101, 100, 100 / 101), 3: (0, 0, 0.0), 5: (3, 0, 0.0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "pred_id bigint, text string")
    assert spans.shared_spans(df, "pred_id", "text").collect() == []


def test_every_window_is_in_exactly_one_block():
    texts = [t for _, t in cases(3) if t]
    key, text, low, high, whole = spans.blocks(texts)
    for k, t in enumerate(texts):
        own = sorted((a, b) for a, b in zip(low[text == k], high[text == k]))
        assert [x for a, b in own for x in range(a, b + 1)] == list(range(max(0, len(t) - 99)))
    assert key.dtype == np.uint64 and len(key) == len(whole)
