"""Leaks against brute force, with and without the shingles that tasks hold."""

import random

from qissaflow.llm import leaks


def brute(docs, items, words=15):
    out = set()
    for d, t in docs:
        own = leaks.bare_words(t) if t else []
        runs = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)}
        for i, x in items:
            w = leaks.bare_words(x) if x else []
            if any(tuple(w[k : k + words]) in runs for k in range(len(w) - words + 1)):
                out.add((d, i))
    return out


def test_join_is_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"كلمة{k}" for k in range(12)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"i{k}", " ".join(words(rng.randrange(10, 40)))) for k in range(12)] + [("same", None), ("empty", ""), ("loop", "قال " * 30)]
    items.append(("version", items[0][1] + " وزاد"))
    docs = []
    for k in range(60):
        own = words(rng.randrange(0, 30))
        source = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(source))
        own += source[a : a + rng.choice((13, 14, 15, 16, 40))] + words(rng.randrange(0, 20))
        docs.append((k, " ".join(own)))
    docs += [(90, None), (91, ""), (92, "قال " * 15), (93, "قال " * 14), (94, docs[0][1]), (95, items[3][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, id string").repartition(2)
    i = spark.createDataFrame(items, "id string, text_ar string")
    want = brute(docs, items)
    assert len(want) > 15
    for held in (leaks.HELD, 3):
        monkeypatch.setattr(leaks, "HELD", held)
        assert sorted(map(tuple, leaks.leaked_items(d, "doc_id", "text", i, "id", "text_ar").collect())) == sorted(want)
    assert leaks.leaked_items(d, "doc_id", "text", i.limit(0), "id", "text_ar").collect() == []
    assert leaks.leaked_items(d.limit(0), "doc_id", "text", i, "id", "text_ar").collect() == []
