"""Contraction against union-find, and shares of the splits."""

import random
from collections import Counter

from qissaflow.llm import splits


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(4)
    edges = [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("hub", f"s{k}") for k in range(40)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {}
    for r in splits.components(spark.createDataFrame([*edges, *edges[:5], ("x", "x")], "a string, b string")).collect():
        got.setdefault(r.label, set()).add(r.v)
    assert sorted(map(sorted, got.values())) == brute(edges)
    assert splits.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_shares_and_groups(spark):
    rng = random.Random(6)
    rows = [(k, None if k % 30 == 0 else f"{100 + min(rng.randrange(300), rng.randrange(300)):04}Author.Work.X-ara1") for k in range(2000)]
    df = spark.createDataFrame(rows, "pred_id int, file string")
    got = {r.pred_id: r.split for r in splits.splits(df, "pred_id", "file").collect()}
    share = Counter(got.values())
    assert len(got) == 2000 and abs(share["train"] - 1600) <= 5 and abs(share["validation"] - 200) <= 5 and abs(share["test"] - 200) <= 5
    by = {}
    for k, f in rows:
        if f:
            by.setdefault(f, set()).add(got[k])
    assert all(len(v) == 1 for v in by.values())


def test_one_huge_group_takes_its_split_alone():
    out = splits.dealt({900: 1, 1: 100}, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert out[0] == (900, 0, 1, "train") and {s for _, _, _, s in out[1:]} == {"validation", "test"}
