"""Packing places every item once, within the room, near the lower bound."""

import random
from collections import Counter

import numpy as np
from qissaflow.llm import packing


def test_groups_have_equal_counts():
    out = packing.grouped({10: 7, 9: 1, 3: 8}, 4)
    assert [sum(n for _, n in g) for g in out] == [4, 4, 4, 4] and out[1] == [(10, 3), (9, 1)]


def test_configurations_solve_a_known_case():
    plan = packing.configurations([50, 34, 30], [10, 12, 12], 100)
    assert all(sum(s * k for s, k in zip((50, 34, 30), own)) <= 100 for _, own in plan)
    got = sum((t * own for t, own in plan), np.zeros(3))
    assert (got <= np.array([10, 12, 12])).all() and sum(t for t, _ in plan) >= 10


def test_every_item_once_and_close_to_the_bound():
    rng = random.Random(2)
    for n in (0, 1, 5, 300, 20_000):
        counts = Counter(min(4096, max(2, int(rng.lognormvariate(6.3, 1.1)))) for _ in range(n))
        back: Counter = Counter()
        bins = 0
        for times, own in packing.patterns(counts):
            assert times > 0 and sum(s * k for s, k in own.items()) <= 4096
            bins += times
            for s, k in own.items():
                back[s] += k * times
        bound = -(-sum(s * k for s, k in counts.items()) // 4096)
        assert back == counts and bins <= bound * 1.01 + 1


def test_large_items_alone():
    bins = sum(t for t, _ in packing.patterns({2049: 10, 4096: 3}))
    assert bins == 13
