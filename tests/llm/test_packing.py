import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapisan.llm import packing, tokens


def test_knapsack_is_best():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 9, 4))
        price = r.random(len(sizes))
        use = packing.dearest(sizes, price, 17)
        best = max(sum(np.array(c) * price) for c in itertools.product(*[range(17 // s + 1) for s in sizes]) if sum(np.array(c) * sizes) <= 17)
        assert (use * sizes).sum() <= 17 and abs((use * price).sum() - best) < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_whole_containers_hold_exactly_the_demand(histogram):
    sizes, demand = np.array(sorted(histogram), np.int64), np.array([histogram[k] for k in sorted(histogram)], np.int64)
    plan, bound = packing.whole(sizes, demand, 40, rounds=30)
    total = sum((use * m for use, m in plan), np.zeros(len(sizes), np.int64))
    assert (total == demand).all() and all((use * sizes).sum() <= 40 for use, _ in plan)
    assert sum(m for _, m in plan) >= bound - 1e-6


@pytest.mark.parametrize("capacity", [7, 50, 5000])
def test_pack(spark, capacity):
    r = np.random.default_rng(2)
    sizes = [0, None, 1, 7, 8, 50, 51, 12_345, *map(int, r.integers(1, 200, 300)), *[25] * 200]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc bigint, tokens bigint").selectExpr("*", "1 as id", "2 as cell", "3 as salt")
    got, summary = packing.pack(df, "doc", "tokens", capacity)
    rows = got.collect()
    per, whole = {}, {}
    for x in rows:
        per[x.container_id] = per.get(x.container_id, 0) + x.tokens
        whole.setdefault(x.doc, []).append((x.start_token, x.tokens))
    assert max(per.values()) <= capacity and set(whole) == set(range(len(sizes)))
    for doc, ps in whole.items():
        n = sizes[doc] or 0
        assert sum(t for _, t in ps) == n and len(ps) == max(1, -(-n // capacity)) and sorted(s for s, _ in ps) == list(range(0, max(1, n), capacity))[: len(ps)]
    total = sum(n or 0 for n in sizes)
    if capacity == 50:
        assert summary["containers"] <= 1.06 * total / capacity


def test_empty_and_tokens(spark):
    got, summary = packing.pack(spark.createDataFrame([], "doc bigint, tokens bigint"), "doc", "tokens", 10)
    assert got.count() == 0 and summary["containers"] == 0
    df = spark.createDataFrame([(1, "Satu dua <|endoftext|>"), (2, None), (3, ""), (4, "x " * 50_000)], "d bigint, text string").selectExpr("*", "5 as tokens")
    n = {r.d: r.tokens for r in tokens.token_counts(df, "d", "text").collect()}
    assert n[1] > 4 and n[2] == n[3] == 0 and n[4] >= 50_000


def cell_by_cell(sizes, price, capacity):
    """The knapsack's best price, from all sizes at every cell."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        value = best[c - sizes[: upto[c]]] + price[: upto[c]]
        best[c] = max(best[c - 1], value[int(value.argmax())])
    return best[-1]


def test_knapsack_takes_less_than_all_sizes_at_every_cell():
    r = np.random.default_rng(3)
    for capacity, noise in ((2048, 0.0), (2047, 0.02), (2048, 0.2), (1, 0.1), (2, 0.1)):
        sizes = np.arange(1, capacity + 1)
        price = sizes / capacity * np.exp(noise * r.standard_normal(len(sizes)))
        took = {}
        for f in (packing.dearest, cell_by_cell):
            for _ in range(5):
                t = time.process_time()
                got = f(sizes, price, capacity)
                took[f] = min(took.get(f, 9e9), time.process_time() - t)
        assert abs((packing.dearest(sizes, price, capacity) * price).sum() - got) < 1e-9
        assert capacity < 100 or took[packing.dearest] < 0.8 * took[cell_by_cell]
