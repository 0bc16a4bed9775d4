"""Packings are whole, fit, and reach what exhaustive search reaches."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tessellar.llm.containers import best_fit_decreasing, fill_containers, fill_report, lower_bound, pack


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                place(i + 1, rooms)
                rooms[k] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_pack_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randrange(10, 60)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 11))]
        bins = pack(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        want = optimum(sizes, capacity) if sizes else 0
        assert lower_bound(np.array(sizes, np.int64), capacity) <= want <= len(bins) <= len(best_fit_decreasing(sorted(sizes, reverse=True), capacity))
        assert len(bins) == want


def test_fill(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(200)] + [(200, None), (201, ""), (202, "word " * 900), (202, "word " * 900), (7, "again")]
    sizes = [(1, "s", 64), (2, "m", 100), (2, "m", 100), (3, "bad", 0), (4, "none", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS row", "3 AS container")
    c = spark.createDataFrame(sizes, "size_id long, name string, capacity_tokens long")
    filled = fill_containers(d, c, group_containers=20).collect()
    capacity = {1: 64, 2: 100}
    assert {r["size_id"] for r in filled} == {1, 2}
    for size, cap in capacity.items():
        rows = [r for r in filled if r["size_id"] == size]
        used = Counter()
        for r in rows:
            if r["container_id"] is not None:
                used[r["container_id"]] += r["tokens"]
        assert max(used.values()) <= cap
        assert {r["doc_id"] for r in rows} == {i for i, _ in docs}
        assert all(r["container_id"] is None and r["tokens"] == 0 for r in rows if r["doc_id"] in (200, 201))
        # Only texts above the capacity are cut, and both copies come out whole.
        total = Counter()
        for r in rows:
            total[r["doc_id"]] += r["tokens"]
        assert all(r["piece"] == 0 or total[r["doc_id"]] > cap for r in rows)
        assert total[202] % 2 == 0 and total[202] > 1000
    report = {r["size_id"]: r for r in fill_report(spark.createDataFrame(filled), c).collect()}
    assert report[1]["unused_share"] < 0.05 and report[2]["unused_share"] < 0.05


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    sizes = spark.createDataFrame([(1, 10)], "size_id long, capacity_tokens long")
    assert fill_containers(docs, sizes).count() == 0
    assert fill_containers(spark.createDataFrame([(1, "a")], docs.schema), sizes.limit(0)).count() == 0
