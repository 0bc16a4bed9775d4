"""Orphan references against brute force, and the anchors they name."""

from __future__ import annotations

import random

import numpy as np

from tessellar.functions.anchors import numbered_anchors, slug_anchor
from tessellar.operators.references import RANGE, SPARSE, Bitmap, bitmaps, orphan_references, surviving

MONTH = 2_629_800_000_000


def test_against_brute_force(spark):
    rng = random.Random(9)
    parents = [(d, f"k{k}", rng.choice([None, rng.randrange(0, 40 * MONTH)])) for d in "ab" for k in range(60) if rng.random() < 0.8] + [("a", None, 1), ("a", "k1", 5), ("a", "k1", 7)]
    refs = [(rng.choice("abc"), rng.choice([None, f"k{rng.randrange(70)}", "k3", "k3"]), rng.choice([None, rng.randrange(0, 40 * MONTH)]), i) for i in range(600)]
    refs += refs[:50]
    since = {}
    for d, k, s in parents:
        if k is not None:
            since[d, k] = min(since.get((d, k), 2**63), -(2**62) if s is None else s)
    want = set()
    for d, k, t, i in refs:
        if k is not None:
            if (d, k) not in since:
                want.add((i, "absent"))
            elif t is not None and since[d, k] > t:
                want.add((i, "later"))
    left = spark.createDataFrame(refs, "domain string, key string, at long, since long")
    right = spark.createDataFrame(parents, "domain string, key string, since long")
    got = orphan_references(left, right).collect()
    assert len(got) == len(want) and {(r["since"], r["reason"]) for r in got} == want
    assert {r["reason"] for r in orphan_references(left, right.limit(0)).collect()} == {"absent"}
    assert orphan_references(left.limit(0), right).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(3)
    for size in (0, 1, SPARSE, SPARSE + 1, RANGE):
        positions = np.sort(rng.choice(RANGE, size, replace=False))
        bits = rng.random(RANGE) < 0.5
        made = Bitmap(positions)
        assert made.dense == (size > SPARSE) and (made.positions() == positions).all()
        assert (made.and_not(bits) == positions[~bits[positions]]).all()
        into = bits.copy()
        made.put_into(into)
        assert into.sum() == len(np.union1d(np.flatnonzero(bits), positions))


def test_ranges():
    rng = np.random.default_rng(4)
    ordinals, periods = rng.integers(0, RANGE, 30_000), rng.integers(0, 6, 30_000)
    pairs = np.unique(np.stack([ordinals, periods], 1), axis=0)
    has = np.unique(rng.integers(0, RANGE, 40_000))
    born = rng.integers(-1, 6, len(has))
    got = {(int(x), p) for p, left in surviving(bitmaps(pairs[:, 0], pairs[:, 1]), bitmaps(has, born)) for x in left}
    when = dict(zip(has.tolist(), born.tolist()))
    assert got == {(x, p) for x, p in pairs.tolist() if when.get(x, 99) >= p}


def test_slugs(spark):
    cases = {"Hello World": "hello-world", " a - b ": "a-b", "a-&-b": "a-b", "Über Straße": "ber-strae", "日本": "section", "__init__": "init", "A_b  c": "a-b-c", "": "section", "K1": "1"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", slug_anchor("t").alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == cases
    assert spark.createDataFrame([(None,)], "t string").select(slug_anchor("t")).first()[0] is None


def test_numbering(spark):
    rows = spark.createDataFrame([("f", 3, "a"), ("f", 1, "a"), ("f", 2, "b"), ("g", 1, "a"), ("f", 9, "a")], "file string, line int, base string")
    got = {(r["file"], r["line"]): r["anchor"] for r in numbered_anchors(rows, "file", ["line"], "base", "anchor").collect()}
    assert got == {("f", 1): "a", ("f", 3): "a-1", ("f", 9): "a-2", ("f", 2): "b", ("g", 1): "a"}
