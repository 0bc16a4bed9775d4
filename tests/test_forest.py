"""Hierarchies against a walk in plain Python, at every size of task."""

from __future__ import annotations

import random

import pytest

from tessellar.operators.forest import descendants, loops, resolve_forest, tree_paths


def walk(parent):
    out = {}
    for node in parent:
        path, x = [node], node
        while parent[x] is not None and parent[x] in parent:
            x = parent[x]
            if x in path:
                path = None
                break
            path.append(x)
        out[node] = (-1, -1, None) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def links(kind, n, rng):
    if kind == "near":
        rows = {i: i - rng.randrange(1, 6) if i % 17 else None for i in range(1, n)}
    elif kind == "chain":
        rows = {i: i - 1 if i else None for i in range(n)}
    elif kind == "hot":
        rows = {i: 0 if i and i % 3 else max(0, i - 7) if i else None for i in range(n)}
    else:
        rows = {i: rng.randrange(int(n * 1.1)) if rng.random() < 0.9 else None for i in range(n)}
    if kind != "chain":
        for _ in range(3):
            a = rng.randrange(1, n - 5)
            rows[a], rows[a + 2], rows[a + 4] = a + 2, a + 4, a
        rows[n // 2] = n // 2
    return rows


@pytest.mark.parametrize("kind", ["near", "chain", "hot", "random"])
@pytest.mark.parametrize("task_rows", [10_000, 60])
def test_against_walk(spark, kind, task_rows):
    parent = links(kind, 300, random.Random(kind))
    want = walk(parent)
    rows = [(i, p, i) for i, p in parent.items()]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows + rows[:40] + [(None, 1, 0)], "id long, parent_id long, root long")
    got = {r["id"]: (r["root"], r["depth"]) for r in resolve_forest(table, "id", "parent_id", task_rows).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    paths = tree_paths(table, "id", "parent_id", task_rows, place="root")
    rows = paths.collect()
    assert {r["id"]: (r["root"], r["depth"], r["path"], r["places"], r["parent"]) for r in rows} == {k: (*v, v[2], parent[k]) for k, v in want.items()}
    pairs = {(r["ancestor_id"], r["id"], r["distance"], r["place"]) for r in descendants(paths).collect()}
    assert pairs == {(a, k, len(v[2]) - 1 - d, "".join(f".{x}" for x in v[2][d + 1 :])) for k, v in want.items() if v[2] for d, a in enumerate(v[2][:-1])}


def test_scattered_chain(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth, wherever the links lie."""
    from tessellar.operators import forest

    n, rounds = 1000, []
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    table = spark.createDataFrame([(ids[k], ids[k - 1] if k else None) for k in range(n)], "id long, parent_id long")
    monkeypatch.setattr(forest, "cut", lambda df, made=forest.cut: rounds.append(1) or made(df))
    got = {r["id"]: r["path"] for r in tree_paths(table, "id", "parent_id").collect()}
    assert got == {ids[k]: ids[: k + 1] for k in range(n)}
    assert len(rounds) <= 20


def test_walk_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from tessellar.operators import forest

    monkeypatch.setattr(forest, "WALK_ROWS", 7)
    parent = {i: i // 2 if i > 1 else 99 if i else None for i in range(40)}
    batch = pa.record_batch({"id": list(parent), "stated": pa.array(list(parent.values()), pa.int64()), "up": pa.array(list(parent.values()), pa.int64()), "place": pa.array([i if i % 3 else None for i in parent], pa.int64())})
    got = [r for b in forest._walk_partition(iter([batch.slice(0, 13), batch.slice(13)])) for r in b.to_pylist()]
    for r in got:
        path = [r["id"]]
        while parent[path[-1]] in parent:
            path.append(parent[path[-1]])
        assert r["ids"] == path[::-1] and r["places"] == [i if i % 3 else None for i in path[::-1]] and r["top"] == path[-1] and r["up"] == parent[path[-1]]
    assert len(got) == 40


def test_loops(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, None), (8, 99)], "id long, parent_id long")
    forest = resolve_forest(table, "id", "parent_id")
    assert {r["id"] for r in forest.where("root = -1").collect()} == {1, 2, 3, 4, 5, 6}
    assert {(r["id"], r["loop_id"]) for r in loops(forest).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6)}
    assert loops(forest.where("root <> -1")).count() == 0


def test_conflicts_and_empty(spark):
    table = spark.createDataFrame([(1, None), (2, 1), (2, 5), (5, None), (2, None)], "id long, parent_id long")
    assert {r["id"]: r["root"] for r in resolve_forest(table, "id", "parent_id").collect()} == {1: 1, 2: 1, 5: 5}
    assert resolve_forest(table.limit(0), "id", "parent_id").count() == 0
    assert tree_paths(table.limit(0), "id", "parent_id").count() == 0
