"""Runs take up what is pending, once, whatever fails between."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessellar.functions.times import clock_micros, instant_micros
from tessellar.operators.incremental import KEY, VERSION, VersionedTarget, latest_entries, pending


def test_instants(spark):
    rows = [("2024-01-01T10:00:00.500Z",), ("2024-01-01T12:00:00.500+02:00",), ("2024-01-01T05:00:00.500-05:00",), ("2024-01-01T10:00:00.500",), ("2024-01-01T10:00:00Z",), ("bad",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(instant_micros("t")).collect()]
    assert got[0] == got[1] == got[2] == got[3] == got[4] + 500_000 and got[5:] == [None] * 3
    ntz = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00.5' AS t")
    assert ntz.select(clock_micros("t")).first()[0] == got[0]


def test_latest_entries_and_pending(spark):
    runs = spark.createDataFrame([(1, "success", 10), (2, "failed", 30), (3, "success", 20), (4, "success", None), (3, "success", 20)], "run_id long, status string, finished_at long")
    state = spark.createDataFrame(
        [(1, "a", 1, 5, 0), (3, "a", 1, 6, 0), (2, "a", 1, 7, 0), (3, "a", 1, 6, 0), (1, "a", 2, 5, 0), (3, "a", 3, 1, 1), (3, "a", 3, 2, 2), (9, "a", 4, 1, 0), (1, "a", 5, None, 0)],
        "run_id long, entity string, id long, version long, recorded_at long",
    )
    known = latest_entries(state, runs, ["entity", "id"], "version")
    assert {(r["id"], r["version"]) for r in known.collect()} == {(1, 6), (2, 5), (3, 2), (5, None)}
    source = spark.createDataFrame([("a", 1, 6), ("a", 1, 6), ("a", 2, 6), ("a", 4, 1), ("a", 4, 1), ("a", 5, None), ("b", 1, 6), ("a", None, 1)], "entity string, id long, version long")
    assert {tuple(r) for r in pending(source, known, ["entity", "id"], "version").collect()} == {("a", 2, 6), ("a", 4, 1), ("b", 1, 6), ("a", None, 1)}
    assert pending(source.limit(0), known, ["entity", "id"], "version").count() == 0
    assert pending(source, known.limit(0), ["entity", "id"], "version").count() == 6


def ident(df):
    return df


def test_target(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "target"))
    assert target.read() is None and target.known() is None
    seen = []

    def process(df):
        seen.append(sorted(r["id"] for r in df.collect()))
        return df.withColumn("out", F.upper("body"))

    first = spark.createDataFrame([(1, "u1", "a"), (2, "u1", "b"), (2, "u1", "b"), (3, None, "c")], "id long, updated string, body string")
    assert target.run(first, ["id"], "updated", process) == 3
    assert target.run(first, ["id"], "updated", process) == 0
    second = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "B2"), (3, None, "c"), (4, "u1", "d")], first.schema)

    def crash():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        target.run(second, ["id"], "updated", process, before_publish=crash)
    assert {r["id"]: r["out"] for r in target.read().collect()} == {1: "A", 2: "B", 3: "C"}
    assert {r["id"] for r in target.pending(second, ["id"], "updated").collect()} == {2, 4}
    assert target.run(second, ["id"], "updated", process) == 2
    assert {r["id"]: r["out"] for r in target.read().collect()} == {1: "A", 2: "B2", 3: "C", 4: "D"}
    assert seen[-1] == [2, 4]
    assert {KEY, VERSION} <= set(target.read().columns)
    # Of two runs from one version only one publishes.
    other = VersionedTarget(spark, str(tmp_path / "target"))
    third = spark.createDataFrame([(5, "u1", "e")], first.schema)
    with pytest.raises(Exception):  # noqa: B017
        target.run(third, ["id"], "updated", process, before_publish=lambda: other.run(third, ["id"], "updated", process))
    assert sorted(r["id"] for r in other.read().collect()) == [1, 2, 3, 4, 5]
    assert target.vacuum(0) > 0
    assert sorted(r["id"] for r in other.read().collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("step", ["before_publish", "_publish", "_write", "_rename"])
def test_a_run_lost_at_any_step_blocks_none(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "target")
    rows = spark.createDataFrame([(1, "u1"), (2, "u1")], "id long, updated string")
    more = rows.unionByName(spark.createDataFrame([(3, "u1")], rows.schema))
    target = VersionedTarget(spark, folder)
    assert target.run(rows, ["id"], "updated", ident) == 2

    def lost(*_):
        raise OSError("lost")

    for _ in range(2):
        with monkeypatch.context() as m:
            if step != "before_publish":
                m.setattr(VersionedTarget, step, lost)
            with pytest.raises(OSError, match="lost"):
                target.run(more, ["id"], "updated", ident, before_publish=lost if step == "before_publish" else None)
        assert {r["id"] for r in target.read().collect()} == {1, 2}
    assert target.run(more, ["id"], "updated", ident) == 1
    assert {r["id"] for r in target.read().collect()} == {1, 2, 3}
    assert target.run(more, ["id"], "updated", ident) == 0


def test_several_versions_of_a_key(spark, tmp_path):
    """A feed keeps all versions of its keys: the newest is taken up once, and an older one that comes late never."""
    feed = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, v long, body string")
    target = VersionedTarget(spark, str(tmp_path / "feed"))
    assert target.run(feed, ["id"], "v", ident, feed=True) == 2
    grown = feed.unionByName(spark.createDataFrame([(1, 2, "A"), (3, None, "c")], feed.schema))
    assert [target.run(grown, ["id"], "v", ident, feed=True) for _ in range(3)] == [2, 0, 0]
    late = spark.createDataFrame([(1, 1, "old"), (2, 0, "older"), (3, None, "c"), (None, 1, "n")], feed.schema)
    assert [target.run(late, ["id"], "v", ident, feed=True) for _ in range(2)] == [1, 0]
    assert {(r["id"], r["v"], r["body"]) for r in target.read().collect()} == {(1, 2, "A"), (2, 1, "b"), (3, None, "c"), (None, 1, "n")}
    # A snapshot says what holds now, so there an older version is a change.
    back = VersionedTarget(spark, str(tmp_path / "snapshot"))
    assert back.run(grown, ["id"], "v", ident) == 3
    assert [back.run(feed, ["id"], "v", ident) for _ in range(2)] == [1, 0]
    assert {(r["id"], r["body"]) for r in back.read().collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_records_without_output_and_with_several(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1) for i in range(6)], "id long, v long")
    target = VersionedTarget(spark, str(tmp_path / "t"))
    some = lambda df: df.where("id % 2 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert [target.run(rows, ["id"], "v", some) for _ in range(3)] == [6, 0, 0]
    assert target.read().count() == 6
    # Now nothing comes of 0: its earlier rows are gone.
    assert target.run(rows.withColumn("v", F.when(F.col("id") == 0, 2).otherwise(F.col("v"))), ["id"], "v", lambda df: df.limit(0)) == 1
    assert {r["id"] for r in target.read().collect()} == {2, 4}
    assert target.known().count() == 6


def test_appended_and_compacted(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"), segments=2)
    for k in range(4):
        rows = spark.createDataFrame([(i, k if i <= k else 0) for i in range(4 + k)], "id long, v long")
        target.run(rows, ["id"], "v", ident)
        assert {(r["id"], r["v"]) for r in target.read().collect()} == {(i, k if i <= k else 0) for i in range(4 + k)}
        assert target.run(rows, ["id"], "v", ident) == 0
        assert len(target._published()[1]) <= 2


def test_empty_and_adopted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1")], "id long, updated string")
    target = VersionedTarget(spark, str(tmp_path / "target"))
    assert target.run(rows.limit(0), ["id"], "updated", ident) == 0
    assert target.read().count() == 0
    target.adopt(rows, ["id"], "updated")
    assert target.run(rows, ["id"], "updated", ident) == 0 and target.read().count() == 0
    assert target.run(rows.withColumn("updated", F.lit("u2")), ["id"], "updated", ident) == 1


def test_clashing_columns_and_long_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1", "p", "k", "x" * 300_000), (2, None, None, None, "")], "id long, updated string, part string, source_key string, target_part string")
    target = VersionedTarget(spark, str(tmp_path / "t"))
    assert [target.run(rows, ["id"], "updated", ident) for _ in range(2)] == [2, 0]
    assert {(r["id"], r["part"]) for r in target.read().collect()} == {(1, "p"), (2, None)}


def test_leftovers_block_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1")], "id long, updated string")
    (tmp_path / "target").mkdir()
    for name in ("_lock-1", "_draft-ab", "s-cd"):
        (tmp_path / "target" / name).touch()
    target = VersionedTarget(spark, str(tmp_path / "target"))
    assert target.run(rows, ["id"], "updated", ident) == 1
    assert target.read().count() == 1
