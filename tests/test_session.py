"""Folders and broadcasts that depend on where a session runs."""

from __future__ import annotations

import pytest

from tessellar import session


class Context:
    """A context as far as the checkpoint folder asks."""

    def __init__(self, master: str, named: str | None):
        self.master, self.named, self.folder = master, named, None

    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder: str):  # noqa: N802
        self.folder = folder


class Session:
    def __init__(self, *args):
        self.sparkContext, self.conf = Context(*args), {}


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_folder(Session(master, None))
        assert session.checkpoint_folder(Session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert "tessellar" in session.checkpoint_folder(Session("local[4]", None)) and "tessellar" in session.checkpoint_folder(Session("local", None))


def test_broadcasts_are_checked(spark):
    rows = spark.range(100).toDF("id")

    def plan(df):
        return spark.range(1_000).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(session.sized_broadcast(rows, 100)) and "strategy=broadcast" not in plan(session.sized_broadcast(rows, 99))
    assert session.sized_broadcast(rows.limit(0)).count() == 0
