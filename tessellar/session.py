"""Session helpers: builder defaults, shared folders, lineage cuts, broadcasts of a checked size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have at most, beyond which the join is left to the planner.
BROADCAST_ROWS = 200_000


def build_session(app: str = "tessellar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume (UTC, AQE); extra settings by keyword, dots as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary one; on a cluster that is an error, as its
    executors share no folder of the driver's machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tessellar-checkpoints"))
        current = context.getCheckpointDir()
    return named or current


def own_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for tables a query writes and reads again."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so that later uses neither recompute it nor carry its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (made once, by ``cut``) marked for broadcast if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    made = cut(df)
    return F.broadcast(made) if made.limit(rows + 1).count() <= rows else made


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted whatever its estimate, which counts compressed files and one element an array."""
    return df.hint("merge")


def task_slots(spark: SparkSession) -> int:
    """Shuffle partitions set for the session; the width used when a plan has to choose a partition count itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
