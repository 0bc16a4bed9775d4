"""Change feeds as streams: the latest row of each key, and a search index kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellar.operators.incremental import VersionedTarget
from tessellar.operators.search import postings


def latest_stream(changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) whenever a key's latest row changes: a stream in update mode, one small state a key.

    Rows that arrive late and are older than the state change nothing; of equal orders the greatest
    value counts. A null order is less than any other.
    """
    last = F.max(F.struct(F.col(order).isNotNull().alias("has"), F.col(order).alias("o"), F.col(value).alias("v")))
    return changes.groupBy(key).agg(last.alias("last")).select(key, F.col("last.o").alias(order), F.col("last.v").alias(value))


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Events per key and window of event time; events later than ``late`` do not count any more."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), *keys, "events")


def keep_index(changes: DataFrame, folder: str, key: str, version: str, text: Callable[[], Column], checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps an index of postings under ``folder`` in step with a stream of documents; each batch publishes one version atomically.

    A batch that comes again after a failure finds its documents in the target and changes nothing.
    """

    def index(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct("*"), version).alias("r")).select("r.*")

        def process(rows: DataFrame) -> DataFrame:
            found = postings(rows, key, text())
            return rows.select(key, "source_key", "source_version").join(found, key, "left")

        VersionedTarget(batch.sparkSession, folder).run(last, [key], version, process, feed=True)

    return changes.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
