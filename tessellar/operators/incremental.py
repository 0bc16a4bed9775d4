"""Taking up only new or changed records, with the target itself as the state.

Every target row stores the key and the version of the source row it came from, and every record
that was taken up leaves such a row, whether it gave output or not. A run anti-joins the source
against them, so what a failed run left unpublished is simply still pending and what was published
never comes twice. A run appends what it made as a segment of its own; a manifest of numbered name
lists the segments of a target version and appears whole or not at all, so one step publishes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.session import cut

#: Columns of a target: the source key as a struct, and the source version (null where the source has none).
KEY, VERSION = "source_key", "source_version"
#: Partition column of a segment: rows of output, or the marks of the records taken up.
PART, ROWS, MARKS = "target_part", "rows", "marks"
#: Segments of a version beyond which they are written together.
SEGMENTS = 16


def pending(source: DataFrame, known: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The distinct rows of ``source`` that ``known`` does not hold in the same version.

    Both have the columns ``keys`` and ``version``; ``known`` one row a key. Versions compare
    null-safely: a null version is a version like another. Null keys never match and are pending.
    """
    there = known.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(version).alias("__v"))
    same = F.col(version).eqNullSafe(F.col("__v"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    return source.join(there, same, "left_anti").distinct()


def latest_entries(state: DataFrame, runs: DataFrame, keys: list[str], version: str, run: str = "run_id", finished: str = "finished_at", recorded: str = "recorded_at", success: str = "success") -> DataFrame:
    """(keys, version) as the successful run with the latest end wrote it down; entries of other runs do not count.

    Of several entries of that run for a key the latest recorded counts. Aggregated map-side, so a
    run or key with a third of all entries does not gather them. Empty tables give no entries.
    """
    good = runs.where(F.col("status") == success).groupBy(run).agg(F.max(finished).alias("__end"))
    rows = state.join(good, run)
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col("__end"), F.col(recorded).alias("__at"), F.col(version).alias("__v"))).alias("__last")).select(*keys, F.col("__last.__v").alias(version))


class VersionedTarget:
    """A folder of segments ``s-<token>`` and of manifests ``_version-<n>`` that list the segments of each published version.

    A manifest is written under another name and gets its own by one rename that fails if the name
    is taken. Of runs that started from one version only one publishes; a run that dies anywhere
    leaves a segment or a file that no manifest names, and the next run takes no notice of it. (On
    stores whose rename may overwrite, two runs at once have to be kept apart by other means.)

    Null keys are a key like another. Where a source holds several versions of a key the greatest
    counts (null is the least), of equal ones any row. Empty sources and outputs publish what they are. The names ``source_key``,
    ``source_version`` and ``target_part`` are the target's own: columns of a source called so are replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, segments: int = SEGMENTS):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), segments
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _published(self) -> tuple[int, list[list]]:
        """Number of the latest published version, and its segments as [number, token], oldest first."""
        best, at = 0, None
        root = self._path(self.folder)
        if self._fs.exists(root):
            for status in self._fs.listStatus(root):
                name = status.getPath().getName()
                if name.startswith("_version-") and int(name[len("_version-") :]) > best:
                    best, at = int(name[len("_version-") :]), status.getPath()
        if at is None:
            return 0, []
        stream = self._fs.open(at)
        try:
            return best, json.loads(stream.readLine())
        finally:
            stream.close()

    def _segment(self, number: int, token: str, part: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/s-{token}").where(F.col(PART) == part).drop(PART)
        return rows.withColumn("__segment", F.lit(number))

    def _gathered(self, segments: list[list], part: str) -> DataFrame | None:
        frames = [self._segment(n, t, part) for n, t in segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def _marks(self, segments: list[list]) -> DataFrame | None:
        """(key, version, segment) of every record the segments took up, as it came last."""
        marks = self._gathered(segments, MARKS)
        if marks is None or len(segments) == 1:
            return None if marks is None else marks.select(KEY, VERSION, "__segment")
        return marks.groupBy(KEY).agg(F.max_by(VERSION, "__segment").alias(VERSION), F.max("__segment").alias("__segment"))

    def known(self) -> DataFrame | None:
        """(source_key, source_version) of every record that was taken up; None before the first version."""
        marks = self._marks(self._published()[1])
        return None if marks is None else marks.select(KEY, VERSION)

    def _current(self, segments: list[list]) -> DataFrame | None:
        rows = self._gathered(segments, ROWS)
        if rows is None or len(segments) == 1:
            return rows
        last = self._marks(segments).select(F.col(KEY).alias("__key"), F.col("__segment").alias("__last"))
        return rows.join(last, (F.col(KEY).eqNullSafe(F.col("__key"))) & (F.col("__segment") == F.col("__last")), "left_semi")

    def read(self) -> DataFrame | None:
        """The output rows of the latest published version; None before the first."""
        rows = self._current(self._published()[1])
        return None if rows is None else rows.drop("__segment")

    def _todo(self, source: DataFrame, keys: list[str], version: str, marks: DataFrame | None, feed: bool) -> DataFrame:
        key = F.struct(*[F.col(k) for k in keys])
        stamped = source.withColumns({KEY: key, VERSION: F.col(version)}).drop(PART)
        # Of several versions the greatest: null is less than any other, so the flag goes first.
        newest = stamped.groupBy(KEY).agg(F.max_by(F.struct("*"), F.struct(F.col(VERSION).isNotNull(), F.col(VERSION))).alias("__row")).select("__row.*")
        if marks is None:
            return newest
        there = marks.select(F.col(KEY).alias("__key"), F.col(VERSION).alias("__v"))
        same: Column = F.col(VERSION).eqNullSafe(F.col("__v"))
        if feed:
            same = same | F.col(VERSION).isNull() | (F.col(VERSION) < F.col("__v"))
        return newest.join(there, F.col(KEY).eqNullSafe(F.col("__key")) & same, "left_anti")

    def pending(self, source: DataFrame, keys: list[str], version: str, feed: bool = False) -> DataFrame:
        """The rows of ``source``, one a key, that the published version has not taken up as they are, with their key and version.

        A snapshot's record is pending if its version is not the one known; of a feed only a greater one is, so that late
        older versions never come after newer ones.
        """
        return self._todo(source, keys, version, self._marks(self._published()[1]), feed)

    def adopt(self, known: DataFrame, keys: list[str], version: str) -> None:
        """Publishes records as taken up without output: what another bookkeeping says is done."""
        self.run(known, keys, version, lambda rows: rows.limit(0))

    def run(self, source: DataFrame, keys: list[str], version: str, process: Callable[[DataFrame], DataFrame], before_publish: Callable[[], None] | None = None, feed: bool = False) -> int:
        """Processes the pending rows of ``source`` and publishes the target with them; gives how many source rows were pending.

        ``process`` keeps the key and version columns; it may give any number of rows for a record,
        or none, and those of a record that comes again replace the earlier ones. Raises, with
        nothing published, if another run published meanwhile. ``before_publish`` is called between
        writing and publishing (a failure there loses nothing). Only what is pending is written.
        """
        number, segments = self._published()
        # Taken up once, so output and marks are of the same rows whatever becomes of the source.
        todo = cut(self._todo(source, keys, version, self._marks(segments), feed))
        count = todo.count()
        if not count and segments:
            return 0
        token = uuid.uuid4().hex
        marks = todo.select(KEY, VERSION).withColumn(PART, F.lit(MARKS))
        made = process(todo).withColumn(PART, F.lit(ROWS)).unionByName(marks, allowMissingColumns=True)
        made.write.partitionBy(PART).parquet(f"{self.folder}/s-{token}")
        if not count:
            # The first segment gives the schema, so even an empty one has a file.
            made.where("false").drop(PART).write.mode("overwrite").parquet(f"{self.folder}/s-{token}/{PART}={MARKS}")
        if before_publish:
            before_publish()
        self._publish(number + 1, [*segments, [number + 1, token]])
        if len(segments) + 1 > self.most:
            self.compact()
        return count

    def compact(self) -> None:
        """Writes the segments of the latest version together as one and publishes that; readers see the same rows."""
        number, segments = self._published()
        if len(segments) < 2:
            return
        token = uuid.uuid4().hex
        marks = self._marks(segments).select(KEY, VERSION).withColumn(PART, F.lit(MARKS))
        rows = self._current(segments).drop("__segment").withColumn(PART, F.lit(ROWS))
        rows.unionByName(marks, allowMissingColumns=True).write.partitionBy(PART).parquet(f"{self.folder}/s-{token}")
        self._publish(number + 1, [[number + 1, token]])

    def _publish(self, number: int, segments: list[list]) -> None:
        draft = f"{self.folder}/_draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            self._write(stream, json.dumps(segments))
        finally:
            stream.close()
        self._rename(draft, f"{self.folder}/_version-{number}")

    def _write(self, stream, text: str) -> None:
        stream.writeBytes(text + "\n")

    def _rename(self, draft: str, name: str) -> None:
        """Gives the draft its name in one step; raises if another run has taken it."""
        there, uri = self._path(draft), self._fs.getUri()
        if uri.getScheme() == "file":
            # A rename on a local disk overwrites; a second link does not.
            strip = lambda p: self._path(p).toUri().getPath()
            os.link(strip(draft), strip(name))
            self._fs.delete(there, False)
        else:
            jvm = self.spark._jvm
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf).rename(there, self._path(name), none)

    def vacuum(self, seconds: float = 7 * 86_400) -> int:
        """Deletes segments and drafts that the latest version does not name and that are older than ``seconds``; gives how many."""
        named = {f"s-{t}" for _, t in self._published()[1]}
        root, gone = self._path(self.folder), 0
        if not self._fs.exists(root):
            return 0
        limit = self.spark._jvm.System.currentTimeMillis() - int(seconds * 1000)
        for status in self._fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(("s-", "_draft-")) and name not in named and status.getModificationTime() <= limit:
                gone += self._fs.delete(status.getPath(), True)
        return gone
