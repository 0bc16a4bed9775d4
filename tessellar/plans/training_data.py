"""Queries of the general training-data operators (problems 4, 5 and 6) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.anchors import numbered_anchors, slug_anchor
from tessellar.functions.times import clock_micros, instant_micros
from tessellar.operators.forest import descendants, dotted, loops, resolve_forest, tree_paths
from tessellar.operators.incremental import VersionedTarget, latest_entries
from tessellar.operators.references import orphan_references
from tessellar.session import own_folder
from tessellar.sources.tables import table

# Problem 4


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    forest = resolve_forest(table(spark, sf, "tasks"), "id", "parent_id")
    return forest.where(F.col("parent").isNotNull()).select(F.col("id").alias("task_id"), F.col("root").alias("root_id"), "depth")


def task_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tree_paths(table(spark, sf, "tasks"), "id", "parent_id", place="child_seq")


def p4_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every task with its place: ids from the root down, and the dotted ``child_seq`` of the steps."""
    ids = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return task_paths(spark, sf).select(F.col("id").alias("task_id"), F.col("root").alias("root_id"), "depth", ids.alias("path"), dotted().alias("place"))


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Everything below every task, with the dotted ``child_seq`` from there down, by which siblings are placed."""
    return descendants(task_paths(spark, sf)).select("ancestor_id", F.col("id").alias("task_id"), "distance", "place")


def p4_loops(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks that lie on a loop, each with the smallest id of its loop."""
    return loops(resolve_forest(table(spark, sf, "tasks"), "id", "parent_id")).select(F.col("id").alias("task_id"), "loop_id")


P4_TREE = """
WITH RECURSIVE n AS (SELECT id, min(parent_id) AS parent, min(child_seq) AS seq FROM tasks WHERE id IS NOT NULL GROUP BY id),
t AS (
  SELECT n.id, n.parent, n.id AS root, CAST(0 AS BIGINT) AS depth, CAST(n.id AS VARCHAR) AS path, '' AS place
  FROM n WHERE n.parent IS NULL OR n.parent NOT IN (SELECT id FROM n)
  UNION ALL
  SELECT c.id, c.parent, t.root, t.depth + 1, t.path || '/' || CAST(c.id AS VARCHAR), t.place || '.' || coalesce(CAST(c.seq AS VARCHAR), '?') FROM t JOIN n c ON c.parent = t.id
),
w AS (SELECT n.id, n.parent, coalesce(t.root, -1) AS root, coalesce(t.depth, -1) AS depth, t.path, t.place FROM n LEFT JOIN t ON t.id = n.id)
"""

# Problem 5


def source_versions(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, record_id, version) of what tasks and projects hold now."""
    parts = [
        table(spark, sf, name).where(F.col("id").isNotNull()).select(F.lit(entity).alias("entity"), F.col("id").alias("record_id"), instant_micros("updated_at").alias("version"))
        for entity, name in (("task", "tasks"), ("project", "projects"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def synced_versions(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, record_id, version) as the latest successful run knew it."""
    state = table(spark, sf, "sync_state").withColumn("version", instant_micros("seen_updated_at"))
    return latest_entries(state, table(spark, sf, "sync_runs"), ["entity", "record_id"], "version")


SYNCED = ["entity", "record_id"]


def sync_target(spark: SparkSession, sf: str) -> VersionedTarget:
    """A target that has taken up what the successful runs wrote down."""
    target = VersionedTarget(spark, own_folder(spark, "sync-target"))
    target.adopt(synced_versions(spark, sf), SYNCED, "version")
    return target


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """What the published target, whose rows hold source key and version, has not taken up of the source as it is now."""
    return sync_target(spark, sf).pending(source_versions(spark, sf), SYNCED, "version").select(*SYNCED)


def p5_sync(spark: SparkSession, sf: str) -> DataFrame:
    """One run that takes up what is pending, one that dies before publishing and one after it: what the target holds of them."""
    target, now = sync_target(spark, sf), source_versions(spark, sf)

    def lost() -> None:
        raise InterruptedError

    try:
        target.run(now, SYNCED, "version", lambda rows: rows, before_publish=lost)
    except InterruptedError:
        pass
    target.run(now, SYNCED, "version", lambda rows: rows)
    target.run(now, SYNCED, "version", lambda rows: rows)
    return target.read().select(*SYNCED, "version")


def p5_sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity how many records a run would add and update, what is unchanged, and what it knows but is gone."""
    now = source_versions(spark, sf).groupBy("entity", "record_id").agg(F.max("version").alias("version"))
    known = synced_versions(spark, sf).withColumnRenamed("version", "seen").withColumn("known", F.lit(True))
    there = now.withColumn("present", F.lit(True)).join(known, ["entity", "record_id"], "full")
    action = F.when(F.col("known").isNull(), "added").when(F.col("present").isNull(), "removed").when(F.col("version").eqNullSafe(F.col("seen")), "unchanged").otherwise("updated")
    return there.groupBy("entity", action.alias("action")).agg(F.count(F.lit(1)).alias("records"))


P5_VERSIONS = """
WITH src AS (
  SELECT DISTINCT 'task' AS entity, id AS record_id, epoch_us(CAST(updated_at AS TIMESTAMPTZ)) AS version FROM tasks WHERE id IS NOT NULL
  UNION SELECT DISTINCT 'project', id, epoch_us(CAST(updated_at AS TIMESTAMPTZ)) FROM projects WHERE id IS NOT NULL
),
known AS (
  SELECT s.entity, s.record_id, arg_max(epoch_us(CAST(s.seen_updated_at AS TIMESTAMPTZ)), r.finished_at) AS version
  FROM sync_state s JOIN sync_runs r ON r.run_id = s.run_id AND r.status = 'success' GROUP BY ALL
)
"""

# Problem 6


def heading_parents(spark: SparkSession, sf: str) -> DataFrame:
    """(file, anchor, since) of the headings, repeated slugs of a file numbered in line order."""
    heads = table(spark, sf, "symbol_rows").where("kind = 'heading' AND sym_id IS NOT NULL").select("sym_id", "file", "line", "indexed_at", slug_anchor("name").alias("base")).dropDuplicates(["sym_id"])
    return numbered_anchors(heads, "file", ["line", "sym_id"], "base", "anchor").select("file", "anchor", clock_micros("indexed_at").alias("since"))


def pair_key(*parts) -> F.Column:
    """A key of several columns; null if one is. The separator cannot occur in paths or slugs."""
    return F.concat(*[p if i == 0 else F.concat(F.lit("\u0000"), p) for i, p in enumerate(parts)])


def record_references(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "tasks")
    projects = table(spark, sf, "projects")
    links = table(spark, sf, "refs_targets")

    def refs(rows: DataFrame, name: str, field: str, domain: str, row: str, key, at) -> DataFrame:
        return rows.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(domain).alias("domain"), F.col(row).alias("ref_id"), key.cast("string").alias("key"), at.alias("at")).where("key IS NOT NULL")

    anchor = F.when(F.length("anchor") > 0, pair_key(F.coalesce("file", "source_file"), slug_anchor("anchor")))
    parts = [
        refs(tasks, "tasks", "project_id", "project", "id", F.col("project_id"), instant_micros("updated_at")),
        refs(tasks, "tasks", "cycle_id", "cycle", "id", F.col("cycle_id"), instant_micros("updated_at")),
        refs(projects, "projects", "space_id", "space", "id", F.col("space_id"), instant_micros("updated_at")),
        refs(links, "refs_targets", "anchor", "anchor", "ref_id", anchor, clock_micros("seen_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record_parents(spark: SparkSession, sf: str) -> DataFrame:
    dead = table(spark, sf, "tombstones").select(F.col("entity").alias("domain"), F.col("record_id").alias("id")).distinct()
    out = heading_parents(spark, sf).select(F.lit("anchor").alias("domain"), pair_key(F.col("file"), F.col("anchor")).alias("key"), "since")
    for domain, name in (("project", "projects"), ("cycle", "cycles"), ("space", "spaces")):
        rows = table(spark, sf, name).select(F.lit(domain).alias("domain"), "id", instant_micros("created_at").alias("since"))
        out = out.unionByName(rows.join(dead, ["domain", "id"], "left_anti").select("domain", F.col("id").cast("string").alias("key"), "since"))
    return out


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(record_references(spark, sf), record_parents(spark, sf)).select("ref_table", "ref_field", "ref_id").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, field, month and reason."""
    found = orphan_references(record_references(spark, sf), record_parents(spark, sf))
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return found.groupBy("ref_table", "ref_field", month.alias("month"), "reason").agg(F.countDistinct("ref_id").alias("orphans"))


P6_TABLES = """
WITH slug AS (
  SELECT sym_id, any_value(file) AS file, any_value(line) AS line, any_value(indexed_at) AS indexed_at, any_value(s) AS base FROM (
    SELECT *, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 \\t\\n\\f\\r_-]', '', 'g'), '[ \\t\\n\\f\\r_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS s
    FROM symbol_rows WHERE kind = 'heading') GROUP BY sym_id),
heads AS (
  SELECT file, indexed_at, CASE WHEN k = 1 THEN base ELSE base || '-' || (k - 1) END AS anchor
  FROM (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY line, sym_id) AS k FROM slug)),
links AS (
  SELECT DISTINCT ref_id, coalesce(file, source_file) AS file, seen_at,
    coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate(anchor, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 \\t\\n\\f\\r_-]', '', 'g'), '[ \\t\\n\\f\\r_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS anchor
  FROM refs_targets WHERE anchor <> ''),
good AS (
  SELECT 'project' AS d, id, created_at FROM projects UNION ALL SELECT 'cycle', id, created_at FROM cycles UNION ALL SELECT 'space', id, created_at FROM spaces),
alive AS (SELECT g.d, g.id, min(CAST(g.created_at AS TIMESTAMPTZ)) AS since FROM good g WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.entity = g.d AND t.record_id = g.id) GROUP BY g.d, g.id),
refs AS (
  SELECT DISTINCT 'tasks' AS ref_table, 'project_id' AS ref_field, id AS ref_id, 'project' AS d, project_id AS k, CAST(updated_at AS TIMESTAMPTZ) AS t FROM tasks WHERE project_id IS NOT NULL
  UNION SELECT DISTINCT 'tasks', 'cycle_id', id, 'cycle', cycle_id, CAST(updated_at AS TIMESTAMPTZ) FROM tasks WHERE cycle_id IS NOT NULL
  UNION SELECT DISTINCT 'projects', 'space_id', id, 'space', space_id, CAST(updated_at AS TIMESTAMPTZ) FROM projects WHERE space_id IS NOT NULL)
"""

P6_FOUND = P6_TABLES + """
SELECT DISTINCT ref_table, ref_field, ref_id FROM refs r LEFT JOIN alive a ON a.d = r.d AND a.id = r.k WHERE a.id IS NULL OR a.since > r.t
UNION
SELECT DISTINCT 'refs_targets', 'anchor', ref_id FROM links l
WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.file = l.file AND h.anchor = l.anchor AND h.indexed_at <= l.seen_at)
"""

P6_REPORT = P6_TABLES + """
, orphan AS (
  SELECT ref_table, ref_field, ref_id, strftime(make_timestamp(epoch_us(r.t)), '%Y-%m') AS month, CASE WHEN a.id IS NULL THEN 'absent' ELSE 'later' END AS reason
  FROM refs r LEFT JOIN alive a ON a.d = r.d AND a.id = r.k WHERE a.id IS NULL OR a.since > r.t
  UNION
  SELECT 'refs_targets', 'anchor', ref_id, strftime(seen_at, '%Y-%m'), CASE WHEN EXISTS (SELECT 1 FROM heads h WHERE h.file = l.file AND h.anchor = l.anchor) THEN 'later' ELSE 'absent' END
  FROM links l WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.file = l.file AND h.anchor = l.anchor AND h.indexed_at <= l.seen_at))
SELECT ref_table, ref_field, month, reason, count(DISTINCT ref_id) AS orphans FROM orphan GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p4_loops, p5_found, p5_sync, p5_sync_counts, p6_found, p6_report)}

SQL = {
    "p4_found": P4_TREE + "SELECT id AS task_id, root AS root_id, depth FROM w WHERE parent IS NOT NULL",
    "p4_paths": P4_TREE + "SELECT id AS task_id, root AS root_id, depth, path, place FROM w",
    "p4_descendants": P4_TREE
    + ", d AS (SELECT id, depth, place, unnest(string_split(path, '/')) AS a, generate_subscripts(string_split(path, '/'), 1) - 1 AS k FROM w WHERE root <> -1)"
    + " SELECT CAST(a AS BIGINT) AS ancestor_id, d.id AS task_id, CAST(d.depth - k AS BIGINT) AS distance, substr(d.place, length(w.place) + 1) AS place FROM d JOIN w ON w.id = CAST(a AS BIGINT) WHERE d.depth > k",
    "p4_loops": P4_TREE
    + ", bad AS (SELECT id, parent FROM w WHERE root = -1), walk AS (SELECT id AS start, parent AS pos FROM bad UNION SELECT k.start, b.parent FROM walk k JOIN bad b ON b.id = k.pos)"
    + " SELECT start AS task_id, min(pos) AS loop_id FROM walk WHERE start IN (SELECT k.start FROM walk k WHERE k.start = k.pos) GROUP BY start",
    "p5_found": P5_VERSIONS
    + "SELECT DISTINCT s.entity, s.record_id FROM src s LEFT JOIN known k ON k.entity = s.entity AND k.record_id = s.record_id"
    + " WHERE k.record_id IS NULL OR k.version IS DISTINCT FROM s.version",
    "p5_sync": P5_VERSIONS
    + "SELECT s.entity, s.record_id, max(s.version) AS version FROM src s LEFT JOIN known k ON k.entity = s.entity AND k.record_id = s.record_id"
    + " WHERE k.record_id IS NULL OR k.version IS DISTINCT FROM s.version GROUP BY ALL",
    "p5_sync_counts": P5_VERSIONS
    + ", now AS (SELECT entity, record_id, max(version) AS version FROM src GROUP BY ALL)"
    + " SELECT coalesce(n.entity, k.entity) AS entity, CASE WHEN k.record_id IS NULL THEN 'added' WHEN n.record_id IS NULL THEN 'removed'"
    + " WHEN n.version IS NOT DISTINCT FROM k.version THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS records"
    + " FROM now n FULL JOIN known k ON k.entity = n.entity AND k.record_id = n.record_id GROUP BY ALL",
    "p6_found": P6_FOUND,
    "p6_report": P6_REPORT,
}
