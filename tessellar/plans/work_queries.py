"""Queries over spaces, projects, cycles and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.text import alias_ok, external_id
from tessellar.operators import records, work
from tessellar.sources.tables import table

OPEN = ["backlog", "cycle", "in_progress"]
VIEW = ["id", "owner_slug", "cycle_key", "status", "priority", "title"]


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Each task once, as it landed last."""
    return work.latest(table(spark, sf, "tasks"), ["id"], ["landed_at"])


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "projects").distinct()


def view(spark: SparkSession, sf: str, places: bool = False) -> DataFrame:
    t = tasks(spark, sf)
    return work.task_view(t, projects(spark, sf), table(spark, sf, "spaces"), table(spark, sf, "cycles"), work.crumbs(t) if places else None)


def task_view_join(spark, sf):
    return view(spark, sf, places=True).select(*VIEW, "root_id", "depth", "suffix")


def task_list_open(spark, sf):
    return work.list_tasks(view(spark, sf), statuses=OPEN).select(*VIEW)


def task_list_space_rollup(spark, sf):
    return work.list_tasks(view(spark, sf), space_id=3, top_level=False).select(*VIEW)


def task_list_cycle_priority(spark, sf):
    return work.list_tasks(view(spark, sf), cycle="C030", priority=2, top_level=False).select(*VIEW)


def task_list_limit(spark, sf):
    """A report: the first fifty."""
    return work.list_tasks(view(spark, sf), limit=50).select(*VIEW)


def task_list_selectors(spark, sf):
    """How many tasks the open statuses, no status at all, and no filter select."""
    v = view(spark, sf)
    parts = [work.list_tasks(v, statuses=s).agg(F.lit(name).alias("selector"), F.count(F.lit(1)).alias("tasks")) for name, s in (("open", OPEN), ("none", []), ("all", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def space_listing(spark, sf):
    """Spaces by slug, with how many live tasks lie in them and their projects."""
    live = work.list_tasks(view(spark, sf), top_level=False).select(F.coalesce("space_id", "project_space_id").alias("space"))
    return work.counted(table(spark, sf, "spaces").where("status <> 'archived' AND id IS NOT NULL"), "id", live, "space", "tasks").select("id", "slug", "alias", "status", "tasks").orderBy("slug")


def space_project_count(spark, sf):
    return work.counted(table(spark, sf, "spaces"), "id", projects(spark, sf), "space_id", "project_count").select("id", "slug", "project_count")


def project_listing(spark, sf):
    """Projects that are not archived, with their space."""
    spaces = table(spark, sf, "spaces").select(F.col("id").alias("space_id"), F.col("slug").alias("space_slug"))
    return projects(spark, sf).where("status <> 'archived'").join(spaces, "space_id", "left").select("id", "slug", "alias", "space_slug").orderBy("slug", "id")


def point_lookups(spark, sf):
    """A project by alias (in any case of letters), a space by slug, a cycle by key."""
    parts = [
        projects(spark, sf).where(F.col("alias") == F.upper(F.lit("ba1"))).select(F.lit("project").alias("entity"), "id"),
        table(spark, sf, "spaces").where(F.col("slug") == "nested-beacon-1").select(F.lit("space").alias("entity"), "id"),
        table(spark, sf, "cycles").where(F.col("key") == "C003").select(F.lit("cycle").alias("entity"), "id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def alias_check(spark, sf):
    return projects(spark, sf).where(F.col("alias").isNotNull()).select("id", "alias", alias_ok("alias").alias("ok"))


def cycle_listing(spark, sf):
    return table(spark, sf, "cycles").select("id", "key", "start_date", "end_date").orderBy(F.desc("start_date"))


def status_in_use(spark, sf):
    return tasks(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


def next_seq(spark, sf):
    return work.next_number(tasks(spark, sf).where("parent_id IS NULL"), ["project_id", "space_id"], "seq")


def allocate_numbers(spark, sf):
    """Places for all children without one, after those of their parent."""
    below = tasks(spark, sf).where("parent_id IS NOT NULL")
    new = below.where("child_seq IS NULL").select("id", "parent_id")
    return work.allocate(new, below.where("child_seq IS NOT NULL").select("parent_id", "child_seq"), ["parent_id"], "child_seq", ["id"]).select("id", "parent_id", F.col("child_seq").cast("long").alias("child_seq"))


def order_key_default(spark, sf):
    return tasks(spark, sf).where("coalesce(seq, child_seq) IS NOT NULL").select("id", work.default_order(F.coalesce("seq", "child_seq")).alias("default_key"), work.order_key().alias("key"))


def external_ids(spark, sf):
    rows = view(spark, sf, places=True)
    roots = tasks(spark, sf).select(F.col("id").alias("root_id"), F.col("seq").alias("root_seq"))
    return rows.join(roots, "root_id").where("owner_alias IS NOT NULL AND root_seq IS NOT NULL").select("id", external_id("owner_alias", "root_seq", "suffix").alias("external_id"))


def chain_crumbs(spark, sf):
    return work.crumbs(tasks(spark, sf)).select("id", "root_id", "depth", "suffix")


def subtree_ids(spark, sf):
    """Everything below the top-level tasks of the first priority."""
    t = tasks(spark, sf)
    return work.subtree(t, t.where("parent_id IS NULL AND priority = 1").select("id")).select("root", "id")


def descendants_in_order(spark, sf):
    """The live tasks below every top-level task, in depth-first sibling order."""
    t = tasks(spark, sf)
    return work.descendants_in_order(t, t.where("parent_id IS NULL").select("id"))


def tasks_by_external_id(spark, sf):
    """Every task that an external id names, with its live children in order; the ids are those of all tasks with children."""
    t = tasks(spark, sf)
    places = work.crumbs(t)
    v = work.task_view(t, projects(spark, sf), table(spark, sf, "spaces"), table(spark, sf, "cycles"))
    seqs = t.select(F.col("id").alias("root_id"), F.col("seq").alias("root_seq"))
    named = v.join(places, "id").join(seqs, "root_id").where("owner_alias IS NOT NULL AND root_seq IS NOT NULL").select("id", external_id("owner_alias", "root_seq", "suffix").alias("external_id"))
    parents = t.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    found = work.by_external_id(v, places, named.join(parents, "id", "left_semi").select(F.lower("external_id").alias("external_id")))
    children = t.where("deleted_at IS NULL AND parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(work.order_key().alias("key"), "child_seq", F.col("id").alias("child")))), lambda c: c["child"].cast("string")), " ").alias("children")
    )
    return found.join(children, "id", "left")


def moves_of_tasks(spark, sf):
    """New order keys of all first-priority tasks moved to the top, to the bottom, and behind the task with the next id."""
    t = tasks(spark, sf).where("id IS NOT NULL")
    some = t.where("priority = 1").select("id")
    target = F.when(F.col("id") % 3 == 0, "top").when(F.col("id") % 3 == 1, "bottom").otherwise("after")
    moves = some.select("id", target.alias("target"), (F.col("id") + 1).alias("sibling"))
    return work.moved(t, moves).select("id", F.col("order_key").isNotNull().alias("moved"), "problem")


def reparented_tasks(spark, sf):
    """All live children of parked tasks moved to the top level, and first-priority top-level tasks below the least task of the table."""
    t = tasks(spark, sf)
    parked = t.where("status = 'parked'").select(F.col("id").alias("parent_id"))
    up = t.where("deleted_at IS NULL").join(parked, "parent_id", "left_semi").select("id", F.lit(None).cast("long").alias("parent_id"))
    down = t.where("parent_id IS NULL AND priority = 1").select("id").join(t.agg(F.min("id").alias("parent_id")))
    return work.reparented(t, up.unionByName(down))


def children_list(spark, sf):
    t = tasks(spark, sf).where("parent_id IS NOT NULL AND deleted_at IS NULL")
    return t.select("parent_id", "id", work.order_key().alias("key"), "child_seq")


def neighbor_order(spark, sf):
    return work.neighbours(tasks(spark, sf), ["project_id", "space_id", "parent_id"]).select("id", "key", "previous_key", "next_key")


def board_top_n(spark, sf):
    """The board of every project: the first ten live top-level tasks of each status, with how many it has."""
    live = work.list_tasks(view(spark, sf)).where("project_id IS NOT NULL")
    top = work.top_per_group(live.select("id", "project_id", "status", "seq", work.order_key().alias("key")), ["project_id", "status"], [F.asc_nulls_first("key"), F.asc_nulls_first("seq"), "id"], 10)
    return top.select("id", "project_id", "status", F.col("place").cast("long").alias("place"), "group_size")


def space_board_top_n(spark, sf):
    """The board of every space over its own tasks and those of its projects, by priority, owner and order."""
    live = work.list_tasks(view(spark, sf)).withColumn("board", F.coalesce("space_id", "project_space_id")).where("board IS NOT NULL")
    rows = live.select("id", "board", "status", "priority", "owner_slug", work.order_key().alias("key"))
    top = work.top_per_group(rows, ["board", "status"], [F.asc_nulls_first("priority"), F.asc_nulls_first("owner_slug"), F.asc_nulls_first("key"), "id"], 10)
    return top.select("id", "board", "status", F.col("place").cast("long").alias("place"), "group_size")


def latest_by_key(spark, sf):
    return tasks(spark, sf).select("id", "landed_at")


def soft_delete_apply(spark, sf):
    """Tasks after the subtrees of parked top-level tasks are deleted; earlier stamps stay."""
    t = tasks(spark, sf)
    gone = work.subtree(t, t.where("parent_id IS NULL AND status = 'parked'").select("id")).select("id")
    return records.soft_delete(t, gone, "2030-01-01T00:00:00.000Z").select("id", "deleted_at")


def restore_apply(spark, sf):
    t = tasks(spark, sf)
    return records.restore(t, t.where("priority = 1").select("id")).select("id", "deleted_at")


def purge_match(spark, sf):
    """What a purge of all deleted tasks takes with it: they and everything below them."""
    t = tasks(spark, sf)
    return work.subtree(t, t.where("deleted_at IS NOT NULL").select("id")).select("id").distinct()


def edit_apply(spark, sf):
    """Cycles after an edit of some: only what is stated changes."""
    changes = spark.createDataFrame([(1, "renamed", None), (2, None, "2030-12-31"), (999, "none", None)], "id long, description string, end_date string")
    return records.edit(table(spark, sf, "cycles"), changes, "id").select("id", "description", "end_date")


def status_rename_cascade(spark, sf):
    renames = spark.createDataFrame([("parked", "shelved")], "old string, new string")
    return records.rename_cascade(tasks(spark, sf), "status", renames).groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


def clashing_numbers(spark, sf):
    """Places that several children of a task have, and numbers that several top-level tasks of a project have."""
    t = tasks(spark, sf)
    places = records.duplicates(t.where("parent_id IS NOT NULL"), ["parent_id", "child_seq"]).select(F.lit("child_seq").alias("number"), F.col("parent_id").alias("owner"), F.col("child_seq").alias("value"), "rows")
    numbers = records.duplicates(t.where("parent_id IS NULL"), ["project_id", "seq"]).select(F.lit("seq").alias("number"), F.col("project_id").alias("owner"), F.col("seq").alias("value"), "rows")
    return places.unionByName(numbers)


QUERIES = {f.__name__: f for f in (
    task_view_join, task_list_open, task_list_space_rollup, task_list_cycle_priority, task_list_limit, task_list_selectors, space_listing, space_project_count, project_listing, point_lookups, alias_check, cycle_listing,
    status_in_use, next_seq, allocate_numbers, order_key_default, external_ids, chain_crumbs, subtree_ids, descendants_in_order, tasks_by_external_id, moves_of_tasks, reparented_tasks, children_list, neighbor_order, board_top_n, space_board_top_n, latest_by_key, soft_delete_apply,
    restore_apply, purge_match, edit_apply, status_rename_cascade, clashing_numbers,
)}

T = "t AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY landed_at DESC) AS r FROM tasks) WHERE r = 1)"
V = (
    T + ", p AS (SELECT DISTINCT * FROM projects), v AS (SELECT t.*, p.slug AS project_slug, p.alias AS project_alias, p.space_id AS project_space_id, coalesce(p.slug, s.slug) AS owner_slug,"
    " coalesce(p.alias, s.alias) AS owner_alias, c.key AS cycle_key, coalesce(t.order_key, printf('%012d', coalesce(t.seq, t.child_seq))) AS k FROM t LEFT JOIN p ON p.id = t.project_id"
    " LEFT JOIN spaces s ON s.id = t.space_id LEFT JOIN cycles c ON c.id = t.cycle_id)"
)
TREE = (
    ", tree AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, '' AS suffix, [id] AS ids FROM t WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM t)"
    " UNION ALL SELECT c.id, x.root_id, x.depth + 1, x.suffix || '.' || coalesce(CAST(c.child_seq AS VARCHAR), '?'), list_append(x.ids, c.id) FROM tree x JOIN t c ON c.parent_id = x.id)"
)
COLUMNS = "id, owner_slug, cycle_key, status, priority, title"
LIVE = "deleted_at IS NULL"


def below(roots: str) -> str:
    """The roots given and everything below them; UNION ends on loops."""
    return f", sub AS (SELECT id AS root, id FROM t WHERE {roots} UNION SELECT s.root, c.id FROM sub s JOIN t c ON c.parent_id = s.id)"



SQL = {
    "task_view_join": f"WITH RECURSIVE {V}{TREE} SELECT v.id, owner_slug, cycle_key, status, priority, title, root_id, depth, suffix FROM v JOIN tree ON tree.id = v.id",
    "task_list_open": f"WITH {V} SELECT {COLUMNS} FROM v WHERE {LIVE} AND parent_id IS NULL AND status IN ('backlog', 'cycle', 'in_progress')",
    "task_list_space_rollup": f"WITH {V} SELECT {COLUMNS} FROM v WHERE {LIVE} AND (space_id = 3 OR project_space_id = 3)",
    "task_list_cycle_priority": f"WITH {V} SELECT {COLUMNS} FROM v WHERE {LIVE} AND cycle_key = 'C030' AND priority = 2",
    "task_list_limit": f"WITH {V} SELECT {COLUMNS} FROM v WHERE {LIVE} AND parent_id IS NULL ORDER BY owner_slug NULLS FIRST, k NULLS FIRST, seq NULLS FIRST, id LIMIT 50",
    "task_list_selectors": f"WITH {V}, l AS (SELECT * FROM v WHERE {LIVE} AND parent_id IS NULL) SELECT 'open' AS selector, count(*) FILTER (status IN ('backlog', 'cycle', 'in_progress')) AS tasks FROM l UNION ALL SELECT 'none', 0 UNION ALL SELECT 'all', count(*) FROM l",
    "space_listing": f"WITH {V} SELECT s.id, s.slug, s.alias, s.status, (SELECT count(*) FROM v WHERE {LIVE} AND coalesce(v.space_id, v.project_space_id) = s.id) AS tasks FROM spaces s WHERE s.status <> 'archived' AND s.id IS NOT NULL",
    "space_project_count": "SELECT s.id, s.slug, (SELECT count(*) FROM (SELECT DISTINCT * FROM projects) p WHERE p.space_id = s.id) AS project_count FROM spaces s",
    "project_listing": "SELECT p.id, p.slug, p.alias, s.slug AS space_slug FROM (SELECT DISTINCT * FROM projects) p LEFT JOIN spaces s ON s.id = p.space_id WHERE p.status <> 'archived'",
    "point_lookups": "SELECT DISTINCT 'project' AS entity, id FROM projects WHERE alias = 'BA1' UNION ALL SELECT 'space', id FROM spaces WHERE slug = 'nested-beacon-1' UNION ALL SELECT 'cycle', id FROM cycles WHERE key = 'C003'",
    "alias_check": "SELECT DISTINCT id, alias, alias = upper(alias) AND length(alias) BETWEEN 2 AND 6 AND regexp_matches(alias, '^[A-Z][A-Z0-9]') AS ok FROM projects WHERE alias IS NOT NULL",
    "cycle_listing": "SELECT id, key, start_date, end_date FROM cycles",
    "status_in_use": f"WITH {T} SELECT status, count(*) AS tasks FROM t GROUP BY status",
    "next_seq": f"WITH {T} SELECT project_id, space_id, CAST(coalesce(max(seq), 0) + 1 AS BIGINT) AS next FROM t WHERE parent_id IS NULL GROUP BY ALL",
    "allocate_numbers": f"WITH {T}, m AS (SELECT parent_id, max(child_seq) AS last FROM t GROUP BY parent_id) SELECT t.id, t.parent_id, CAST(coalesce(m.last, 0) + row_number() OVER (PARTITION BY t.parent_id ORDER BY t.id) AS BIGINT) AS child_seq"
    " FROM t LEFT JOIN m ON m.parent_id = t.parent_id WHERE t.parent_id IS NOT NULL AND t.child_seq IS NULL",
    "order_key_default": f"WITH {V} SELECT id, printf('%012d', coalesce(seq, child_seq)) AS default_key, k AS key FROM v WHERE coalesce(seq, child_seq) IS NOT NULL",
    "external_ids": f"WITH RECURSIVE {V}{TREE} SELECT v.id, v.owner_alias || '-' || printf('%04d', r.seq) || tree.suffix AS external_id FROM v JOIN tree ON tree.id = v.id JOIN t r ON r.id = tree.root_id WHERE v.owner_alias IS NOT NULL AND r.seq IS NOT NULL",
    "chain_crumbs": f"WITH RECURSIVE {T}{TREE} SELECT id, root_id, depth, suffix FROM tree",
    "subtree_ids": f"WITH RECURSIVE {T}{below('parent_id IS NULL AND priority = 1')} SELECT root, id FROM sub",
    "descendants_in_order": f"WITH RECURSIVE {T}, walk AS (SELECT id AS root, id, CAST(0 AS BIGINT) AS distance, '' AS k FROM t WHERE parent_id IS NULL"
    " UNION ALL SELECT w.root, c.id, w.distance + 1, w.k || '.' || coalesce(printf('%012d', c.child_seq), '~') FROM walk w JOIN t c ON c.parent_id = w.id)"
    " SELECT root, w.id, distance, row_number() OVER (PARTITION BY root ORDER BY k, w.id) AS place FROM walk w JOIN t ON t.id = w.id WHERE distance > 0 AND t.deleted_at IS NULL",
    "tasks_by_external_id": f"WITH RECURSIVE {V}{TREE}, x AS (SELECT v.id, lower(v.owner_alias || '-' || printf('%04d', r.seq) || tree.suffix) AS external_id, upper(v.owner_alias) AS a, r.seq, tree.suffix, tree.root_id FROM v JOIN tree ON tree.id = v.id JOIN t r ON r.id = tree.root_id"
    " WHERE v.owner_alias IS NOT NULL AND r.seq IS NOT NULL), w AS (SELECT DISTINCT external_id, a, seq, suffix FROM x WHERE id IN (SELECT parent_id FROM t) AND suffix NOT LIKE '%?%' AND suffix NOT LIKE '%.0%'),"
    " kids AS (SELECT parent_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY k NULLS FIRST, child_seq NULLS FIRST, id) AS children FROM v WHERE deleted_at IS NULL AND parent_id IS NOT NULL GROUP BY parent_id),"
    " tops AS (SELECT DISTINCT upper(owner_alias) AS a, seq, id FROM v WHERE parent_id IS NULL)"
    " SELECT w.external_id, tree.id, kids.children FROM w JOIN tops ON tops.a = w.a AND tops.seq = w.seq JOIN tree ON tree.root_id = tops.id AND tree.suffix = w.suffix LEFT JOIN kids ON kids.parent_id = tree.id",
    "reparented_tasks": f"WITH {T}, m AS (SELECT id, NULL::BIGINT AS parent_id FROM t WHERE deleted_at IS NULL AND parent_id IN (SELECT id FROM t WHERE status = 'parked') UNION ALL SELECT id, (SELECT min(id) FROM t) FROM t WHERE parent_id IS NULL AND priority = 1),"
    " d AS (SELECT m.id, m.parent_id, t.project_id, t.space_id FROM m JOIN t ON t.id = m.id WHERE m.parent_id IS DISTINCT FROM t.parent_id AND m.parent_id IS DISTINCT FROM m.id),"
    " n AS (SELECT d.*, CASE WHEN parent_id IS NULL THEN coalesce((SELECT max(seq) FROM t WHERE t.parent_id IS NULL AND t.project_id IS NOT DISTINCT FROM d.project_id AND t.space_id IS NOT DISTINCT FROM d.space_id), 0) + row_number() OVER (PARTITION BY parent_id IS NULL, project_id, space_id ORDER BY id)"
    " ELSE coalesce((SELECT max(child_seq) FROM t WHERE t.parent_id = d.parent_id), 0) + row_number() OVER (PARTITION BY parent_id ORDER BY id) END AS number FROM d)"
    " SELECT id, parent_id, CASE WHEN parent_id IS NULL THEN CAST(number AS BIGINT) END AS seq, CASE WHEN parent_id IS NOT NULL THEN CAST(number AS BIGINT) END AS child_seq, printf('%012d', CAST(number AS BIGINT)) AS order_key FROM n",
    "children_list": f"WITH {V} SELECT parent_id, id, k AS key, child_seq FROM v WHERE parent_id IS NOT NULL AND {LIVE}",
    "neighbor_order": f"WITH {V} SELECT id, k AS key, lag(k) OVER w AS previous_key, lead(k) OVER w AS next_key FROM v WINDOW w AS (PARTITION BY project_id, space_id, parent_id ORDER BY k NULLS FIRST, id)",
    "board_top_n": f"WITH {V} SELECT id, project_id, status, place, group_size FROM (SELECT id, project_id, status, row_number() OVER (PARTITION BY project_id, status ORDER BY k NULLS FIRST, seq NULLS FIRST, id) AS place,"
    f" count(*) OVER (PARTITION BY project_id, status) AS group_size FROM v WHERE {LIVE} AND parent_id IS NULL AND project_id IS NOT NULL) WHERE place <= 10",
    "space_board_top_n": f"WITH {V}, b AS (SELECT *, coalesce(space_id, project_space_id) AS board FROM v WHERE {LIVE} AND parent_id IS NULL) SELECT id, board, status, place, group_size FROM (SELECT id, board, status,"
    " row_number() OVER (PARTITION BY board, status ORDER BY priority NULLS FIRST, owner_slug NULLS FIRST, k NULLS FIRST, id) AS place, count(*) OVER (PARTITION BY board, status) AS group_size FROM b WHERE board IS NOT NULL) WHERE place <= 10",
    "latest_by_key": "SELECT id, max(landed_at) AS landed_at FROM tasks GROUP BY id",
    "soft_delete_apply": f"WITH RECURSIVE {T}{below("parent_id IS NULL AND status = 'parked'")} SELECT id, CASE WHEN deleted_at IS NULL AND id IN (SELECT id FROM sub) THEN '2030-01-01T00:00:00.000Z' ELSE deleted_at END AS deleted_at FROM t",
    "restore_apply": f"WITH {T} SELECT id, CASE WHEN priority = 1 THEN NULL ELSE deleted_at END AS deleted_at FROM t",
    "purge_match": f"WITH RECURSIVE {T}{below('deleted_at IS NOT NULL')} SELECT DISTINCT id FROM sub",
    "edit_apply": "SELECT id, CASE WHEN id = 1 THEN 'renamed' ELSE description END AS description, CASE WHEN id = 2 THEN '2030-12-31' ELSE end_date END AS end_date FROM cycles",
    "status_rename_cascade": f"WITH {T} SELECT CASE WHEN status = 'parked' THEN 'shelved' ELSE status END AS status, count(*) AS tasks FROM t GROUP BY ALL",
    "clashing_numbers": f"WITH {T} SELECT 'child_seq' AS number, parent_id AS owner, child_seq AS value, count(*) AS rows FROM t WHERE parent_id IS NOT NULL AND child_seq IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
    " UNION ALL SELECT 'seq', project_id, seq, count(*) FROM t WHERE parent_id IS NULL AND project_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
}
