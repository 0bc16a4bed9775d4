"""The work-tracking layer: joined task rows, listings, places in trees, next numbers and boards.

Every function takes and gives DataFrames. Re-sent rows of a record are put together first with
``latest``, so joins never multiply. Owners match null-safely, as a task belongs to a project or a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.order_keys import order_between
from tessellar.functions.text import default_order, parse_external_id
from tessellar.operators.forest import clean_links, dotted, resolve_forest, tree_paths
from tessellar.session import cut


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key: the one whose ``by`` columns are greatest, ties broken by all columns; aggregated map-side."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max(F.struct(*by, *[F.col(c) for c in rest if c not in by]))
    return rows.groupBy(*keys).agg(picked.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def crumbs(tasks: DataFrame) -> DataFrame:
    """(id, root_id, depth, suffix) of every task reachable from a root: the dotted ``child_seq`` of the steps down to it."""
    paths = tree_paths(tasks.select("id", "parent_id", "child_seq"), "id", "parent_id", place="child_seq").where("root <> -1")
    return paths.select("id", F.col("root").alias("root_id"), "depth", dotted().alias("suffix"))


def task_view(tasks: DataFrame, projects: DataFrame, spaces: DataFrame, cycles: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Tasks with owner slug and alias, cycle key and, with ``places`` (``crumbs``), the dotted place; unreachable tasks drop out then."""
    p = projects.select(F.col("id").alias("project_id"), F.col("slug").alias("project_slug"), F.col("alias").alias("project_alias"), F.col("space_id").alias("project_space_id"))
    s = spaces.select(F.col("id").alias("space_id"), F.col("slug").alias("space_slug"), F.col("alias").alias("space_alias"))
    c = cycles.select(F.col("id").alias("cycle_id"), F.col("key").alias("cycle_key"))
    view = tasks.join(p, "project_id", "left").join(s, "space_id", "left").join(c, "cycle_id", "left")
    view = view.withColumns({"owner_slug": F.coalesce("project_slug", "space_slug"), "owner_alias": F.coalesce("project_alias", "space_alias")})
    return view if places is None else view.join(places.select("id", "root_id", "depth", "suffix"), "id")


def order_key(order: str = "order_key", seq: str = "seq", child_seq: str = "child_seq") -> Column:
    """The key a task is listed by: its own, or its number."""
    return F.coalesce(F.col(order), default_order(F.coalesce(F.col(seq), F.col(child_seq))))


def list_tasks(view: DataFrame, statuses: list[str] | None = None, project: str | None = None, space_id: int | None = None, space_only: bool = False, cycle: str | None = None, priority: int | None = None, top_level: bool = True, limit: int | None = None) -> DataFrame:
    """Live tasks under all filters given, by owner, order key and number (nulls first).

    No ``statuses`` is no filter, an empty list an empty result. A space holds its own tasks and
    those of its projects. A negative ``limit`` is none.
    """
    rows = view.where(F.col("deleted_at").isNull())
    if statuses is not None:
        rows = rows.where(F.col("status").isin(statuses) if statuses else F.lit(False))
    if project is not None:
        rows = rows.where(F.col("project_slug") == project)
    if space_id is not None:
        rows = rows.where((F.col("space_id") == space_id) if space_only else (F.col("space_id") == space_id) | (F.col("project_space_id") == space_id))
    if cycle is not None:
        rows = rows.where(F.col("cycle_key") == cycle)
    if priority is not None:
        rows = rows.where(F.col("priority") == priority)
    if top_level:
        rows = rows.where(F.col("parent_id").isNull())
    rows = rows.orderBy(F.asc_nulls_first("owner_slug"), order_key().asc_nulls_first(), F.asc_nulls_first("seq"), "id")
    return rows if limit is None or limit < 0 else rows.limit(limit)


def counted(parents: DataFrame, key: str, children: DataFrame, reference: str, out: str) -> DataFrame:
    """``parents`` with how many ``children`` refer to each; 0 where none does."""
    counts = children.where(F.col(reference).isNotNull()).groupBy(F.col(reference).alias(key)).agg(F.count(F.lit(1)).alias(out))
    return parents.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def next_number(rows: DataFrame, owner: list[str], number: str) -> DataFrame:
    """The next free number for every owner, deleted rows counted; null owners are an owner of their own."""
    return rows.groupBy(*owner).agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("next"))


def allocate(new_rows: DataFrame, existing: DataFrame, owner: list[str], number: str, order: list[str]) -> DataFrame:
    """``new_rows`` with their numbers, following those of their owner in the order given."""
    taken = next_number(existing, owner, number).select(*[F.col(o).alias(f"__{o}") for o in owner], "next")
    match = F.lit(True)
    for o in owner:
        match = match & F.col(o).eqNullSafe(F.col(f"__{o}"))
    k = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
    return new_rows.withColumn("__k", k).join(taken, match, "left").withColumn(number, F.coalesce("next", F.lit(1)) + F.col("__k") - 1).drop("__k", "next", *[f"__{o}" for o in owner])


def neighbours(rows: DataFrame, siblings: list[str]) -> DataFrame:
    """Every row with the order keys before and after it among its siblings (null at the ends), deleted ones counted."""
    w = Window.partitionBy(*siblings).orderBy("key", "id")
    return rows.withColumn("key", order_key()).withColumns({"previous_key": F.lag("key").over(w), "next_key": F.lead("key").over(w)})


def top_per_group(rows: DataFrame, group: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of every group (all if negative), each with its place and the size of its whole group.

    Ranked by Spark's grouped limit before the shuffle, so a group with a third of the rows is cut down map-side.
    """
    size = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked if top < 0 else ranked.where(F.col("place") <= top)
    match = F.lit(True)
    sized = size.select(*[F.col(g).alias(f"__{g}") for g in group], "group_size")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return kept.join(sized, match).drop(*[f"__{g}" for g in group])


def subtree(tasks: DataFrame, roots: DataFrame, keys: bool = False) -> DataFrame:
    """(root, id, distance) of the roots given (column ``id``) and everything below them, deleted tasks included.

    The links above the roots are cut, and the forest that is left says of every task the nearest
    root above it. Roots below roots make a forest of their own, climbed one nesting a round. With
    ``keys`` also ``sort_key``: the padded ``child_seq`` of the steps below the root (those without
    one behind all others), so its text order is depth-first sibling order. Roots that are no task
    give nothing; on loops each node counts once, by its least distance.
    """
    links = cut(clean_links(tasks, "id", "parent_id", "child_seq"))
    given = roots.select(F.col("id").alias("root")).distinct()
    wanted = cut(links.join(given, F.col("id") == F.col("root"), "left_semi"))
    marks = wanted.select("id", F.lit(True).alias("wanted"))
    rest = links.join(marks, "id", "left").select("id", F.when(F.col("wanted").isNull(), F.col("parent")).alias("parent"), "place")
    if keys:
        padded = F.transform(F.slice("places", F.lit(2), F.size("places")), lambda x: F.concat(F.lit("."), F.coalesce(F.lpad(x.cast("string"), 12, "0"), F.lit("~"))))
        forest = tree_paths(rest, "id", "parent", place="place").select("id", "root", "depth", F.array_join(padded, "").alias("key"))
    else:
        forest = resolve_forest(rest, "id", "parent").select("id", "root", "depth", F.lit("").alias("key"))
    nearest = cut(forest.join(wanted.select(F.col("id").alias("root")), "root", "left_semi"))
    step = F.concat("key", F.lit("."), F.coalesce(F.lpad(F.col("place").cast("string"), 12, "0"), F.lit("~")))
    up = wanted.where("parent IS NOT NULL").select(F.col("id").alias("low"), F.col("parent").alias("id"), "place").join(nearest, "id")
    up = cut(up.select(F.col("low").alias("over"), F.col("root").alias("next"), (F.col("depth") + 1).alias("more"), step.alias("front")))
    found = front = cut(wanted.select(F.col("id").alias("over"), F.col("id").alias("root"), F.lit(0).cast("long").alias("distance"), F.lit("").alias("key")))
    while True:
        higher = front.join(up, "over").select(F.col("next").alias("over"), "root", (F.col("distance") + F.col("more")).alias("distance"), F.concat("front", "key").alias("key"))
        front = cut(higher.join(found.select("over", "root"), ["over", "root"], "left_anti"))
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    above = found.select("over", "root", F.col("distance").alias("__far"), F.col("key").alias("__key"))
    out = nearest.join(above, "root").select(F.col("over").alias("root"), "id", (F.col("depth") + F.col("__far")).alias("distance"), F.concat("__key", "key").alias("sort_key"))
    return out if keys else out.drop("sort_key")


def descendants_in_order(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, distance, place) of the live tasks below each root, numbered from 1 in depth-first sibling order.

    What lies below a deleted task is reached through it. Equal places go by id.
    """
    live = tasks.where("deleted_at IS NULL").select("id").distinct()
    below = subtree(tasks, roots, keys=True).where("distance > 0").join(live, "id", "left_semi")
    return below.select("root", "id", "distance", F.row_number().over(Window.partitionBy("root").orderBy("sort_key", "id")).cast("long").alias("place"))


def by_external_id(view: DataFrame, places: DataFrame, wanted: DataFrame) -> DataFrame:
    """(external_id, id) of the tasks that ids such as ``KB-0007.1.2`` name; ids that are none, or name nothing, give no row.

    ``view``: ``task_view`` with the columns id, owner_alias, seq; ``places``: ``crumbs``; ``wanted``: external_id.
    An alias matches in any case of letters.
    """
    ids = wanted.select("external_id", parse_external_id("external_id").alias("p")).where("p IS NOT NULL").distinct()
    ids = ids.select("external_id", F.col("p.alias").alias("alias"), F.col("p.seq").alias("seq"), F.array_join(F.transform("p.children", lambda x: F.concat(F.lit("."), x.cast("string"))), "").alias("suffix"))
    tops = view.where("parent_id IS NULL").select(F.upper("owner_alias").alias("alias"), "seq", F.col("id").alias("root_id")).distinct()
    return ids.join(tops, ["alias", "seq"]).join(places.select("id", "root_id", "suffix"), ["root_id", "suffix"]).select("external_id", "id")


SIBLINGS = ["project_id", "space_id", "parent_id"]


def moved(tasks: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, order_key, problem) of moves among siblings: each by itself gets a key between its new neighbours.

    ``moves``: id, target (``top``, ``bottom``, ``before``, ``after``), sibling (for the last two).
    Siblings share owner and parent; deleted ones count. A move whose sibling is elsewhere or
    missing, or where no key lies between, has a problem and no key; a move beside itself keeps its key.
    """
    rows = tasks.select("id", *SIBLINGS, order_key().alias("key"))
    w = Window.partitionBy(*SIBLINGS).orderBy(F.asc_nulls_first("key"), "id")

    def beside(k: int) -> Column:
        f = F.lag if k < 0 else F.lead
        return F.struct(f("id", abs(k)).over(w).alias("id"), f("key", abs(k)).over(w).alias("key"))

    placed = rows.withColumns({"before": F.array(beside(-1), beside(-2)), "after": F.array(beside(1), beside(2))})
    mine = placed.select("id", *[F.col(c).alias(f"__{c}") for c in SIBLINGS], F.col("key").alias("own_key"))
    lowest = rows.groupBy(*SIBLINGS).agg(F.min(F.struct("key", "id")).alias("low"), F.max(F.struct("key", "id")).alias("high"))
    second = rows.join(lowest.select(*[F.col(c).alias(f"__{c}") for c in SIBLINGS], "low", "high"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SIBLINGS])
    second = second.groupBy(*SIBLINGS).agg(
        F.first("low").alias("low"), F.first("high").alias("high"),
        F.min(F.when(F.col("id") != F.col("low.id"), F.struct("key", "id"))).alias("low2"), F.max(F.when(F.col("id") != F.col("high.id"), F.struct("key", "id"))).alias("high2"),
    )
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in SIBLINGS]
    at = moves.select("id", "target", "sibling").join(mine, "id")
    outer = at.where("target IN ('top', 'bottom')").join(second, same).select(
        "id",
        F.when(F.col("target") == "bottom", F.when(F.col("high.id") == F.col("id"), F.col("high2.key")).otherwise(F.col("high.key"))).alias("low_key"),
        F.when(F.col("target") == "top", F.when(F.col("low.id") == F.col("id"), F.col("low2.key")).otherwise(F.col("low.key"))).alias("high_key"),
        F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("kept"),
    )
    sibling = placed.select(F.col("id").alias("sibling"), *SIBLINGS, "key", "before", "after")

    def next_to(column: str) -> Column:
        return F.when(F.element_at(column, 1)["id"] == F.col("id"), F.element_at(column, 2)["key"]).otherwise(F.element_at(column, 1)["key"])

    elsewhere = ~(same[0] & same[1] & same[2])
    inner = at.where("target IN ('before', 'after')").join(sibling, "sibling", "left").select(
        "id",
        F.when(F.col("target") == "before", next_to("before")).otherwise(F.col("key")).alias("low_key"),
        F.when(F.col("target") == "before", F.col("key")).otherwise(next_to("after")).alias("high_key"),
        F.when(F.col("key").isNull(), "no such sibling").when(elsewhere, "sibling elsewhere").alias("problem"),
        F.when(F.col("id") == F.col("sibling"), F.col("own_key")).alias("kept"),
    )
    both = outer.unionByName(inner).withColumn("made", order_between("low_key", "high_key"))
    key = F.when(F.col("problem").isNull(), F.coalesce("kept", "made"))
    return both.select("id", key.alias("order_key"), F.coalesce("problem", F.when(key.isNull(), "no key between")).alias("problem"))


def reparented(tasks: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, parent_id, seq, child_seq, order_key) of tasks under new parents (null: top level), numbered behind those there.

    ``moves``: id, parent_id; several to one place go in the order of ids. The old number is lost and the order key starts anew. Moves
    to the parent a task has are none; those that would close a loop are for ``records.would_loop`` to find.
    """
    now = tasks.select("id", F.col("parent_id").alias("old_parent"), "project_id", "space_id")
    todo = moves.select("id", "parent_id").join(now, "id").where(~F.col("parent_id").eqNullSafe(F.col("old_parent")) & ~F.col("parent_id").eqNullSafe(F.col("id")))
    under = allocate(todo.where("parent_id IS NOT NULL"), tasks.where("parent_id IS NOT NULL").select("parent_id", "child_seq"), ["parent_id"], "child_seq", ["id"])
    top = allocate(todo.where("parent_id IS NULL"), tasks.where("parent_id IS NULL").select("project_id", "space_id", "seq"), ["project_id", "space_id"], "seq", ["id"])
    none = F.lit(None).cast("long")
    return under.select("id", "parent_id", none.alias("seq"), F.col("child_seq").cast("long").alias("child_seq"), default_order("child_seq").alias("order_key")).unionByName(
        top.select("id", "parent_id", F.col("seq").cast("long").alias("seq"), none.alias("child_seq"), default_order("seq").alias("order_key"))
    )


def attached(labels: DataFrame, links: DataFrame, item: str = "task_id") -> DataFrame:
    """Labels of every item, by slug."""
    return links.select(item, "label_id").distinct().join(labels.withColumnRenamed("id", "label_id"), "label_id").orderBy(item, "slug")


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """``paths`` with the deepest of the roots that is the path or lies above it (null if none), by ancestors and an equi-join."""
    from tessellar.functions.paths import ancestors

    every = paths.select(path).distinct().select(path, F.explode(ancestors(path, own=True)).alias("__root"))
    hits = every.join(roots.select(F.col(root).alias("__root")).distinct(), "__root")
    deepest = hits.groupBy(path).agg(F.max_by("__root", F.length("__root")).alias(root))
    return paths.join(deepest, path, "left")
