"""The link graph of a vault: targets resolved, broken links, inbound and outbound edges, orphans, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.anchors import slug_anchor
from tessellar.functions.paths import lies_under, path_order

#: Rounds of a loop after which its parts are written as one.
TOGETHER = 16
NO_FILE, NO_HEADING, OUTSIDE = "target file not found", "target heading not found", "target resolves outside root"


def resolve_links(links: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """Links with ``reason``: null where the target exists.

    ``links``: target (path, or null where it leaves the root), target_anchor; ``files``: path;
    ``headings``: path, anchor. An empty anchor is none. The joins aggregate nothing and the hot
    targets of the link side are split by adaptive execution.
    """
    slug = F.when(F.length("target_anchor") > 0, slug_anchor("target_anchor"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("__file")).distinct()
    heads = headings.select(F.col("path").alias("target"), F.col("anchor").alias("__slug"), F.lit(True).alias("__head")).distinct()
    joined = links.withColumn("__slug", slug).join(known, "target", "left").join(heads, ["target", "__slug"], "left")
    reason = (
        F.when(F.col("target").isNull(), OUTSIDE)
        .when(F.col("__file").isNull(), F.concat(F.lit(NO_FILE + ": "), "target"))
        .when(F.col("__slug").isNotNull() & F.col("__head").isNull(), F.concat(F.lit(NO_HEADING + ": "), "target", F.lit("#"), "target_anchor"))
    )
    return joined.withColumn("reason", reason).drop("__file", "__head", "__slug")


def inbound(links: DataFrame, files: DataFrame) -> DataFrame:
    """The links that reach an indexed file, self links included."""
    return links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")


def orphans(links: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no other file links to."""
    linked = links.where(F.col("source") != F.col("target")).select(F.col("target").alias("path")).distinct()
    return files.select("path").distinct().join(linked, "path", "left_anti")


def outbound(links: DataFrame) -> DataFrame:
    """Distinct (source, target, raw anchor), whether the target exists or not; targets outside the root drop out."""
    return links.where(F.col("target").isNotNull()).select("source", "target", "target_anchor").distinct()


def issues(resolved: DataFrame, orphan_files: DataFrame) -> DataFrame:
    """(kind, path, line, raw, reason): broken links and embeds, and orphans."""
    kind = F.when(F.col("kind") == "embed", "embed").otherwise("link")
    broken = resolved.where("reason IS NOT NULL").select(kind.alias("kind"), F.col("source").alias("path"), "line", "raw", "reason")
    return broken.unionByName(orphan_files.select(F.lit("orphan").alias("kind"), "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("reason")))


def scoped(rows: DataFrame, scopes: list[str], path: str = "path") -> DataFrame:
    """Rows whose path is one of the scopes or lies below one; no scopes are all."""
    if not scopes:
        return rows
    inside = F.lit(False)
    for s in scopes:
        inside = inside | lies_under(path, F.lit(s))
    return rows.where(inside)


def referring(links: DataFrame, target: str, anchor: str | None = None) -> DataFrame:
    """Links to a file, or to one of its headings, by source path, line and text."""
    rows = links.where(F.col("target") == target)
    if anchor is not None:
        rows = rows.where(slug_anchor("target_anchor") == anchor)
    return rows.orderBy(path_order("source"), "line", "raw")


def section_ends(headings: DataFrame) -> DataFrame:
    """Headings (path, pos, level, line) with ``end_line``: the line before the next heading of the same or a higher rank; null at the end of the file.

    With at most six levels the next closer is the nearest of the next headings of each level, so
    one window of running minima does it without comparing headings pairwise.
    """
    after = Window.partitionBy("path").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)]
    pick = F.element_at(F.array(*nexts), F.greatest(F.lit(1), F.least(F.lit(6), F.col("level"))))
    return headings.withColumn("end_line", (pick - 1).cast("int"))


def heading_parents(headings: DataFrame) -> DataFrame:
    """Headings with ``parent_line``: the nearest heading before of a higher rank (null for the topmost)."""
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.max(F.when(F.col("level") < k, F.col("line"))).over(before) for k in range(1, 7)]
    return headings.withColumn("parent_line", F.element_at(F.array(*lasts), F.greatest(F.lit(1), F.least(F.lit(6), F.col("level")))))


def enclosing(blocks: DataFrame, headings: DataFrame, marks: Column) -> DataFrame:
    """Blocks (path, line) with ``enclosing``: what ``marks`` gives for the last heading of level 1 or 2 before the block (null if that marks nothing)."""
    heads = headings.where("level <= 2").select("path", "line", F.lit(0).alias("__block"), F.struct(marks.alias("mark")).alias("__mark"))
    rows = blocks.select("path", "line", F.lit(1).alias("__block"), F.lit(None).cast("struct<mark:string>").alias("__mark")).unionByName(heads)
    last = F.last("__mark", ignorenulls=True).over(Window.partitionBy("path").orderBy("line", "__block"))
    return rows.withColumn("enclosing", last["mark"]).where("__block = 1").select("path", "line", "enclosing").distinct().join(blocks, ["path", "line"], "right")


def selected_section(headings: DataFrame, selector: str) -> DataFrame:
    """The first heading of every file whose anchor a selector (with or without #, in any case) names."""
    wanted = selector.strip().removeprefix("#").strip().lower()
    return headings.where(F.lower("anchor") == wanted).groupBy("path").agg(F.min_by(F.struct("pos", "title", "anchor", "level", "line"), "pos").alias("h")).select("path", "h.*")


def context_lines(files: DataFrame, text: str, hits: DataFrame, context: int) -> DataFrame:
    """(path, hit_line, line, marked, text): the lines around every hit (path, line), cut at the ends of the file."""
    lines = files.select("path", F.split(text, "\n").alias("__lines"))
    joined = hits.select("path", F.col("line").alias("hit_line")).distinct().join(lines, "path")
    around = F.filter(F.sequence(F.col("hit_line") - context, F.col("hit_line") + context), lambda i: (i >= 1) & (i <= F.size("__lines")))
    rows = joined.select("path", "hit_line", "__lines", F.explode(around).alias("line"))
    return rows.select("path", "hit_line", F.col("line").cast("int").alias("line"), (F.col("line") == F.col("hit_line")).alias("marked"), F.element_at("__lines", F.col("line").cast("int")).alias("text"))


def first_matches(files: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(path, line): the first line of a file that contains one of the terms, case ignored."""
    hit = F.lit(False)
    rows = files.select("path", F.posexplode(F.split(F.lower(F.col(text)), "\n")).alias("k", "line_text"))
    for t in terms:
        hit = hit | F.contains(F.col("line_text"), F.lit(t.lower()))
    return rows.where(hit).groupBy("path").agg((F.min("k") + 1).cast("int").alias("line"))


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, steps): all nodes reached from the starts (column ``node``) over edges (source, target), with the fewest steps.

    A frontier loop until nothing is new: every round joins only what was new in the last one and
    drops what is known; lineage is cut each round, and what is known is put together now and then,
    so that long ways make no long plans.
    """
    from tessellar.session import cut

    known = cut(starts.select("node").distinct().withColumn("steps", F.lit(0)))
    frontier, step = known, 0
    links = edges.select(F.col("source").alias("node"), "target").where("node IS NOT NULL AND target IS NOT NULL").distinct()
    while True:
        step += 1
        fresh = cut(frontier.select("node").join(links, "node").select(F.col("target").alias("node")).distinct().join(known, "node", "left_anti").withColumn("steps", F.lit(step)))
        if not fresh.limit(1).count():
            break
        known = known.unionByName(fresh)
        if step % TOGETHER == 0:
            known = cut(known)
        frontier = fresh
    return known
