"""Boards and task pages as markdown: rendered per owner by aggregation, written as files by a small driver step."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.text import external_id

NOTE = "<!-- generated; edits are lost -->\n"
NONE = "_(none)_\n\n"
HEAD = "| Task | Title | Priority |\n|---|---|---|\n"
PAGE = re.compile(r"^T-\d+\.md$")


def cell(text: Column) -> Column:
    """A text as a table cell: bars escaped, line ends as blanks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def page_name(seq: Column) -> Column:
    return F.concat(F.lit("T-"), F.format_string("%04d", seq), F.lit(".md"))


def task_rows(top: DataFrame, linked: Column) -> DataFrame:
    """Rows (owner_alias, seq, title, priority, ...) with ``row``: the table line of a task, its id a link where ``linked``."""
    id_ = external_id("owner_alias", "seq")
    shown = F.when(linked, F.concat(F.lit("["), id_, F.lit("]("), page_name(F.col("seq")), F.lit(")"))).otherwise(F.concat(F.lit("`"), id_, F.lit("`")))
    return top.withColumn("row", F.concat(F.lit("| "), shown, F.lit(" | "), cell(F.col("title")), F.lit(" | "), F.coalesce(F.col("priority").cast("string"), F.lit("")), F.lit(" |\n")))


def boards(top: DataFrame, statuses: DataFrame, owner: str) -> DataFrame:
    """(owner, text): one section a status, in the order of ``statuses`` (slug, name, sort_order, is_closed, is_hidden).

    ``top``: the first rows of each owner and status with ``place`` and ``group_size`` as
    ``top_per_group`` gives them. Hidden statuses show their count only, closed ones are not linked.
    """
    known = statuses.select(F.col("slug").alias("status"), "name", "sort_order", "is_closed", "is_hidden")
    owners = top.select(owner).where(F.col(owner).isNotNull()).distinct()
    rows = task_rows(top.join(known, "status"), ~F.col("is_closed"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]), "")
    filled = rows.groupBy(owner, "status").agg(F.max("group_size").alias("total"), F.count(F.lit(1)).alias("shown"), listed.alias("rows"))
    # Owners times statuses: a fixed handful of statuses, spread as an array so that it is no join without a key.
    names = known.agg(F.array_sort(F.collect_list(F.struct("sort_order", "status", "name", "is_hidden"))).alias("all")).first()
    spread = F.explode(F.array(*[F.struct(F.lit(s["sort_order"]).alias("sort_order"), F.lit(s["status"]).alias("status"), F.lit(s["name"]).alias("name"), F.lit(s["is_hidden"]).alias("is_hidden")) for s in names["all"]])).alias("s")
    every = owners.select(owner, spread).select(owner, "s.*").join(filled, [owner, "status"], "left")
    total, shown = F.coalesce("total", F.lit(0)), F.coalesce("shown", F.lit(0))
    count = F.when((total > shown) & ~F.col("is_hidden"), F.format_string("(top %d of %d)", shown, total)).otherwise(F.format_string("(%d)", total))
    body = F.when(F.col("is_hidden"), "").when(shown == 0, NONE).otherwise(F.concat(F.lit(HEAD), F.col("rows"), F.lit("\n")))
    section = F.concat(F.lit("## "), "name", F.lit(" "), count, F.lit("\n\n"), body)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", section.alias("section")))), lambda x: x["section"]), "")
    return every.groupBy(owner).agg(F.concat(F.lit(NOTE + "\n"), text).alias("text"))


def task_pages(top: DataFrame, subtasks: DataFrame, owner: str) -> DataFrame:
    """(owner, name, text): a page for each task with its body and the table of its subtasks (parent_id, place, row)."""
    below = subtasks.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]), "").alias("rows"))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\n+", "")
    text = F.concat(
        F.lit("# "), external_id("owner_alias", "seq"), F.lit(" — "), F.coalesce("title", F.lit("")), F.lit("\n\n" + NOTE),
        F.when(body == "", "").otherwise(F.concat(F.lit("\n"), F.regexp_replace(body, r"\n?$", "\n"))),
        F.when(F.col("n").isNull(), "").otherwise(F.concat(F.format_string("\n## Subtasks (%d)\n\n", "n"), F.lit(HEAD), "rows", F.lit("\n"))),
    )
    return top.join(below, "id", "left").select(owner, page_name(F.col("seq")).alias("name"), text.alias("text"))


def write_pages(pages: DataFrame, folder: str) -> list[str]:
    """Writes one owner's pages (name, text) into a local folder and removes pages of tasks that are gone; gives the names removed. Other files stay."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    kept = set()
    for row in pages.toLocalIterator():
        path = target / row["name"]
        kept.add(row["name"])
        if not path.exists() or path.read_text() != row["text"]:
            path.write_text(row["text"])
    gone = sorted(p.name for p in target.iterdir() if PAGE.match(p.name) and p.name not in kept)
    for name in gone:
        (target / name).unlink()
    return gone
