"""Documents with their embeds replaced by the sections they name, recursively.

Rounds of joins: every round replaces all embed lines of all documents at once by the lines of
their sections; a line's place is the array of positions on the way to it, so sorting puts a
document together again. An embed of what is already on its way is a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions import links as link_texts
from tessellar.functions.anchors import slug_anchor
from tessellar.functions.paths import resolve_target
from tessellar.operators.markdown import headings, parse_files, section_lines
from tessellar.session import cut

#: Embeds inside embeds deeper than this are an error.
MAX_DEPTH = 10


def render(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, text, errors): every document with its embeds replaced; ``text`` is null where there are errors."""
    parsed = cut(parse_files(files, content))
    heads = headings(parsed)
    sections = section_lines(parsed, heads)
    every = parsed.select("path", F.explode("lines").alias("l")).select("path", "l.line", "l.text", "l.embed")
    # The lines of every section once, so that rounds only join.
    bodies = cut(
        sections.join(every, "path").where("line BETWEEN first_line AND last_line").groupBy("path", "anchor")
        .agg(F.array_sort(F.collect_list(F.struct("line", "text", "embed"))).alias("body"))
        .select(F.col("path").alias("target"), F.coalesce("anchor", F.lit("")).alias("slug"), "body")
    )
    rows = every.select(F.col("path").alias("document"), F.array(F.col("line")).alias("place"), "text", "embed", F.col("path").alias("file"), F.array("path").alias("chain"), F.lit(None).cast("string").alias("error"))
    done, depth = None, 0
    while True:
        rows = cut(rows)
        finished = rows.where("embed IS NULL OR error IS NOT NULL").select("document", "place", "text", "error")
        done = finished if done is None else done.unionByName(finished)
        waiting = rows.where("embed IS NOT NULL AND error IS NULL")
        if not waiting.limit(1).count():
            break
        t = link_texts.embed_target("embed")
        named = waiting.withColumn("t", t).withColumn("target", resolve_target("file", F.lit("wikilink"), "t.file", "t.root_relative"))
        named = named.withColumn("slug", F.coalesce(F.when(F.length("t.anchor") > 0, slug_anchor("t.anchor")), F.lit("")))
        named = named.withColumn("key", F.concat("target", F.when(F.col("slug") == "", "").otherwise(F.concat(F.lit("#"), "slug"))))
        joined = named.join(bodies, ["target", "slug"], "left")
        error = (
            F.when(F.col("t").isNull() | F.col("target").isNull(), F.concat(F.lit("bad embed: "), "embed"))
            .when(F.array_contains("chain", F.col("key")) | F.array_contains("chain", F.col("target")) & (F.col("slug") == ""), F.concat(F.lit("embed cycle: "), "key"))
            .when(F.lit(depth >= MAX_DEPTH), F.concat(F.lit("embeds too deep: "), "key"))
            .when(F.col("body").isNull(), F.concat(F.lit("embed not found: "), "key"))
        )
        marked = joined.withColumn("error", error)
        failed = marked.where("error IS NOT NULL").select("document", "place", "text", "embed", "file", "chain", "error")
        # Blank lines at the end of a section are left out.
        last = F.array_max(F.transform(F.filter("body", lambda x: F.trim(x["text"]) != ""), lambda x: x["line"]))
        fresh = marked.where("error IS NULL").withColumn("last", last).select("document", "place", "target", F.concat("chain", F.array("key")).alias("chain"), "last", F.explode("body").alias("b")).where("b.line <= last")
        rows = failed.unionByName(
            fresh.select("document", F.concat("place", F.array("b.line")).alias("place"), "b.text", "b.embed", F.col("target").alias("file"), "chain", F.lit(None).cast("string").alias("error"))
        )
        depth += 1
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    whole = done.groupBy("document").agg(F.array_join(lines, "\n").alias("text"), F.array_sort(F.collect_set("error")).alias("errors"))
    out = files.select("path").join(whole.withColumnRenamed("document", "path"), "path", "left")
    return out.select("path", F.when(F.coalesce(F.size("errors"), F.lit(0)) == 0, F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
