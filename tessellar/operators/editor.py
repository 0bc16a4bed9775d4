"""What an editor asks of the index, as queries: definitions, completions, previews, diagnostics and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.anchors import slug_anchor
from tessellar.functions.text import truncate_chars
from tessellar.operators import linkgraph, markdown

#: Characters of a preview.
PREVIEW = 420


def definition_at(links: DataFrame, headings: DataFrame, path: str, line: int, col: int) -> DataFrame:
    """(target, line): where the link under a place leads: its heading, or the first line of its file."""
    here = links.where((F.col("source") == path) & (F.col("line") == line) & (F.col("col") <= col) & (F.col("col") + F.octet_length("raw") > col)).orderBy(F.desc("col")).limit(1)
    slug = F.when(F.length("target_anchor") > 0, slug_anchor("target_anchor"))
    heads = headings.select(F.col("path").alias("target"), F.col("anchor").alias("slug"), F.col("line").alias("__line"))
    return here.withColumn("slug", slug).join(heads, ["target", "slug"], "left").where("slug IS NULL OR __line IS NOT NULL").select("target", F.coalesce("__line", F.lit(1)).alias("line"))


def complete_files(files: DataFrame, prefix: str, wikilink: bool = False) -> DataFrame:
    """Paths that begin with what is typed; in wikilinks without their .md."""
    label: Column = F.regexp_replace("path", r"\.md$", "") if wikilink else F.col("path")
    return files.where(F.col("path").startswith(prefix)).select(label.alias("label")).distinct().orderBy("label")


def complete_headings(headings: DataFrame, path: str, prefix: str) -> DataFrame:
    """Anchors of a file that begin with what is typed, read as a slug."""
    rows = headings.where(F.col("path") == path)
    if prefix.strip():
        rows = rows.where(F.col("anchor").startswith(slug_anchor(F.lit(prefix))))
    return rows.select("anchor", "title", "line").orderBy("line")


def previews(parsed: DataFrame, headings: DataFrame, size: int = PREVIEW) -> DataFrame:
    """(path, anchor, text): the first characters of every section; a null anchor is the file."""
    sections = markdown.section_lines(parsed, headings)
    lines = parsed.select("path", F.transform("lines", lambda x: x["text"]).alias("__lines"))
    body = F.array_join(F.slice("__lines", F.col("first_line"), F.greatest(F.col("last_line") - F.col("first_line") + 1, F.lit(0))), "\n")
    return sections.join(lines, "path").select("path", "anchor", truncate_chars(body, size).alias("text"))


def diagnostics(buffer: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """Broken links of an open text (path, content), with its own headings in place of the indexed ones."""
    parsed = markdown.parse_files(buffer)
    own = markdown.headings(parsed)
    known = headings.join(buffer.select("path"), "path", "left_anti").select("path", "anchor").unionByName(own.select("path", "anchor"))
    return linkgraph.resolve_links(markdown.links(parsed), files, known).where("reason IS NOT NULL").select("source", "line", "col", "raw", "reason")
