"""Markdown files into tables: headings, links, fenced statement blocks and embeds.

``parse_files`` reads every file once, by lines: frontmatter, fences and indented code first, so
that nothing in them counts; what a file holds comes out nested and is exploded into tables.
Lines count from 1, columns are bytes from 1, as text editors of the index expect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions import links as link_texts
from tessellar.functions.anchors import numbered_anchors, slug_anchor
from tessellar.functions.paths import resolve_target
from tessellar.operators import linkgraph
from tessellar.session import cut

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
OTHER_BLOCK = re.compile(r"^ {0,3}(?:[-*+][ \t]|\d{1,9}[.)][ \t]|>|#{1,6}(?:[ \t]|$)|<!--|\|)")
CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(?:.*?[^`])?\1(?!`)")
INLINE_LINK = re.compile(r"(?<![!\\])\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
WIKILINK = re.compile(r"\[\[([^\]\r\n]+)\]\]")
EMBED = re.compile(r"^\s*!\[\[([^\]\r\n]+)\]\]\s*$")
#: Info word of the fences that hold statements.
STATEMENTS = "prosaic"

PARSED = (
    "path string, headings array<struct<pos:int,raw:string,level:int,line:int,col:int>>, links array<struct<pos:int,kind:string,raw:string,body:string,line:int,col:int>>,"
    " blocks array<struct<line:int,body:string>>, lines array<struct<line:int,text:string,embed:string>>"
)


def _bytes(text: str) -> int:
    return len(text.encode())


@dataclass
class Parsed:
    headings: list[tuple]
    links: list[tuple]
    blocks: list[tuple]
    lines: list[tuple]


def parse(content: str) -> Parsed:
    """All that one file holds."""
    lines = content.splitlines()
    code, headings, blocks = [False] * len(lines), [], []
    start = 0
    if lines and lines[0].rstrip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].rstrip() == "---"), None)
        if end is not None:
            start = end + 1
            code[:start] = [True] * start
    i, paragraph, listed = start, False, False
    while i < len(lines):
        line = lines[i]
        fence = FENCE.match(line)
        if fence:
            mark, info = fence[1], fence[2].strip()
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[j]):
                j += 1
            if j < len(lines) and info.split() and info.split()[0].lower() == STATEMENTS:
                blocks.append((i + 1, "\n".join(lines[i + 1 : j])))
            for k in range(i, min(j + 1, len(lines))):
                code[k] = True
            i, paragraph = j + 1, False
            continue
        if not line.strip():
            paragraph = False
        elif line.startswith(("    ", "\t")) and not paragraph and not listed:
            code[i] = True
        else:
            heading = ATX.match(line)
            if heading:
                headings.append((heading[2] or "", len(heading[1]), i + 1, _bytes(line[: heading.start(1)]) + 1))
                paragraph = listed = False
            elif paragraph and UNDERLINE.match(line) and not OTHER_BLOCK.match(lines[i - 1]):
                above = lines[i - 1]
                headings.append((above.strip(), 1 if line.strip()[0] == "=" else 2, i, _bytes(above[: len(above) - len(above.lstrip())]) + 1))
                paragraph = listed = False
            else:
                is_list = bool(re.match(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]", line))
                listed = listed and line.startswith((" ", "\t")) or is_list
                paragraph = True
        i += 1
    found: list[tuple] = []
    wiki: list[tuple] = []
    for n, line in enumerate(lines):
        if code[n]:
            continue
        masked = CODE_SPAN.sub(lambda m: " " * len(m[0]), line)
        found += [("link", line[m.start() : m.end()], m[2], n + 1, _bytes(line[: m.start()]) + 1) for m in INLINE_LINK.finditer(masked)]
        wiki += [("wikilink", line[m.start() : m.end()], m[1], n + 1, _bytes(line[: m.start()]) + 1) for m in WIKILINK.finditer(masked)]
    fenced, out = False, []
    for n, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            out.append((n + 1, line, None))
        else:
            embed = EMBED.match(line)
            out.append((n + 1, line, embed[1] if embed and not fenced else None))
    return Parsed([(k, *h) for k, h in enumerate(headings)], [(k, *x) for k, x in enumerate(found + wiki)], blocks, out)


def parse_files(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (path, content) with what each holds, nested; null content is an empty file. Filter files before, not after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, text in frame.itertuples(index=False):
                p = parse(text or "")
                rows.append((path, p.headings, p.links, p.blocks, p.lines))
            yield pd.DataFrame(rows, columns=["path", "headings", "links", "blocks", "lines"], dtype=object)

    return files.select("path", content).mapInPandas(run, PARSED)


def headings(parsed: DataFrame) -> DataFrame:
    """(path, pos, title, anchor, level, line, col), repeated anchors of a file numbered."""
    rows = parsed.select("path", F.explode("headings").alias("h")).select("path", "h.*").withColumn("title", link_texts.heading_text("raw"))
    return numbered_anchors(rows.withColumn("base", slug_anchor("title")), "path", ["pos"], "base", "anchor").drop("base", "raw")


def links(parsed: DataFrame) -> DataFrame:
    """(source, pos, kind, raw, target, target_anchor, line, col); links to elsewhere and to other kinds of files drop out."""
    rows = parsed.select(F.col("path").alias("source"), F.explode("links").alias("l")).select("source", "l.*")
    t = F.when(F.col("kind") == "wikilink", link_texts.wikilink_target("body")).otherwise(link_texts.markdown_target("body"))
    rows = rows.withColumn("t", t).where(F.col("t").isNotNull())
    return rows.select("source", "pos", "kind", "raw", resolve_target("source", "kind", "t.file", "t.root_relative").alias("target"), F.col("t.anchor").alias("target_anchor"), "line", "col")


def embeds(parsed: DataFrame) -> DataFrame:
    """(path, line, target, target_anchor, raw): lines that are one embed outside fences."""
    rows = parsed.select("path", F.explode("lines").alias("l")).where("l.embed IS NOT NULL").select("path", "l.line", "l.text", link_texts.embed_target("l.embed").alias("t")).where(F.col("t").isNotNull())
    target = resolve_target("path", F.lit("wikilink"), "t.file", "t.root_relative")
    return rows.select("path", "line", target.alias("target"), F.col("t.anchor").alias("target_anchor"), F.trim("text").alias("raw"))


def statements(parsed: DataFrame) -> DataFrame:
    """(path, block, line, statement, id, use_path): the use and run lines of statement blocks, comments left out."""
    rows = parsed.select("path", F.explode("blocks").alias("b")).select("path", F.col("b.line").alias("block"), "b.body")
    # Newlines of block comments are kept, so lines keep their numbers.
    kept = F.array_join(F.transform(F.regexp_extract_all("body", F.lit(r"(?s)(/\*.*?(?:\*/|$)|[^/]+|/)"), F.lit(1)), lambda x: F.when(x.startswith("/*"), F.regexp_replace(x, "[^\n]", "")).otherwise(x)), "")
    split = rows.select("path", "block", F.posexplode(F.split(kept, "\n")).alias("k", "raw")).withColumn("text", F.regexp_replace("raw", r"//.*$", ""))
    use, run = F.regexp_extract("text", link_texts.USE, 1), F.regexp_extract("text", link_texts.RUN, 1)
    kind = F.when(use != "", "use").when(run != "", "run")
    return split.withColumn("statement", kind).where("statement IS NOT NULL").select(
        "path", "block", (F.col("block") + F.col("k") + 1).cast("int").alias("line"), "statement", F.when(use != "", use).otherwise(run).alias("id"), F.when(use != "", F.regexp_extract("text", link_texts.USE, 2)).alias("use_path")
    )


def procedures(heads: DataFrame) -> DataFrame:
    """(path, id) of the second-level headings that define a procedure."""
    return heads.where("level = 2").select("path", F.regexp_extract("title", link_texts.PROCEDURE_HEADING, 1).alias("id")).where("id <> ''").distinct()


def procedure_issues(parsed: DataFrame, heads: DataFrame) -> DataFrame:
    """(kind, path, line, raw, reason) of use and run statements, in blocks under a procedure, that name nothing."""
    defined = procedures(heads)
    rows = statements(parsed)
    mark = F.when(F.regexp_extract("title", link_texts.PROCEDURE_HEADING, 1) != "", F.regexp_extract("title", link_texts.PROCEDURE_HEADING, 1))
    inside = linkgraph.enclosing(rows.select("path", F.col("block").alias("line")).distinct(), heads, mark).where("enclosing IS NOT NULL").select("path", F.col("line").alias("block"))
    rows = rows.join(inside, ["path", "block"], "left_semi")
    files = heads.select(F.col("path").alias("use_path")).unionByName(parsed.select(F.col("path").alias("use_path"))).distinct()
    uses = rows.where("statement = 'use'")
    known = defined.select(F.col("path").alias("use_path"), "id", F.lit(True).alias("__id"))
    checked = uses.join(files.withColumn("__file", F.lit(True)), "use_path", "left").join(known, ["use_path", "id"], "left")
    reason = F.when(F.col("__file").isNull(), F.concat(F.lit(linkgraph.NO_FILE + ": "), "use_path")).when(F.col("__id").isNull(), F.concat(F.lit("procedure not found: "), "id", F.lit(" in "), "use_path"))
    bad_uses = checked.withColumn("reason", reason).where("reason IS NOT NULL")
    runs = rows.where("statement = 'run'").join(defined, ["path", "id"], "left_anti").join(uses.select("path", "block", "id").distinct(), ["path", "block", "id"], "left_anti")
    bad_runs = runs.withColumn("reason", F.concat(F.lit("procedure not imported: "), "id"))
    columns = [F.lit("procedure").alias("kind"), "path", "line", F.concat_ws(" ", "statement", "id").alias("raw"), "reason"]
    return bad_uses.select(*columns).unionByName(bad_runs.select(*columns))


def section_lines(parsed: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, anchor, first_line, last_line): the lines of every section; a null anchor is the whole file."""
    ends = linkgraph.section_ends(heads)
    size = parsed.select("path", F.size("lines").alias("__n"))
    sections = ends.join(size, "path").select("path", "anchor", F.col("line").alias("first_line"), F.coalesce("end_line", "__n").alias("last_line"))
    return sections.unionByName(size.select("path", F.lit(None).cast("string").alias("anchor"), F.lit(1).alias("first_line"), F.col("__n").alias("last_line")))


def check(files: DataFrame, content: str = "content") -> DataFrame:
    """(kind, path, line, raw, reason): broken links and embeds, faulty procedures, orphans of a vault (path, content)."""
    parsed = cut(parse_files(files, content))
    heads = headings(parsed)
    known = files.select("path")
    resolved = linkgraph.resolve_links(links(parsed), known, heads)
    broken = linkgraph.issues(resolved, linkgraph.orphans(links(parsed), known))
    shown = linkgraph.resolve_links(embeds(parsed).withColumn("kind", F.lit("embed")).withColumnRenamed("path", "source"), known, heads)
    bad_embeds = shown.where("reason IS NOT NULL").select("kind", F.col("source").alias("path"), "line", "raw", "reason")
    return broken.unionByName(bad_embeds).unionByName(procedure_issues(parsed, heads))
