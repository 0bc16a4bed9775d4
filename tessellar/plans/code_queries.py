"""Queries over source files and markdown texts as they are parsed here: symbols, imports, references, headings, renders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators import markdown, transclude
from tessellar.operators.code import facts, graph
from tessellar.sources.tables import table


def code_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content), each file of each repository once; paths begin with the repository."""
    front = F.concat("repo", F.lit("/"))
    path = F.when(F.col("repo").isNull() | F.startswith("path", front), F.col("path")).otherwise(F.concat(front, "path"))
    return table(spark, sf, "code_files").select(path.alias("path"), F.col("source").alias("content")).where("path IS NOT NULL").dropDuplicates(["path"])


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("path", F.col("text").alias("content"))


def code_symbols(spark, sf):
    """Symbols parsed from the sources of all files that have any in ``symbol_rows``, where the line is that of the comments above.

    That table has none of the files that do not parse; ``code_symbol_counts`` is over all files.
    """
    listed = table(spark, sf, "symbol_rows").where("kind <> 'heading'").select(F.col("file").alias("path")).distinct()
    rows = graph.symbols(facts.extract(code_texts(spark, sf).join(listed, "path", "left_semi")))
    return rows.select(F.col("path").alias("file"), "name", "parent", "kind", F.trim("display_kind").alias("display_kind"), F.col("body_line").alias("line"), "end_line", "is_public").distinct()


def code_symbol_counts(spark, sf):
    return graph.symbols(facts.extract(code_texts(spark, sf))).groupBy("kind", "display_kind", "is_public").agg(F.count(F.lit(1)).alias("symbols"))


def code_imports(spark, sf):
    """Imports of every file with the file they name, where it is one of ours."""
    files = code_texts(spark, sf)
    return graph.resolve_imports(facts.extract(files), files).select("path", "line", "raw", "local", "style", "target")


def code_deps(spark, sf):
    files = code_texts(spark, sf)
    return graph.deps(graph.resolve_imports(facts.extract(files), files))


def symbol_references(spark, sf):
    """Uses of every symbol from other files, counted."""
    files = code_texts(spark, sf)
    rows = graph.references(files, facts.extract(files))
    return rows.groupBy("target_file", "symbol").agg(F.sum(F.col("is_definition").cast("long")).alias("definitions"), F.sum((~F.col("is_definition")).cast("long")).alias("uses"), F.countDistinct("source_file").alias("files"))


def references_to_file(spark, sf):
    """Definitions and uses of every symbol of the first file that another one imports."""
    files = code_texts(spark, sf)
    parsed = facts.extract(files)
    first = graph.deps(graph.resolve_imports(parsed, files)).agg(F.min("target")).first()[0]
    rows = graph.references(files, parsed, first or files.agg(F.min("path")).first()[0])
    return rows.groupBy("target_file", "symbol").agg(F.count(F.lit(1)).alias("places"))


def markdown_headings(spark, sf):
    return markdown.headings(markdown.parse_files(doc_texts(spark, sf))).select("path", "line", "level", "title", "anchor")


def heading_extract(spark, sf):
    return markdown.headings(markdown.parse_files(doc_texts(spark, sf))).select("path", "line", "level")


def markdown_links(spark, sf):
    """Links in the bodies of all tasks, each body a file of its own; the documents have none."""
    bodies = table(spark, sf, "tasks").select(F.format_string("tasks/%d.md", "id").alias("path"), F.col("body").alias("content")).where("id IS NOT NULL").distinct()
    return markdown.links(markdown.parse_files(bodies)).select("source", "line", "kind", "target", "target_anchor")


def vault_check(spark, sf):
    return markdown.check(doc_texts(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("issues"))


def rendered_documents(spark, sf):
    return transclude.render(doc_texts(spark, sf)).select("path", F.length("text").alias("characters"), F.size("errors").alias("errors"))


QUERIES = {f.__name__: f for f in (code_symbols, code_symbol_counts, code_imports, code_deps, symbol_references, references_to_file, markdown_headings, heading_extract, markdown_links, vault_check, rendered_documents)}

SQL = {
    "vault_check": "SELECT 'orphan' AS kind, count(DISTINCT path) AS issues FROM documents",
    "rendered_documents": "SELECT path, CAST(length(coalesce(text, '')) AS INTEGER) AS characters, CAST(0 AS INTEGER) AS errors FROM documents",
    "code_symbols": "SELECT DISTINCT file, name, parent, kind, trim(display_kind) AS display_kind, line, end_line, is_public FROM symbol_rows WHERE kind <> 'heading'",
    "heading_extract": "WITH l AS (SELECT path, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL)"
    " SELECT path, CAST(k AS INTEGER) AS line, CAST(length(regexp_extract(s, '^ {0,3}(#{1,6})([ \\t]|$)', 1)) AS INTEGER) AS level FROM l WHERE regexp_matches(s, '^ {0,3}#{1,6}([ \\t]|$)')",
}
