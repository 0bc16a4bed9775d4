"""Queries over the link graph of markdown files, symbols and code paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.anchors import numbered_anchors, slug_anchor
from tessellar.functions.paths import ancestors, classify, language, like_prefix, parent_dir, relative_path
from tessellar.functions.text import symbol_display
from tessellar.operators import coverage, linkgraph
from tessellar.operators.code import graph
from tessellar.operators.work import longest_prefix
from tessellar.sources.tables import table


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(ref_id, source, line, kind, raw, target, target_anchor), each link once."""
    rows = table(spark, sf, "refs_targets").select("ref_id", F.col("source_file").alias("source"), "line", F.col("link_kind").alias("kind"), "raw", F.coalesce("file", "source_file").alias("target"), F.col("anchor").alias("target_anchor"))
    return rows.dropDuplicates(["ref_id"])


def headings(spark: SparkSession, sf: str) -> DataFrame:
    """(path, pos, title, level, line, anchor)."""
    rows = table(spark, sf, "symbol_rows").where("kind = 'heading'").select("sym_id", F.col("file").alias("path"), F.col("name").alias("title"), F.length("display_kind").alias("level"), "line").dropDuplicates(["sym_id"])
    based = rows.withColumn("base", slug_anchor("title"))
    return numbered_anchors(based, "path", ["line", "sym_id"], "base", "anchor").withColumn("pos", F.col("line"))


def vault_files(spark: SparkSession, sf: str) -> DataFrame:
    """The markdown files known: those with headings."""
    return headings(spark, sf).select("path").distinct()


def heading_slugs(spark, sf):
    return headings(spark, sf).select("path", "line", F.col("base").alias("slug"))


def anchor_dedup(spark, sf):
    return headings(spark, sf).select("path", "line", "anchor")


def link_resolve(spark, sf):
    return linkgraph.resolve_links(links(spark, sf), vault_files(spark, sf), headings(spark, sf)).select("ref_id", "source", "target", "target_anchor", "reason")


def link_broken(spark, sf):
    return link_resolve(spark, sf).where("reason IS NOT NULL").groupBy(F.regexp_extract("reason", "^target [a-z]+ not found", 0).alias("problem"), "source").agg(F.count(F.lit(1)).alias("links"))


def link_inbound(spark, sf):
    return linkgraph.inbound(links(spark, sf), vault_files(spark, sf)).groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("source").alias("sources"))


def orphans(spark, sf):
    """Files that no embed or wikilink of another file leads to."""
    return linkgraph.orphans(links(spark, sf).where("kind <> 'link'"), vault_files(spark, sf))


def deps_outbound(spark, sf):
    return linkgraph.outbound(links(spark, sf))


def doc_graph_issues(spark, sf):
    resolved = linkgraph.resolve_links(links(spark, sf), vault_files(spark, sf), headings(spark, sf))
    return linkgraph.issues(resolved, linkgraph.orphans(links(spark, sf), vault_files(spark, sf))).select("kind", "path", "line", "raw", "reason")


def scoped_issues(spark, sf):
    """The report of some directories only; links are resolved over the whole vault."""
    return linkgraph.scoped(doc_graph_issues(spark, sf), ["docs/filter", "docs/window", "docs/lock"])


def section_bounds(spark, sf):
    return linkgraph.section_ends(headings(spark, sf)).select("path", "line", "level", "end_line")


def heading_tree(spark, sf):
    return linkgraph.heading_parents(headings(spark, sf)).select("path", "line", "level", "parent_line")


def link_reach(spark, sf):
    """All files reached by links from the first of those that have any, with the fewest steps."""
    edges = links(spark, sf).select("source", "target")
    return linkgraph.reach(edges, edges.agg(F.min("source").alias("node")))


def files_of_links(spark, sf):
    """Per target how many references, and the distinct files they are in."""
    return links(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("references"), F.countDistinct("source").alias("files"))


def relative_links(spark, sf):
    """The way from the directory of every link's source to its target."""
    return links(spark, sf).select("ref_id", relative_path(parent_dir("source"), F.col("target")).alias("way"))


def outline(spark, sf):
    """Symbols as an outline shows them, each once."""
    rows = table(spark, sf, "symbol_rows").where("kind <> 'heading'").dropDuplicates(["sym_id"])
    return rows.select("sym_id", "file", "line", symbol_display("name", "display_kind", "kind", "parent").alias("display"))


def public_symbols(spark, sf):
    """Public symbols without a parent, by file and name."""
    return table(spark, sf, "symbol_rows").where("kind <> 'heading' AND is_public AND parent IS NULL").select("file", "name", "kind").distinct()


def symbols_named(spark, sf):
    """The symbols that the first selector of parent and name in the table stands for."""
    rows = table(spark, sf, "symbol_rows").where("kind <> 'heading'").select("sym_id", "file", "parent", "name").distinct()
    first = rows.agg(F.min(F.concat("parent", F.lit("::"), "name"))).first()[0]
    return graph.selected(rows, first) if first else rows.limit(0)


def code(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, repo, path, size, mtime), each file once."""
    return table(spark, sf, "code_files").select("file_id", "repo", "path", "size", "mtime").dropDuplicates(["file_id"])


def classify_files(spark, sf):
    paths = code(spark, sf).select("path").unionByName(table(spark, sf, "documents").select("path"))
    return paths.select(classify("path").alias("kind"), language("path").alias("language")).groupBy("kind", "language").agg(F.count(F.lit(1)).alias("files"))


def path_prefix(spark, sf):
    return code(spark, sf).where(like_prefix("path", "Quillmast-Web/lib")).select("path")


def ancestor_counts(spark, sf):
    return coverage.directory_counts(code(spark, sf))


def mapped_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Directories that hold a Go file stand for those with a map of their own."""
    return code(spark, sf).where(language("path") == "go").select(parent_dir("path").alias("root")).distinct()


def coverage_gaps(spark, sf):
    return coverage.gaps(code(spark, sf), mapped_roots(spark, sf))


def uncovered_files(spark, sf):
    return coverage.uncovered(code(spark, sf), mapped_roots(spark, sf)).select("path")


def longest_prefix_owner(spark, sf):
    return longest_prefix(code(spark, sf).select("path"), "path", mapped_roots(spark, sf), "root").select("path", "root")


def maps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.codemaps(table(spark, sf, "documents").where("kind = 'codemap'").select("path", "text"), "text")


def codemap_listing(spark, sf):
    return maps(spark, sf).select("path", "domain", "root", "owner")


def codemap_findings(spark, sf):
    """All findings about the maps, counted."""
    dirs = code(spark, sf).select(F.explode(ancestors("path")).alias("dir")).distinct()
    return coverage.findings(maps(spark, sf), code(spark, sf), dirs).groupBy("kind").agg(F.count(F.lit(1)).alias("findings"))


def section_by_selector(spark, sf):
    return linkgraph.selected_section(headings(spark, sf), "#Known-Limits").select("path", "line", "level", "anchor")


def dangling_roots(spark, sf):
    """Roots of codemap documents with what is wrong with them: the directory is outside or gone."""
    dirs = code(spark, sf).select(F.explode(ancestors("path")).alias("dir")).distinct()
    return coverage.dangling(maps(spark, sf).where("problem IS NULL"), dirs).select("path", "domain", "root", "reason")


QUERIES = {f.__name__: f for f in (
    heading_slugs, anchor_dedup, link_resolve, link_broken, link_inbound, orphans, deps_outbound, doc_graph_issues, scoped_issues, section_bounds, heading_tree, link_reach, files_of_links, relative_links, outline,
    public_symbols, symbols_named, classify_files, path_prefix, ancestor_counts, coverage_gaps, uncovered_files, longest_prefix_owner, codemap_listing, codemap_findings, section_by_selector, dangling_roots,
)}

SLUG = (
    "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9 \\t\\n\\f\\r_-]', '', 'g'),"
    " '[ \\t\\n\\f\\r_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"
)
H = (
    "h0 AS (SELECT sym_id, any_value(file) AS path, any_value(name) AS title, any_value(CAST(length(display_kind) AS INTEGER)) AS level, any_value(line) AS line FROM symbol_rows WHERE kind = 'heading' GROUP BY sym_id),"
    f" h1 AS (SELECT *, {SLUG.format(c='title')} AS base FROM h0), h AS (SELECT *, CASE WHEN k = 1 THEN base ELSE base || '-' || (k - 1) END AS anchor"
    " FROM (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line, sym_id) AS k FROM h1))"
)
L = (
    "l AS (SELECT ref_id, any_value(source_file) AS source, any_value(line) AS line, any_value(link_kind) AS kind, any_value(raw) AS raw, any_value(coalesce(file, source_file)) AS target, any_value(anchor) AS target_anchor"
    f" FROM refs_targets GROUP BY ref_id), f AS (SELECT DISTINCT path FROM h), r AS (SELECT l.*, CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.path = l.target) THEN 'target file not found: ' || target"
    f" WHEN target_anchor <> '' AND NOT EXISTS (SELECT 1 FROM h WHERE h.path = l.target AND h.anchor = {SLUG.format(c='l.target_anchor')}) THEN 'target heading not found: ' || target || '#' || target_anchor END AS reason FROM l)"
)
LH = f"WITH RECURSIVE {H}, {L}"
ISSUES = (
    "SELECT CASE WHEN kind = 'embed' THEN 'embed' ELSE 'link' END AS kind, source AS path, line, raw, reason FROM r WHERE reason IS NOT NULL"
    " UNION ALL SELECT 'orphan', path, NULL, NULL, NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target = f.path AND l.source <> f.path)"
)
C = "WITH c AS (SELECT file_id, any_value(repo) AS repo, any_value(path) AS path FROM code_files GROUP BY file_id)"
UP = "(SELECT path, unnest(list_transform(range(0, len(string_split(path, '/')) {n}), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir FROM {t})"
ROOTS = ", roots AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS root FROM c WHERE regexp_matches(lower(path), '[^/]\\.go$'))"
UNCOVERED = f", un AS (SELECT * FROM c WHERE path NOT IN (SELECT path FROM {UP.format(n='+ 1', t='c')} x JOIN roots ON roots.root = x.dir))"
GAPS = (
    UNCOVERED + f", cnt AS (SELECT dir, count(*) AS files FROM {UP.format(n='', t='un')} GROUP BY dir HAVING count(*) >= 5), ok AS (SELECT * FROM cnt WHERE NOT EXISTS (SELECT 1 FROM roots"
    " WHERE roots.root = cnt.dir OR starts_with(roots.root, cnt.dir || '/') OR cnt.dir = ''))"
)

SQL = {
    "heading_slugs": f"WITH {H} SELECT path, line, base AS slug FROM h",
    "anchor_dedup": f"WITH {H} SELECT path, line, anchor FROM h",
    "link_resolve": f"{LH} SELECT ref_id, source, target, target_anchor, reason FROM r",
    "link_broken": f"{LH} SELECT regexp_extract(reason, '^target [a-z]+ not found') AS problem, source, count(*) AS links FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "link_inbound": f"{LH} SELECT target, count(*) AS links, count(DISTINCT source) AS sources FROM l WHERE target IN (SELECT path FROM f) GROUP BY target",
    "orphans": f"{LH} SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target = f.path AND l.source <> f.path AND l.kind <> 'link')",
    "relative_links": f"{LH}, p AS (SELECT ref_id, string_split(source, '/')[:-2] AS a, string_split(target, '/') AS b FROM l), q AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) - 1 AS k FROM p)"
    " SELECT ref_id, repeat('../', CAST(len(a) - least(k, len(b) - 1) AS BIGINT)) || array_to_string(b[least(k, len(b) - 1) + 1:], '/') AS way FROM q",
    "dangling_roots": "WITH m AS (SELECT path, string_split(text, chr(10) || '---' || chr(10))[1] AS f FROM documents WHERE kind = 'codemap' AND starts_with(text, '---' || chr(10)) AND contains(text, chr(10) || '---' || chr(10))),"
    " n AS (SELECT path, nullif(trim(regexp_extract(f, '\ndomain:([^\n]*)', 1)), '') AS domain, coalesce(nullif(trim(regexp_extract(f, '\nroot:([^\n]*)', 1)), ''), regexp_replace(path, '/[^/]*$', '')) AS root FROM m)"
    " SELECT path, domain, root, 'root no longer exists' AS reason FROM n WHERE domain IS NOT NULL AND root NOT IN (SELECT dir FROM " + UP.format(n="", t="code_files") + ")",
    "section_by_selector": f"WITH {H} SELECT path, line, level, anchor FROM h WHERE anchor = 'known-limits'",
    "codemap_listing": "WITH m AS (SELECT path, CASE WHEN starts_with(text, '---' || chr(10)) AND contains(text, chr(10) || '---' || chr(10)) THEN string_split(text, chr(10) || '---' || chr(10))[1] END AS f FROM documents WHERE kind = 'codemap')"
    " SELECT path, nullif(trim(regexp_extract(f, '\ndomain:([^\n]*)', 1)), '') AS domain, coalesce(nullif(trim(regexp_extract(f, '\nroot:([^\n]*)', 1)), ''), regexp_replace(path, '/[^/]*$', '')) AS root, nullif(trim(regexp_extract(f, '\nowner:([^\n]*)', 1)), '') AS owner FROM m",
    "deps_outbound": f"{LH} SELECT DISTINCT source, target, target_anchor FROM l",
    "doc_graph_issues": f"{LH} {ISSUES}",
    "scoped_issues": f"{LH} SELECT * FROM ({ISSUES}) WHERE starts_with(path, 'docs/filter/') OR starts_with(path, 'docs/window/') OR starts_with(path, 'docs/lock/')",
    "section_bounds": f"WITH {H} SELECT path, line, level, CAST((SELECT min(n.line) FROM h n WHERE n.path = h.path AND n.line > h.line AND n.level <= h.level) - 1 AS INTEGER) AS end_line FROM h",
    "heading_tree": f"WITH {H} SELECT path, line, level, (SELECT max(n.line) FROM h n WHERE n.path = h.path AND n.line < h.line AND n.level < h.level) AS parent_line FROM h",
    "link_reach": f"{LH}, e AS (SELECT DISTINCT source, target FROM l), w AS (SELECT min(source) AS node, 0 AS steps FROM e"
    " UNION SELECT e.target, w.steps + 1 FROM w JOIN e ON e.source = w.node WHERE w.steps < (SELECT count(*) FROM f)) SELECT node, CAST(min(steps) AS INTEGER) AS steps FROM w GROUP BY node",
    "files_of_links": f"{LH} SELECT target, count(*) AS references, count(DISTINCT source) AS files FROM l GROUP BY target",
    "outline": "SELECT sym_id, any_value(file) AS file, any_value(line) AS line, any_value((CASE WHEN parent IS NOT NULL THEN '  ' ELSE '' END) || (CASE WHEN length(trim(display_kind)) > 0 THEN display_kind || ' ' ELSE '' END) || name"
    " || (CASE WHEN kind IN ('fn', 'method', 'constructor', 'getter', 'setter', 'macro') THEN '()' ELSE '' END)) AS display FROM symbol_rows WHERE kind <> 'heading' GROUP BY sym_id",
    "public_symbols": "SELECT DISTINCT file, name, kind FROM symbol_rows WHERE kind <> 'heading' AND is_public AND parent IS NULL",
    "symbols_named": "WITH s AS (SELECT DISTINCT sym_id, file, parent, name FROM symbol_rows WHERE kind <> 'heading') SELECT * FROM s WHERE parent || '::' || name = (SELECT min(parent || '::' || name) FROM s)",
    "classify_files": f"{C}, p AS (SELECT path FROM c UNION ALL SELECT path FROM documents), e AS (SELECT lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS e FROM p)"
    " SELECT CASE WHEN e IN ('md', 'markdown', 'txt') THEN 'docs' WHEN e IN ('rs', 'py', 'js', 'jsx', 'ts', 'tsx', 'go', 'toml', 'sql', 'sh') THEN 'code' END AS kind,"
    " CASE e WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' END AS language, count(*) AS files FROM e GROUP BY ALL",
    "path_prefix": f"{C} SELECT path FROM c WHERE lower(path) LIKE 'quillmast-web/lib/%'",
    "ancestor_counts": f"{C} SELECT dir, count(*) AS files FROM {UP.format(n='', t='c')} GROUP BY dir",
    "uncovered_files": f"{C}{ROOTS}{UNCOVERED} SELECT path FROM un",
    "coverage_gaps": f"{C}{ROOTS}{GAPS} SELECT dir, files FROM ok WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE starts_with(ok.dir, o.dir || '/'))",
    "longest_prefix_owner": f"{C}{ROOTS} SELECT c.path, (SELECT arg_max(root, length(root)) FROM roots WHERE starts_with(c.path, root || '/') OR c.path = root) AS root FROM c",
}
