"""References to symbols: imports resolved to files, names followed through re-exports, uses joined to definitions.

Tables of facts go in, tables come out; what one file passes on of another is followed in rounds of
joins until nothing moves (a chain of re-exports of length n takes n rounds), lineage cut each round.
No join is left to the planner's estimates, by which it would broadcast tables that grow with the files.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.paths import ancestors, parent_dir, path_order
from tessellar.operators.code import manifests
from tessellar.session import cut, shuffled

#: Rounds of re-exports after which the parts are written as one, so that long chains make no long plans.
TOGETHER = 16


def symbols(facts: DataFrame) -> DataFrame:
    """(path, name, parent, kind, display_kind, line, end_line, is_public, body_line)."""
    return facts.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def resolve_imports(facts: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """Imports with ``target`` (null where outside): the first candidate path that exists, in any case of letters.

    An import that names a module is a namespace, one that goes on inside a module a name of it.
    Go packages are all Go files of their directory, one row each.
    """
    rows = facts.select("path", "language", F.explode("imports").alias("i")).select("path", "language", F.monotonically_increasing_id().alias("n"), "i.*")
    rows = cut(rows)
    there = files.select(F.lower("path").alias("low"), F.col("path").alias("target")).groupBy("low").agg(F.min("target").alias("target"))
    options = rows.where("language <> 'go'").select("n", F.posexplode("candidates").alias("rank", "c")).select("n", "rank", "c.rest", F.col("c.path").alias("file"))
    # What manifests declare comes after what the path itself names.
    outer = rows.where("language <> 'go' AND NOT startswith(raw, '.')")
    for later, more in enumerate((manifests.exported_candidates, manifests.package_candidates, manifests.alias_candidates, manifests.python_candidates), 1):
        options = options.unionByName(more(outer, files, content).withColumn("rank", F.col("rank") + 1_000 * later))
    options = options.select("n", "rank", "rest", F.lower("file").alias("low"))
    best = options.join(shuffled(there), "low").groupBy("n").agg(F.min(F.struct("rank", "target", "rest")).alias("b")).select("n", "b.target", "b.rest")
    plain = rows.where("language <> 'go'").join(shuffled(best), "n", "left")
    style = F.when((F.col("style") == "path") & (F.col("rest") == 0), "namespace").when(F.col("style") == "path", "name").otherwise(F.col("style"))
    plain = plain.withColumn("style", style).select("path", "local", "definition", "style", "passed_on", "line", "raw", "target")
    # Go: the module whose name starts the import path, the rest is a directory.
    spec = rows.where("language = 'go'").select("path", "local", "definition", "style", "passed_on", "line", "raw")
    modules = manifests.go_modules(files, content)
    # The module is a front of the import path: its fronts are joined by equality, the longest counts.
    fronts = spec.select("raw").distinct().select("raw", F.explode(ancestors("raw", own=True)).alias("module")).where("module <> ''")
    owner = fronts.join(shuffled(modules), "module").groupBy("raw").agg(F.max(F.struct(F.length("module").alias("n"), "module", "dir")).alias("m")).select("raw", "m.module", "m.dir")
    inside = spec.join(shuffled(owner), "raw")
    tail = F.expr("substring(raw, length(module) + 2)")
    where = F.when(tail == "", F.col("dir")).when(F.col("dir") == "", tail).otherwise(F.concat("dir", F.lit("/"), tail))
    go_files = files.where(F.lower("path").endswith(".go")).select(F.col("path").alias("target"), parent_dir("path").alias("package"))
    located = inside.withColumn("package", where).join(shuffled(go_files), "package").select("path", "local", "definition", "style", "passed_on", "line", "raw", "target")
    return plain.unionByName(located)


def deps(imports: DataFrame) -> DataFrame:
    """(path, target): the distinct files a file imports."""
    return imports.where(F.col("target").isNotNull() & (F.col("target") != F.col("path"))).select("path", "target").distinct()


def passed_on(imports: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, exported, target, definition, line): names a file passes on of another; a null name passes on all; default exports included."""
    rows = imports.where(F.col("passed_on") & F.col("target").isNotNull() & (F.col("target") != F.col("path")) & F.col("style").isin("name", "glob"))
    named = rows.select("path", F.col("local").alias("exported"), "target", "definition", "line")
    own = facts.where("default_name IS NOT NULL").select("path", F.lit("default").alias("exported"), F.col("path").alias("target"), F.col("default_name").alias("definition"), F.lit(None).cast("int").alias("line"))
    return named.unionByName(own)


def follow(pairs: DataFrame, names: DataFrame, exports: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(target, definition, file, name): where a name asked of a file is defined in the end; unresolved ones drop out.

    ``pairs``: distinct (target, definition); ``names``: (path, name) of symbols. Where a file
    neither defines nor passes on a name, it is looked for in all that the file passes on whole.
    """
    defined = shuffled(cut(names.select(F.col("path").alias("file"), "name").distinct()))
    exact = shuffled(cut(exports.where("exported IS NOT NULL").select(F.col("path").alias("file"), F.col("exported").alias("name"), F.col("target").alias("to"), F.col("definition").alias("as")).distinct()))
    whole = cut(exports.where("exported IS NULL").select(F.col("path").alias("file"), F.col("target").alias("to")).distinct())
    state = cut(pairs.select("target", "definition", F.col("target").alias("file"), F.col("definition").alias("name")).distinct())
    seen = state
    done = None
    for step in count(1):
        found = state.join(defined, ["file", "name"], "left_semi")
        done = found if done is None else done.unionByName(found)
        open_ = state.join(defined, ["file", "name"], "left_anti")
        one = open_.join(exact, ["file", "name"])
        all_ = open_.join(exact.select("file", "name"), ["file", "name"], "left_anti").join(shuffled(whole), "file").select("target", "definition", "to", F.col("name").alias("as"))
        nxt = one.select("target", "definition", "to", "as").unionByName(all_).select("target", "definition", F.col("to").alias("file"), F.col("as").alias("name")).distinct()
        state = cut(nxt.join(shuffled(seen), ["target", "definition", "file", "name"], "left_anti"))
        if not state.limit(1).count():
            break
        seen = seen.unionByName(state)
        if step % TOGETHER == 0:
            seen, done = cut(seen), cut(done)
    return done.distinct()


def visible_names(targets: DataFrame, names: DataFrame, exports: DataFrame) -> DataFrame:
    """(target, name): the names a file defines or passes on, by itself or through files that it passes on whole."""
    whole = cut(exports.where("exported IS NULL").select(F.col("path").alias("file"), F.col("target").alias("to")).distinct())
    front = cut(targets.select("target", F.col("target").alias("file")))
    reach = front
    while front.limit(1).count():
        front = cut(front.join(shuffled(whole), "file").select("target", F.col("to").alias("file")).distinct().join(shuffled(reach), ["target", "file"], "left_anti"))
        reach = reach.unionByName(front)
    own = names.select(F.col("path").alias("file"), "name").unionByName(exports.where("exported IS NOT NULL").select(F.col("path").alias("file"), F.col("exported").alias("name")))
    return reach.join(shuffled(own.distinct()), "file").select("target", "name").distinct()


def references(files: DataFrame, facts: DataFrame, target: str | None = None) -> DataFrame:
    """(target_file, symbol, source_file, line, col, is_definition): definitions, uses and re-exports of every top-level symbol.

    A qualified use names a member of the module it is taken from, any other use the name bound by
    an import; names of whole-module imports are tried against what the module defines or passes
    on. Files of one Go package see each other. Uses of one place count once. With ``target`` only
    the symbols of that file count, and uses are read only in files from which it can be seen.
    """
    facts = cut(facts)
    imports = cut(resolve_imports(facts, files))
    exports = cut(passed_on(imports, facts))
    if target is not None:
        seeing = importer_closure(imports, exports, target).unionByName(facts.where("language = 'go'").where(parent_dir("path") == parent_dir(F.lit(target))).select("path")).distinct()
        facts = cut(facts.join(shuffled(seeing), "path", "left_semi"))
        imports, exports = (cut(t.join(shuffled(seeing), "path", "left_semi")) for t in (imports, exports))
    every = symbols(facts)
    top = every.where("parent IS NULL").select("path", "name", "line")
    uses = facts.select("path", "language", "all_names", F.explode("uses").alias("u")).select("path", "language", "u.*")
    bound = imports.where("target IS NOT NULL AND local IS NOT NULL").select("path", F.col("local").alias("name"), "style", "target", F.coalesce("definition", "local").alias("definition")).distinct()
    named = uses.join(shuffled(bound.where("style = 'name'")), ["path", "name"]).select("path", "line", "col", "target", "definition")
    members = uses.where("member IS NOT NULL").join(shuffled(bound.where("style = 'namespace'")), ["path", "name"]).select("path", "line", "col", "target", F.col("member").alias("definition"))
    globs = imports.where("style = 'glob' AND target IS NOT NULL").select("path", "target").distinct()
    bare = uses.join(shuffled(bound.select("path", "name")), ["path", "name"], "left_anti").join(shuffled(top.select("path", "name")), ["path", "name"], "left_anti")
    listed = facts.where("all_names IS NOT NULL").select(F.col("path").alias("target"), "all_names")
    # A bare name is looked up only where a module imported whole has it: by file and name, not each use in each module.
    visible = visible_names(globs.select("target").distinct(), top, exports).join(shuffled(listed), "target", "left").where("all_names IS NULL OR array_contains(all_names, name)").select("target", "name")
    through = bare.join(shuffled(globs.join(shuffled(visible), "target")), ["path", "name"]).select("path", "line", "col", "target", F.col("name").alias("definition"))
    package = every.where("parent IS NULL").select("path", "name").join(shuffled(facts.where("language = 'go'").select("path")), "path", "left_semi").select(parent_dir("path").alias("dir"), F.col("path").alias("target"), "name")
    siblings = bare.where("language = 'go'").withColumn("dir", parent_dir("path")).join(shuffled(package), ["dir", "name"]).where("path <> target").select("path", "line", "col", "target", F.col("name").alias("definition"))
    asked = cut(named.unionByName(members).unionByName(through).unionByName(siblings).distinct())
    passing = exports.where("exported IS NOT NULL AND line IS NOT NULL").select("path", "line", F.lit(1).alias("col"), "target", "definition")
    wanted = asked.unionByName(passing)
    places = follow(wanted.select("target", "definition").distinct(), top, exports)
    found = wanted.join(shuffled(places), ["target", "definition"]).select(F.col("file").alias("target_file"), F.col("name").alias("symbol"), F.col("path").alias("source_file"), "line", "col", F.lit(False).alias("is_definition"))
    own = top.select(F.col("path").alias("target_file"), F.col("name").alias("symbol"), F.col("path").alias("source_file"), "line", F.lit(1).alias("col"), F.lit(True).alias("is_definition"))
    every_one = own.unionByName(found.where(F.col("target_file") != F.col("source_file"))).distinct()
    return every_one if target is None else every_one.where(F.col("target_file") == target)


def references_of(rows: DataFrame, file: str, symbol: str) -> DataFrame:
    """References to one symbol: its definition first, then by path, line and column."""
    return rows.where((F.col("target_file") == file) & (F.col("symbol") == symbol)).orderBy(F.desc("is_definition"), path_order("source_file"), "line", "col")


def importer_closure(imports: DataFrame, exports: DataFrame, target: str) -> DataFrame:
    """(path): the files from which a symbol of ``target`` can be seen: it, all files that pass on names of it, and whoever imports one of these."""
    links = cut(exports.select(F.col("path").alias("by"), F.col("target").alias("path")).where("by <> path").distinct())
    front = imports.sparkSession.createDataFrame([(target,)], "path string")
    passing = front
    while front.limit(1).count():
        front = cut(links.join(shuffled(front), "path").select(F.col("by").alias("path")).distinct().join(shuffled(passing), "path", "left_anti"))
        passing = passing.unionByName(front)
    importers = deps(imports).join(shuffled(passing.select(F.col("path").alias("target"))), "target", "left_semi").select("path")
    return passing.unionByName(importers).distinct()


def selected(rows: DataFrame, selector: str, dotted: bool = True) -> DataFrame:
    """Symbols under a selector: ``parent::name``, with ``dotted`` also ``parent.name``, or a name; brackets behind do not count."""
    text = selector.strip().removesuffix("()")
    for mark in ("::", ".") if dotted else ("::",):
        parent, found, name = text.rpartition(mark)
        if found:
            if not parent or not name:
                raise ValueError(f"bad selector {selector!r}")
            return rows.where((F.col("name") == name) & (F.col("parent") == parent))
    if not text:
        raise ValueError("empty selector")
    return rows.where(F.col("name") == text)


def bodies(files: DataFrame, content: str, rows: DataFrame) -> DataFrame:
    """Symbols with ``body``: their lines with the comment and attribute lines above."""
    lines = files.select("path", F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n").alias("__lines"))
    cut_out: Column = F.slice("__lines", F.col("body_line"), F.greatest(F.col("end_line") - F.col("body_line") + 1, F.lit(0)))
    return rows.join(lines, "path").withColumn("body", F.trim(F.array_join(cut_out, "\n"))).drop("__lines")
