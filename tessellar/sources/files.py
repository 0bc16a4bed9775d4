"""Files as a table: listing, reading, ignore rules, trees."""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.globs import DEFAULT_IGNORES, decision, glob_regex, ignore_patterns, ignore_rules, ignored
from tessellar.functions.paths import ancestors, extension, file_name, language, parent_dir, path_order


def read_files(spark: SparkSession, root: str, ignores: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, size, mtime, content) of all files below a root, relative paths, ignored ones left out; content is null where it is no UTF-8.

    Reading is lazy: filters on path and size reach the listing before a file is opened. Spark lists
    no names that begin with a dot or underscore; ``walk_files`` does.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    rows = reader.load(base)
    relative = relative_to(F.col("path"), base)
    out = rows.select(relative.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"))
    return out.where(~ignored("path", ignores if ignores is not None else list(DEFAULT_IGNORES)))


#: Ignore files of a folder, the later ones overriding the earlier.
IGNORE_FILES = (".gitignore", ".ignore")


def walk_files(spark: SparkSession, root: str, ignores: list[str] | None = None, parts: int = 8) -> DataFrame:
    """As ``read_files``, dotfiles included, of a folder that driver and executors both see; the files are read in parallel.

    Besides ``ignores`` the ignore files of every folder on the way count, and those of the folders
    above up to the one of the repository: a deeper file overrides a higher one, a later line an
    earlier one, and what ``!`` takes in again stays. Ignored folders are not entered, links not followed.
    """
    import re

    globs = ignores if ignores is not None else list(DEFAULT_IGNORES)
    pattern = re.compile("^(?:" + "|".join(glob_regex(g)[1:-1] for g in globs) + ")(?:/.*)?$") if globs else None

    def rules_of(folder: str, base: str) -> list:
        return [r for name in IGNORE_FILES for r in ignore_rules(_lines(os.path.join(folder, name)) or [], base)]

    # The ignore files above the root count for paths from there.
    root = os.path.abspath(root)
    higher, above, inner = [], root, ""
    while not os.path.exists(os.path.join(above, ".git")) and os.path.dirname(above) != above:
        inner = os.path.basename(above) + ("/" + inner if inner else "")
        above = os.path.dirname(above)
        higher.append((above, inner))
    outer = [(rules_of(folder, ""), inner) for folder, inner in higher] if os.path.exists(os.path.join(above, ".git")) else []
    listed, rules = [], {"": []}

    def out(path: str, folder: bool, here: list) -> bool:
        if pattern and pattern.match(path):
            return True
        # The nearest folder with a rule that fits decides.
        said = [decision(path, folder, here), *(decision(f"{inner}/{path}", folder, r) for r, inner in outer)]
        return next((x for x in said if x is not None), False)

    for folder, dirs, names in os.walk(root):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        here = "" if here == "." else here
        front = here + "/" if here else ""
        mine = rules.pop(here) + rules_of(folder, here)
        dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(folder, d)) and not out(front + d, True, mine))
        rules |= {front + d: mine for d in dirs}
        listed += [(front + n,) for n in names if not os.path.islink(os.path.join(folder, n)) and not out(front + n, False, mine)]

    def read(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for (path,) in frame.itertuples(index=False):
                full = os.path.join(root, path)
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                    stat = os.stat(full)
                except OSError:
                    continue
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    text = None
                rows.append((path, len(data), int(stat.st_mtime), text))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime", "content"], dtype=object)

    paths = spark.createDataFrame(listed, "path string").repartition(parts)
    return paths.mapInPandas(read, "path string, size long, mtime long, content string")


def relative_to(path: Column, root: str) -> Column:
    """A listed URI without scheme and root."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    front = "/" + unquote(root.split("://", 1)[-1].removeprefix("file:")).strip("/") + "/"
    return F.regexp_replace(plain, "^" + "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in front), "")


#: Folder in which a workspace keeps its settings.
SETTINGS = ".workspace"


def _lines(path: str) -> list[str] | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()
    except OSError:
        return None


def workspace_ignores(root: str, settings: str = SETTINGS) -> list[str]:
    """Globs of a local workspace: the ``ignore`` file of its settings folder (or the defaults), and the ignore list of ``config.toml`` there.

    Ignore files of version control are no plain globs; ``walk_files`` reads them where it goes.
    """
    import tomllib

    own = _lines(os.path.join(root, settings, "ignore"))
    globs = list(DEFAULT_IGNORES) if own is None else ignore_patterns(own)
    config = _lines(os.path.join(root, settings, "config.toml"))
    if config is not None:
        named = tomllib.loads("\n".join(config)).get("index", {}).get("ignore", [])
        if not isinstance(named, list) or not all(isinstance(x, str) for x in named):
            raise ValueError("[index].ignore is no list of patterns")
        globs += ignore_patterns(named)
    return globs


def markdown_files(files: DataFrame) -> DataFrame:
    return files.where(extension("path") == "md")


def code_files(files: DataFrame) -> DataFrame:
    return files.where(language("path").isNotNull())


def expand(files: DataFrame, targets: list[str]) -> DataFrame:
    """Files named, and all markdown and code files below directories named, each once, in path order."""
    hit = F.lit(False)
    for t in targets:
        t = t.strip("/")
        below = F.col("path").startswith(t + "/") if t and t != "." else F.lit(True)
        hit = hit | (F.col("path") == t) | (below & ((extension("path") == "md") | language("path").isNotNull()))
    return files.where(hit).dropDuplicates(["path"]).orderBy(path_order("path"))


def tree(files: DataFrame, start: str = "", depth: int | None = None, hidden: bool = False, dirs_only: bool = False, ignore: str | None = None, pattern: str | None = None) -> DataFrame:
    """(path, parent, name, depth, is_dir) below ``start``, directories before files and then by name at each level.

    Patterns are separated by bars, and a star in them crosses slashes. With ``pattern`` a
    directory stays only if it matches or holds something that does.
    """
    start = start.strip("/")
    below = files.where(F.col("path").startswith(start + "/")) if start else files
    union = lambda globs: "|".join(glob_regex(g, separator=False)[1:-1] for g in globs.split("|"))
    rows = below.select("path", F.lit(False).alias("is_dir"))
    dirs = rows.select(F.explode(ancestors("path")).alias("path")).where(F.col("path") != "").where(F.col("path").startswith(start + "/") if start else F.lit(True)).distinct()
    every = rows.unionByName(dirs.withColumn("is_dir", F.lit(True)))
    name = file_name("path")
    if not hidden:
        every = every.where(~F.col("path").rlike(r"(^|/)\."))
    if ignore:
        every = every.where(~F.exists(F.split("path", "/"), lambda x: x.rlike(f"^(?:{union(ignore)})$")) & ~F.col("path").rlike(f"^(?:{union(ignore)})(?:/.*)?$"))
    if pattern:
        hits = every.where(name.rlike(f"^(?:{union(pattern)})$"))
        kept = hits.select("path").unionByName(hits.select(F.explode(ancestors("path")).alias("path"))).distinct()
        every = every.join(kept, "path", "left_semi")
    if dirs_only:
        every = every.where("is_dir")
    steps = F.size(F.split("path", "/")) - (len(start.split("/")) if start else 0)
    every = every.select("path", parent_dir("path").alias("parent"), name.alias("name"), steps.alias("depth"), "is_dir")
    if depth is not None:
        every = every.where(F.col("depth") <= depth)
    # Files sort behind the directories of their level.
    parts = F.split("path", "/")
    key = F.transform(parts, lambda x, i: F.concat(F.when((i == F.size(parts) - 1) & ~F.col("is_dir"), "1").otherwise("0"), x))
    return every.orderBy(key)


def write_changed(formatted: DataFrame, root: str) -> int:
    """Writes the changed rows of ``format_files`` back below a local root, one file at a time; gives how many."""
    n = 0
    for row in formatted.where("changed").select("path", "content").toLocalIterator():
        with open(os.path.join(root, row["path"]), "w", encoding="utf-8", newline="") as f:
            f.write(row["content"])
        n += 1
    return n
