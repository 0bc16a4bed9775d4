"""Maps of a code base: which files they cover, where maps are missing, which roots are gone or stale."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.paths import ancestors, normalize

#: Directories with fewer uncovered files are no gap.
LEAST_FILES = 5
OUTSIDE, GONE = "root points outside the repo", "root no longer exists"


def directory_counts(files: DataFrame) -> DataFrame:
    """(dir, files) for every directory above a file, the root (empty) included; counted map-side before the shuffle."""
    return files.select(F.explode(ancestors("path")).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def uncovered(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files under none of the roots."""
    above = files.select("path", F.explode(ancestors("path", own=True)).alias("root"))
    covered = above.join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return files.join(covered, "path", "left_anti")


def gaps(files: DataFrame, roots: DataFrame, least: int = LEAST_FILES) -> DataFrame:
    """(dir, files): the highest directories with at least ``least`` uncovered files that enclose no root."""
    counts = directory_counts(uncovered(files, roots)).where(F.col("files") >= least)
    enclosing = roots.select(F.explode(ancestors("root", own=True)).alias("dir")).distinct()
    free = counts.join(enclosing, "dir", "left_anti")
    above = free.select("dir", F.explode(ancestors("dir")).alias("up"))
    nested = above.join(free.select(F.col("dir").alias("up")), "up", "left_semi").select("dir").distinct()
    return free.join(nested, "dir", "left_anti")


FRONT = "path string, domain string, repo string, root string, owner string, updated string, commit string, problem string"


def front_matter(text: str | None) -> tuple[dict | None, str | None]:
    """The YAML block between leading --- lines, or why there is none."""
    import yaml

    if not text or not text.startswith("---"):
        return None, "no frontmatter"
    lines = text.splitlines()
    if lines[0].rstrip() != "---":
        return None, "no frontmatter"
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), None)
    if end is None:
        return None, "unterminated frontmatter"
    try:
        block = yaml.safe_load("\n".join(lines[1:end]))
    except yaml.YAMLError as e:
        return None, f"bad frontmatter: {str(e).splitlines()[0]}"
    return (block, None) if isinstance(block, dict) else (None, "frontmatter is no mapping")


def codemaps(files: DataFrame, text: str) -> DataFrame:
    """(path, domain, repo, root, owner, updated, commit, problem) of map files; blank values are null, the root defaults to the map's directory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["domain", "repo", "root", "owner", "updated", "commit"]
        for frame in batches:
            rows = []
            for path, content in frame.itertuples(index=False):
                block, problem = front_matter(content)
                values = {k: str(block[k]).strip() or None if block and block.get(k) is not None else None for k in names}
                if block is not None and not values["domain"]:
                    problem = "no domain"
                if values["root"] is None:
                    values["root"] = path.rpartition("/")[0]
                rows.append((path, *[values[k] for k in names], problem))
            yield pd.DataFrame(rows, columns=["path", *names, "problem"], dtype=object)

    return files.select("path", text).mapInPandas(run, FRONT)


def dangling(maps: DataFrame, directories: DataFrame) -> DataFrame:
    """Maps whose root leaves the repository or is no directory (``dir``) of it."""
    known = directories.select(F.col("dir").alias("__root"), F.lit(True).alias("__there")).distinct()
    joined = maps.withColumn("__root", normalize("root")).join(known, "__root", "left")
    reason = F.when(F.col("__root").isNull(), OUTSIDE).when(F.col("__there").isNull() & (F.col("__root") != ""), GONE)
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__root", "__there")


def stale(maps: DataFrame, commits: DataFrame) -> DataFrame:
    """Per map (path, root, commit): whether a file below its root differs from what it was at the commit it names.

    ``commits``: seq (ascending), id, path, blob (a row for each changed file with the name of its
    new content, null where it is gone; a commit without files has a null path). A map without a
    commit or with one that is unknown is unverifiable. ``distance`` is the number of commits since;
    a change that was taken back is none. The first three changed paths come with it.
    """
    each = commits.select("seq", "id").distinct()
    pins = maps.select("path", "root", "commit").join(each.select(F.col("id").alias("commit"), F.col("seq").alias("pin")), "commit", "left")
    order = Window.orderBy("seq")
    count = each.select("seq").distinct().withColumn("number", F.row_number().over(order))
    last = count.agg(F.max("number").alias("last"))
    pins = pins.join(count.select(F.col("seq").alias("pin"), "number"), "pin", "left").join(F.broadcast(last)).withColumn("distance", F.coalesce((F.col("last") - F.col("number")).cast("long"), F.lit(0)))
    changes = commits.where(F.col("path").isNotNull() & ~F.col("path").endswith("CODEMAP.md")).select("seq", "blob", F.col("path").alias("changed"), F.explode(ancestors("path", own=True)).alias("root"))
    files = pins.where("pin IS NOT NULL").join(changes, "root").groupBy("path", "changed").agg(
        F.max_by("blob", F.when(F.col("seq") <= F.col("pin"), F.col("seq"))).alias("then"), F.max_by("blob", "seq").alias("now")
    )
    found = files.where(~F.col("then").eqNullSafe(F.col("now"))).groupBy("path").agg(F.slice(F.array_sort(F.collect_set("changed")), 1, 3).alias("sample"))
    state = F.when(F.col("pin").isNull(), "unverifiable").when(F.col("sample").isNull(), "fresh").otherwise("stale")
    return pins.join(found, "path", "left").select("path", "root", state.alias("state"), "distance", "sample")


def findings(maps: DataFrame, files: DataFrame, directories: DataFrame, commits: DataFrame | None = None, least: int = LEAST_FILES) -> DataFrame:
    """(kind, path, detail): parse problems and dangling roots always, gaps, and what ``commits`` shows to be stale or cannot show."""
    good = maps.where("problem IS NULL")
    out = maps.where("problem IS NOT NULL").select(F.lit("problem").alias("kind"), "path", F.col("problem").alias("detail"))
    out = out.unionByName(dangling(good, directories).select(F.lit("dangling").alias("kind"), "path", F.col("reason").alias("detail")))
    out = out.unionByName(gaps(files, good.select("root"), least).select(F.lit("gap").alias("kind"), F.col("dir").alias("path"), F.format_string("%d files without a map", "files").alias("detail")))
    if commits is not None:
        state = stale(good, commits).where("state <> 'fresh'")
        out = out.unionByName(state.select(F.col("state").alias("kind"), "path", F.format_string("%d commits since", "distance").alias("detail")))
    return out


def git_commits(repository: str) -> list[tuple[int, str, str | None, str | None]]:
    """(seq, id, path, blob) of a local repository's history, oldest first, for ``stale``; empty where git cannot read it."""
    try:
        log = subprocess.run(["git", "-C", repository, "log", "--reverse", "-m", "--first-parent", "--raw", "--no-abbrev", "--no-renames", "--pretty=format:%x00%H"], capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return []
    out = []
    for seq, entry in enumerate(log.split("\0")[1:]):
        head, *changes = [line for line in entry.splitlines() if line]
        files = [(c.partition("\t")[2], c.split()[3]) for c in changes]
        out += [(seq, head, p, b if b.strip("0") else None) for p, b in files] or [(seq, head, None, None)]
    return out


def index_text(maps: DataFrame, problems: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the overview of all maps as markdown (domains, gaps, problems); small tables, put together in order."""
    row = F.concat(F.lit("| "), "domain", F.lit(" | "), F.when(F.col("root") == "", ".").otherwise(F.col("root")), F.lit(" | "), F.coalesce("owner", F.lit("")), F.lit(" |"))
    domains = maps.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("root", "domain", row.alias("row")))), lambda x: x["row"]), "\n").alias("domains"))
    missing = candidates.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("- %s (%d files)", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), "files"))), "\n").alias("gaps"))
    bad = problems.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "path", F.lit(": "), "problem"))), "\n").alias("bad"))
    text = F.concat(F.lit("# Code maps\n\n| Domain | Root | Owner |\n|---|---|---|\n"), "domains", F.lit("\n\n## Without a map\n\n"), "gaps", F.lit("\n\n## Problems\n\n"), "bad", F.lit("\n"))
    return domains.join(missing).join(bad).select(text.alias("text"))


