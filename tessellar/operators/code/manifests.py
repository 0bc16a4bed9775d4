"""What manifests say about where modules lie: Go modules, packages by name, path aliases, package roots of Python projects.

Manifests are few beside the files; they are read in one pass, and imports meet them by equi-joins on
the front parts of what they name.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions.paths import ancestors, normalize, parent_dir
from tessellar.session import shuffled


def go_modules(files: DataFrame, content: str = "content") -> DataFrame:
    """(module, dir) of every go.mod, and of every local directory that a go.mod or go.work puts in place of a module: a handful of rows."""
    rows = files.where(F.col("path").rlike(r"(^|/)go\.(mod|work)$")).select("path", parent_dir("path").alias("dir"), F.col(content).alias("text"))
    own = rows.where(F.col("path").endswith("go.mod")).select(F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1).alias("module"), "dir")
    rule = r"(?m)^[ \t]*(?:replace[ \t]+)?([^\s=]+)(?:[ \t]+v\S+)?[ \t]*=>[ \t]*(\.\.?(?:/[^\s]*)?)[ \t]*$"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(rule), F.lit(1)).alias("module"), F.regexp_extract_all("text", F.lit(rule), F.lit(2)).alias("to"))
    put = rows.select("dir", F.explode(pairs).alias("r")).select(F.col("r.module").alias("module"), normalize(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "r.to")).alias("dir")).where("dir IS NOT NULL")
    return own.unionByName(put).where("module <> ''").distinct()


def read_exports(text: str | None) -> list[tuple[str, str, str]]:
    """(name, part, file) of what a package.json exports: parts and files below the package, a star left off where both end or begin at one."""
    try:
        manifest = json.loads(text or "")
        name, exports = manifest.get("name"), manifest.get("exports")
    except (ValueError, AttributeError):
        return []

    def first(x: object) -> str | None:
        if isinstance(x, str):
            return x
        if isinstance(x, dict):
            # Conditions in the order in which sources are looked for, then any other.
            order = [k for k in ("source", "types", "import", "module", "require", "default") if k in x] + list(x)
            return next((f for k in order if (f := first(x[k]))), None)
        return next((f for y in x if (f := first(y))), None) if isinstance(x, list) else None

    if not name or not exports:
        return []
    parts = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
    return [(name, k.removeprefix(".").strip("/"), f.removeprefix("./")) for k, v in parts.items() if (f := first(v)) and f.startswith("./")]


def exported_candidates(rows: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """(n, rank, rest, file) of imports that a package's export map names, by its whole part or the part before a star."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = [(name + ("/" + part.partition("*")[0].rstrip("/") if part.partition("*")[0] else ""), "*" in part, d, *f.partition("*")[::2]) for d, t in frame.itertuples(index=False) for name, part, f in read_exports(t)]
            yield pd.DataFrame(out, columns=["front", "star", "dir", "before", "after"])

    manifests = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(parent_dir("path").alias("dir"), content)
    maps = manifests.mapInPandas(run, "front string, star boolean, dir string, before string, after string")
    bare = rows.where("language NOT IN ('go', 'python', 'rust')").select("n", F.col("raw").alias("spec"))
    hits = bare.select("n", "spec", F.explode(ancestors("spec", own=True)).alias("front")).where("front <> ''").join(shuffled(maps), "front").where(F.col("star") == (F.col("spec") != F.col("front")))
    inside = F.expr("substring(spec, length(front) + 2)")
    file = F.when(F.col("star"), F.concat("before", inside, "after")).otherwise(F.col("before"))
    return hits.select("n", F.when(F.col("star"), 1).otherwise(0).alias("rank"), F.lit(0).alias("rest"), F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), file).alias("file"))


def packages(files: DataFrame, content: str = "content") -> DataFrame:
    """(family, name, dir, entry) of the packages that manifests declare: package.json by name, Cargo.toml with dashes as underscores."""
    json_rows = files.where(F.col("path").rlike(r"(^|/)package\.json$"))
    entry = F.regexp_replace(F.coalesce(*[F.get_json_object(content, f"$.{k}") for k in ("types", "module", "main")], F.lit("")), r"^\./", "")
    js = json_rows.select(F.lit("script").alias("family"), F.get_json_object(content, "$.name").alias("name"), parent_dir("path").alias("dir"), entry.alias("entry"))
    cargo = files.where(F.col("path").rlike(r"(^|/)Cargo\.toml$"))
    name = F.regexp_replace(F.regexp_extract(content, r'(?s)\[package\].*?\bname\s*=\s*"([^"]+)"', 1), "-", "_")
    rust = cargo.select(F.lit("rust").alias("family"), name.alias("name"), parent_dir("path").alias("dir"), F.regexp_extract(content, r'(?s)\[lib\].*?\bpath\s*=\s*"([^"]+)"', 1).alias("entry"))
    return js.unionByName(rust).where("name <> ''")


def package_candidates(rows: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """(n, rank, rest, file) of imports by package name: the longest package name in front, then the file its rest names."""
    bare = rows.where("language <> 'go' AND language <> 'python'").select("n", F.when(F.col("language") == "rust", "rust").otherwise("script").alias("family"), F.regexp_replace("raw", "::", "/").alias("spec"))
    fronts = bare.select("n", "family", "spec", F.explode(ancestors("spec", own=True)).alias("name")).where("name <> ''").join(shuffled(packages(files, content)), ["family", "name"])
    best = fronts.groupBy("n", "family", "spec").agg(F.max(F.struct(F.length("name").alias("k"), "name", "dir", "entry")).alias("m")).select("n", "family", "spec", "m.*")
    inner = F.filter(F.split(F.expr("substring(spec, length(name) + 2)"), "/"), lambda x: (x != "") & (x != "*"))
    best = best.withColumn("inner", inner).withColumn("front", F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))))
    # For Rust ever shorter module paths below src, for scripts the path with each extension.
    shorter = F.transform(F.sequence(F.size("inner"), F.lit(0)), lambda k: F.struct(F.array_join(F.slice("inner", F.lit(1), k), "/").alias("at"), (F.size("inner") - k).alias("rest")))
    rust = best.where("family = 'rust'").select("n", "front", "entry", F.posexplode(shorter).alias("rank", "s")).select(
        "n", "rank", "s.rest", F.explode(F.when(F.col("s.at") == "", F.array(F.concat("front", "entry"), F.concat("front", F.lit("src/lib.rs")), F.concat("front", F.lit("src/main.rs")))).otherwise(F.array(F.concat("front", F.lit("src/"), "s.at", F.lit(".rs")), F.concat("front", F.lit("src/"), "s.at", F.lit("/mod.rs"))))).alias("file")
    )
    at = F.array_join("inner", "/")
    endings = [F.lit(x) for x in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]
    whole = F.array(F.concat("front", "entry"), *[F.concat("front", F.lit(x)) for x in ("src/index.ts", "src/index.tsx", "src/index.js", "index.ts", "index.tsx", "index.js")])
    parts = F.concat(F.array(*[F.concat("front", at, e) for e in endings]), F.array(*[F.concat("front", F.lit("src/"), at, e) for e in endings]))
    script = best.where("family = 'script'").select("n", F.posexplode(F.when(F.size("inner") == 0, whole).otherwise(parts)).alias("rank", "file")).select("n", "rank", F.lit(0).alias("rest"), "file")
    return rust.unionByName(script).select("n", "rank", "rest", "file")


def read_aliases(text: str | None) -> list[tuple[str, str]]:
    """(alias, target) of the path aliases of a script configuration, stars left off, relative to its directory; comments are allowed in it."""
    plain = re.sub(r'("(?:[^"\\\\]|\\\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text or "")
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    base = str(options.get("baseUrl", ".")).strip("/").removeprefix("./")
    out = []
    for alias, targets in (options.get("paths") or {}).items():
        for target in targets if isinstance(targets, list) else []:
            where = "/".join(x for x in (base if base != "." else "", target.removeprefix("./").removesuffix("*").rstrip("/")) if x)
            out.append((alias.removesuffix("*").rstrip("/"), where))
    return out


def read_roots(path: str, text: str | None) -> list[str]:
    """Directories, relative to a Python project's, that hold its packages as its manifest declares them."""
    if path.endswith("setup.py"):
        found = re.findall(r"package_dir\s*=\s*\{[^}]*['\"]['\"]\s*:\s*['\"]([^'\"]+)['\"]|find_(?:namespace_)?packages\(\s*(?:where\s*=\s*)?['\"]([^'\"]+)['\"]", text or "")
        return [a or b for a, b in found]
    try:
        tool = tomllib.loads(text or "").get("tool", {})
    except tomllib.TOMLDecodeError:
        return []
    out: list[str] = []
    tools = tool.get("setuptools", {})
    packages = tools.get("packages", {})
    if isinstance(packages, dict):
        out += packages.get("find", {}).get("where", []) or []
    out += [v for k, v in (tools.get("package-dir", {}) or {}).items() if k == ""]
    out += [p["from"] for p in tool.get("poetry", {}).get("packages", []) or [] if isinstance(p, dict) and p.get("from")]
    out += [p.rpartition("/")[0] for p in tool.get("hatch", {}).get("build", {}).get("targets", {}).get("wheel", {}).get("packages", []) or []]
    return out


def _parsed(rows: DataFrame, content: str, kind: str) -> DataFrame:
    """(dir, name, target) of the manifests given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path, text in frame.itertuples(index=False):
                here = path.rpartition("/")[0]
                if kind == "alias":
                    out += [(here, a, t) for a, t in read_aliases(text)]
                else:
                    out += [(here, "", r.strip("./")) for r in read_roots(path, text)]
            yield pd.DataFrame(out, columns=["dir", "name", "target"], dtype=object)

    return rows.select("path", content).mapInPandas(run, "dir string, name string, target string")


ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def alias_candidates(rows: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """(n, rank, rest, file) of script imports by path aliases of a configuration above their file, the nearest first."""
    known = _parsed(files.where(F.col("path").rlike(r"(^|/)(ts|js)config(\.[\w-]+)?\.json$")), content, "alias")
    spec = rows.where("language IN ('javascript', 'typescript', 'tsx')").select("n", "path", "raw")
    fronts = spec.select("n", "path", "raw", F.explode(ancestors("raw", own=True)).alias("name")).where("name <> ''").join(shuffled(known), "name")
    near = fronts.where(F.expr("dir = '' OR startswith(path, concat(dir, '/'))"))
    tail = F.expr("substring(raw, length(name) + 1)")
    base = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), "target", tail)
    order = (F.lit(500) - F.least(F.length("dir"), F.lit(49)) * 10).alias("far")
    return near.select("n", order, F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS])).alias("k", "file")).select("n", (F.col("far") + F.col("k")).alias("rank"), F.lit(0).alias("rest"), "file")


def python_candidates(rows: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """(n, rank, rest, file) of Python imports from the package roots that projects declare; joined on the first part of the module."""
    projects = files.where(F.col("path").rlike(r"(^|/)(pyproject\.toml|setup\.py)$"))
    roots = _parsed(projects, content, "roots").select(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.when(F.col("target") != "", F.col("target"))).alias("root")).distinct()
    above = files.where(F.lower("path").endswith(".py")).select("path", F.explode(ancestors("path")).alias("root")).join(shuffled(roots), "root")
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    tops = above.select("root", F.regexp_replace(F.substring_index(inner, "/", 1), r"\.py$", "").alias("top")).distinct()
    module = F.regexp_replace("raw", r"\.\*$", "")
    asked = rows.where("language = 'python'").select("n", "style", "definition", F.translate(module, ".", "/").alias("at")).withColumn("top", F.substring_index("at", "/", 1)).join(shuffled(tops), "top")
    front = F.concat(F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))), "at")
    item = lambda path, rest: F.struct(path.alias("file"), F.lit(rest).alias("rest"))
    whole = lambda rest: [item(F.concat(front, F.lit(".py")), rest), item(F.concat(front, F.lit("/__init__.py")), rest)]
    below = [item(F.concat(front, F.lit("/"), "definition", F.lit(e)), 0) for e in (".py", "/__init__.py")]
    options = F.when(F.col("style") == "path", F.array(*below, *whole(1))).otherwise(F.array(*whole(0)))
    return asked.select("n", F.posexplode(options).alias("rank", "c")).select("n", "rank", "c.rest", "c.file")
