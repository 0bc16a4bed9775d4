"""Paths as text with ``/``: normalising, ancestors, prefixes, kinds and order, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by what a file is indexed as, and by programming language.
DOCS = ("md", "markdown", "txt")
CODE = ("rs", "py", "js", "jsx", "ts", "tsx", "go", "toml", "sql", "sh")
LANGUAGES = {"rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "py": "python", "go": "go"}
#: Larger files are not indexed for search.
MAX_INDEXED_BYTES = 262_144


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path: Column | str) -> Column:
    """Lower-case extension of the last component; empty where it has none or only a leading dot."""
    return F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_dir(path: Column | str) -> Column:
    """The directory of a path; empty at the root."""
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def normalize(path: Column | str) -> Column:
    """Without ``.`` and ``..``; null for absolute paths and for those that leave the root on the way."""
    c = _c(path)
    parts = F.aggregate(
        F.split(c, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(acc.isNull(), acc)
        .when((x == ".") | (x == ""), acc)
        .when((x == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(x == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(~c.startswith("/"), F.array_join(parts, "/"))


def ancestors(path: Column | str, own: bool = False) -> Column:
    """All directories above a path from the root (empty text) down; with ``own`` the path itself too."""
    parts = F.split(_c(path), "/")
    last = F.size(parts) if own else F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def path_order(path: Column | str) -> Column:
    """Sorts by components, so that ``a/b`` comes before ``a.md``."""
    return F.split(_c(path), "/")


def lies_under(path: Column | str, root: Column | str) -> Column:
    """Whether a path is a root or lies below it, component by component; the empty root covers all."""
    p, r = _c(path), _c(root)
    return (r == "") | (p == r) | p.startswith(F.concat(r, F.lit("/")))


def like_prefix(path: Column | str, prefix: str) -> Column:
    """Prefix test that ignores ASCII case and takes % and _ in the prefix as wildcards; a directory prefix gets its slash."""
    full = prefix if prefix == "" or prefix.endswith("/") else prefix + "/"
    return F.lower(_c(path)).like(full.lower() + "%")


def classify(path: Column | str) -> Column:
    """``docs``, ``code`` or null, by extension."""
    e = extension(path)
    return F.when(e.isin(*DOCS), "docs").when(e.isin(*CODE), "code")


def language(path: Column | str) -> Column:
    """Programming language by extension, or null."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def resolve_target(source: Column | str, kind: Column | str, target: Column | str, root_relative: Column | str) -> Column:
    """The path a link names: none is the source itself, a wikilink without extension is a .md file, a relative
    target starts at the source's directory; null where it is absolute or leaves the root."""
    s, k, t, r = _c(source), _c(kind), _c(target), _c(root_relative)
    named = F.when((k == "wikilink") & ~F.element_at(F.split(t, "/"), -1).rlike(r"[^/]\.[^.]*$"), F.concat(t, F.lit(".md"))).otherwise(t)
    base = parent_dir(s)
    joined = F.when(r | (base == ""), named).otherwise(F.concat(base, F.lit("/"), named))
    return F.when(t.isNull(), s).when(named.startswith("/"), F.lit(None)).otherwise(normalize(joined))


def relative_path(source_dir: Column | str, target: Column | str) -> Column:
    """The way from a directory to a target: the common front dropped, ``..`` for each step up."""
    a = F.filter(F.split(_c(source_dir), "/"), lambda x: x != "")
    b = F.filter(F.split(_c(target), "/"), lambda x: x != "")
    n = F.least(F.size(a), F.size(b))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((i <= n) & (acc == i - 1) & (F.try_element_at(a, i) == F.try_element_at(b, i)), i).otherwise(acc))
    ups = F.array_repeat(F.lit(".."), F.size(a) - common)
    return F.array_join(F.concat(ups, F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))), "/")
