"""Column functions against values worked out by hand, and stems against SQLite."""

from __future__ import annotations

import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.functions import globs, links, paths, text
from tessellar.functions.order_keys import key_between, order_between
from tessellar.functions.stemming import index_term


def values(spark, rows, column, schema="a string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_paths(spark):
    one = lambda cases, f: values(spark, [(k,) for k in cases], f("a")) == list(cases.values())
    assert one({"a/b/../c": "a/c", "../x": None, "a/../../b": None, "/a": None, "./a//b": "a/b", "": ""}, paths.normalize)
    assert one({"a/b/c.rs": ["", "a", "a/b"], "x": [""]}, paths.ancestors)
    assert one({"a/b": ["", "a", "a/b"]}, lambda c: paths.ancestors(c, own=True))
    assert one({"a/b.MD": "md", "a.b/c": "", ".x": "", "a/.x.y": "y", "a": ""}, paths.extension)
    assert one({"a/b.md": "docs", "a.Tsx": "code", "a.json": None, "a": None}, paths.classify)
    assert one({"a.rs": "rust", "b.JSX": "javascript", "c.cs": None, "d": None}, paths.language)
    assert one({"a/b/c": "a/b", "c": "", "": ""}, paths.parent_dir)
    ordered = [r[0] for r in spark.createDataFrame([("a.md",), ("a/b",), ("a",)], "a string").orderBy(paths.path_order("a")).collect()]
    assert ordered == ["a", "a/b", "a.md"]
    rows = [("src/a", "src"), ("srcx", "src"), ("src", "src"), ("x", "")]
    assert values(spark, rows, paths.lies_under("a", "b"), "a string, b string") == [True, False, True, True]
    rows = [("d/x.md", "wikilink", "y", False), ("d/x.md", "link", "../y.md", False), ("d/x.md", "link", "e/y.md", True), ("x.md", "link", "/y.md", False), ("x.md", "link", None, False), ("x.md", "link", "../y.md", False), ("x.md", "wikilink", "v1.2", False)]
    assert values(spark, rows, paths.resolve_target("s", "k", "t", "r"), "s string, k string, t string, r boolean") == ["d/y.md", "y.md", "e/y.md", None, "x.md", None, "v1.2"]
    rows = [("a/b", "a/c/d"), ("", "x/y"), ("a/b", "a/b"), ("x", "y")]
    assert values(spark, rows, paths.relative_path("a", "b"), "a string, b string") == ["../c/d", "x/y", "", "../y"]
    assert values(spark, [("Docs/a",), ("docs2/a",), ("docs/b",)], paths.like_prefix("a", "docs")) == [True, False, True]


def test_globs(spark):
    cases = [("*.rs", "a.rs", True), ("*.rs", "b/a.rs", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**", "a/b/c", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[!a]b", "cb", True), ("{a,b*}.md", "bx.md", True), ("a.b", "axb", False)]
    for glob, path, want in cases:
        assert values(spark, [(path,)], F.col("a").rlike(globs.glob_regex(glob))) == [want], (glob, path)
    assert values(spark, [("b/a.rs",)], F.col("a").rlike(globs.glob_regex("*.rs", separator=False))) == [True]
    found = globs.ignore_patterns(["# c", "", "node_modules/", "docs/old", "*.tmp"])
    assert found == ["**/node_modules", "docs/old", "**/*.tmp"]
    rows = [("node_modules/x.js",), ("a/node_modules",), ("docs/old/y.md",), ("docs/older",), ("b/c.tmp",), ("",), ("src/a",)]
    assert values(spark, rows, globs.ignored("a", found)) == [True, True, True, False, True, False, False]


def test_links(spark):
    get = lambda f, cases: [tuple(x) if x else None for x in values(spark, [(c,) for c in cases], f("a"))]
    assert get(links.markdown_target, ["b.md#x", "#x", "root://d/b.md", "a.txt", "https://x/y.md", "mailto:a@b", "", "<c d.md>", "#"]) == [("b.md", "x", False), (None, "x", False), ("d/b.md", None, True), None, None, None, None, ("c d.md", None, False), None]
    assert get(links.wikilink_target, ["page|label", "page#part", "#part", "root://p", "", " | x"]) == [("page", None, False), ("page", "part", False), (None, "part", False), ("p", None, True), None, None]
    assert get(links.embed_target, ["#part", "p#q"]) == [None, ("p", "q", False)]
    assert values(spark, [("The `x` of [a](b.md) and [[p|q]] it's",)], links.heading_text("a")) == ["The x of a and q it’s"]
    assert values(spark, [("SOP-OPS-12 :: Do",), ("SOP12 :: no",)], F.regexp_extract("a", links.PROCEDURE_HEADING, 1)) == ["SOP-OPS-12", ""]


def test_texts(spark):
    assert values(spark, [("A-b, Ünï 3x!",), (None,), ("--",)], text.terms("a")) == [["a", "b", "ünï", "3x"], [], []]
    assert values(spark, [("ab-0012.3.1",), ("X-Y-7",), ("bad",), ("a-1.0",)], text.parse_external_id("a")) == [("AB", 12, [3, 1]), ("X-Y", 7, []), None, None]
    assert values(spark, [(12345,), (7,)], text.external_id(F.lit("AB"), "a", F.lit(".2")), "a int") == ["AB-12345.2", "AB-0007.2"]
    assert values(spark, [("AB",), ("A",), ("ab",), ("AB-",), ("1AB",), ("ABCDEFG",)], text.alias_ok("a")) == [True, False, False, True, False, False]
    assert values(spark, [("abcdef",), ("abc",)], text.truncate_chars("a", 3)) == ["abc...", "abc"]


@settings(max_examples=200, deadline=None)
@given(st.text("0az", max_size=5), st.text("0az", max_size=5))
def test_key_between(a, b):
    low, high = sorted((a, b))
    try:
        key = key_between(low or None, high or None)
    except ValueError:
        assert low >= high or not high.strip("0") or high.startswith(low) and not high[len(low) :].strip("0")
        return
    assert (not low or low < key) and (not high or key < high)


def test_order_between(spark):
    rows = [(None, None), ("a", None), (None, "i"), ("a", "b"), ("z", None), ("b", "a"), (None, "00")]
    got = values(spark, rows, order_between("a", "b"), "a string, b string")
    assert got[0] == "i" and got[5] is None and got[6] is None
    assert all((a is None or a < k) and (b is None or k < b) for (a, b), k in zip(rows[:5], got))


@pytest.mark.parametrize("seed", range(3))
def test_stems_as_sqlite(seed):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    rng = random.Random(seed)
    heads = "relat condit rat valenc hesit digit conform radic differ vil analog vietnam predicat operat feudal decis hop callous formal sensit triplic form electr good reviv allow infer airlin adjust defens irrit homolog commun activ angul effect bowdl probat ceas control roll happ sky caress pon ti cat feed agre plaster bled motor sing conflat troubl siz hopp tann fall hiss fizz fail fil café naïv índex".split()
    tails = ["", "s", "es", "ed", "ing", "ational", "tional", "y", "ly", "ness", "ful", "ization", "ation", "ator", "ive", "iveness", "ence", "ent", "ement", "ion", "e", "er", "able", "ism", "iti", "ousli", "eed", "ies", "sses", "logi", "bli"]
    for word in {rng.choice(heads) + rng.choice(tails) + rng.choice(tails[:6]) for _ in range(400)}:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (word,))
        (want,) = con.execute("SELECT term FROM v").fetchone()
        assert index_term(word) == want, word
