"""Markdown tables, the vault check and transclusion on small vaults."""

from __future__ import annotations

import pytest

from tessellar.operators import linkgraph, markdown
from tessellar.operators.transclude import render

VAULT = {
    "a.md": "# A\n\nSee [b](b.md#Target), [gone](missing.md), [out](../x.md), [web](https://x.invalid) and [[sub/c]].\n\n```\n[no](no.md) [[no]]\n```\n\n    [no](no.md)\n\n`[[no]]` done\n",
    "b.md": "---\ntitle: B\n---\n# B\n\n## Target\n\ntext\n\nTitle again\n===========\n\n## Target\n\n[self](#target-1) [bad](#nope)\n",
    "sub/c.md": "# C\n\n![[../b#Target]]\n![[gone]]\n",
    "d.md": "",
}


@pytest.fixture(scope="module")
def vault(spark):
    return spark.createDataFrame(list(VAULT.items()), "path string, content string")


def test_tables(vault):
    parsed = markdown.parse_files(vault)
    heads = {(r["path"], r["line"]): (r["anchor"], r["level"], r["title"]) for r in markdown.headings(parsed).collect()}
    assert heads == {("a.md", 1): ("a", 1, "A"), ("b.md", 4): ("b", 1, "B"), ("b.md", 6): ("target", 2, "Target"), ("b.md", 10): ("title-again", 1, "Title again"), ("b.md", 13): ("target-1", 2, "Target"), ("sub/c.md", 1): ("c", 1, "C")}
    found = {(r["source"], r["target"], r["target_anchor"]) for r in markdown.links(parsed).collect()}
    assert found == {("a.md", "b.md", "Target"), ("a.md", "missing.md", None), ("a.md", None, None), ("a.md", "sub/c.md", None), ("b.md", "b.md", "target-1"), ("b.md", "b.md", "nope"), ("sub/c.md", "b.md", "Target"), ("sub/c.md", "sub/gone.md", None)}
    ends = {(r["path"], r["line"]): r["end_line"] for r in linkgraph.section_ends(markdown.headings(parsed)).collect()}
    assert ends["b.md", 4] == 9 and ends["b.md", 6] == 9 and ends["b.md", 13] is None
    parents = {(r["path"], r["line"]): r["parent_line"] for r in linkgraph.heading_parents(markdown.headings(parsed)).collect()}
    assert parents["b.md", 13] == 10 and parents["b.md", 6] == 4 and parents["b.md", 10] is None


def test_columns_are_bytes():
    (link,) = markdown.parse("äö [x](y.md)").links
    assert link[1:] == ("link", "[x](y.md)", "y.md", 1, 6)


def test_check(vault):
    rows = {(r["kind"], r["path"], r["reason"]) for r in markdown.check(vault).collect()}
    assert rows == {
        ("link", "a.md", "target file not found: missing.md"), ("link", "a.md", "target resolves outside root"), ("link", "b.md", "target heading not found: b.md#nope"), ("link", "sub/c.md", "target file not found: sub/gone.md"),
        ("embed", "sub/c.md", "target file not found: sub/gone.md"), ("orphan", "a.md", None), ("orphan", "d.md", None),
    }
    assert markdown.check(vault.limit(0)).count() == 0


def test_procedures(spark):
    lib = "# Lib\n\n## SOP-OPS-1 :: Start\n"
    use = "# Use\n\n## SOP-2 :: Go\n\n```prosaic\nuse SOP-OPS-1 from lib.md\nrun SOP-OPS-1 // fine\n/* run\nSOP-9 */ run SOP-7\nuse SOP-3 from lib.md\nuse SOP-1 from none.md\nrun SOP-2\n```\n\n## Plain\n\n```prosaic\nrun SOP-99\n```\n"
    files = spark.createDataFrame([("lib.md", lib), ("use.md", use)], "path string, content string")
    rows = {(r["line"], r["reason"]) for r in markdown.check(files).where("kind = 'procedure'").collect()}
    assert rows == {(10, "procedure not found: SOP-3 in lib.md"), (11, "target file not found: none.md"), (9, "procedure not imported: SOP-7")}


def test_render(spark):
    files = {
        "a.md": "start\n![[b#Part]]\nend", "b.md": "# B\n\n## Part\n\nx\n![[c]]\n\n## Next\ny", "c.md": "c1\n\n", "loop.md": "![[loop2]]", "loop2.md": "![[loop]]", "miss.md": "![[none]]\n", "code.md": "```\n![[c]]\n```", "self.md": "# S\n![[self#S]]",
    }
    out = {r["path"]: r for r in render(spark.createDataFrame(list(files.items()), "path string, content string")).collect()}
    assert out["a.md"]["text"] == "start\n## Part\n\nx\nc1\nend" and out["code.md"]["text"] == files["code.md"]
    assert out["loop.md"]["text"] is None and out["loop.md"]["errors"][0].startswith("embed cycle")
    assert out["miss.md"]["errors"] == ["embed not found: none.md"] and out["self.md"]["errors"][0].startswith("embed cycle")
