"""Listings, changes, coverage, editor queries and search on small tables."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessellar.functions.registry import register
from tessellar.operators import coverage, editor, markdown, records, search, work

TASKS = "id long, project_id long, space_id long, seq long, child_seq long, title string, status string, priority long, order_key string, cycle_id long, parent_id long, deleted_at string"


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [(1, 1, None, 1, None, "a", "open", 2, "b", 9, None, None), (2, 1, None, 2, None, "b", "done", None, None, None, None, None), (3, 1, None, None, 1, "c", "open", 1, None, None, 1, None),
            (4, None, 7, 1, None, "d", "open", 1, None, 8, None, None), (5, 1, None, 3, None, "e", "open", 1, None, None, None, "x"), (6, 1, None, None, 2, "f", "open", 1, None, None, 3, None), (7, None, None, 4, None, None, None, None, None, None, 99, None)]
    return spark.createDataFrame(rows, TASKS)


@pytest.fixture(scope="module")
def view(spark, tasks):
    projects = spark.createDataFrame([(1, "p", "PP", 7)], "id long, slug string, alias string, space_id long")
    spaces = spark.createDataFrame([(7, "s", "SS")], "id long, slug string, alias string")
    cycles = spark.createDataFrame([(8, "C8"), (9, "C9")], "id long, key string")
    return work.task_view(tasks, projects, spaces, cycles, work.crumbs(tasks))


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_listing(view, tasks):
    assert {r["id"]: (r["owner_slug"], r["suffix"], r["cycle_key"]) for r in view.collect()} == {1: ("p", "", "C9"), 2: ("p", "", None), 3: ("p", ".1", None), 4: ("s", "", "C8"), 5: ("p", "", None), 6: ("p", ".1.2", None), 7: (None, "", None)}
    assert ids(work.list_tasks(view)) == [2, 1, 4]
    assert ids(work.list_tasks(view, statuses=["open"], limit=1)) == [1] and ids(work.list_tasks(view, statuses=[])) == []
    assert ids(work.list_tasks(view, space_id=7)) == [2, 1, 4] and ids(work.list_tasks(view, space_id=7, space_only=True)) == [4]
    assert ids(work.list_tasks(view, cycle="C8")) == [4] and ids(work.list_tasks(view, project="p", priority=2)) == [1] and len(ids(work.list_tasks(view, top_level=False, limit=-1))) == 6
    assert {r["id"]: r["project_count"] for r in work.counted(tasks.select("id"), "id", view, "project_id", "project_count").collect()}[1] == 5
    assert {(r["project_id"], r["space_id"]): r["next"] for r in work.next_number(tasks, ["project_id", "space_id"], "seq").collect()} == {(1, None): 4, (None, 7): 2, (None, None): 5}
    new = tasks.select("project_id", "space_id", F.lit(0).alias("x"), "id")
    assert {r["id"]: r["seq"] for r in work.allocate(new.where("id IN (1, 2, 4)"), tasks, ["project_id", "space_id"], "seq", ["id"]).collect()} == {1: 4, 2: 5, 4: 2}
    assert {(r["root"], r["id"], r["distance"]) for r in work.subtree(tasks, tasks.where("id = 1").select("id")).collect()} == {(1, 1, 0), (1, 3, 1), (1, 6, 2)}
    top = {(r["status"], r["place"]): r["group_size"] for r in work.top_per_group(tasks, ["status"], ["id"], 1).collect()}
    assert top == {("open", 1): 5, ("done", 1): 1, (None, 1): 1}
    assert ids(work.latest(tasks.unionByName(tasks.withColumn("title", F.lit("z"))), ["id"], ["title"]).where("title = 'z'").orderBy("id")) == [1, 2, 3, 4, 5, 6, 7]
    assert work.list_tasks(view.limit(0)).count() == 0 and work.crumbs(tasks.limit(0)).count() == 0


def test_moves(spark):
    rows = [(1, 1, None, None, 1, None, "a"), (2, 1, None, None, 2, None, "c"), (3, 1, None, None, 3, None, "e"), (4, 1, None, 1, None, 1, "x"), (5, 2, None, None, 1, None, "m"), (6, 1, None, 1, None, 4, "x")]
    t = spark.createDataFrame(rows, "id long, project_id long, space_id long, parent_id long, seq long, child_seq long, order_key string")

    def move(*m):
        return {r["id"]: (r["order_key"], r["problem"]) for r in work.moved(t, spark.createDataFrame([m], "id long, target string, sibling long")).collect()}[m[0]]

    assert move(3, "top", None)[0] < "a" and move(1, "top", None)[0] < "c" and "e" < move(1, "bottom", None)[0] and "c" < move(3, "bottom", None)[0]
    assert "c" < move(1, "after", 2)[0] < "e" and "c" < move(3, "after", 2)[0] and "a" < move(3, "before", 2)[0] < "c" and move(1, "before", 2)[0] < "c"
    assert move(2, "after", 2) == ("c", None) and move(1, "after", 4) == (None, "sibling elsewhere") and move(1, "after", 99) == (None, "no such sibling")
    assert move(5, "top", None) == ("i", None)
    moves = spark.createDataFrame([(2, 1), (3, 1), (4, None), (6, 1), (5, 5)], "id long, parent_id long")
    got = {r["id"]: (r["parent_id"], r["seq"], r["child_seq"], r["order_key"]) for r in work.reparented(t, moves).collect()}
    assert got == {2: (1, None, 5, "000000000005"), 3: (1, None, 6, "000000000006"), 4: (None, 4, None, "000000000004")}


def test_below_a_loop(spark):
    t = spark.createDataFrame([(1, 2, 1, None), (2, 1, 1, None), (3, 1, None, None), (4, 1, 2, "x"), (5, 4, 1, None), (6, None, 1, None)], "id long, parent_id long, child_seq long, deleted_at string")
    roots = t.where("id IN (1, 6)").select("id")
    assert {(r["root"], r["id"], r["distance"]) for r in work.subtree(t, roots).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 2), (6, 6, 0)}
    assert [(r["id"], r["place"]) for r in work.descendants_in_order(t, roots).orderBy("place").collect()] == [(2, 1), (5, 2), (3, 3)]
    assert work.subtree(t, roots.limit(0)).count() == 0
    # Roots below roots, and on one loop.
    nested = t.where("id IN (1, 2, 4, 5)").select("id")
    got = {(r["root"], r["id"], r["distance"]) for r in work.subtree(t, nested).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 2), (2, 2, 0), (2, 1, 1), (2, 3, 2), (2, 4, 2), (2, 5, 3), (4, 4, 0), (4, 5, 1), (5, 5, 0)}
    assert [(r["id"], r["place"]) for r in work.descendants_in_order(t, nested).where("root = 1").orderBy("place").collect()] == [(2, 1), (5, 2), (3, 3)]


def test_labels_and_prefixes(spark):
    labels = spark.createDataFrame([(1, "b"), (2, "a")], "id long, slug string")
    links = spark.createDataFrame([(5, 1), (5, 2), (5, 2), (6, 3)], "task_id long, label_id long")
    assert ids(work.attached(labels, links), "slug") == ["a", "b"]
    assert records.attach(links.distinct(), links).count() == 3
    paths = spark.createDataFrame([("a/b/c.rs",), ("ab/c",), ("x",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("a",)], "root string")
    assert {r["path"]: r["root"] for r in work.longest_prefix(paths, "path", roots, "root").collect()} == {"a/b/c.rs": "a/b", "ab/c": None, "x": None}


def test_records(spark, tasks):
    ids_ = tasks.where("id IN (1, 5)").select("id")
    assert {r["id"]: r["deleted_at"] for r in records.soft_delete(tasks, ids_, "now").where("deleted_at IS NOT NULL").collect()} == {1: "now", 5: "x"}
    assert records.restore(tasks, ids_).where("deleted_at IS NOT NULL").count() == 0
    assert records.delete(tasks, ids_, "id").count() == 5
    changed = records.upsert(tasks, tasks.where("id = 1").withColumn("title", F.lit("new")), ["id"])
    assert changed.count() == 7 and changed.where("title = 'new'").count() == 1
    assert ids(records.duplicates(tasks, ["priority"]), "priority") == [1]
    moves = spark.createDataFrame([(1, 6), (3, 2)], "id long, parent_id long")
    assert ids(records.would_loop(tasks, moves.where("id = 1"))) == [1] and records.would_loop(tasks, moves.where("id = 3")).count() == 0


def test_coverage(spark):
    files = spark.createDataFrame([(f"src/api/f{i}.rs",) for i in range(6)] + [(f"src/ui/g{i}.rs",) for i in range(3)] + [("map/m.rs",)], "path string")
    roots = spark.createDataFrame([("map",)], "root string")
    assert {r["dir"]: r["files"] for r in coverage.directory_counts(files).collect()} == {"": 10, "src": 9, "src/api": 6, "src/ui": 3, "map": 1}
    assert [tuple(r) for r in coverage.gaps(files, roots).collect()] == [("src", 9)]
    assert [tuple(r) for r in coverage.gaps(files, spark.createDataFrame([("src/ui",)], "root string")).collect()] == [("src/api", 6)]
    assert coverage.gaps(files, spark.createDataFrame([("",)], "root string")).count() == 0
    texts = [("a/CODEMAP.md", "---\ndomain: d\nroot: src\nowner: ''\n---\n# x"), ("b/CODEMAP.md", "---\nroot: gone\ndomain: e\ncommit: c1\n---"), ("c/CODEMAP.md", "none"), ("d/CODEMAP.md", "---\nowner: x\n---"), ("e/CODEMAP.md", "---\ndomain: f\nroot: ../x\n"), ("f/CODEMAP.md", "---\ndomain: f\nroot: ../x\ncommit: c9\n---"), ("g", None)]
    maps = coverage.codemaps(spark.createDataFrame(texts, "path string, text string"), "text")
    got = {r["path"]: (r["domain"], r["root"], r["owner"], r["problem"]) for r in maps.collect()}
    assert got["a/CODEMAP.md"] == ("d", "src", None, None) and got["c/CODEMAP.md"][3] == "no frontmatter" and got["d/CODEMAP.md"][3] == "no domain" and got["e/CODEMAP.md"][3] == "unterminated frontmatter"
    good = maps.where("problem IS NULL")
    dirs = spark.createDataFrame([("src",)], "dir string")
    assert {r["path"]: r["reason"] for r in coverage.dangling(good, dirs).collect()} == {"b/CODEMAP.md": coverage.GONE, "f/CODEMAP.md": coverage.OUTSIDE}
    commits = spark.createDataFrame([(1, "c1", "gone/a", "A"), (1, "c1", "gone/t", "T"), (2, "c2", "gone/b", "B"), (2, "c2", "gone/t", "U"), (2, "c2", "gone/CODEMAP.md", "M"), (3, "c3", "src/x", "X"), (4, "c4", "gone/t", "T"), (5, "c5", None, None)], "seq int, id string, path string, blob string")
    assert {r["path"]: (r["state"], r["distance"], r["sample"]) for r in coverage.stale(good, commits).collect()} == {"a/CODEMAP.md": ("unverifiable", 0, None), "b/CODEMAP.md": ("stale", 4, ["gone/b"]), "f/CODEMAP.md": ("unverifiable", 0, None)}
    assert "| d | src |" in coverage.index_text(good, maps.where("problem IS NOT NULL"), coverage.gaps(files, roots)).first()["text"]
    assert coverage.git_commits("/nonexistent") == []


DOCS = [("a.md", "docs", "On observation", "the observers observe one thing. Then much later in this long text, after a great many words, observing again."), ("b.rs", "code", "b", "fn observe() {}"), ("c.md", "docs", "Nothing", "other words, thing"), ("d.md", "docs", None, None), ("e.md", "docs", "é", "Café thing thing")]


def test_search_as_sqlite(spark):
    docs = spark.createDataFrame(DOCS, "path string, kind string, title string, body string")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, title, body, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(p, t or "", b or "") for p, _, t, b in DOCS])
    for needle in ("observing", "thing", "thing observe", "cafe", "none", "OBSERVE* NOT ("):
        got = {r["path"]: r["score"] for r in search.search(docs, needle, "path", text).collect()}
        match = " ".join(f'"{w}"' for w in search.WORD.findall(needle))
        want = {p: s for p, s in con.execute("SELECT path, -bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got), needle
    assert search.search(docs, "?!", "path", text).count() == 0
    assert ids(search.search(docs, "observe", "path", text, kind="code"), "path") == ["b.rs"] and ids(search.search(docs, "thing", "path", text, prefix="E.", limit=5), "path") == []
    snippet = search.with_snippets(search.search(docs, "observe", "path", text, kind="docs"), "body", "observe").first()["snippet"]
    assert "«observers» «observe»" in snippet and snippet.endswith(search.GAP)
    index = search.postings(docs, "path", text)
    sizes = docs.select("path", F.size(search.terms(text)).alias("tokens"))
    assert {r["path"]: round(r["score"], 9) for r in search.query_index(index, sizes, "thing observe", "path").collect()} == {r["path"]: round(r["score"], 9) for r in search.search(docs, "thing observe", "path", text).collect()}
    assert search.search(docs.limit(0), "thing", "path", text).count() == 0


def test_sync(spark):
    docs = spark.createDataFrame([("a", 1, 5, "one"), ("b", 2, 5, "two"), ("c", 1, 1, "three")], "path string, mtime long, size long, body string")
    manifest = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("z", 1, 1)], "path string, mtime long, size long")
    index = spark.createDataFrame([("one", "a", 1), ("old", "b", 1), ("gone", "z", 1)], "term string, path string, tf long")
    new, listed, counts = search.sync(index, docs, manifest, "path", F.col("body"))
    assert {(r["term"], r["path"]) for r in new.collect()} == {("one", "a"), ("two", "b"), ("three", "c")}
    assert {r["action"]: r["files"] for r in counts.collect()} == {"unchanged": 1, "updated": 1, "added": 1, "removed": 1}
    again = search.sync(new, docs, listed, "path", F.col("body"))[2]
    assert {r["action"]: r["files"] for r in again.collect()} == {"unchanged": 3}
    sized = spark.createDataFrame([("a.md", 262_144), ("b.md", 262_145), ("c.json", 1)], "path string, size long")
    assert ids(search.indexable(sized), "path") == ["a.md"]


def test_editor_and_sql(spark):
    files = spark.createDataFrame([("a.md", "# A\nsee [b](b.md#Part) now\n"), ("b.md", "# B\n\n## Part\ntext")], "path string, content string")
    parsed = markdown.parse_files(files)
    heads, links = markdown.headings(parsed), markdown.links(parsed)
    assert [tuple(r) for r in editor.definition_at(links, heads, "a.md", 2, 8).collect()] == [("b.md", 3)]
    assert editor.definition_at(links, heads, "a.md", 2, 1).count() == 0
    assert ids(editor.complete_files(files, "b", wikilink=True), "label") == ["b"] and ids(editor.complete_headings(heads, "b.md", "Pa"), "anchor") == ["part"]
    assert {(r["path"], r["anchor"]): r["text"] for r in editor.previews(parsed, heads, 7).collect()}["b.md", "part"] == "## Part..."
    buffer = spark.createDataFrame([("a.md", "# New\n[x](#new) [y](#a) [z](b.md#Part)")], "path string, content string")
    assert ids(editor.diagnostics(buffer, files, heads), "raw") == ["[y](#a)"]
    register(spark)
    assert spark.sql("SELECT index_term('relational') AS t").first()["t"] == "relat"
    assert spark.sql("SELECT * FROM markdown_headings('# A\n## B')").count() == 2
    assert [tuple(r)[:3] for r in spark.sql("SELECT * FROM code_symbols('a.py', 'def f():\n    pass')").collect()] == [("f", None, "fn")]


def test_all_nodes_are_reached_however_far(spark):
    from tessellar.operators.linkgraph import reach

    n = 104
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)] + [(f"n{n}", "n3"), ("n7", "n7"), (None, "n1"), ("n2", None)], "source string, target string")
    got = [(r["node"], r["steps"]) for r in reach(edges, spark.createDataFrame([("n0",), ("n0",)], "node string")).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(f"n{i}", i) for i in range(n + 1)]
