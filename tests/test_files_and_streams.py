"""File tables, written headers, boards, and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessellar.operators import boards, headers
from tessellar.operators.work import top_per_group
from tessellar.sources import files
from tessellar.streaming import changes


@pytest.fixture
def tree(tmp_path):
    for path, text in {"src/a.rs": "fn a() {}\n", "src/b/c.py": "def c():\n    pass\n", "docs/x.md": "# X\n", ".workspace/ignore": "node_modules\n", ".gitignore": "/out\n", "node_modules/y.js": "", "out/z.js": "", "e.txt": "é"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe")
    return tmp_path


def test_read_and_tree(spark, tree):
    ignores = files.workspace_ignores(str(tree))
    assert ignores == ["**/node_modules"]
    listed = {r["path"]: r for r in files.read_files(spark, str(tree), [*ignores, "out"]).collect()}
    table = files.walk_files(spark, str(tree), ignores).cache()
    assert {r["path"]: r for r in table.where("path NOT RLIKE '(^|/)[.]'").collect()} == listed
    got = {r["path"]: r for r in table.collect()}
    assert set(got) == {"src/a.rs", "src/b/c.py", "docs/x.md", ".workspace/ignore", ".gitignore", "e.txt", "bin.dat"}
    assert got["e.txt"]["content"] == "é" and got["e.txt"]["size"] == 2 and got["bin.dat"]["content"] is None and got["e.txt"]["mtime"] > 0
    assert [r["path"] for r in files.expand(table, ["src", "e.txt"]).collect()] == ["e.txt", "src/a.rs", "src/b/c.py"]
    assert files.markdown_files(table).count() == 1 and files.code_files(table).count() == 2
    assert [r["path"] for r in files.tree(table).collect()] == ["docs", "docs/x.md", "src", "src/b", "src/b/c.py", "src/a.rs", "bin.dat", "e.txt"]
    assert [r["path"] for r in files.tree(table, depth=1, dirs_only=True).collect()] == ["docs", "src"]
    assert [r["path"] for r in files.tree(table, "src", pattern="*.py").collect()] == ["src/b", "src/b/c.py"]
    assert [r["path"] for r in files.tree(table, ignore="src|*.md|bin.dat", hidden=True).collect()] == [".workspace", ".workspace/ignore", "docs", ".gitignore", "e.txt"]


def test_ignore_files_of_every_folder(spark, tmp_path):
    texts = {
        ".gitignore": "*.log\n/top.txt\ncache/\n!keep.log\n# no rule\n", "a.log": "", "keep.log": "", "top.txt": "", "sub/top.txt": "", "sub/cache/x.py": "", "cache": "a file", "sub/.gitignore": "!b.log\nonly/here.md\nkeep.log\n",
        "sub/b.log": "", "sub/keep.log": "", "sub/only/here.md": "", "sub/deep/only/here.md": "", "sub/deep/.ignore": "*.md\n!c.log", "sub/deep/d.md": "", "sub/deep/c.log": "",
    }
    for path, text in texts.items():
        p = tmp_path / "w" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text) if path != "cache" else None
    (tmp_path / "w" / "cache").write_text("a file")

    def walked(root):
        return {r["path"] for r in files.walk_files(spark, str(root), [], 1).collect() if not r["path"].rpartition("/")[2].startswith(".")}

    assert walked(tmp_path / "w") == {"keep.log", "sub/top.txt", "cache", "sub/b.log", "sub/deep/c.log"}
    # The files above count up to the folder of the repository, and only where there is one.
    assert walked(tmp_path / "w" / "sub" / "deep") == {"c.log"}
    (tmp_path / "w" / ".git").mkdir()
    (tmp_path / "w" / "sub" / "deep" / "z.log").write_text("")
    (tmp_path / "w" / "sub" / "deep" / "b.log").write_text("")
    assert walked(tmp_path / "w" / "sub" / "deep") == {"c.log", "b.log"}


def test_headers():
    source = "use a::b;\nuse c::{\n    d,\n};\n\npub struct User {}\nimpl User {\n    pub fn name(&self) {}\n}\n"
    text, warning = headers.write_index(source, "src/lib.rs")
    assert warning is None
    lines = text.split("\n")
    assert lines[4].startswith("// ---") and lines[5:7] == ["// src/lib.rs", "//"] and lines[7].endswith("L13") and "  pub fn name()" in lines[8] and lines[8].endswith("L15")
    assert lines[12] == "pub struct User {}" and lines[14].strip() == "pub fn name(&self) {}"
    assert headers.write_index(text, "src/lib.rs") == (text, None)
    moved, _ = headers.write_index(text, "src/other.rs")
    assert moved.count("// ---") == 2 and "// src/other.rs" in moved and "lib.rs" not in moved
    crlf, _ = headers.write_index("x = 1\r\n", "a.py")
    assert crlf.count("\r\n") == crlf.count("\n") and "# a.py" in crlf
    none, _ = headers.write_index("", "a.go")
    assert none.startswith("// a.go\n//\n")
    doc, _ = headers.write_outline("# One\n\n## Two `x`\n", "d/a.md")
    assert doc.startswith("---\npath: d/a.md\noutline: |\n  • One") and headers.write_outline(doc, "d/a.md")[0] == doc
    lines = doc.split("\n")
    assert lines[int(lines[3].rsplit("L", 1)[1]) - 1] == "# One" and lines[int(lines[4].rsplit("L", 1)[1]) - 1] == "## Two `x`"
    assert headers.write_outline("---\ntitle: x\n---\n# A\n", "a.md") == (None, "frontmatter has other keys")
    forced, _ = headers.write_outline("---\ntitle: x\n---\n# A\n", "a.md", force=True)
    assert forced.startswith("---\ntitle: x\npath: a.md\n")


def test_format(spark, tree):
    table = files.read_files(spark, str(tree), [*files.workspace_ignores(str(tree)), "out"])
    assert files.write_changed(headers.format_files(table), str(tree)) == 3
    again = headers.format_files(files.read_files(spark, str(tree), [*files.workspace_ignores(str(tree)), "out"]))
    assert {(r["path"], r["changed"]) for r in again.collect()} == {("src/a.rs", False), ("src/b/c.py", False), ("docs/x.md", False)}


def test_boards(spark, tmp_path):
    tasks = spark.createDataFrame([(i, 1, "AB", i, f"t|{i}", 3, "open" if i % 2 else "done", "\nbody") for i in range(1, 8)], "id long, project_id long, owner_alias string, seq long, title string, priority long, status string, body string")
    statuses = spark.createDataFrame([("open", "Open", 0, False, False), ("done", "Done", 1, True, True), ("parked", "Parked", 2, True, False)], "slug string, name string, sort_order int, is_closed boolean, is_hidden boolean")
    top = top_per_group(tasks, ["project_id", "status"], ["seq"], 3)
    (row,) = boards.boards(top, statuses, "project_id").collect()
    assert "## Open (top 3 of 4)" in row["text"] and "| [AB-0001](T-0001.md) | t\\|1 | 3 |" in row["text"] and "## Done (3)\n\n## Parked (0)\n\n_(none)_" in row["text"]
    subs = boards.task_rows(tasks.where("id = 2").selectExpr("*", "1 AS parent_id", "1 AS place"), F.lit(False))
    pages = boards.task_pages(top.where("status = 'open'"), subs, "project_id")
    (tmp_path / "T-0099.md").write_text("old")
    (tmp_path / "TODO.md").write_text("mine")
    assert boards.write_pages(pages, str(tmp_path)) == ["T-0099.md"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["T-0001.md", "T-0003.md", "T-0005.md", "TODO.md"]
    assert "## Subtasks (1)" in (tmp_path / "T-0001.md").read_text()


def test_streams(spark, tmp_path):
    def feed(name, rows):
        spark.createDataFrame(rows, "doc long, version long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    feed("a", [(1, 1, "one fox"), (2, 1, "two"), (1, 3, "three foxes")])
    stream = spark.readStream.schema("doc long, version long, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = changes.latest_stream(stream, "doc", "version", "text")
    query = got.writeStream.outputMode("update").format("memory").queryName("latest_docs").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("latest_docs").collect()} == {(1, 3, "three foxes"), (2, 1, "two")}
    from tessellar.operators.incremental import VersionedTarget

    for name, rows in (("b", [(3, 1, "fox")]), ("c", [(1, 4, "none")])):
        changes.keep_index(stream, str(tmp_path / "index"), "doc", "version", lambda: F.col("text"), str(tmp_path / "cp2")).awaitTermination(60)
        feed(name, rows)
    changes.keep_index(stream, str(tmp_path / "index"), "doc", "version", lambda: F.col("text"), str(tmp_path / "cp2")).awaitTermination(60)
    index = VersionedTarget(spark, str(tmp_path / "index")).read()
    assert {(r["term"], r["doc"]) for r in index.collect()} == {("two", 2), ("fox", 3), ("none", 1)}
    events = spark.readStream.schema("doc long, version long, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds(F.col("version") * 3600))
    counts = changes.windowed_counts(events, "at", ["doc"], "2 hours", "1 hour")
    q = counts.writeStream.outputMode("update").format("memory").queryName("window_counts").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("window_counts").agg(F.sum("events")).first()[0] == 5
