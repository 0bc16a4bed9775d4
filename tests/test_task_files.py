"""Task files, their faults, and which are new."""

from __future__ import annotations

from tessellar.operators.linkgraph import selected_section
from tessellar.sources.task_files import task_files, tasks_to_add

FILES = {
    "p/T-0001.md": "---\nid: AB-7\ntitle: 'One: two'\nstatus: open\npriority: high\n---\n\n# One\n\nbody\n",
    "p/T-0002.md": "---\r\ntitle: Two\r\n---\r\n", "p/T-0003.md": "none", "p/T-0004.md": "---\ntitle: x", "p/T-0005.md": "---\nstatus: x\n---", "p/notes.md": "---\ntitle: n\n---", "q/T-0007.md": "---\ntitle: again\n---", "p/T-0006.md": None,
}


def test_task_files(spark):
    got = {r["path"]: r for r in task_files(spark.createDataFrame(list(FILES.items()), "path string, content string")).collect()}
    assert set(got) == set(FILES) - {"p/notes.md"}
    assert tuple(got["p/T-0001.md"])[1:] == (7, "One: two", "open", "high", "body", None) and tuple(got["p/T-0002.md"])[1:] == (2, "Two", None, None, None, None)
    assert [got[f"p/T-000{i}.md"]["problem"] for i in (3, 4, 5, 6)] == ["no frontmatter", "unterminated frontmatter", "no title", "no frontmatter"]
    parsed = task_files(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    new = tasks_to_add(parsed, spark.createDataFrame([(2,), (None,)], "seq long"))
    assert [(r["seq"], r["path"]) for r in new.collect()] == [(7, "p/T-0001.md")]


def test_selected_section(spark):
    rows = spark.createDataFrame([("a", 1, "X", "x", 1, 1), ("a", 2, "X", "x", 2, 5), ("b", 1, "Y", "y", 1, 1)], "path string, pos int, title string, anchor string, level int, line int")
    assert [(r["path"], r["line"]) for r in selected_section(rows, " #X ").collect()] == [("a", 1)]
