"""Task files (T-0001.md) as rows: frontmatter and body parsed, faulty files told apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions.paths import file_name

NAME = r"^T-(\d+)\.md$"
ROWS = "path string, seq long, title string, status string, priority string, body string, problem string"


def unquote(text: str) -> str:
    """A scalar without the quotes around it."""
    t = text.strip()
    return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"" else t


def parse(path: str, content: str | None) -> tuple:
    """(seq, title, status, priority, body, problem) of one file; simple ``key: value`` lines between --- lines."""
    lines = (content or "").replace("\r\n", "\n").split("\n")
    if content is None or lines[0].strip() != "---":
        return None, None, None, None, None, "no frontmatter"
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if end is None:
        return None, None, None, None, None, "unterminated frontmatter"
    values = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon and not line.startswith((" ", "\t", "#")):
            values[key.strip()] = unquote(value)
    number = re.search(r"(\d+)\s*$", values.get("id", "")) or re.match(NAME, path.rpartition("/")[2])
    seq = int(number[1]) if number else None
    if seq is None or seq < 1:
        return None, None, None, None, None, "no number"
    if not values.get("title"):
        return seq, None, None, None, None, "no title"
    body = lines[end + 1 :]
    while body and not body[0].strip():
        body.pop(0)
    # The heading repeats the title.
    if body and re.match(r"#\s", body[0]):
        body.pop(0)
    text = "\n".join(body).strip("\n")
    return seq, values["title"], values.get("status") or None, values.get("priority") or None, text or None, None


def task_files(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, seq, title, status, priority, body, problem) of every task file by its name; ``problem`` says why a file gives no task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(p, *parse(p, c)) for p, c in frame.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["path", "seq", "title", "status", "priority", "body", "problem"], dtype=object)
            yield out

    return files.where(file_name("path").rlike(NAME)).select("path", content).mapInPandas(run, ROWS).orderBy("path")


def tasks_to_add(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """Parsed tasks whose number is not there yet (``existing``: seq); of several files of a number the first path counts."""
    good = parsed.where("problem IS NULL").groupBy("seq").agg(F.min_by(F.struct("path", "title", "status", "priority", "body"), "path").alias("t")).select("seq", "t.*")
    return good.join(existing.select("seq").where("seq IS NOT NULL").distinct(), "seq", "left_anti")
