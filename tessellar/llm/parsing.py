"""Source files that do not parse, flagged per file, with rates per repository and language.

A file is cut into chunks at line ends; each chunk is summed up as a map from the lexer states it
may start in to what it does to modes and brackets, and the maps of a file are merged pairwise. A
file whose brackets and literals balance is then read by the grammar of its language.
"""

from __future__ import annotations

import ast
import keyword
import pickle
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.syntax import go, rust, script
from tessellar.llm.syntax.lexing import CODE, PAIRS, PYTHON, Chunk, Chunks, Fault, finish, merge, tokens_of

# The language of each extension.
LANGUAGES = {"rs": "rust", "py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx"}
#: Languages whose modes at line ends are all in the maps of the lexer, so that a fold that fails is a fault of the file.
BALANCED = ("rust", "go")
#: Characters of a chunk, and of a file from which its chunks are summed up by several tasks.
CHUNK, SPREAD = 4_096, 4_194_304
#: Nested brackets of Python that its parser reads at once; deeper ones are read from the inside out.
NESTED = 50


def language_of(path: str | None) -> str | None:
    """The language of a path's extension, in any case of letters."""
    return LANGUAGES.get(path.rpartition(".")[2].lower()) if path and "." in path else None


def prepare(source: str) -> str:
    """The text a grammar sees: without a byte-order mark or a first line with #!."""
    text = source[1:] if source.startswith("﻿") else source
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text.partition("\n")[1] + text.partition("\n")[2]
        return text[2:] if text.startswith("//\n") or text == "//" else text
    return text


def chunks_of(text: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of whole lines of about ``size`` characters."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.find("\n", end)
            end = len(text) if cut < 0 else cut + 1
        out.append(text[at:end])
        at = end
    return out


def read_python(text: str) -> None:
    """Reads a whole text of Python by its own parser; raises Fault. What the parser cannot hold at once is read in parts."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError) as e:
            if "too many nested" in str(e):
                read_parts(text)
            else:
                raise Fault(f"{type(e).__name__}: {str(e)[:100]}") from None
        except (RecursionError, MemoryError):
            read_parts(text)


def read_parts(text: str) -> None:
    """Reads brackets that nest deeply by themselves, innermost first, and the text with a name in their place; raises Fault."""
    #: For each open bracket: what stands before it, the text since then, and how deep brackets nest in that.
    before, since, height = "", [], 0
    outer: list[tuple[str, str, list[str], int]] = []
    for m in PYTHON.finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "open":
            outer.append((word, before, since, height))
            before, since, height = "", [], 0
        elif kind == "close":
            if not outer or PAIRS[word] != outer[-1][0]:
                raise Fault(f"{word} closes nothing of its kind")
            bracket, before, around, above = outer.pop()
            group = bracket + "".join(since) + word
            since, height = around, max(above, height + 1)
            if height > NESTED:
                applied = bracket != "{" and bool(before) and (before[-1] in ")]}\"'" or before.isidentifier() and not keyword.iskeyword(before))
                read_shallow(("f" if applied else "(") + group + ("" if applied else ")"))
                group, height = {"(": "()", "[": "[0]"}[bracket] if applied else " x ", above
            since.append(group)
            before = word
        else:
            since.append(word)
            if kind not in ("space", "line"):
                before = word
    if outer:
        raise Fault(f"{outer[-1][0]} is never closed")
    read_shallow("".join(since))


def read_shallow(text: str) -> None:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise Fault(f"{type(e).__name__}: {str(e)[:100]}") from None
    except (RecursionError, MemoryError):
        # Long without being nested: the parser gives up, which is no fault of the text.
        return


def read_grammar(text: str, language: str) -> None:
    """Reads a whole text by its language's grammar; raises Fault."""
    if language == "python":
        read_python(text)
        return
    tokens = tokens_of(text, language)
    # The grammars call themselves for each bracket; their frames are on the heap and bounded by the tokens.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + 40 * len(tokens.kinds)))
    if language == "rust":
        rust.check(tokens)
    elif language == "go":
        go.check(tokens)
    else:
        script.check(tokens, language != "javascript", language != "typescript")


def settle(whole: Chunk | Chunks, language: str) -> None:
    """The start of a file put to its chunks' map; raises Fault where a bracket or literal does not balance.

    A border inside a script's element, template or string hides what only the whole text tells, so
    there a fault of the map decides nothing and the grammar does.
    """
    summary = whole.run(CODE)
    if language in BALANCED:
        if summary.fault or summary.closed:
            raise Fault(summary.fault or f"{summary.closed[0]} closes nothing")
        finish(summary.mode, list(summary.opened))


def fault_of(source: str, language: str, size: int = CHUNK) -> str | None:
    """Why a text is not valid for a language, or None."""
    text = prepare(source)
    chunks = chunks_of(text, size)
    try:
        # Strings nested in Python's formatted strings may use their quotes again, so there only the parser decides.
        # The map of a file's only chunk has one start, and what it says of that is found while its tokens are read.
        if language != "python" and len(chunks) > 1:
            settle(merge([Chunk(c, language, not k) for k, c in enumerate(chunks)]), language)
        read_grammar(text, language)
    except Fault as e:
        return str(e)
    return None


FAULTS = "file_id {kind}, language string, fault string"


def file_faults(files: DataFrame, key: str = "file_id", chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(key, language, fault) of every file in a language with a grammar; ``fault`` is null where the source parses.

    ``files``: key, path, source. The language is that of the path's extension. A null source is an
    empty file, and empty files parse. Re-sent rows count once; files in other languages and null
    keys or paths give no row; other columns are not read. Every file is summed up chunk by chunk
    and its chunks merged, those of a file larger than ``spread`` by several tasks. Rust and Go files
    are read by the grammar only if they balance; of any other file the grammar alone decides
    whether it parses, whatever the chunks. Depth and length of a file are no fault.
    """
    kind = dict(files.dtypes)[key]
    some = files.where(F.col(key).isNotNull() & F.col("path").isNotNull()).select(F.col(key).alias("file_id"), "path", F.coalesce("source", F.lit("")).alias("source"))
    schema = FAULTS.format(kind=kind)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(i, lang, fault_of(s, lang, chunk)) for i, p, s in frame.itertuples(index=False) if (lang := language_of(p))]
            yield pd.DataFrame(rows, columns=["file_id", "language", "fault"], dtype=object)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i, p, s in frame.itertuples(index=False):
                if lang := language_of(p):
                    parts = chunks_of(prepare(s), max(chunk, spread // 16))
                    yield pd.DataFrame({"file_id": [i] * len(parts), "path": [p] * len(parts), "language": [lang] * len(parts), "chunk": range(len(parts)), "text": parts})

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            maps = []
            for t, lang, k in zip(frame["text"], frame["language"], frame["chunk"]):
                parts = [Chunk(c, lang, not k and not j) for j, c in enumerate(chunks_of(t, chunk))] if lang != "python" else []
                maps.append(pickle.dumps(merge(parts) if parts else None))
            yield frame.drop(columns="text").assign(map=maps)

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        language, fault = frame["language"].iloc[0], None
        try:
            if language != "python":
                settle(merge([pickle.loads(m) for m in frame["map"]]), language)
        except Fault as e:
            fault = str(e)
        return pd.DataFrame({"file_id": [frame["file_id"].iloc[0]], "language": [language], "fault": [fault]}, dtype=object)

    def grammar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(i, lang, f if isinstance(f, str) else fault_of(s, lang, len(s) + 1)) for i, lang, f, s in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["file_id", "language", "fault"], dtype=object)

    small = some.where(F.length("source") <= spread).mapInPandas(whole, schema)
    big = some.where(F.length("source") > spread).distinct()
    pieces = big.mapInPandas(split, f"file_id {kind}, path string, language string, chunk int, text string").repartition("file_id", "chunk")
    summed = pieces.mapInPandas(sum_up, f"file_id {kind}, path string, language string, chunk int, map binary")
    balanced = summed.groupBy("file_id", "path").applyInPandas(reduce, schema)
    large = balanced.join(big.select("file_id", "source"), "file_id").select("file_id", "language", "fault", "source").mapInPandas(grammar, schema)
    # Re-sent rows are told apart by their small results; the sources stay where they are.
    return small.unionByName(large).distinct().withColumnRenamed("file_id", key)


def fault_rates(files: DataFrame, faults: DataFrame, key: str = "file_id") -> DataFrame:
    """Per repository and language: files, those that do not parse, and their share."""
    named = faults.join(files.select(key, "repo").distinct(), key)
    counts = named.groupBy("repo", "language").agg(F.countDistinct(key).alias("files"), F.countDistinct(F.when(F.col("fault").isNotNull(), F.col(key))).alias("invalid"))
    return counts.withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))
