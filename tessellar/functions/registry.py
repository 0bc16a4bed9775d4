"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessellar.functions.order_keys import order_between
from tessellar.functions.stemming import index_terms


class MarkdownHeadings:
    """One row for each heading of a text."""

    def eval(self, text: str):
        from tessellar.operators.markdown import parse

        for _, raw, level, line, _ in parse(text or "").headings:
            yield raw, level, line


class CodeSymbols:
    """One row for each symbol of a source file."""

    def eval(self, path: str, source: str):
        from tessellar.operators.code.facts import facts_of, language_of

        if path and language_of(path):
            for name, parent, kind, _, line, end, public, _ in facts_of(path, source or "", language_of(path)).symbols:
                yield name, parent, kind, line, end, public


def register(spark: SparkSession) -> None:
    """Makes index_term(word), order_between(before, after), markdown_headings(text) and code_symbols(path, source) known to SQL."""
    spark.udf.register("index_term", index_terms)
    spark.udf.register("order_between", order_between)
    spark.udtf.register("markdown_headings", udtf(MarkdownHeadings, returnType="raw string, level int, line int"))
    spark.udtf.register("code_symbols", udtf(CodeSymbols, returnType="name string, parent string, kind string, line int, end_line int, is_public boolean"))
