"""Queries over ``tasks.body`` and ``hits.snippet``: markup (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.markup import clean_text, parse_paths, path_ratios, with_markup
from tessellar.sources.tables import table

KEYS = ["ref_table", "row_id"]


def marked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(ref_table, row_id, text) of all bodies and snippets."""
    tasks = table(spark, sf, "tasks").select(F.lit("tasks").alias("ref_table"), F.col("id").alias("row_id"), F.col("body").alias("text"))
    hits = table(spark, sf, "hits").select(F.lit("hits").alias("ref_table"), F.col("hit_id").alias("row_id"), F.col("snippet").alias("text"))
    return tasks.unionByName(hits)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows with a node on a path of markup. Repeated ones count once: only keys and paths are compared, the texts are not moved."""
    return with_markup(marked_texts(spark, sf), KEYS, "text")


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every body and snippet as clean text."""
    return clean_text(marked_texts(spark, sf).distinct(), KEYS, "text")


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The ratios of every tag path, and which are content."""
    return path_ratios(parse_paths(marked_texts(spark, sf).distinct(), KEYS, "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_paths)}
SQL: dict[str, str] = {}
