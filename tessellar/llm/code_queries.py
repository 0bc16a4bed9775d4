"""Queries over ``symbol_rows`` and ``code_files``: documented functions (2) and files that do not parse (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellar.llm.documented import documented, documented_rows
from tessellar.llm.parsing import fault_rates, file_faults
from tessellar.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return documented_rows(table(spark, sf, "symbol_rows")).select("sym_id").distinct()


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Description and code of every documented function."""
    return documented(table(spark, sf, "symbol_rows"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return file_faults(table(spark, sf, "code_files")).where("fault IS NOT NULL").select("file_id").distinct()


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Files that do not parse, per repository and language."""
    files = table(spark, sf, "code_files")
    return fault_rates(files, file_faults(files))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_rates)}
SQL: dict[str, str] = {}
