"""Changes of record tables as new table versions: insert, edit, upsert, delete, restore and cascades.

Tables are immutable DataFrames; every function gives the table after the change, to be written as a
new version (``VersionedTarget`` publishes one atomically). Checks come as DataFrames of violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.operators.forest import resolve_forest


def edit(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` taken over where they are not null; keys without change stay."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def clear(table: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the keys with the columns set to null."""
    marked = table.join(keys.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("__hit").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows put in, in place of those with the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def attach(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Links with those that are not there yet."""
    return links.unionByName(rows).distinct()


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def soft_delete(table: DataFrame, ids: DataFrame, at: str, column: str = "deleted_at") -> DataFrame:
    """Rows of the ids stamped; earlier stamps stay."""
    marked = table.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.select(*[F.when(F.col("__hit") & F.col(column).isNull(), F.lit(at)).otherwise(F.col(column)).alias(c) if c == column else F.col(c) for c in table.columns])


def restore(table: DataFrame, ids: DataFrame, column: str = "deleted_at") -> DataFrame:
    return clear(table, ids, "id", [column])


def rename_cascade(table: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """A table whose ``column`` follows the renames (old, new)."""
    joined = table.join(renames.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
    return joined.select(*[F.coalesce("__new", column).alias(c) if c == column else F.col(c) for c in table.columns])


def duplicates(table: DataFrame, columns: list[str]) -> DataFrame:
    """Values of a unique key (all parts non-null) that more than one row has."""
    whole = table.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)))
    return whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def would_loop(table: DataFrame, moves: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """The moves (key, parent) after which a node would lie on a loop or below one."""
    after = edit(table.select(key, parent), moves.select(key, parent), key)
    bad = resolve_forest(after, key, parent).where("root = -1").select(F.col("id").alias(key))
    return moves.join(bad, key, "left_semi")
