"""Heading anchors: slugs and the numbering of repeated headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The slug of a heading in which no letter or digit is left.
EMPTY_SLUG = "section"


def slug_anchor(text: Column | str) -> Column:
    """ASCII-lowered letters and digits, runs of blanks, ``-`` and ``_`` as one dash, everything else dropped."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.translate(c, UPPER, LOWER)
    c = F.regexp_replace(c, r"[^a-z0-9 \t\n\f\r_-]", "")
    c = F.regexp_replace(c, r"[ \t\n\f\r_-]+", "-")
    c = F.regexp_replace(c, r"^-+|-+$", "")
    return F.when(c == "", F.lit(EMPTY_SLUG)).otherwise(c)


def numbered_anchors(headings: DataFrame, file: str, order: list[str], base: str, out: str) -> DataFrame:
    """Adds ``out``: the base slug, with -1, -2 … for the repeats of a slug in its file, in the order given."""
    w = Window.partitionBy(file, base).orderBy(*order)
    k = F.row_number().over(w) - 1
    return headings.withColumn(out, F.when(k == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), k.cast("string"))))
