"""Queries over ``documents``: containers (7), leaked evaluation texts (8) and look-alike characters (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.containers import fill_containers, fill_report
from tessellar.llm.leaks import leaked_spans, leaks, removal_spans
from tessellar.llm.visual_forms import consistent_form, look_alike_pairs, look_classes
from tessellar.sources.tables import table

# Problem 7


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's containers for each capacity."""
    return fill_containers(table(spark, sf, "documents"), table(spark, sf, "container_sizes"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "container_sizes")
    return fill_report(fill_containers(table(spark, sf, "documents"), sizes), sizes)


# Problem 8


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_removal_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The word spans to cut out of each document."""
    return removal_spans(leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items")))


# Problem 9


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf, "documents"))


def p9_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its text in the one consistent form."""
    return consistent_form(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("consistent").alias("text"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return look_classes(table(spark, sf, "documents"))


# The look-alike letters the SQL knows, pairwise. They are written out here, apart from the operator's own table.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеорсхуѕіјһԁԛԝӏ", "ABESIJKMHOPCTXaeopcxysijhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))


def sql_form(column: str) -> str:
    """The consistent form in SQL, as far as these tables' characters go, all in Latin letters."""
    wide = [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    spaces = [(chr(c), " ") for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
    alike = [*CYRILLIC.items(), *GREEK.items(), ("K", "K")]
    gone = [chr(c) for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)]
    pairs = wide + spaces + alike
    old, new = "".join(a for a, _ in pairs) + "".join(gone), "".join(b for _, b in pairs).replace("'", "''")
    form = f"replace(replace({column}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"nfc_normalize(translate({form}, '{old}', '{new}'))"


def sql_words(key: str, name: str) -> str:
    return f"SELECT {key} AS k, regexp_extract_all(lower({sql_form('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name} WHERE text <> ''"


QUERIES = {f.__name__: f for f in (p7_containers, p7_report, p8_found, p8_removal_spans, p9_found, p9_consistent, p9_classes)}

SQL = {
    "p8_found": f"""
WITH d AS ({sql_words("doc_id", "documents")}), i AS ({sql_words("item_id", "eval_items")}),
grams AS (SELECT DISTINCT k AS item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) > 11)),
places AS (SELECT k AS doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) > 11))
SELECT DISTINCT doc_id, item_id FROM places JOIN grams USING (g)""",
    "p8_removal_spans": f"""
WITH d AS ({sql_words("doc_id", "documents")}), i AS ({sql_words("item_id", "eval_items")}),
grams AS (SELECT DISTINCT array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) > 11)),
places AS (SELECT k AS doc_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) > 11)),
hits AS (SELECT DISTINCT doc_id, p FROM places JOIN grams USING (g)),
fresh AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 12 THEN 0 ELSE 1 END AS f FROM hits),
spans AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM fresh)
SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS first_word, CAST(max(p) + 10 AS BIGINT) AS last_word FROM spans GROUP BY doc_id, n""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, text, {sql_form("text")} AS look FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p9_classes": f"""
WITH d AS (SELECT doc_id, text, {sql_form("text")} AS look FROM documents WHERE text <> ''),
c AS (SELECT look, min(doc_id) AS class_id, count(*) AS documents, count(DISTINCT text) AS texts FROM d GROUP BY look)
SELECT doc_id, class_id, documents, texts FROM d JOIN c USING (look)""",
}
