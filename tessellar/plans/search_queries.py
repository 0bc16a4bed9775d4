"""Queries of full-text search over ``documents``, and of its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.text import terms
from tessellar.operators import linkgraph, search
from tessellar.sources.tables import table

NEEDLE = "marker snapshot"


def text() -> F.Column:
    """What is searched of a document."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "path", "kind", "title", "text")


def scored(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "path", F.round("score", 6).alias("score"))


def search_bm25_topk(spark, sf):
    return scored(search.search(docs(spark, sf), NEEDLE, "doc_id", text(), stemmed=False))


def search_all_hits(spark, sf):
    return scored(search.search(docs(spark, sf), NEEDLE, "doc_id", text(), stemmed=False, limit=None))


def search_scoped(spark, sf):
    """Runbooks under one directory only; the statistics are those of all documents."""
    return scored(search.search(docs(spark, sf), "daemon", "doc_id", text(), kind="runbook", prefix="Notes", stemmed=False))


def search_stemmed(spark, sf):
    return scored(search.search(docs(spark, sf), "archives windows", "doc_id", text()))


def search_snippet(spark, sf):
    hits = search.search(docs(spark, sf), "archives windows", "doc_id", text())
    return search.with_snippets(hits, "text", "archives windows").select("doc_id", F.round("score", 6).alias("score"), "snippet")


def tokenize_terms(spark, sf):
    """Words and different words of every document."""
    return docs(spark, sf).select("doc_id", F.size(terms(text())).alias("words"), F.size(F.array_distinct(terms(text()))).alias("different"))


def postings(spark, sf):
    return search.postings(docs(spark, sf), "doc_id", text(), stemmed=False)


def stemmed_dictionary(spark, sf):
    """How many documents hold each stem."""
    return search.document_frequencies(search.postings(docs(spark, sf), "doc_id", text()))


def df_corpus_stats(spark, sf):
    return search.corpus_stats(docs(spark, sf), text()).select("documents", "tokens", F.round("average", 6).alias("average"))


def document_frequencies(spark, sf):
    return search.document_frequencies(search.postings(docs(spark, sf), "doc_id", text(), stemmed=False))


def manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What is there (documents with a text, their time and size) and what was noted of them (the size that came with them)."""
    rows = table(spark, sf, "documents")
    now = rows.where("text IS NOT NULL").select("path", "mtime", F.length("text").cast("long").alias("size"))
    return now, rows.where("n_chars IS NOT NULL").select("path", "mtime", F.col("n_chars").cast("long").alias("size"))


def sync_diff(spark, sf):
    return search.sync_actions(*manifests(spark, sf)).select("path", "action")


def sync_counts(spark, sf):
    return search.sync_counts(search.sync_actions(*manifests(spark, sf)))


def line_context(spark, sf):
    """One line around the first line of every document that names a heading."""
    first = linkgraph.first_matches(docs(spark, sf), "text", ["## known limits"])
    return linkgraph.context_lines(docs(spark, sf), "text", first, 1)


def first_match_line(spark, sf):
    return linkgraph.first_matches(docs(spark, sf), "text", ["daemon", "worker"])


QUERIES = {f.__name__: f for f in (search_bm25_topk, search_all_hits, search_scoped, search_stemmed, search_snippet, tokenize_terms, postings, stemmed_dictionary, df_corpus_stats, document_frequencies, sync_diff, sync_counts, line_context, first_match_line)}

W = "w AS (SELECT doc_id, path, kind, text, list_filter(regexp_split_to_array(lower(coalesce(title, '') || chr(10) || coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents)"


def bm25(needles: list[str], filters: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(ws, lambda x: x = '{n}')) AS tf{i}" for i, n in enumerate(needles))
    idf = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(needles)))
    part = " + ".join(
        f"(CASE WHEN ln((s.n - s.n{i} + 0.5) / (s.n{i} + 0.5)) > 0 THEN ln((s.n - s.n{i} + 0.5) / (s.n{i} + 0.5)) ELSE 1e-6 END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / s.a))" for i in range(len(needles))
    )
    every = " AND ".join(f"tf{i} > 0" for i in range(len(needles)))
    return f"WITH {W}, c AS (SELECT doc_id, path, kind, len(ws) AS dl, {tf} FROM w), s AS (SELECT count(*) AS n, avg(dl) AS a, {idf} FROM c) SELECT doc_id, path, round({part}, 6) AS score FROM c, s WHERE {every} AND {filters}"


LINES = "ls AS (SELECT path, string_split(text, chr(10)) AS t, range(1, len(string_split(text, chr(10))) + 1) AS ks FROM documents WHERE text IS NOT NULL)"

M = (
    "WITH now AS (SELECT path, max((mtime, CAST(length(text) AS BIGINT))) AS v FROM documents WHERE text IS NOT NULL GROUP BY path),"
    " old AS (SELECT path, max((mtime, CAST(n_chars AS BIGINT))) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY path),"
    " a AS (SELECT coalesce(now.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' WHEN now.v IS NOT DISTINCT FROM old.v THEN 'unchanged' ELSE 'updated' END AS action FROM now FULL JOIN old ON old.path = now.path)"
)

SQL = {
    "search_bm25_topk": bm25(NEEDLE.split()) + " ORDER BY score DESC, doc_id LIMIT 20",
    "search_all_hits": bm25(NEEDLE.split()),
    "search_scoped": bm25(["daemon"], "kind = 'runbook' AND lower(path) LIKE 'notes/%'") + " ORDER BY score DESC, doc_id LIMIT 20",
    "tokenize_terms": f"WITH {W} SELECT doc_id, CAST(len(ws) AS INTEGER) AS words, CAST(len(list_distinct(ws)) AS INTEGER) AS different FROM w",
    "postings": f"WITH {W} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY ALL",
    "df_corpus_stats": f"WITH {W} SELECT count(*) AS documents, CAST(sum(len(ws)) AS BIGINT) AS tokens, round(avg(len(ws)), 6) AS average FROM w",
    "document_frequencies": f"WITH {W} SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY ALL",
    "sync_diff": M + " SELECT path, action FROM a",
    "sync_counts": M + " SELECT action, count(*) AS files FROM a GROUP BY action",
    "first_match_line": f"WITH {LINES}, e AS (SELECT path, unnest(t) AS s, unnest(ks) AS k FROM ls) SELECT path, CAST(min(k) AS INTEGER) AS line FROM e WHERE contains(lower(s), 'daemon') OR contains(lower(s), 'worker') GROUP BY path",
    "line_context": f"WITH {LINES}, e AS (SELECT path, unnest(t) AS s, unnest(ks) AS k FROM ls), m AS (SELECT path, min(k) AS k FROM e WHERE contains(lower(s), '## known limits') GROUP BY path)"
    " SELECT e.path, CAST(m.k AS INTEGER) AS hit_line, CAST(e.k AS INTEGER) AS line, e.k = m.k AS marked, e.s AS text FROM m JOIN e ON e.path = m.path AND e.k BETWEEN m.k - 1 AND m.k + 1",
}
