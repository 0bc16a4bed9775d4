"""Full-text search: an inverted index with stemmed terms, BM25, snippets, and its upkeep by manifest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.paths import MAX_INDEXED_BYTES, classify, like_prefix
from tessellar.functions.stemming import index_term, index_terms
from tessellar.functions.text import terms
from tessellar.session import cut

K1, B = 1.2, 0.75
#: Stands for the weight of a term that most documents hold.
LEAST_IDF = 1e-6
HIT_OPEN, HIT_CLOSE, GAP = "«", "»", " … "
WORD = re.compile(r"[^\W_]+")


def query_terms(needle: str) -> list[str]:
    """The stemmed words of a query, each once; punctuation and operators are nothing."""
    return list(dict.fromkeys(index_term(w) for w in WORD.findall(needle)))


def indexable(files: DataFrame, size: str = "size") -> DataFrame:
    """The files that are indexed, with their ``kind``: docs and code up to the size limit."""
    return files.withColumn("kind", classify("path")).where(F.col("kind").isNotNull() & (F.col(size) <= MAX_INDEXED_BYTES))


def postings(docs: DataFrame, key: str, text: Column, stemmed: bool = True) -> DataFrame:
    """(term, key, tf): how often a document holds a term. Words are stemmed once each, not once an occurrence."""
    raw = docs.select(key, F.explode(terms(text)).alias("word")).groupBy("word", key).agg(F.count(F.lit(1)).alias("tf"))
    if not stemmed:
        return raw.select(F.col("word").alias("term"), key, "tf")
    dictionary = raw.select("word").distinct().withColumn("term", index_terms("word"))
    return raw.join(dictionary, "word").groupBy("term", key).agg(F.sum("tf").alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """(documents, tokens, average): one row."""
    size = F.size(terms(text))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(size).cast("long").alias("tokens"), F.avg(size).alias("average"))


def idf(documents: int, holding: int) -> float:
    value = math.log((documents - holding + 0.5) / (holding + 0.5))
    return value if value > 0 else LEAST_IDF


def _one_of(words: list[str]):
    return lambda x: x.isin(words)


def search(docs: DataFrame, needle: str, key: str, text: Column, kind: str | None = None, prefix: str | None = None, limit: int | None = 20, stemmed: bool = True, path: str = "path") -> DataFrame:
    """``docs`` that hold every term of the query, with ``score`` (BM25, more is better), best first.

    Text statistics are over all documents, whatever the filters. No term gives no rows. Documents
    stay where they are: a scan counts the query's words per document, one row of statistics comes
    to the driver, and a top-k takes the best; only stemming shuffles, namely the distinct words.
    """
    wanted = list(dict.fromkeys(index_term(w) if stemmed else w.lower() for w in WORD.findall(needle)))
    if not wanted:
        return docs.withColumn("score", F.lit(None).cast("double")).where(F.lit(False))
    if stemmed:
        # The surface forms of the query's stems; few, as they share their stem.
        words = docs.select(F.explode(F.array_distinct(terms(text))).alias("word")).distinct()
        rows = words.withColumn("term", index_terms("word")).where(F.col("term").isin(wanted)).collect()
        forms = {t: [r["word"] for r in rows if r["term"] == t] for t in wanted}
    else:
        forms = {t: [t] for t in wanted}
    if not all(forms.values()):
        return docs.withColumn("score", F.lit(None).cast("double")).where(F.lit(False))
    tokens = terms(text)
    counts = [F.size(F.filter("__tokens", _one_of(forms[t]))).alias(f"__tf{i}") for i, t in enumerate(wanted)]
    counted = docs.withColumn("__tokens", tokens).select(*docs.columns, F.size("__tokens").alias("__dl"), *counts)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avg"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))]).first()
    hits = counted
    for i in range(len(wanted)):
        hits = hits.where(F.col(f"__tf{i}") > 0)
    if kind is not None:
        hits = hits.where(F.col("kind") == kind)
    if prefix is not None:
        hits = hits.where(like_prefix(path, prefix))
    score = F.lit(0.0)
    average = stats["avg"] or 1.0
    for i in range(len(wanted)):
        tf = F.col(f"__tf{i}").cast("double")
        score = score + F.lit(idf(stats["n"], stats[f"df{i}"] or 0)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.lit(float(average))))
    scored = hits.withColumn("score", score).select(*docs.columns, "score").orderBy(F.desc("score"), key)
    return scored if limit is None or limit < 0 else scored.limit(limit)


def snippet_of(text: str, stems: set[str], size: int = 12) -> str:
    """The window of ``size`` words with most different hits (the first of several), hits marked, cuts shown."""
    words = [(m.start(), m.end(), index_term(m[0]) in stems) for m in WORD.finditer(text)]
    if not words:
        return text
    best, start = -1, 0
    stemmed = [index_term(text[a:b]) if hit else "" for a, b, hit in words]
    for i in range(max(1, len(words) - size + 1)):
        score = 1000 * len({s for s in stemmed[i : i + size] if s}) + sum(1 for s in stemmed[i : i + size] if s)
        if score > best:
            best, start = score, i
    chosen = words[start : start + size]
    out, at = "", chosen[0][0] if start else 0
    for a, b, hit in chosen:
        out += text[at:a] + (f"{HIT_OPEN}{text[a:b]}{HIT_CLOSE}" if hit else text[a:b])
        at = b
    last = start + size >= len(words)
    return (GAP if start else "") + out + (text[at:] if last else GAP)


def with_snippets(hits: DataFrame, text: str, needle: str, out: str = "snippet", size: int = 12) -> DataFrame:
    """Hits (few, after the top-k) with the window of their text around the query's words."""
    stems = set(query_terms(needle))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else snippet_of(t, stems, size))

    return hits.withColumn(out, F.pandas_udf(run, "string")(text))


def sync_actions(present: DataFrame, manifest: DataFrame, key: str = "path", version: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """(key, action, and the present version): added, updated, removed or unchanged, by one full join of two manifests."""
    now = present.select(key, F.struct(*version).alias("__now")).groupBy(key).agg(F.max("__now").alias("__now"))
    old = manifest.select(key, F.struct(*version).alias("__old")).groupBy(key).agg(F.max("__old").alias("__old"))
    joined = now.join(old, key, "full")
    action = F.when(F.col("__old").isNull(), "added").when(F.col("__now").isNull(), "removed").when(F.col("__now").eqNullSafe(F.col("__old")), "unchanged").otherwise("updated")
    return joined.select(key, action.alias("action"), "__now.*")


def sync_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("files"))


def sync(index: DataFrame, docs: DataFrame, manifest: DataFrame, key: str, text: Column, version: tuple[str, ...] = ("mtime", "size"), stemmed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, manifest, counts) after a sync: only new and changed documents are read, vanished ones leave the index."""
    actions = cut(sync_actions(docs, manifest, key, version))
    gone = actions.where("action IN ('updated', 'removed')").select(key)
    fresh = docs.join(actions.where("action IN ('added', 'updated')").select(key), key, "left_semi")
    new_index = index.join(gone, key, "left_anti").unionByName(postings(fresh, key, text, stemmed))
    return new_index, docs.select(key, *version).distinct(), sync_counts(actions)


def query_index(index: DataFrame, sizes: DataFrame, needle: str, key: str, limit: int = 20) -> DataFrame:
    """(key, score) from stored postings and document sizes (key, tokens): only the postings of the query's terms are read."""
    wanted = query_terms(needle)
    if not wanted:
        return sizes.select(key, F.lit(None).cast("double").alias("score")).where(F.lit(False))
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("avg")).first()
    of_terms = index.where(F.col("term").isin(wanted))
    held = {r["term"]: r["df"] for r in document_frequencies(of_terms).collect()}
    weight = F.lit(0.0)
    for t in wanted:
        weight = F.when(F.col("term") == t, F.lit(idf(stats["n"], held.get(t, 0)))).otherwise(weight)
    tf = F.col("tf").cast("double")
    part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("tokens") / F.lit(float(stats["avg"] or 1))))
    scored = of_terms.join(sizes, key).groupBy(key).agg(F.count(F.lit(1)).alias("__terms"), F.sum(part).alias("score"))
    return scored.where(F.col("__terms") == len(wanted)).select(key, "score").orderBy(F.desc("score"), key).limit(limit)


