"""The FM-index against naive search, and leaks against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessellar.llm.leaks import FmIndex, Words, leaked_spans, leaks, removal_spans, suffix_order
from tessellar.llm.visual_forms import Forms


def test_suffix_order_and_search():
    rng = random.Random(1)
    for _ in range(60):
        symbols = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 60))] + [0], np.int64)
        text = symbols.tolist()

        def key(i, text=text):
            # Every 0 ends a run and sorts by its place.
            end = next(j for j in range(i, len(text)) if text[j] == 0)
            return [(x, 0) for x in text[i:end]] + [(0, end)]

        assert suffix_order(symbols).tolist() == sorted(range(len(text)), key=key)
        index = FmIndex(symbols, sample=3)
        phrases = np.array([[rng.choice([1, 2, 3, 4]) for _ in range(3)] for _ in range(20)], np.int64)
        which, low, high = index.search(phrases)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        for k, p in enumerate(phrases.tolist()):
            assert found.get(k, []) == [i for i in range(len(text)) if text[i : i + 3] == p]


def brute(docs, items, n, words_of):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.fixture(scope="module")
def words_of(spark):
    words = Words(Forms.of(spark))
    return lambda text: words.of([text])[0]


def test_leaks_against_brute_force(spark, words_of):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30)))) for i in range(15)] + [(15, None), (16, ""), (3, "another text of item three that is long enough")]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choice([*vocabulary, "else", "more"]) for _ in range(rng.randrange(20)))]
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts.append(" - ".join(w[a : a + rng.randrange(12)]).upper())
        docs.append((d, " ".join(parts)))
    docs += [(80, None), (81, ""), (82, "ｗ１ " * 5000), (5, docs[5][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5, words_of)
    assert {tuple(r) for r in leaks(d, i, phrase_words=5).collect()} == want
    # Keys of any type; shards and blocks of any size give the same.
    assert {tuple(r) for r in leaks(d.selectExpr("concat('d', doc_id) AS doc_id", "text"), i, phrase_words=5).collect()} == {(f"d{a}", b) for a, b in want}
    assert {tuple(r) for r in leaks(d, i, phrase_words=5, shard_words=40, block_words=20).collect()} == want
    spans = leaked_spans(d, i, phrase_words=5).collect()
    text = dict(docs)
    for s in spans:
        assert 0 <= s["first_word"] and s["last_word"] < len(words_of(text[s["doc_id"]])) and s["last_word"] - s["first_word"] >= 4
    assert {(r["doc_id"], r["item_id"]) for r in spans} == want


def test_whole_form_counts(spark):
    passage = "Every canal that outlives the ochre windmill pays twelve coins to the ferryman"
    docs = [(1, "before " + passage.replace("a", "\u0430").replace(" ", "\u00a0-\n") + " after"), (2, passage.replace("coins", "coin"))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 9)]


def test_case_of_other_scripts_is_ignored(spark, words_of):
    russian = "Все они шли тем же путём, когда ёж ел тот снег у моста и там ВСЁ кончилось"
    greek = "Το νερό και τα τείχη του κάστρου τα είδε ο ταξιδιώτης από τη μικρή πύλη"
    mixed = russian.replace("тем", "ТЕМ").replace("тот", "Тот").replace("Все", "все")
    docs = [(1, russian.upper()), (2, greek.upper()), (3, mixed), (4, russian.lower()), (5, greek.replace("τα", "ΤΑ")), (6, russian.replace("шли", "ехали").replace("кончилось", ""))]
    items = [(8, russian), (9, greek)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 8), (2, 9), (3, 8), (4, 8), (5, 9), (6, 8)}
    assert words_of("ВСЕ ΤΆ Ёж") == words_of("все τά ёж")


def test_empty_tables_and_spans(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, items).count() == 0
    assert leaks(spark.createDataFrame([(1, "a b")], docs.schema), items).count() == 0
    spans = spark.createDataFrame([(1, 7, 0, 4), (1, 8, 5, 9), (1, 8, 20, 30), (1, 9, 22, 25), (2, 7, 3, 3)], "doc_id long, item_id long, first_word long, last_word long")
    assert sorted(tuple(r) for r in removal_spans(spans).collect()) == [(1, 0, 9), (1, 20, 30), (2, 3, 3)]
