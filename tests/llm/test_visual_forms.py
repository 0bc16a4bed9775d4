"""The consistent form against its one-text version, and look-alike pairs against brute force."""

from __future__ import annotations

import itertools
import random
import unicodedata as ud

import pytest

from tessellar.llm.visual_forms import Forms, consistent_form, look_alike_pairs, look_classes

SAME = [
    ("ｆｕｌｌ ｗｉｄｔｈ １２", "full width 12"),
    ("café naïve", "cafe\u0301 nai\u0308ve"),
    ("a\u0323\u0301", "a\u0301\u0323"),
    ("soft\u00adhy\u200bphen", "softhyphen"),
    ("a\u00a0b\u2009c\u202fd", "a b c d"),
    ("ﬁne ﬂow", "fine flow"),
    ("\u0440\u0430ge", "page"),
    ("Α ΒΟΟΚ", "A BOOK"),
    ("e\u200b\u0301t\u00e9", "\u00e9t\u00e9"),
    ("M\u043e\u0441\u043a\u0432\u0430", "\u041c\u043e\u0441\u043a\u0432\u0430"),
    ("\u212a", "K"),
    ("𝐀𝑏 𝟏𝟐", "Ab 12"),
    ("\u03bdalue \u03c1age \u03b1nd", "value page and"),
    ("\u0251nd \u0261o", "and go"),
    ("w\u0585rk", "work"),
    ("M\u13aaX", "MAX"),
]
OTHER = [("Case", "case"), ("resume", "résumé"), ("item 1", "item 2"), ("x²", "x2"), ("a b", "ab"), ("Straße", "Strasse"), ("ſ", "s"), ("\u04173", "33"), ("n", "v")]


@pytest.fixture(scope="module")
def consistent(spark):
    return Forms.of(spark).text


def slow(forms, text):
    """The form of one text by the standard library's decomposition and ordering."""
    return ud.normalize("NFC", forms._in_script(ud.normalize("NFD", ud.normalize("NFD", text).translate({ord(k): v for k, v in forms.table.items()}))))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(consistent, a, b):
    assert consistent(a) == consistent(b)
    assert consistent(consistent(a)) == consistent(a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(consistent, a, b):
    assert consistent(a) != consistent(b)


def test_script_of_a_word_is_kept(consistent):
    assert consistent("Привет, мир") == "Привет, мир"
    assert consistent("ёлка") == "ёлка"
    assert consistent("όμορφο") == "όμορφο"
    # Words of letters that could be Latin go with the words around them.
    for text in ("Το νερό και αν το είδα", "все они тут, а сер не ору", "Առաջին օր ու"):
        assert consistent(text) == text
    assert consistent("see \u0430nd \u0441ode") == "see and code"


def test_plan_equals_single_texts(spark):
    forms = Forms.of(spark)
    rng = random.Random(3)
    alphabet = "ab Zé\u0301\u0323\u0327\u200b\u00a0ｆＱ１ﬁаоСΟο\u00ad\n漢カﾊﾞ가각ᄀ\u1161😀K\u0451\u0456"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "\u200b\u200d", "plain", "\u0301 first", "x" * 70_000 + "\u0301", "é" * 5_000 + "\u043e" * 5_000]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    out = consistent_form(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["consistent"] == (None if r["text"] is None else slow(forms, r["text"])), repr(r["text"])


def test_columns_with_clashing_names_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "ｘ", "old", 7, 8)], "doc_id long, text string, consistent string, ch int, form int")
    assert [r.asDict() for r in consistent_form(rows).collect()] == [{"doc_id": 1, "text": "ｘ", "ch": 7, "form": 8, "consistent": "x"}]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert consistent_form(empty).count() == look_alike_pairs(empty).count() == look_classes(empty).count() == 0


def test_pairs_against_brute_force(spark, consistent):
    rng = random.Random(5)
    base = ["page one", "Page one", "café", "two words", "fine"]

    def vary(t):
        choices = [t, ud.normalize("NFD", t), t.replace("a", "\u0430"), t.replace(" ", "\u00a0"), t.replace("fi", "ﬁ"), t + "\u200b"]
        return rng.choice(choices)

    docs = [(i, vary(rng.choice(base))) for i in range(60)] + [(60, None), (61, ""), (62, "\u200b"), (63, "\u200d")]
    want_links = {(a, b) for (a, x), (b, y) in itertools.combinations(docs, 2) if x and y and x != y and consistent(x) == consistent(y)}
    got = {tuple(r) for r in look_alike_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= want_links
    assert (62, 63) in got
    # No link between different texts is lost: every two texts of one look are joined by some pair.
    text = dict(docs)
    assert {frozenset((text[a], text[b])) for a, b in want_links} == {frozenset((text[a], text[b])) for a, b in got}
    # Without copies all pairs come out.
    single = {t: i for i, t in docs if t}
    alone = [(i, t) for t, i in single.items()]
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(alone, 2) if consistent(x) == consistent(y)}
    assert {tuple(r) for r in look_alike_pairs(spark.createDataFrame(alone, "doc_id long, text string")).collect()} == want
