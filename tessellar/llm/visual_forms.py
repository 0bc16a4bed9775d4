"""One consistent form for texts that look the same but differ in their characters.

Texts are exploded to positioned code points, a whole Arrow batch at once and where they lie, as
arrays: nothing of them is shuffled. The code points are joined by position with a broadcast table
of decompositions and look-alikes, combining marks are put in the order of their class by one
stable sort, and the texts are recomposed and rebuilt. The look-alike letters are not listed here:
they are all cased letters that Unicode's own data on confusable characters (as the ICU library of
a Spark session holds it) calls like one Latin letter of the same case.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata as ud
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.session import cut

#: Decompositions of these kinds change the width, the kind of space or the typeface, not the letter.
WIDTH_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Code points looked at. Ideographs and Hangul syllables outside them are their own form.
BLOCKS = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
#: Scripts whose words keep their letters; the first word of their letters' names.
SCRIPTS = ("CYRILLIC", "GREEK", "COPTIC", "ARMENIAN", "GEORGIAN", "CHEROKEE", "DESERET", "OSAGE", "WARANG")
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def script_of(ch: str) -> str:
    """The script of a letter by its name; empty for all others."""
    first = ud.name(ch, "").partition(" ")[0] if ud.category(ch)[0] == "L" else ""
    return first if first in SCRIPTS else ""


def _code_points() -> Iterator[str]:
    for first, end in BLOCKS:
        yield from (chr(c) for c in range(first, end) if not 0xD800 <= c < 0xE000)


@lru_cache(maxsize=1)
def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Each cased letter that looks like one Latin letter of its case, and that letter.

    Where several letters of one script look like the same one, only the first of them counts, as
    the others are letters of their own beside it; so does a letter whose capital is another Latin one.
    """
    letters = [ch for ch in _code_points() if ud.category(ch) in ("Lu", "Ll") and not ud.decomposition(ch)]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join([*LATIN, *letters])).split("\n")
    if len(skeletons) != len(LATIN) + len(letters):
        raise ValueError("the skeletons do not match the letters")
    plain: dict[tuple[str, str], str] = {}
    for a, s in zip(LATIN, skeletons):
        plain.setdefault((s, ud.category(a)), a)
    out, seen = {}, set()
    for ch, s in zip(letters, skeletons[len(LATIN) :]):
        a = plain.get((s, ud.category(ch)))
        capital = ch.upper()
        if a is None or capital.isascii() and capital != a.upper() or (script_of(ch) and (script_of(ch), a) in seen):
            continue
        seen.add((script_of(ch), a))
        out[ch] = a
    return out


def _alike(ch: str, letters: dict[str, str]) -> str:
    """One code point of a canonical decomposition in its consistent form."""
    category = ud.category(ch)
    if category == "Cf" or ch in "͏ᅟᅠㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if category == "Zs":
        return " "
    if ch in letters:
        return letters[ch]
    tag = ud.decomposition(ch).partition(" ")[0]
    if tag in WIDTH_TAGS or tag == "<compat>" and (category == "Nl" or ch == "µ" or "LIGATURE" in ud.name(ch, "")):
        return "".join(_alike(x, letters) for x in ud.normalize("NFKD", ch))
    return ch


class Forms:
    """The consistent form of texts; small to send, its lookup arrays are made where they are used."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters
        #: Every code point with a decomposition, a look-alike or a combining class, and its decomposed consistent form.
        self.table: dict[str, str] = {}
        for ch in _code_points():
            to = "".join(_alike(x, letters) for x in ud.normalize("NFD", ch))
            if to != ch or ud.category(ch)[0] == "M":
                self.table[ch] = to
        #: By script, the letter of it that a Latin letter stands for.
        self.back: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        for ch, a in letters.items():
            if script_of(ch):
                self.back[script_of(ch)].setdefault(a, ch)

    @classmethod
    def of(cls, spark: SparkSession) -> Forms:
        return _forms(spark)

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, ...]:
        """By code point: its row in the table (or -1), whether it changes a text by itself, its class, whether it is of a script kept."""
        size = 0x110000
        row, changes, marks, kept = np.full(size, -1, np.int32), np.zeros(size, bool), np.zeros(size, np.uint8), np.zeros(size, bool)
        codes = [ord(ch) for ch in self.table]
        row[codes] = np.arange(len(codes))
        forms = list(self.table.values())
        changes[codes] = [ud.combining(ch) > 0 or ud.normalize("NFC", to) != ch for ch, to in self.table.items()]
        # Jamo are composed whether they are in the table or not.
        changes[0x1100:0x1200] = True
        for ch in self.table:
            marks[ord(ch)] = ud.combining(ch)
        for ch in _code_points():
            if ord(ch) < 0x20000 and script_of(ch):
                kept[ord(ch)] = True
        lengths = np.array([len(f) for f in forms], np.int64)
        return row, changes, marks, kept, lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]), _exploded("".join(forms))

    def texts(self, texts: list[str | None]) -> list[str | None]:
        """The consistent forms of many texts at once; null stays null."""
        out = list(texts)
        odd = [i for i, t in enumerate(texts) if t and not t.isascii()]
        if odd:
            some = [texts[i] for i in odd]
            points = _exploded("".join(some))
            ends = np.cumsum([len(t) for t in some])
            touched = np.logical_or.reduceat(self._arrays[1][points], np.concatenate([[0], ends[:-1]]))
            if touched.any():
                which = np.flatnonzero(touched)
                inside = np.repeat(touched, np.diff(ends, prepend=0))
                for i, form in zip(which, self._rebuilt(points[inside], np.diff(ends, prepend=0)[which])):
                    out[odd[i]] = form
        return out

    def _rebuilt(self, points: np.ndarray, sizes: np.ndarray) -> Iterator[str]:
        row, _, classes, kept, lengths, starts, flat = self._arrays
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # Joined by position: each code point becomes those of its form, none for an invisible one.
        at = row[points]
        count = np.where(at >= 0, lengths[at], 1)
        source = np.repeat(np.arange(len(points)), count)
        k = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        joined = at[source]
        points, owner = np.where(joined >= 0, flat[np.where(joined >= 0, starts[joined] + k, 0)], points[source]), owner[source]
        # Ordered: marks behind one letter by class, those of one class as they come.
        mark = classes[points]
        if mark.any():
            run = np.cumsum((mark == 0) | np.concatenate([[True], owner[1:] != owner[:-1]]))
            points = points[np.lexsort((mark, run))]
        ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))
        scripts = np.bincount(owner, kept[points], minlength=len(sizes)) > 0
        raw = points.astype("<u4").tobytes()
        first = 0
        for end, script in zip(ends.tolist(), scripts):
            text = raw[4 * first : 4 * end].decode("utf-32-le")
            yield ud.normalize("NFC", self._in_script(text) if script else text)
            first = end

    def text(self, text: str) -> str:
        """The consistent form of one text."""
        return self.texts([text])[0]

    @cached_property
    def _backs(self) -> dict[str, tuple[dict[int, str], frozenset[str]]]:
        return {s: (str.maketrans(back), frozenset(back)) for s, back in self.back.items()}

    def _script(self, word: str) -> str:
        """The script a word is written in: a name of SCRIPTS, LATIN, or nothing where its letters could be of several."""
        own = {s for s in map(_script_cached, word) if s}
        latin = [c for c in word if c.isascii()]
        if not own:
            return "LATIN" if any(all(c not in b for _, b in self._backs.values()) for c in latin) else ""
        if len(own) == 1:
            (script,) = own
            return script if all(c in self._backs[script][1] for c in latin) else "LATIN"
        return "LATIN"

    def _in_script(self, text: str) -> str:
        """Latin letters that only stand for look-alikes go back to the script of their word.

        A word with letters proper to one script and none proper to Latin is written in that script
        throughout; one whose letters could be of several goes with the nearest word before it that
        is certain, else after it. A function of the look alone, so different texts stay different.
        """
        words = list(WORD.finditer(text))
        scripts = [self._script(m[0]) for m in words]
        before = next((s for s in scripts if s), "")
        out, at = [], 0
        for m, script in zip(words, scripts):
            before = script or before
            if before in self._backs:
                out += [text[at : m.start()], m[0].translate(self._backs[before][0])]
                at = m.end()
        return "".join([*out, text[at:]])


@lru_cache(maxsize=4096)
def _script_cached(ch: str) -> str:
    return script_of(ch)


@lru_cache(maxsize=1)
def _forms(spark: SparkSession) -> Forms:
    return Forms(look_alikes(spark))


def _exploded(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def consistent_form(docs: DataFrame, text: str = "text", out: str = "consistent") -> DataFrame:
    """``docs`` with a column ``out``: the text in its one consistent form.

    Null stays null and empty empty; a text of invisible characters only becomes empty. Rows are
    kept one for one, repeated rows and all other columns included (a column ``out`` of ``docs`` is
    replaced). Texts of any length; a batch of texts is in memory at once. Nothing is shuffled.
    """
    forms = docs.sparkSession.sparkContext.broadcast(Forms.of(docs.sparkSession))
    columns = [c for c in docs.columns if c != out]
    at = columns.index(text) if text in columns else len(columns)
    source = docs.select(*columns) if text in columns else docs.select(*columns, text)
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(forms.value.texts(batch.column(at).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], made], names=[*columns, out])

    return source.mapInArrow(run, schema)


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents that look the same throughout and differ in characters.

    Null and empty texts make no pair, nor do equal ones. Where a text has exact copies, each of
    its documents is paired with the smallest document of every other text of that look (and the
    smallest with all theirs), so no link between different texts is lost and copies are not
    expanded against copies. A key that several rows share counts as one document. As many rows as
    there are pairs of spellings; ``look_classes`` gives the same classes in one row a document.
    """
    return _pairs(cut(hashed_forms(docs, key, text)), key)


def hashed_forms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, look): 256-bit hashes of each non-empty text and of its consistent form; the texts go nowhere."""
    forms = docs.sparkSession.sparkContext.broadcast(Forms.of(docs.sparkSession))
    some = docs.where(F.length(text) > 0).select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw = [hashlib.sha256(t.encode()).digest() for t in texts]
            look = [r if f == t else hashlib.sha256(f.encode()).digest() for t, f, r in zip(texts, forms.value.texts(texts), raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(look, pa.binary())], names=[key, "raw", "look"])

    return some.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("raw", T.BinaryType()), T.StructField("look", T.BinaryType())]))


def _pairs(hashed: DataFrame, key: str) -> DataFrame:
    texts = hashed.groupBy("look", "raw").agg(F.min(key).alias("first"))
    mixed = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    several = cut(texts.join(mixed, "look", "left_semi"))
    other = several.select("look", F.col("raw").alias("other_raw"), F.col("first").alias("other"))
    links = several.join(other, "look").where(F.col("raw") != F.col("other_raw")).select("raw", "other")
    both = hashed.select("raw", F.col(key).alias("doc")).join(links, "raw").where(F.col("doc") != F.col("other"))
    return both.select(F.least("doc", "other").alias("doc_a"), F.greatest("doc", "other").alias("doc_b")).distinct()


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a non-empty text: its look class (smallest document of that look), how many
    documents and how many different texts that class has."""
    hashed = cut(hashed_forms(docs, key, text))
    texts = hashed.groupBy("look", "raw").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("documents"), F.count(F.lit(1)).alias("texts"))
    return hashed.select(key, "look").join(classes, "look").select(key, "class_id", "documents", "texts")
