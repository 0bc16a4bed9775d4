"""Passages of evaluation items inside a training corpus, by an FM-index per training shard.

A shard is a run of documents of one partition. Its words become numbers of the vocabulary of all
items (every other word is 0); stretches too short to hold a passage are dropped, the rest gets a
suffix order, its Burrows-Wheeler transform in a wavelet matrix and sampled suffix positions. A
shard is indexed once, and the phrases of every block of items are searched backwards in it, all of
a block at a time, the hits located and merged to spans: the corpus is read in one pass.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.visual_forms import Forms

#: Consecutive words that make a leak.
PHRASE_WORDS = 12
#: Words of documents in one shard, and words of items searched at once (more items take further passes).
SHARD_WORDS, BLOCK_WORDS = 2_000_000, 500_000
#: Every so many suffix positions one is kept.
SAMPLE = 8

WORD = re.compile(r"[^\W_]+")
SPANS = "item long, first_word long, last_word long"
OTHER_SCRIPT = re.compile("[\u0370-\u058f\u10a0-\u10ff\u13a0-\u13ff\u1c80-\u1cbf\u2c80-\u2cff\uab70-\uabbf\U00010400-\U000104ff\U000118a0-\U000118ff]")


class Words:
    """The words of texts in consistent form without regard to case: runs of letters and digits.

    Without case a word has no capitals that could tell its script, so every letter whose capital, or
    else it itself, is drawn like a Latin letter stands for the small form of that letter.
    """

    def __init__(self, forms: Forms):
        self.forms = forms
        small = {}
        for ch, a in forms.letters.items():
            if ch != ch.casefold() or ch.upper() not in forms.letters:
                small[ch.casefold()] = a.casefold()
        self.caseless = str.maketrans({k: v for k, v in small.items() if len(k) == 1})

    def of(self, texts: list[str]) -> list[list[str]]:
        out = []
        for text in self.forms.texts(texts):
            folded = text.casefold()
            if not folded.isascii():
                # Accented letters are looked up by their base; casefolding may take composed letters apart.
                folded = ud.normalize("NFC", ud.normalize("NFD", folded).translate(self.caseless) if OTHER_SCRIPT.search(folded) else folded)
            out.append(WORD.findall(folded))
        return out


class WaveletMatrix:
    """Ranks of any symbol at any position of a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.zeros, self.ones = width, [], []
        s = symbols
        for level in range(width - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(s) - ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(end), end
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.width - 1 - i)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by doubled prefixes; every 0 ends a run and is unlike any other 0."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    reach = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] + 1
        pair = rank * (int(rank.max()) + 2) + np.where(rank < ends.sum(), 0, ahead)
        order = np.argsort(pair, kind="stable")
        changed = np.empty(n, np.int64)
        changed[0], changed[1:] = 0, pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changed)
        if rank[order[-1]] == n - 1 or reach >= n:
            return order
        reach *= 2


class FmIndex:
    """Runs of positive symbols, each ended by a 0, searched backwards."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        self.size = len(symbols)
        top = int(symbols.max(initial=1))
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.bwt = last
        self.matrix = WaveletMatrix(last, top.bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        # A run's first symbol has a 0 before it, over which no step leads, so it is always kept.
        kept = (order % sample == 0) | (last == 0)
        self.kept, self.kept_rank, self.position = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to) of the suffix ranges of those rows of ``phrases`` that occur."""
        alive = np.flatnonzero((phrases < len(self.before) - 1).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low = self.before[symbol] + self.matrix.rank(symbol, low)
            high = self.before[symbol] + self.matrix.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, by steps back to kept ones."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            walking = np.flatnonzero(~self.kept[rows])
            if not len(walking):
                return self.position[self.kept_rank[rows]] + steps
            symbol = self.bwt[rows[walking]]
            rows[walking] = self.before[symbol] + self.matrix.rank(symbol, rows[walking])
            steps[walking] += 1


@dataclass
class Phrases:
    """The phrases of a block of items: distinct windows of words as numbers, and the items each occurs in."""

    windows: np.ndarray
    items: np.ndarray
    items_from: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, list[str]]], length: int, vocabulary: dict[str, int]) -> Phrases | None:
        """Of (item, words); new words are added to the vocabulary."""
        found: dict[tuple[int, ...], list[int]] = {}
        for item, words in items:
            if len(words) < length:
                continue
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            for i in range(len(numbers) - length + 1):
                found.setdefault(tuple(numbers[i : i + length]), []).append(item)
        if not found:
            return None
        owners = [sorted(set(v)) for v in found.values()]
        return cls(np.array(list(found), np.int64), np.array([x for o in owners for x in o], np.int64), np.concatenate([[0], np.cumsum([len(o) for o in owners])]))


class Shard:
    """Documents gathered until there are enough words for an index."""

    def __init__(self, vocabulary: dict[str, int], length: int):
        self.vocabulary, self.length = vocabulary, length
        self.clear()

    def clear(self) -> None:
        self.numbers, self.keys, self.lengths, self.words = [], [], [], 0

    def add(self, key: object, words: list[str]) -> None:
        if len(words) < self.length:
            return
        self.numbers.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)))
        self.numbers.append(np.zeros(1, np.int64))
        self.keys.append(key)
        self.lengths.append(len(words) + 1)
        self.words += len(words) + 1

    def search(self, blocks: Callable[[], Iterator[Phrases]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(key, item, first_word, last_word) of what the gathered documents hold, for each block of phrases; they are then dropped."""
        if not self.keys:
            return
        length, numbers, keys = self.length, np.concatenate(self.numbers), self.keys
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.clear()
        known = np.concatenate([[False], numbers > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        first, end = edges[::2], edges[1::2]
        long = end - first >= length
        first, end = first[long], end[long]
        if not len(first):
            return
        size = end - first + 1
        into = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first - into, size)
        index = FmIndex(numbers[at])
        for phrases in blocks():
            found = self._spans(index, phrases, at, starts)
            if found is not None:
                document, *columns = found
                yield pa.record_batch([pa.array([keys[d] for d in document.tolist()], kind), *map(pa.array, columns)], names=["key", "item", "first_word", "last_word"])

    def _spans(self, index: FmIndex, phrases: Phrases, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...] | None:
        length = self.length
        phrase, low, high = index.search(phrases.windows)
        count = high - low
        if not count.sum():
            return None
        rows = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
        word, phrase = at[index.locate(rows)], np.repeat(phrase, count)
        document = np.searchsorted(starts, word, side="right") - 1
        owners = phrases.items_from[phrase + 1] - phrases.items_from[phrase]
        item = phrases.items[np.arange(int(owners.sum())) + np.repeat(phrases.items_from[phrase] - (np.cumsum(owners) - owners), owners)]
        document, word = np.repeat(document, owners), np.repeat(word, owners)
        order = np.lexsort((word, item, document))
        document, item, word = document[order], item[order], word[order]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (document[1:] != document[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + length)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(word) - 1)
        begin = starts[document[fresh]]
        return document[fresh], item[fresh], word[fresh] - begin, word[last] + length - 1 - begin


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, each collected by itself; usually one."""
    some = items.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).distinct()
    size = some.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = int(size // block_words) + 1
    for b in range(blocks):
        yield [tuple(r) for r in some.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == b).collect()]


def leaked_spans(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", phrase_words: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_key, item_key, first_word, last_word): the spans of documents that repeat an item's words.

    A span is a maximal stretch of words (counted from 0) covered by passages of at least
    ``phrase_words`` consecutive words of the item. Null or empty texts and null keys give no rows,
    items of fewer words none either; a document or item row that comes twice counts once; other
    columns are not read. Documents keep a key of any type, items have whole numbers. Documents stay
    where they are: nothing of them is shuffled but the spans. The items are held-out material: their
    vocabulary is broadcast whole, their phrases in blocks of which a task holds one at a time.
    """
    context, forms = docs.sparkSession.sparkContext, Forms.of(docs.sparkSession)
    words, vocabulary, blocks = Words(forms), {}, []
    for block in item_blocks(items, item_key, text, block_words):
        phrases = Phrases.of(list(zip([i for i, _ in block], words.of([t for _, t in block]))), phrase_words, vocabulary)
        if phrases is not None:
            blocks.append(context.broadcast(phrases))
    shared = context.broadcast((words, vocabulary))
    texts = docs.where(F.col(doc_key).isNotNull() & (F.length(text) > 0)).select(F.col(doc_key).alias("key"), F.col(text).alias("text"))
    spans = T.StructType([T.StructField("key", docs.schema[doc_key].dataType), *T._parse_datatype_string(SPANS).fields])

    def each_block() -> Iterator[Phrases]:
        for block in blocks:
            yield block.value
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vocabulary = shared.value
        shard, kind = Shard(vocabulary, phrase_words), None
        for batch in batches:
            kind = batch.column(0).type
            for key, found in zip(batch.column(0).to_pylist(), words.of(batch.column(1).to_pylist())):
                shard.add(key, found)
                if shard.words >= shard_words:
                    yield from shard.search(each_block, kind)
        if kind is not None:
            yield from shard.search(each_block, kind)

    found = texts.mapInArrow(run, spans) if blocks else docs.sparkSession.createDataFrame([], spans)
    return found.distinct().select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "first_word", "last_word")


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id): every document that holds a passage of an item."""
    return leaked_spans(docs, items, **options).select(options.get("doc_key", "doc_id"), options.get("item_key", "item_id")).distinct()


def removal_spans(spans: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The spans of a document over all items, overlapping or touching ones merged: what to cut out of it."""
    reach = F.expr(f"max(last_word) OVER (PARTITION BY {doc_key} ORDER BY first_word, last_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    marked = spans.select(doc_key, "first_word", "last_word").distinct().withColumn("__fresh", (F.col("first_word") > F.coalesce(reach, F.lit(-2)) + 1).cast("int"))
    grouped = marked.withColumn("__span", F.expr(f"sum(__fresh) OVER (PARTITION BY {doc_key} ORDER BY first_word, last_word)"))
    return grouped.groupBy(doc_key, "__span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).drop("__span")
