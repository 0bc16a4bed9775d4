"""References to records that do not exist, by compressed bitmaps per key range and period.

Keys of any type are put together per domain, with the months they are referred to in and the time
their record came to exist. Where they lie they are dictionary-encoded: keys of one domain get
ordinals in the order they come, and every 65,536 of them are a range. Each range has one bitmap a
period of the keys referred to and one of the keys that came to exist, stored as sorted positions
while they are few and as bits from there on. For each period, references AND NOT all keys known
before it leave the bits that may be orphans; they are decoded by the range's dictionary, and only
the references behind them are compared with the parent's time exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.session import sized_broadcast

#: Ordinals of a range, and positions up to which a bitmap is a list of them (2 bytes each against 8 KB of bits).
RANGE, SPARSE = 65_536, 4_096
#: Month 1970-01 is period 0; references without a time are put after all others, parents without a time before.
NO_TIME_REFERENCE, NO_TIME_PARENT = 2**31 - 1, -(2**31)

SURVIVORS = "domain string, key string, period int, since long, `exists` boolean"


def month_of(micros: Column) -> Column:
    """Months since 1970-01 of an instant."""
    t = F.timestamp_micros(micros)
    return ((F.year(t) - 1970) * 12 + F.month(t) - 1).cast("int")


class Bitmap:
    """A set of ordinals of one range: sorted positions while sparse, bits when dense."""

    def __init__(self, positions: np.ndarray):
        """``positions`` ascend and are distinct."""
        self.dense = len(positions) > SPARSE
        if self.dense:
            bits = np.zeros(RANGE, bool)
            bits[positions] = True
            self.data = np.packbits(bits)
        else:
            self.data = positions.astype(np.uint16)

    def positions(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.data)) if self.dense else self.data.astype(np.int64)

    def put_into(self, bits: np.ndarray) -> None:
        """Adds the set to unpacked bits."""
        if self.dense:
            bits |= np.unpackbits(self.data).astype(bool)
        else:
            bits[self.data] = True

    def and_not(self, bits: np.ndarray) -> np.ndarray:
        """The positions of the set that unpacked bits do not hold."""
        if self.dense:
            return np.flatnonzero(np.unpackbits(self.data).astype(bool) & ~bits)
        return self.data[~bits[self.data]].astype(np.int64)


def bitmaps(ordinals: np.ndarray, periods: np.ndarray) -> list[tuple[int, Bitmap]]:
    """(period, bitmap) in the order of periods."""
    order = np.lexsort((ordinals, periods))
    ordinals, periods = ordinals[order], periods[order]
    edges = np.flatnonzero(np.concatenate([[True], periods[1:] != periods[:-1], [True]])) if len(periods) else [0]
    return [(int(periods[a]), Bitmap(ordinals[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def surviving(references: list[tuple[int, Bitmap]], parents: list[tuple[int, Bitmap]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each period the positions referred to that no parent of an earlier period has."""
    known, k = np.zeros(RANGE, bool), 0
    for period, wanted in references:
        while k < len(parents) and parents[k][0] < period:
            parents[k][1].put_into(known)
            k += 1
        left = wanted.and_not(known)
        if len(left):
            yield period, left


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = table["periods"].combine_chunks()
        months = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        born, there = table["born"].to_numpy(), table["exists"].to_numpy()
        has = np.flatnonzero(there)
        for period, left in surviving(bitmaps(owner, months), bitmaps(has, born[has])):
            found = table.take(pa.array(left)).combine_chunks()
            columns = [found[c].combine_chunks() for c in ("domain", "key")]
            yield pa.record_batch([*columns, pa.array(np.full(len(left), period, np.int32)), found["since"].combine_chunks(), found["exists"].combine_chunks()], names=["domain", "key", "period", "since", "exists"])

    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, RANGE - rows)
            held.append(part)
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == RANGE:
                yield from solve(pa.Table.from_batches(held))
                held, rows = [], 0
    if held:
        yield from solve(pa.Table.from_batches(held))


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose parent is absent or came to exist only after them.

    ``references``: domain (string), key (string), at (micros, or null), and any columns naming the
    row; ``parents``: domain, key, since (micros, or null). Deleted parents must not be in
    ``parents``. A parent without ``since`` has always existed; a reference without ``at`` is an
    orphan only if its parent is absent; null keys are no references; of repeated parents the
    earliest counts. Gives the distinct rows of ``references`` with ``period`` and ``reason``
    (``absent`` or ``later``). Empty tables on either side are fine: no parents at all leaves
    every reference. Columns named ``period``, ``reason``, ``since`` or ``exists`` of ``references``
    are replaced or kept as they are: only those two are added.
    """
    # The month of a reference without time is unknown; a parent is known before it from any month on.
    refs = references.where(F.col("key").isNotNull()).withColumn("period", F.coalesce(month_of(F.col("at")), F.lit(NO_TIME_REFERENCE)))
    known = parents.where(F.col("key").isNotNull())
    both = refs.select("domain", "key", "period", F.lit(None).cast("long").alias("since"), F.lit(False).alias("exists")).unionByName(
        known.select("domain", "key", F.lit(None).cast("int").alias("period"), F.coalesce("since", F.lit(-(2**62))).alias("since"), F.lit(True).alias("exists"))
    )
    # One row a key, put together map-side: a key with a third of all references comes as its months.
    keys = both.groupBy("domain", "key").agg(F.collect_set("period").alias("periods"), F.min("since").alias("since"), F.max("exists").alias("exists"))
    born = F.when(F.col("since") == -(2**62), F.lit(NO_TIME_PARENT)).otherwise(F.coalesce(month_of(F.col("since")), F.lit(NO_TIME_PARENT))).cast("int")
    decoded = keys.withColumn("born", born).mapInArrow(_and_not, SURVIVORS)
    decoded = sized_broadcast(decoded.select("domain", "key", "period", F.col("since").alias("__since"), F.col("exists").alias("__exists")))
    late = F.col("__exists") & (F.col("__since") > F.col("at"))
    return (
        refs.join(decoded, ["domain", "key", "period"])
        .withColumn("reason", F.when(~F.col("__exists"), F.lit("absent")).when(late, F.lit("later")))
        .where(F.col("reason").isNotNull())
        .drop("__since", "__exists")
        .distinct()
    )
