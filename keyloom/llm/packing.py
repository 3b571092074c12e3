"""Packing token sequences: greedy filling with best-two-fit replacement, planned on the histogram of lengths.

Pieces of one length are interchangeable, so the plan needs no pieces, only how many there are of each length: at most one
count per length up to the capacity. A sequence is filled greedily with the longest pieces that fit. Then its shortest piece
is given back if two unpacked pieces fill the gap that it leaves more tightly. The same filling is used for as many
sequences as the counts allow, so after each some length can't serve another, and there are about as many fillings as
lengths. Pieces then take the plan's places by their rank among those of their length; ranks are counted in salted parts
and offset, so a length that most pieces have isn't ranked in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import documents, prepare, save
from keyloom.llm.tokens import encoder

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 4096, 1
#: Pieces of a length that are ranked in one task, about.
RANKED = 2_000


class _Stock:
    """Counts by length, with the longest length in stock that is at most x for each x."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64)
        self._refresh()

    def _refresh(self) -> None:
        self.fit = np.maximum.accumulate(np.where(self.n > 0, np.arange(len(self.n)), 0))

    def take(self, length: int, n: int = 1) -> None:
        self.n[length] -= n
        if self.n[length] == 0:
            self._refresh()

    def give(self, length: int) -> None:
        self.n[length] += 1
        if self.n[length] == 1:
            self._refresh()

    def two(self, room: int) -> tuple[int, int]:
        """The two pieces in stock with the largest sum up to room; (0, 0) if there are none."""
        a = np.flatnonzero(self.n[: room + 1])
        if not len(a):
            return 0, 0
        b = self.fit[room - a]
        single = (b == a) & (self.n[a] < 2)  # the only one of its length can't be both
        b = np.where(single, self.fit[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        best = int(np.argmax(total))
        return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths in it) for each filling; counts[l] is the number of pieces of length l."""
    stock, out = _Stock(np.concatenate([counts, np.zeros(capacity + 1 - len(counts), np.int64)])), []
    while stock.fit[capacity] > 0:
        filling, gap = [], capacity
        while gap and (length := int(stock.fit[gap])) > 0:
            n = int(min(stock.n[length], gap // length))
            stock.take(length, n)
            filling += [length] * n
            gap -= length * n
        while gap and len(filling) > 1:
            smallest = filling[-1]
            a, b = stock.two(gap + smallest)
            if a + b <= smallest:
                break
            stock.take(a)
            stock.take(b)
            stock.give(smallest)
            filling = sorted([*filling[:-1], a, b], reverse=True)
            gap += smallest - a - b
        lengths, uses = np.unique(filling, return_counts=True)
        more = int((stock.n[lengths] // uses).min())
        if more:
            for length, use in zip(lengths.tolist(), uses.tolist(), strict=True):
                stock.take(length, use * more)
        out.append((1 + more, filling))
    return out


def places(fillings: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, per sequence, first offset): where pieces of a length go, by rank."""
    out, used, sequence = [], {}, 0
    for often, filling in fillings:
        lengths, uses = np.unique(filling, return_counts=True)
        offset = 0
        for length, use in sorted(zip(lengths.tolist(), uses.tolist(), strict=True), reverse=True):
            first = used.get(length, 0)
            out.append((length, first, often * use, sequence, use, offset))
            used[length] = first + often * use
            offset += length * use
        sequence += often
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Return (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece of docs (doc_id, text).

    A document is its ids and `end`, so a null or empty text is one piece of length 1. Documents beyond the capacity are cut
    into full pieces and a rest. Rows with the same doc_id or a null one are documents of their own. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    prepare(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for c, v in zip(columns, (i, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = save(documents(docs).select("doc_id", "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    slots = spark.sparkContext.broadcast(np.array(sorted(places(plan(counts, capacity))), np.int64).reshape(-1, 6))
    salts = spark.createDataFrame([(length, -(-int(n) // RANKED)) for length, n in enumerate(counts) if n], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    window = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(window), F.lit(0)).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = table[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(rank) else table[:0]
            nth, uses = rank - slot[:, 1], slot[:, 4]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + nth // uses), pa.array(slot[:, 5] + nth % uses * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
