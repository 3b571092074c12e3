"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words that a document shares with a benchmark item, found by rolling hashes (Karp-Rabin) against the
sorted table of the items' runs and compared word by word. Seeds on one diagonal that follow each other are a match; the
longest match of unmarked words is marked as a tile again and again until none of five words is left. An item leaks into a
document if tiles cover enough of it, in whatever order they come there. Where words repeat so often that the seeds would be
too many, matches are found by going through the item word by word with the lengths of the matches that end at each place of
the document, so memory follows the texts and not their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import documents, forget_tables, prepare
from keyloom.llm.shingles import WIDTH, batch_words, rolled, word_hashes

#: Share of an item's words that tiles must cover, in percent.
COVERAGE = 60
#: Words of benchmark items that one pass over the documents takes; more items mean more passes.
BLOCK_WORDS = 2_000_000
#: Seeds of an item in a document that are listed one by one; beyond, matches are found along the document.
LISTED = 300_000


class Items:
    """Benchmark items and the sorted table of their seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids, self.words = [i for i, _ in items], [h for _, h in items]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {min(WIDTH, len(h)) for h in self.words if len(h)}:
            own = [(k, rolled(h, width)) for k, h in enumerate(self.words) if min(WIDTH, len(h)) == width]
            seeds = np.concatenate([s for _, s in own])
            item = np.concatenate([np.full(len(s), k) for k, s in own])
            place = np.concatenate([np.arange(len(s)) for _, s in own])
            at = np.argsort(seeds, kind="stable")
            self.tables[width] = seeds[at], item[at], place[at]

    def covered(self, h: np.ndarray, coverage: int) -> Iterator[tuple[int, int, int]]:
        """(item, words under tiles, tiles) of the items of which tiles cover enough in a document with these word hashes."""
        for width, (table, item, place) in self.tables.items():
            if len(h) < width:
                continue
            runs = rolled(h, width)
            low = np.searchsorted(table, runs)
            hit = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == runs)
            if not len(hit):
                continue
            # Which items have how many seeds here: of each different seed its places in the items, and how often it comes here.
            value, first, times = np.unique(runs[hit], return_index=True, return_counts=True)
            start = low[hit[first]]
            n = np.searchsorted(table, value, "right") - start
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owners, index = np.unique(item[at], return_inverse=True)
            here, seeds = np.bincount(index), np.bincount(index, np.repeat(times, n))
            for j in np.flatnonzero((here + width - 1) * width * 100 >= coverage * np.array([len(self.words[k]) for k in owners])).tolist():
                k, own = int(owners[j]), at[index == j]
                words = self.words[k]
                if seeds[j] > LISTED:
                    covered, tiles = tile_along(words, h, width)
                else:
                    order = np.argsort(table[own], kind="stable")
                    values, places = table[own][order], place[own][order]
                    in_doc = hit[np.isin(runs[hit], values)]
                    begin = np.searchsorted(values, runs[in_doc])
                    m = np.searchsorted(values, runs[in_doc], "right") - begin
                    in_item = places[np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                    in_doc = np.repeat(in_doc, m)
                    same = np.logical_and.reduce([words[in_item + d] == h[in_doc + d] for d in range(width)])
                    covered, tiles = tile(len(words), width, in_item[same], in_doc[same])
                if 100 * covered >= coverage * len(words):
                    yield k, covered, tiles


def tile(n_item: int, width: int, in_item: np.ndarray, in_doc: np.ndarray) -> tuple[int, int]:
    """(words of the item under tiles, tiles) for the seeds at these places."""
    if not len(in_item):
        return 0, 0
    item_marked, doc_marked = np.zeros(n_item, bool), {}
    diagonal = in_doc - in_item
    order = np.lexsort((in_item, diagonal))
    p, d = in_item[order], diagonal[order]
    breaks = np.flatnonzero((np.diff(p) != 1) | (np.diff(d) != 0)) + 1
    starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(p)]])
    matches = [(int(p[a]), int(d[a]), int(e - a) + width - 1) for a, e in zip(starts, ends, strict=True)]
    by_length: dict[int, list] = {}
    for start, diag, length in matches:
        by_length.setdefault(length, []).append((start, diag))
    tiles = 0
    for length in range(max(by_length), width - 1, -1):
        for start, diag in sorted(by_length.pop(length, [])):
            free = [not item_marked[start + k] and (start + diag + k) not in doc_marked for k in range(length)]
            if all(free):
                item_marked[start : start + length] = True
                doc_marked.update(dict.fromkeys(range(start + diag, start + diag + length)))
                tiles += 1
                continue
            run = 0  # what is left of the match are shorter matches, tried when their length's turn comes
            for k in range(length + 1):
                if k < length and free[k]:
                    run += 1
                else:
                    if run >= width:
                        by_length.setdefault(run, []).append((start + k - run, diag))
                    run = 0
    return int(item_marked.sum()), tiles


def tile_along(item: np.ndarray, doc: np.ndarray, width: int) -> tuple[int, int]:
    """tile() without a list of seeds: each pass finds the longest matches of unmarked words and marks them."""
    item_marked, doc_marked, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), 0
    while True:
        longest, found = width, []
        before = np.zeros(len(doc) + 1, np.int32)  # how long the match is that ends before each place
        for p in range(len(item) + 1):
            now = np.zeros(len(doc) + 1, np.int32)
            if p < len(item) and not item_marked[p]:
                now[1:] = np.where((doc == item[p]) & ~doc_marked, before[:-1] + 1, 0)
            ended = np.flatnonzero(before[:-1] >= longest)
            ended = np.concatenate([ended[now[1:][ended] == 0], np.flatnonzero(before[-1:] >= longest) + len(doc)])
            if len(ended):
                length = before[ended]
                if length.max() > longest:
                    longest, found = int(length.max()), []
                ended = ended[length == longest]
                found.append(np.stack([np.full(len(ended), p - longest), ended - longest], 1))
            before = now
        if not found:
            return int(item_marked.sum()), tiles
        for start, at in sorted(map(tuple, np.concatenate(found).tolist()), key=lambda m: (m[0], m[1] - m[0])):
            if not item_marked[start : start + longest].any() and not doc_marked[at : at + longest].any():
                item_marked[start : start + longest] = doc_marked[at : at + longest] = True
                tiles += 1


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Return (doc_id, item_id, item_words, covered_words, tiles, th), th being the text's xxhash64: a row per document of docs (doc_id, text) and item of benchmark
    (item_id, text) of which tiles cover at least `coverage` percent.

    Words are runs of non-white-space, A-Z lower-cased. Items of fewer than five words match only as a whole; items without
    words never. Null texts are empty; a null item_id is returned as null; repeated rows give repeated results. The benchmark
    is taken in blocks of at most block_words words (one item at least), each of which is compared with all documents in a
    pass of its own, so any number of items is within bounds. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows, out = documents(docs).select("doc_id", "text", F.xxhash64("text").alias("th")), None
    for block in _blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forget_tables()
            items = Items(sent.value)
            for batch in batches:
                found = []
                hashes, at = batch_words(batch.column("text"))
                for i, th, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found += [(i, items.ids[k], len(items.words[k]), covered, tiles, th) for k, covered, tiles in items.covered(hashes[a:b], coverage)]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "item_words", "covered_words", "tiles", "th"])

        part = rows.mapInArrow(search, "doc_id long, item_id long, item_words long, covered_words long, tiles long, th long")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, item_words long, covered_words long, tiles long, th long")
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        own = word_hashes(r.text)
        if block and n + len(own) > block_words:
            yield block
            block, n = [], 0
        if len(own):
            block.append((r.item_id, own))
            n += len(own)
    if block:
        yield block
