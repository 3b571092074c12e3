"""Removal of byte strings of LENGTH that start more than once, by sparse, hash-compared suffix sorting.

Prefix polynomial hashes give the hash of any substring in constant time. Every window of LENGTH bytes selects its smallest
GRAM-byte hash as its anchor, so equal windows hold equal anchors at equal offsets, and only anchors are shuffled, about one
in a hundred positions. With an anchor goes the hash of its context, the union of the windows that select it. Then

1. anchors whose gram is found once have no window of interest;
2. contexts found twice are duplicate as a whole: all their windows are;
3. for the others the offsets of their windows are cut into blocks, and open blocks into finer ones, for which the same is
   asked: the bytes that all windows of a block share (found once: none is duplicate), and those that they cover (found
   twice: all are);
4. in blocks still open, the suffixes at each offset are sorted per batch by a mergesort that compares two suffixes by
   binary search for their common extension over the prefix hashes; neighbours that agree over LENGTH bytes are compared byte
   by byte, and classes of equal windows are counted over all batches by a digest of their bytes.

All counts are aggregated partially and no group of equal strings is gathered anywhere. What a step knows of a gram or block
meets its contexts in a join by the gram; the few grams with a thousandth of all contexts or more are sent to all tasks
instead, so a passage that many texts share is even work too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import discard, documents, forget_tables, prepare, release, save
from keyloom.llm.shingles import mixed

LENGTH, GRAM = 400, 200
SPREAD = LENGTH - GRAM
#: Offsets of a block, each a multiple of the next, and start positions that are hashed at a time in a long text.
BLOCKS, SEGMENT = (21, 3), 1 << 20
#: Contexts whose windows are sorted at a time, about; each takes some kilobytes.
SORTED = 4096
#: A gram or block with more than one HOTth of all contexts doesn't meet them in one task.
HOT = 1000
#: Bytes by which windows are told apart before they are merged.
LEADING = 8
#: Odd multiplier of the polynomial hash, modulo 2^64.
BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + 3 * LENGTH
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b % 2**64, np.uint64)])) for b in (BASE, pow(BASE, -1, 2**64)))


class Prefixes:
    """Prefix hashes of rows of bytes (the last axis)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers()
        self.sums = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.shape[-1]], axis=-1, out=self.sums[..., 1:])

    def of(self, start: np.ndarray, length: np.ndarray | int, row: np.ndarray | None = None) -> np.ndarray:
        at = (lambda i: self.sums[i]) if row is None else (lambda i: self.sums[row, i])
        return (at(start + length) - at(start)) * self.down[start]


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over each run of `width` values: of a block's end and the next one's beginning."""
    rows = np.full(-(-len(x) // width) * width, fill, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ends, starts = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel(), best.accumulate(rows, axis=1).ravel()
    return best(ends[: len(x) - width + 1], starts[width - 1 : len(x)])


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of a text's windows that select the same anchor: where its context starts, first and last offset of its
    windows (the window at offset o starts SPREAD - o before the anchor), hash of the anchor's gram and of the context."""
    n, parts = len(data), []
    for s in range(0, n - LENGTH + 1, SEGMENT):
        windows = min(SEGMENT, n - LENGTH + 1 - s)
        own = Prefixes(data[s : s + windows + LENGTH])
        grams = mixed(own.of(np.arange(windows + SPREAD), GRAM), 1)
        least = _sliding(grams, SPREAD + 1, np.minimum, 2**64 - 1)
        edge = np.zeros(SPREAD, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SPREAD + 1, np.maximum, 0) == grams)
        # Each window selects the first of its smallest grams.
        k = np.searchsorted(chosen, np.arange(windows))
        wrong = np.flatnonzero(grams[chosen[k]] != least)
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[grams[chosen[k[wrong]]] != least[wrong]]
        selected = chosen[k]
        first = np.flatnonzero(np.diff(selected, prepend=-1))
        last = np.append(first[1:], windows) - 1
        at = selected[first]
        low, high = first - at + SPREAD, last - at + SPREAD
        context = own.of(first, high - low + LENGTH)
        parts.append((first + s, low, high, grams[at], mixed(context + mixed((low * (SPREAD + 1) + high).astype(np.uint64), 2), 3)))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _extension(p: Prefixes, row: np.ndarray, at: np.ndarray, row2: np.ndarray, at2: np.ndarray) -> np.ndarray:
    """How many bytes (up to LENGTH) suffixes have in common: binary search over the prefix hashes."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), LENGTH)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = p.of(at, middle, row) == p.of(at2, middle, row2)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sort_windows(data: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows data[row, at : at + LENGTH] and, for each in that order, its class of equal windows.

    Windows are told apart by their leading bytes; those that share them with others are sorted by merging."""
    leading = np.ascontiguousarray(data[row[:, None], at[:, None] + np.arange(LEADING)]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(leading, kind="stable")
    same = np.diff(leading[order]) == 0
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    own = np.flatnonzero(tied)
    among = order[own]
    merged, classes = _merge_sorted(data, row[among], at[among])
    order[own] = among[merged]
    new = np.ones(len(order), bool)
    new[own[1:]] = np.diff(classes) > 0
    return order, np.cumsum(new) - 1


def _merge_sorted(data: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of windows; return their order and, for each in that order, its class of equal windows.

    Runs are merged by ranking each element in its sister run; a comparison costs a binary search for the common extension.
    Neighbours with a full extension are compared byte by byte before they share a class."""
    n = len(at)
    p, order = Prefixes(data), np.arange(len(at))

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix x sorts before y (or equals it, where ties)."""
        common = _extension(p, row[x], at[x], row[y], at[y])
        step = np.minimum(common, LENGTH - 1)
        left, right = data[row[x], at[x] + step], data[row[y], at[y] + step]
        return np.where(common >= LENGTH, ties, left < right)

    width = 1
    while width < n:
        place = np.arange(n)
        pair = place // (2 * width) * (2 * width)
        second = place - pair >= width
        # The sister run's bounds; elements of the second run come after equal ones of the first.
        low = np.where(second, pair, np.minimum(pair + width, n))
        base, high = low.copy(), np.where(second, pair + width, np.minimum(pair + 2 * width, n))
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                break
            middle = (low[going] + high[going]) // 2
            other, own = order[middle], order[going]
            down = np.where(second[going], before(other, own, True), before(other, own, False))
            low[going] = np.where(down, middle + 1, low[going])
            high[going] = np.where(down, high[going], middle)
        rank = np.where(second, place - pair - width, place - pair) + low - base
        merged = np.empty_like(order)
        merged[pair + rank] = order
        order, width = merged, 2 * width
    if n < 2:
        return order, np.zeros(n, np.int64)
    x, y = order[:-1], order[1:]
    equal = _extension(p, row[x], at[x], row[y], at[y]) >= LENGTH
    for i in np.flatnonzero(equal):
        equal[i] = data[row[x[i]], at[x[i]] : at[x[i]] + LENGTH].tobytes() == data[row[y[i]], at[y[i]] : at[y[i]] + LENGTH].tobytes()
    return order, np.concatenate([[0], np.cumsum(~equal)])


def _batch(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v) for k, v in columns.items()})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables()
    for batch in batches:
        columns = []
        for i, t, text in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text")), strict=True):
            at, low, high, gram, context = anchors(np.frombuffer(text.encode(), np.uint8))
            columns.append((np.full(len(at), i, np.int64), np.full(len(at), t, np.int64), at, low.astype(np.int16), high.astype(np.int16), gram, context))
        yield _batch(dict(zip(("id", "t", "at", "low", "high", "core", "hull"), map(np.concatenate, zip(*columns, strict=True)), strict=True)))


#: at is where a context starts; it stands for the context.
ANCHORS = "id long, t long, at long, low short, high short, core long, hull long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open contexts; a row has a text and its open contexts."""
    for batch in batches:
        rows = []
        for i, t, text, found in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text", "open")), strict=True):
            data = text.encode()
            rows += [(i, t, x["at"], x["low"], x["high"], data[x["at"] : x["at"] - x["low"] + x["high"] + LENGTH]) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary()))], names=["id", "t", "at", "low", "high", "bytes"])


def _aligned(batch: pa.RecordBatch) -> np.ndarray:
    """Contexts as rows of bytes in which column c is offset c."""
    data = np.zeros((batch.num_rows, SPREAD + LENGTH), np.uint8)
    for k, (low, b) in enumerate(zip(batch.column("low").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
        data[k, low : low + len(b)] = np.frombuffer(b, np.uint8)
    return data


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last offset of each open block of a batch's contexts."""
    found = [(k, x["low"], x["high"]) for k, blocks in enumerate(batch.column("open").to_pylist()) for x in blocks]
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the value, for each value of the ranges."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _blocks(step: int):
    """For each part of `step` offsets of the open blocks the hash of what all its windows share and of what they cover."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, (row, low, high) = Prefixes(_aligned(batch)), _opened(batch)
            of, block = _each(low // step, high // step)
            first, last = block * step, np.minimum(block * step + step - 1, SPREAD)
            lo, hi, r = np.maximum(low[of], first), np.minimum(high[of], last), row[of]
            core = mixed(p.of(last, LENGTH + first - last, r), 4)
            hull = mixed(p.of(lo, hi - lo + LENGTH, r) + mixed((lo * (SPREAD + 1) + hi).astype(np.uint64), 2), 5)
            ids, t, at, shift = (batch.column(c).to_numpy()[r] for c in ("id", "t", "at", "low"))
            yield _batch({"id": ids, "t": t, "at": at, "start": at + lo - shift, "block": block.astype(np.int16), "low": lo.astype(np.int16), "high": hi.astype(np.int16), "core": core, "hull": hull})

    return hashed


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open block the windows at its offsets, with a digest of their bytes taken once for equal windows."""
    for batch in _gathered(batches, SORTED):
        data, (row, low, high) = _aligned(batch), _opened(batch)
        of, at = _each(low, high)
        row = row[of]
        order, classes = sort_windows(data, row, at)
        digests = np.zeros((int(classes[-1]) + 1 if len(classes) else 0, 2), np.int64)
        for k in np.flatnonzero(np.diff(classes, prepend=-1)):
            w = order[k]
            digests[classes[k]] = np.frombuffer(hashlib.blake2b(data[row[w], at[w] : at[w] + LENGTH].tobytes(), digest_size=16).digest(), np.int64)
        row, at, of = row[order], at[order], digests[classes]
        ids, t, context, shift = (batch.column(c).to_numpy()[row] for c in ("id", "t", "at", "low"))
        yield _batch({"id": ids, "t": t, "start": context - shift + at, "offset": at.astype(np.int16), "d1": of[:, 0], "d2": of[:, 1]})


def _placed(rows: DataFrame, core: list[str], columns: list[str]) -> DataFrame:
    """The columns of the rows whose core is found twice, with `same`, how often the hull is, and whether the row is `open`: its
    hull is found once, or it stands for those with its hull, all duplicate, that a hull found once may partly equal."""
    tagged = rows.withColumn("tag", F.xxhash64("id", "t", "at"))
    hulls = save(tagged.groupBy(*core, "hull").agg(F.count("*").alias("same"), F.min("tag").alias("first")), "hulls")
    cores = hulls.groupBy(*core).agg(F.sum("same").alias("all"), F.min("same").alias("least"), F.count("*").alias("hulls")).where(F.col("all") >= 2).drop("all")
    cores = save(cores, "cores")
    often = hulls.count() / HOT
    hot, others = F.broadcast(cores.where(F.col("hulls") > often).drop("hulls")), cores.where(F.col("hulls") <= often).drop("hulls")  # less than HOT rows
    known = hulls.join(hot, core).unionByName(hulls.join(hot, core, "left_anti").join(others, core))
    out = tagged.join(known, [*core, "hull"])
    out = out.withColumn("open", (F.col("same") == 1) | ((F.col("least") == 1) & (F.col("tag") == F.col("first")))).select(*columns, "same", "open")
    out = save(out, "placed")
    discard(hulls)
    discard(cores)
    release(rows.sparkSession)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            data, runs = text.encode(), []
            for x in sorted(spans or [], key=lambda x: x["start"]):
                if runs and x["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x["end"])
                else:
                    runs.append([x["start"], x["end"]])
            at = [0, *(p for run in runs for p in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
            rows.append((i, len(data), len(data) - len(kept), len(runs), kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Return (doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs (doc_id, text), kept being the UTF-8 bytes that
    no string of LENGTH bytes covers which starts anywhere else, in whichever row.

    A null text is empty. Rows are texts of their own even if their doc_ids are equal or null, so repeated rows of LENGTH bytes
    or more lose everything. Cuts may split characters, so kept is binary. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = documents(docs).withColumn("t", F.xxhash64("text"))
    found = save(rows.where(F.octet_length("text") >= LENGTH).select("id", "t", "text").mapInArrow(_scan, ANCHORS), "found")
    # Saved, so that the join's partitions can be split where many rows have one gram.
    twice = save(found.groupBy("core").count().where("count >= 2").select("core"), "twice")
    dup = save(found.join(twice, "core"), "anchors")
    discard(found)
    discard(twice)
    release(spark)
    placed = _placed(dup, ["core"], ["id", "t", "at", "low", "high"])
    discard(dup)
    whole = lambda df, start: df.where("same >= 2").select("id", "t", F.col(start).alias("start"), (F.col(start) - F.col("low") + F.col("high") + LENGTH).alias("end"))
    spans = whole(placed, "at")
    opened = placed.where("open").groupBy("id", "t").agg(F.collect_set(F.struct("at", "low", "high")).alias("open"))
    contexts = save(rows.join(opened, ["id", "t"]).select("id", "t", "text", "open").mapInArrow(_contexts, "id long, t long, at long, low short, high short, bytes binary"), "contexts")
    release(spark)
    opened = contexts.withColumn("open", F.array(F.struct("low", "high")))
    for step in BLOCKS:
        parts = save(opened.mapInArrow(_blocks(step), "id long, t long, at long, start long, block short, low short, high short, core long, hull long"), "parts")
        blocks = _placed(parts, ["block", "core"], ["id", "t", "at", "start", "low", "high"])
        discard(parts)
        spans = spans.union(whole(blocks, "start"))
        opened = contexts.join(blocks.where("open").groupBy("id", "t", "at").agg(F.collect_set(F.struct("low", "high")).alias("open")), ["id", "t", "at"])
    windows = opened.mapInArrow(_windows, "id long, t long, start long, offset short, d1 long, d2 long")
    windows = save(windows, "windows")
    discard(contexts)
    release(spark)
    equal = windows.groupBy("offset", "d1", "d2").agg(F.count("*").alias("same")).where("same >= 2").select("offset", "d1", "d2")
    spans = spans.union(windows.join(equal, ["offset", "d1", "d2"]).select("id", "t", "start", (F.col("start") + LENGTH).alias("end")))
    spans = save(spans.groupBy("id", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    release(spark)
    return rows.join(spans, ["id", "t"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
