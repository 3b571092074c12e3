"""Token ids in bit-packed files.

A file holds ids in blocks of BLOCK, each id in as few bits as the vocabulary needs, most significant bit first, each block
starting at a byte. Behind them come, as little-endian 64-bit integers, the blocks' byte offsets, the documents' ids, whether
each has one (0 or 1) and the documents' id counts, and at the end the trailer: bits, blocks, documents, ids and MAGIC. So any
id is found from its block's offset without reading others, and whole blocks unpack in numpy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import documents, new_folder, prepare
from keyloom.llm.tokens import encoder

BLOCK = 4096
MAGIC = 0x31534449
#: The id that ends a document.
END = 0


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, filled up to a whole byte."""
    return np.packbits(np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :].ravel()).tobytes()


def unpack_ids(packed: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids that pack_ids wrote."""
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """Writes one file; documents come with add()."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.held, self.n_held, self.at = [], 0, 0
        self.offsets, self.docs, self.counts = [], [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(0, n, BLOCK):
            packed = pack_ids(ids[k : min(k + BLOCK, n)], self.bits)
            self.offsets.append(self.at)
            self.at += self.out.write(packed)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        trailer = [self.bits, len(self.offsets), len(self.docs), sum(self.counts), MAGIC]
        self.out.write(np.array([*self.offsets, *(d or 0 for d in self.docs), *(d is not None for d in self.docs), *self.counts, *trailer], "<i8").tobytes())


class Reader:
    """Reads one file: docs, known (whether they are), counts, and ids(start, n) from any place."""

    def __init__(self, file, size: int):
        file.seek(size - 40)
        self.file = file
        self.bits, blocks, docs, self.n, magic = np.frombuffer(file.read(40), "<i8").tolist()
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        table = size - 40 - 8 * (blocks + 3 * docs)
        file.seek(table)
        whole = np.frombuffer(file.read(8 * (blocks + 3 * docs)), "<i8")
        self.offsets, self.docs, self.known, self.counts = np.append(whole[:blocks], table), *whole[blocks:].reshape(3, docs)

    def ids(self, start: int, n: int) -> np.ndarray:
        if n == 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        self.file.seek(int(self.offsets[first]))
        packed = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        full = min(self.n, (last + 1) * BLOCK) - first * BLOCK
        step = -(-BLOCK * self.bits // 8)
        if step * 8 == BLOCK * self.bits:
            ids = unpack_ids(packed, self.bits, full)
        else:
            ids = np.concatenate([unpack_ids(packed[k * step : (k + 1) * step], self.bits, min(BLOCK, full - k * BLOCK)) for k in range(-(-full // BLOCK))])
        return ids[start - first * BLOCK :][:n]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> list[tuple[str, int, int]]:
    """Write docs (doc_id, text) in ascending doc_id order, a file per range of ids; return (name, documents, ids) of each file in order.

    A null text is an empty one and has only the end id; a null doc_id comes last. Equal doc_ids are ordered by a hash of
    their texts, and may go on in the next file. A task that runs again writes a file of its own; only the names returned count.
    """
    rows = documents(docs).withColumn("th", F.xxhash64("text"))
    prepare(docs.sparkSession)
    shards = max(1, rows.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codec = TaskContext.get().partitionId(), encoder(tokenizer)
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{path.rstrip('/')}/{name}") as out:
            writer = Writer(out, max(1, int(codec.size - 1).bit_length()))
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), codec.encode(batch.column("text").to_pylist()), strict=True):
                    writer.add(doc, np.append(ids, np.uint32(end)))
            writer.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "name": [name], "docs": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([sum(writer.counts)], pa.int64())})

    order = [F.col("doc_id").isNull(), "id", "th"]
    written = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, "shard long, name string, docs long, ids long").collect()  # a row per file
    return [(r.name, r.docs, r.ids) for r in sorted(written, key=lambda r: r.shard)]


def read_token_files(spark, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, start counting over all files in order."""
    prepare(spark)
    bases = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).astype(np.int64)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                with store.open_input_file(f"{path.rstrip('/')}/{files[shard][0]}") as file:
                    reader = Reader(file, file.size())
                    ends = np.cumsum(reader.counts)
                    for k in range(0, len(ends), 256):
                        counts, first = reader.counts[k : k + 256], int(ends[k] - reader.counts[k])
                        ids = reader.ids(first, int(counts.sum())).astype("<u4")
                        at = ends[k : k + 256] - counts - first
                        crcs = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.docs[k : k + 256], mask=reader.known[k : k + 256] == 0), pa.array(at + first + bases[shard]), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.range(0, len(files), 1, max(1, len(files)))
    return shards.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to files in the shared folder and read their table back."""
    folder = new_folder(docs.sparkSession, "token-ids")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, tokenizer, folder))
