"""Token ids in files of compressed byte or bit planes with a chunk index.

A file holds the documents of one range of ids in order. Its ids are cut into chunks of
`chunk_ids`; a chunk is transposed into planes (the n-th bytes, or the n-th bits, of all its
ids), and each plane is compressed with zstandard on its own, so the nearly empty upper planes
cost nothing. The documents' ids and lengths and the place and size of every plane follow, then
a footer with their sizes. `manifest.parquet` beside the files names the file that counts for
each range and the number of ids before it: a task tried twice leaves a file nobody reads.

Files are written through the file system of the folder's address, from the tasks.

Defined results: null and empty texts hold the end id alone; rows with one document id follow
each other by a hash of their text; null ids come first; an empty table gives a manifest
without files; other columns are ignored. A very long text is encoded whole by its task, and its
ids go to as many chunks as they fill.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches, shared_encoder

MAGIC = b"BPLANES1"
NO_ID = -(2**63)  # stands for a null document id inside a file
FILE_SCHEMA = "part int, file string, n_docs long, n_ids long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class BinaryConfig:
    tokenizer: str
    end_id: int = 2
    chunk_ids: int = 65_536
    bits: bool = False
    level: int = 3


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes, lowest first, or the bit planes of unsigned 32-bit ids."""
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        table = np.unpackbits(table, axis=1, bitorder="little")
        return [np.packbits(column).tobytes() for column in table.T]
    return [column.tobytes() for column in table.T]


def from_planes(planes: list[bytes], n_ids: int, bits: bool) -> np.ndarray:
    columns = [np.frombuffer(p, np.uint8) for p in planes]
    if bits:
        unpacked = np.stack([np.unpackbits(c, count=n_ids) for c in columns], axis=1)
        table = np.packbits(unpacked, axis=1, bitorder="little")
    else:
        table = np.stack(columns, axis=1)
    return np.ascontiguousarray(table).view("<u4").reshape(-1)


class PlaneWriter:
    def __init__(self, sink, cfg: BinaryConfig):
        self.sink, self.cfg = sink, cfg
        self.packer = zstandard.ZstdCompressor(level=cfg.level)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.at = len(MAGIC)
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.chunks: list[list[int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.cfg.chunk_ids:
            self._flush(whole_only=True)

    def _put(self, data: bytes) -> list[int]:
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.at += len(packed)
        return [self.at - len(packed), len(packed)]

    def _flush(self, whole_only: bool) -> None:
        ids, size = np.concatenate(self.waiting), self.cfg.chunk_ids
        end = len(ids) // size * size if whole_only else len(ids)
        for start in range(0, end, size):
            chunk = ids[start : min(start + size, end)]
            places = [self._put(p) for p in to_planes(chunk, self.cfg.bits)]
            self.chunks.append([len(chunk), *(x for place in places for x in place)])
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        if self.held:
            self._flush(whole_only=False)
        index = {
            "bits": self.cfg.bits,
            "docs": self._put(np.array(self.docs, "<i8").tobytes()),
            "lengths": self._put(np.array(self.lengths, "<i8").tobytes()),
            "chunks": self._put(np.array(self.chunks, "<i8").tobytes()),
            "n_chunks": len(self.chunks),
        }
        footer = json.dumps(index).encode()
        self.sink.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class PlaneReader:
    def __init__(self, source):
        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        end = source.size()
        tail = self._at(end - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a file of id planes")
        size = struct.unpack("<I", tail[:4])[0]
        self.index = json.loads(self._at(end - 12 - size, size))
        self.docs = self._numbers("docs")
        self.lengths = self._numbers("lengths")
        self.chunks = self._numbers("chunks").reshape(self.index["n_chunks"], -1)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def _numbers(self, name: str) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(self._at(*self.index[name])), "<i8")

    def chunk(self, k: int) -> np.ndarray:
        """The ids of one chunk, read on its own."""
        n_ids, *places = self.chunks[k].tolist()
        planes = [
            self.unpacker.decompress(self._at(a, n))
            for a, n in zip(places[::2], places[1::2], strict=True)
        ]
        return from_planes(planes, n_ids, self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """Document id, number of ids and their crc32, holding one chunk at a time."""
        k, chunk, at = -1, np.zeros(0, "<u4"), 0
        for doc_id, length in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            crc, left = 0, length
            while left:
                if at == len(chunk):
                    k, at = k + 1, 0
                    chunk = self.chunk(k)
                part = chunk[at : at + left]
                crc = zlib.crc32(part.tobytes(), crc)
                at, left = at + len(part), left - len(part)
            yield (None if doc_id == NO_ID else doc_id), length, crc


def write_ids(docs: DataFrame, folder: str, cfg: BinaryConfig) -> DataFrame:
    """Write all documents in ascending id order below `folder`; returns the manifest."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        encoder = shared_encoder(cfg.tokenizer)
        writer = None
        end = np.array([cfg.end_id], np.uint32)
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}")
                    writer = PlaneWriter(sink, cfg)
                texts = [text for _, text in group]
                for (doc_id, _), ids in zip(group, encoder.encode(texts), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": part, "file": name, "n_docs": len(writer.docs), "n_ids": writer.n_ids}
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array([v], t) for v, t in zip(row.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, list(row))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    files = sorted(ordered.select("doc_id", "text").mapInArrow(write, FILE_SCHEMA).collect())
    before, entries = 0, []
    for row in files:  # a row per file
        entries.append((row["part"], row["file"], row["n_docs"], row["n_ids"], before))
        before += row["n_ids"]
    schema = f"{FILE_SCHEMA}, start long"
    manifest = spark.createDataFrame(entries, schema)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest.parquet")
    return manifest


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document, from the files: place among all ids, length and crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                with store.open_input_file(f"{root}/{entry['file']}") as source:
                    reader = PlaneReader(source)
                    found = list(reader.documents())
                lengths = np.array([n for _, n, _ in found], np.int64)
                starts = np.cumsum(lengths) - lengths + entry["start"]
                for a in range(0, len(found), 10_000):
                    some = found[a : a + 10_000]
                    columns = [
                        pa.array([d for d, _, _ in some], pa.int64()),
                        pa.array(starts[a : a + 10_000]),
                        pa.array(lengths[a : a + 10_000]),
                        pa.array([c for _, _, c in some], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    manifest = spark.read.parquet(f"{folder}/manifest.parquet").select("file", "start")
    tasks = max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 64))
    return manifest.repartition(tasks).mapInArrow(read, READ_SCHEMA)
