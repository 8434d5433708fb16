"""Packing of documents into sequences of bounded length by swap-based local search.

Documents are tokenized where they are read; only their numbers travel: 40 bytes a piece.
Pieces of full length are sequences of their own. All others are dealt by hash to blocks of
about `block_rows`, each packed by best fit and then improved by exchanges between underfull
bins. Blocks do not exchange pieces, so each may end with underfull sequences of its own.

Defined results: null and empty texts hold the end id alone; repeated rows and repeated or
null ids are packed row by row; an empty table gives no row; other columns are ignored; pieces of
one length may stand for each other, so which of them goes where depends on the order in which they
come. A very long text is encoded whole by its task, and cut into pieces there.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches, shared_encoder
from reasonloom.session import write_once

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long"


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    max_tokens: int = 4096
    end_id: int = 1
    block_rows: int = 8192


def cut_documents(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """A row per piece of at most `max_tokens` ids of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(cfg.tokenizer)
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                out = []
                texts = [text for _, text in group]
                for (doc_id, _), ids in zip(group, encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(cfg.end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), cfg.max_tokens)):
                        part = ids[start : start + cfg.max_tokens]
                        out.append((doc_id, n, start, len(part), zlib.crc32(part.tobytes())))
                columns = [
                    pa.array(values, kind)
                    for values, kind in zip(
                        zip(*out, strict=True),
                        (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                        strict=True,
                    )
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still takes it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        at = bisect_left(free, (length, -1))
        if at == len(free):
            bins.append([item])
            insort(free, (size - length, len(bins) - 1))
        else:
            room, k = free.pop(at)
            bins[k].append(item)
            insort(free, (room - length, k))
    return bins


class LocalSearch:
    """Exchanges between underfull bins, ids moving out of the emptier one.

    Moving d ids from a bin of fill f to one of fill g changes the sum of squared fills by
    2d(g - f + d); only exchanges that increase it are made, the most ids first, from the emptiest
    bin that has one. One or two pieces go out for none or one back, or one for two, over all
    pieces of all bins. The search ends when no bin has an exchange, or at the least number of bins
    there can be.

    Pieces of s ids of a bin with room r give way to any t with s < t <= s + r. So what bins can
    give is kept by s + r, the least s first; what is given for t out of a bin of room q is the
    least s between t and t + q, beyond which the squares would not grow. Pieces of one length in
    one bin are alike, so a bin has no more different pairs than it has ids.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], size: int):
        self.size = size
        self.least = -(-int(lengths.sum()) // size) if len(lengths) else 0
        self.held: list[dict[int, list[int]]] = []  # of each bin, its pieces by length
        for items in bins:
            by_length: dict[int, list[int]] = {}
            for item in items:
                by_length.setdefault(int(lengths[item]), []).append(item)
            self.held.append(by_length)
        self.room = np.array([size - int(lengths[b].sum()) for b in bins], np.int64)
        self.version = [0] * len(bins)
        self.sums: list[dict[int, tuple[int, int]] | None] = [None] * len(bins)
        # for none or one back, and for two: the least s of each s + r, and who offers it
        self.give = np.full((2, size + 1), size + 1, np.int64)
        self.offers: list[list[list[tuple[int, int, int]]]] = [
            [[] for _ in range(size + 1)] for _ in range(2)
        ]
        for k in range(len(bins)):
            self._offer(k)

    def run(self) -> list[list[int]]:
        waiting = np.where([bool(held) for held in self.held], self.room, 0)
        looked = np.zeros(len(self.held), np.int64)  # exchanges made when a bin had none
        filled, made = sum(map(bool, self.held)), 0
        while filled > self.least:
            source = int(waiting.argmax())
            if waiting[source] <= 0:
                again = [bool(held) for held in self.held] & (looked < made)
                waiting = np.where(again, self.room, 0)
                if not waiting.any():
                    break
                continue
            target = self._exchange(source)
            if target is None:
                waiting[source], looked[source] = 0, made
                continue
            made += 1
            for k in (source, target):
                waiting[k] = self.room[k] if self.held[k] else 0
            filled -= not self.held[source]
        return [[i for items in held.values() for i in items] for held in self.held if held]

    def _pairs(self, k: int) -> dict[int, tuple[int, int]]:
        """The different sums of two pieces of a bin, and the lengths of one such pair."""
        found = self.sums[k]
        if found is None:
            own = sorted(self.held[k])
            found = {a + b: (a, b) for i, a in enumerate(own) for b in own[:i]}
            found |= {2 * a: (a, a) for a in own if len(self.held[k][a]) > 1}
            self.sums[k] = found
        return found

    def _offer(self, k: int) -> None:
        room = int(self.room[k])
        if room <= 0 or not self.held[k]:
            return
        for table, sums in enumerate(((0, *self.held[k]), self._pairs(k))):
            give, offers = self.give[table], self.offers[table]
            for s in sums:
                heappush(offers[s + room], (s, k, self.version[k]))
                if s < give[s + room]:
                    give[s + room] = s

    def _withdraw(self, k: int) -> None:
        self.version[k] += 1  # what was offered is passed over where it is met

    def _best_back(self, table: int, low: int, high: int, below: int) -> tuple[int, int] | None:
        """The fewest ids, under `below`, that a bin gives for `low`, and that bin."""
        give, offers = self.give[table], self.offers[table]
        while True:
            at = low + int(give[low:high].argmin())
            if give[at] >= below:
                return None
            heap = offers[at]
            while heap and self.version[heap[0][1]] != heap[0][2]:
                heappop(heap)
            if heap and heap[0][0] == give[at]:
                return heap[0][:2]
            give[at] = heap[0][0] if heap else self.size + 1

    def _exchange(self, source: int) -> int | None:
        """Makes the exchange that moves the most ids out of `source`; its target, if any."""
        self._withdraw(source)
        ones, room = self.held[source], int(self.room[source])
        pairs = self._pairs(source)
        best: tuple[int, int, tuple[int, ...], int, int] = (0, -1, (), 0, 0)
        for total in sorted({*ones, *pairs}, reverse=True):
            if total <= best[0]:
                break
            high = min(total + room, self.size + 1)
            for table in (0, 1) if total in ones else (0,):
                found = self._best_back(table, total, high, total - best[0])
                if found:
                    out = (total,) if total in ones else pairs[total]
                    best = (total - found[0], found[1], out, table, found[0])
        moved, target, out, table, s = best
        if moved <= 0:
            self._offer(source)
            return None
        self._withdraw(target)
        back = self._pairs(target)[s] if table else (s,) if s else ()
        for here, there, what in ((source, target, out), (target, source, back)):
            for length, item in [(length, self._take(here, length)) for length in what]:
                self.held[there].setdefault(length, []).append(item)
        self.room[source] += moved
        self.room[target] -= moved
        for k in (source, target):
            self.sums[k] = None
            self._offer(k)
        return target

    def _take(self, k: int, length: int) -> int:
        items = self.held[k][length]
        item = items.pop()
        if not items:
            del self.held[k][length]
        return item


def pack_lengths(lengths: np.ndarray, size: int) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, size), size).run()


def pack(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """Place every piece of every document in a sequence, gapless from offset 0."""
    pieces = write_once(cut_documents(docs, cfg), "pieces")
    full = F.col("length") == cfg.max_tokens
    alone = pieces.filter(full).select(
        "*",
        (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    short = pieces.filter(~full)
    blocks = max(1, -(-short.count() // cfg.block_rows))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.rand(7)), F.lit(blocks))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, items in enumerate(pack_lengths(lengths, cfg.max_tokens)):
            sequence[items] = (int(key[0]) << 32) + n
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        out = rows.drop(columns="block")
        return out.assign(sequence_id=sequence, offset=offset)

    packed = short.withColumn("block", block).groupBy("block").applyInPandas(fill, PACKED_SCHEMA)
    return packed.unionByName(alone)
