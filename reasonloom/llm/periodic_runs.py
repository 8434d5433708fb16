"""Periodic runs of words: stretches that repeat with a period at least `min_exponent` times.

A run is a maximal stretch of consecutive words in which words one period apart are equal, named
by its least period. The words of many texts are laid one after the other, with a number between
two texts that no other place has, and looked at in three steps:

1. Periods up to `direct` are too short for windows: each such lag is compared word by word.
2. For every scale k = 2, 4, 8 ... times `direct` the hashes of all stretches of k words are made
   from those of the scale before, and the places that hold the least hash of some window of k / 2
   hashes are chosen. A run of period q, k / 2 < q <= k, is at least 4 q long, so windows lie in
   it one period apart and choose places one period apart; between two such places no stretch of k
   words in the run is equal to theirs. So the run has a pair of chosen places of equal hash, next
   to each other among the chosen ones of that hash, at a distance of q.
3. Every such pair is a seed: it is extended to both sides, word by word, as far as the words at
   that distance are equal. Seeds inside a stretch that is known already are skipped.

Stretches of equal bounds are one run, of the least period. Distances of pairs grow with the scale,
so the work is about n log(n)^2 for a text of n words, on arrays; nothing is shuffled.

Defined results: words are runs of characters other than blank and U+0009 to U+000D; a null or empty
text has no word and no run; equal rows have equal results, null ids are kept, an empty table gives
no row; other columns are ignored, whatever their names. A very long text is held whole by its task,
with about 100 bytes a word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches, release_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class RunConfig:
    min_length: int = 6
    min_exponent: int = 4
    direct: int = 16

    def __post_init__(self):
        if self.min_exponent < 4:
            raise ValueError("windows find runs of four periods or more")
        if self.direct < 1 or self.direct & (self.direct - 1):
            raise ValueError("direct must be a power of two")


def _stretches(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of all maximal stretches whose words equal those one lag on."""
    at = np.flatnonzero(words[lag:] == words[:-lag])
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    return (at[first], at[last] + 1) if len(at) else (at, at)


def _windowed(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """`pick` over every `width` (a power of two) neighbouring values."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places whose value is the least of some window."""
    least = _windowed(hashes, width, np.minimum)
    edge = np.zeros(width - 1, hashes.dtype)
    reached = _windowed(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero(hashes == reached)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(29))) * FACTOR
    return x ^ (x >> np.uint64(32))


def _joined(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of stretches twice as long."""
    return _mixed((hashes[:-length] * FACTOR) ^ hashes[length:])


def _agreement(words: np.ndarray, x: int, y: int, step: int) -> int:
    """How many words from x on (step 1) or before x (step -1) equal those at y, for x < y."""
    total, size = 0, 64
    while True:
        if step > 0:
            size = min(size, len(words) - y - total)
            a, b = words[x + total : x + total + size], words[y + total : y + total + size]
        else:
            size = min(size, x - total)
            a, b = (words[p - total - size : p - total][::-1] for p in (x, y))
        unequal = a != b
        if size == 0 or unequal.any():
            return total + (int(unequal.argmax()) if size else 0)
        total, size = total + size, size * 2


def find_runs(words: np.ndarray, longest: np.ndarray, cfg: RunConfig) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of numbered words.

    `longest[i]` is the number of words of text i; texts stand by falling length, each followed by
    a number that occurs nowhere else.
    """
    found = [np.zeros((0, 3), np.int64)]

    def keep(first: np.ndarray, end: np.ndarray, lag: int) -> None:
        length = end - first + lag
        good = length >= max(cfg.min_length, cfg.min_exponent * lag)
        rows = np.stack([first, length, np.full(len(first), lag)], axis=1)
        found.append(rows[good])

    for lag in range(1, min(cfg.direct, len(words) - 1) + 1):
        keep(*_stretches(words, lag), lag)

    ends = np.cumsum(longest + 1)
    hashes, length = _mixed(words.view(np.uint64) + FACTOR), 1
    while True:
        reach = cfg.min_exponent * (max(length, cfg.direct) + 1)
        texts = int(np.searchsorted(-longest, -reach, side="right"))  # long enough for this scale
        if not texts:
            break
        hashes = _joined(hashes[: ends[texts - 1]], length)
        length *= 2
        if length <= cfg.direct:
            continue
        width = length // 2
        chosen = _minimizers(hashes, width)
        order = np.argsort(hashes[chosen], kind="stable")
        at, value = chosen[order], hashes[chosen][order]
        apart = np.diff(at)
        seed = (np.diff(value) == 0) & (apart > width) & (apart <= length)
        known: tuple[int, int] = (0, -1)  # the last stretch: its lag and end
        for lag, place in sorted(zip(apart[seed].tolist(), at[:-1][seed].tolist(), strict=True)):
            if known[0] == lag and place < known[1]:
                continue
            first = place - _agreement(words, place, place + lag, -1)
            known = (lag, place + _agreement(words, place, place + lag, 1))
            keep(np.array([first]), np.array([known[1]]), lag)

    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(split: list[list[str]]) -> np.ndarray:
    """The words of all texts as numbers, equal for equal words, a number of its own after each."""
    numbers = defaultdict(count().__next__)
    total = sum(map(len, split))
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, total)
    ends = np.cumsum([len(words) for words in split])
    return np.insert(flat, ends, -1 - np.arange(len(split)))


def runs_of_texts(texts: list[str | None], cfg: RunConfig) -> tuple[list, list, list]:
    """For each text: its number of words, its runs, and its words without the repetitions."""
    split = [WORD.findall(text) if text else [] for text in texts]
    sizes = np.array([len(words) for words in split])
    order = np.argsort(-sizes, kind="stable")
    words = _numbered([split[k] for k in order])
    rows = find_runs(words, sizes[order], cfg)
    bounds = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, rows[:, 0] + rows[:, 2], 1)
    np.add.at(dropped, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    cuts = np.searchsorted(rows[:, 0], bounds)
    runs: list[list[dict]] = [[] for _ in texts]
    collapsed: list[str] = [""] * len(texts)
    for place, k in enumerate(order.tolist()):
        some = rows[cuts[place] : cuts[place + 1]]
        if len(some):
            begin = int(bounds[place])
            runs[k] = [
                {"start": s - begin, "length": n, "period": q} for s, n, q in some.tolist()
            ]
            stays = np.flatnonzero(kept[begin : begin + sizes[k]])
            collapsed[k] = " ".join([split[k][i] for i in stays.tolist()])
        else:
            collapsed[k] = " ".join(split[k])
    return sizes.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, cfg: RunConfig | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed; a row per row of the table.

    `collapsed` holds the words joined by a blank, without those that a run contains after its
    first period.
    """
    cfg = cfg or RunConfig()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                sizes, runs, collapsed = runs_of_texts([text for _, text in group], cfg)
                columns = [
                    pa.array([doc_id for doc_id, _ in group], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(runs, pa.list_(RUN)),
                    pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    schema = (
        "doc_id long, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return docs.select(doc_id.alias("doc_id"), text.alias("text")).mapInArrow(find, schema)


def longest_run(runs: Column) -> Column:
    """The run of the greatest length, of those the first, of those the one of least period."""
    ranked = F.transform(
        runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length"))
    )
    return F.array_min(ranked)


def digest(found: DataFrame) -> DataFrame:
    """One row per text: the number of runs, the longest one, and digests of runs and words left."""
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    best = longest_run(F.col("runs"))
    rows = found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
