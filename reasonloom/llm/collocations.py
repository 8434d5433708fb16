"""Phrases whose words occur together, counted on a weighted de Bruijn graph per language.

Nodes are stretches of `longest - 1` words, edges those of `longest` words, which overlap in all
but their outer words; the weight of an edge is its number of occurrences.

1. Only edges are counted from the texts, and for words from which no edge leaves, as their piece
   ends too soon, the stretch up to its end. To count less, words and pairs are first counted in
   hashed buckets, then the longer stretches of frequent pairs: a bucket of fewer than `min_count`
   holds no part of a wanted phrase, so a piece may as well end before it. Buckets only ever count
   too much, so no wanted phrase is touched; with too few buckets more is counted for nothing.
2. Shorter stretches are not counted but derived: the flow of a node is the weight of the edges
   that leave it and of the pieces that end in it, and so on down to single words.
3. Unary paths are compacted: where a node has one edge in and one out, of its own weight, the
   two belong to one path. Such nodes are settled, as they always lie in a longer phrase as
   frequent as they are. Paths are ranked by pointer jumping, in rounds that double the distance.
4. A phrase is cut at every place; the cut that speaks least for the phrase counts.

Counts add up before every shuffle. Phrases are shuffled as texts and compared exactly; 64-bit
hashes tell words apart inside a task's block of texts and in the buckets alone.

Defined results: only A to Z are lower-cased; a null text has no word; a null language is `und`;
repeated rows count each time; ties are resolved by the order of UTF-8 bytes; an empty table gives
no row; other columns are ignored. A very long text is cut into blocks at piece ends, a single
piece is held whole by its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches, release_words
from reasonloom.session import write_once

BREAK = re.compile(r"[.,;:!?\n-\r]")
BLANKS = re.compile(r"[ \t]{2,}|\t")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
ROOT = 0xD1342543DE82EF95  # odd, so that it has an inverse
KINDS = np.zeros(256, np.int8)  # of bytes: part of a word, blank, end of a piece
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
VALUES = np.random.default_rng(5).integers(1, 2**64, 256, np.uint64)


@dataclass(frozen=True)
class PhraseConfig:
    longest: int = 4
    min_count: int = 30
    inside: int = 80  # a phrase goes if a longer one has this percentage of its occurrences
    bucket_bits: int = 27  # at least one bucket for every few words of the corpus prunes best
    top_salts: int = 64
    block_chars: int = 2_000_000

    def __post_init__(self):
        if self.longest < 3 or not 16 <= self.bucket_bits <= 30:
            raise ValueError("phrases need three words or more, buckets 16 to 30 bits")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FACTOR
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of ROOT and of its inverse, as many as the longest block needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            factors = np.full(size, ROOT, np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = np.uint64(pow(ROOT, -1, 2**64))
            self.down = np.multiply.accumulate(factors)
        return self.up, self.down


class Block:
    """The words of some texts: their places in lower-cased bytes, pieces, languages and hashes."""

    def __init__(self, rows: list[tuple[str, str]], langs: dict[str, int], powers: Powers):
        texts = [
            BLANKS.sub(" ", text) if "  " in text or "\t" in text else text for _, text in rows
        ]
        encoded = [text.encode() for text in texts]
        self.data = LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
        kinds = KINDS[self.data]
        inside = np.concatenate([[False], kinds == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        pieces = np.cumsum(kinds == 2, dtype=np.int32)[self.starts]
        self.joined = pieces[1:] == pieces[:-1]  # with the next word
        codes = np.array([langs.setdefault(lang, len(langs)) for lang, _ in rows])
        text_ends = np.cumsum([len(e) + 1 for e in encoded])
        self.lang = codes[np.searchsorted(text_ends, self.starts, side="right")]
        up, down = powers.upto(len(self.data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(VALUES[self.data] * up[: len(self.data)])])
        word = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.word = _mixed(word + _mixed(self.lang_hashes(langs)[self.lang]))

    def stretches(self, size: int, first: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the stretches of `size` words from each of these words on, or from every word."""
        if first is None:
            first = np.arange(max(0, len(self.word) - size + 1))
        value = self.word[first]
        for k in range(1, size):
            value = _mixed(value * FACTOR + self.word[first + k])
        return value

    @staticmethod
    def lang_hashes(langs: dict[str, int]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(lang) for lang in langs], np.uint64)

    def texts(self, first: np.ndarray, n: int) -> pa.Array:
        """The stretches of n words from each of these words on, as strings."""
        starts, lengths = self.starts[first], self.ends[first + n - 1] - self.starts[first]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - ends + lengths, lengths)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[at].tobytes())]
        return pa.LargeStringArray.from_buffers(len(first), buffers[1], buffers[2])


def _cut(rows: Iterator[tuple], size: int) -> Iterator[tuple[str, str]]:
    """Texts cut at piece ends into parts of about `size` characters."""
    for lang, text in rows:
        start = 0
        while len(text) - start > size:
            found = BREAK.search(text, start + size)
            if not found:
                break
            yield lang, text[start : found.end()]
            start = found.end()
        yield lang, text[start:]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Block, list[str]]]:
    release_words()
    powers = Powers()
    for batch in batches:
        for rows in char_batches(_cut(arrow_rows(batch), size), size):
            langs: dict[str, int] = {}
            block = Block(rows, langs, powers)
            yield block, list(langs)


def _texts(docs: DataFrame) -> DataFrame:
    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    return docs.select(
        F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text")
    )


class Buckets:
    """Which hashes lie in a bucket of many occurrences; a bit for every bucket."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - int(len(bits) * 64).bit_length() + 1)

    def often(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes >> self.shift).astype(np.int64)
        return (self.bits[bucket >> 6] >> (bucket & 63)) & 1 == 1


CHUNK_BITS = 16  # buckets travel in chunks of 65,536
CHUNKED = "chunk int, gaps binary, counts binary"
MOST = 255  # to which buckets are counted; a larger min_count prunes as if it were this


def _packed(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts above zero, a row per chunk: the gaps between their places, and their values."""
    for chunk, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
        at = np.flatnonzero(part)
        if len(at):
            gaps = np.diff(at, prepend=0).astype(np.uint16).tobytes()
            columns = [pa.array([chunk], pa.int32()), pa.array([gaps]), pa.array([part[at].tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "gaps", "counts"])


def _add(counts: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
    counts[at] = np.minimum(counts[at].astype(np.int64) + more, MOST)


def _count_buckets(
    docs: DataFrame, cfg: PhraseConfig, hashes_of: Callable[[Block], np.ndarray]
) -> np.ndarray:
    """A bit for every bucket with `min_count` or more of the hashes of all blocks.

    A task holds a byte for each bucket and sends what it counted as one row per chunk of buckets;
    rows of a chunk are added up one by one, whatever their number.
    """
    shift = np.uint64(64 - cfg.bucket_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << cfg.bucket_bits, np.uint8)
        for block, _ in _blocks(batches, cfg.block_chars):
            _add(counts, *np.unique(hashes_of(block) >> shift, return_counts=True))
        yield from _packed(counts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, gaps, counts in arrow_rows(batch):
                total = chunks.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.uint8))
                at = np.cumsum(np.frombuffer(gaps, np.uint16), dtype=np.int64)
                _add(total, at, np.frombuffer(counts, np.uint8))
        for chunk, total in chunks.items():
            bits = np.packbits(total >= min(cfg.min_count, MOST), bitorder="little").tobytes()
            columns = [pa.array([chunk], pa.int32()), pa.array([bits])]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "bits"])

    sent = _texts(docs).mapInArrow(count, CHUNKED)
    # one row per chunk reaches the driver: 2 ** bucket_bits bits
    table = sent.repartition("chunk").mapInArrow(add_up, "chunk int, bits binary").toArrow()
    bits = np.zeros((1 << (cfg.bucket_bits - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    for chunk, row in zip(table["chunk"].to_pylist(), table["bits"].to_pylist(), strict=True):
        bits[chunk] = np.frombuffer(row, np.uint8)
    return bits.reshape(-1).view(np.int64)


def _words_and_pairs(block: Block) -> np.ndarray:
    return np.concatenate([block.word, block.stretches(2)[block.joined]])


def _linked(block: Block, short: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Which words are frequent, and which also make a frequent pair with the next word."""
    good = short.often(block.word)
    linked = block.joined & good[1:] & good[:-1]
    linked[linked] = short.often(block.stretches(2, np.flatnonzero(linked)))
    return good, np.append(linked, False)[: len(good)]


def _both(reached: np.ndarray) -> np.ndarray:
    """From which words on a stretch and the one after it are reached."""
    return reached & np.append(reached[1:], False)


def _longer(longest: int, short: np.ndarray) -> Callable[[Block], np.ndarray]:
    """Hashes of all stretches of three words or more whose pairs are all frequent."""

    def hashes(block: Block) -> np.ndarray:
        _, reached = _linked(block, Buckets(short))
        found = [np.zeros(0, np.uint64)]
        for size in range(3, longest + 1):
            reached = _both(reached)
            found.append(block.stretches(size, np.flatnonzero(reached)))
        return np.concatenate(found)

    return hashes


def _frequent_buckets(docs: DataFrame, cfg: PhraseConfig) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and pairs, and those of longer stretches."""
    short = _count_buckets(docs, cfg, _words_and_pairs)
    sent = docs.sparkSession.sparkContext.broadcast(short)  # at most 2 ** bucket_bits bits
    return short, _count_buckets(docs, cfg, lambda block: _longer(cfg.longest, sent.value)(block))


def _grams(docs: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """lang, size, phrase, n: all edges, and the stretches that end a piece; size 0 counts words."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent_buckets(docs, cfg))

    def rows_of(block: Block, names: list[str], size: int, first: np.ndarray) -> pa.RecordBatch:
        value = block.stretches(size, first)
        _, one, counts = np.unique(value, return_index=True, return_counts=True)
        some = first[one]
        columns = [
            pa.array(names, pa.string()).take(pa.array(block.lang[some])),
            pa.array(np.full(len(some), size, np.int32)),
            block.texts(some, size).cast(pa.string()),
            pa.array(counts.astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = map(Buckets, sent.value)
        for block, names in _blocks(batches, cfg.block_chars):
            if not len(block.word):
                continue
            words = np.bincount(block.lang, minlength=len(names))
            columns = [names, [0] * len(names), [""] * len(names), words]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "size", "phrase", "n"])
            # one stretch from every word on, the longest that is frequent as a whole
            shorter, reached = _linked(block, short)
            for size in range(2, cfg.longest + 1):
                if size > 2:
                    reached = _both(shorter)
                    at = np.flatnonzero(reached)
                    reached[at] = long.often(block.stretches(size, at))
                yield rows_of(block, names, size - 1, np.flatnonzero(shorter & ~reached))
                shorter = reached
            yield rows_of(block, names, cfg.longest, np.flatnonzero(shorter))

    made = _texts(docs).mapInArrow(gram, "lang string, size int, phrase string, n long")
    return made.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _first(phrase: str | Column, words: int | Column) -> Column:
    return F.substring_index(phrase, " ", words)


def _rest(phrase: str) -> Column:
    return F.expr(f"substr({phrase}, instr({phrase}, ' ') + 1)")


@dataclass(frozen=True)
class Graph:
    """counts: lang, size, phrase, n of every phrase of min_count; words: lang, n of all words;
    links: lang, phrase, next: pairs of edges around a node of a unary path."""

    counts: DataFrame
    words: DataFrame
    links: DataFrame


def build_graph(docs: DataFrame, cfg: PhraseConfig | None = None) -> Graph:
    """Count the edges, derive all shorter counts from the flow, and find the unary nodes."""
    cfg = cfg or PhraseConfig()
    grams = write_once(_grams(docs, cfg), "grams")
    level = edges = grams.filter(F.col("size") == cfg.longest).select("lang", "phrase", "n")
    levels = [edges.withColumn("size", F.lit(cfg.longest))]
    for size in range(cfg.longest - 1, 0, -1):
        leaving = level.select("lang", _first("phrase", size).alias("phrase"), "n")
        ending = grams.filter(F.col("size") == size).select("lang", "phrase", "n")
        flow = leaving.unionByName(ending).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = write_once(flow, f"flow-{size}")
        levels.append(level.withColumn("size", F.lit(size)))
    counts = levels[0]
    for more in levels[1:]:
        counts = counts.unionByName(more)
    counts = counts.filter(F.col("n") >= cfg.min_count).select("lang", "size", "phrase", "n")
    counts = write_once(counts, "counts")

    often = counts.filter(F.col("size") == cfg.longest).select("lang", "phrase", "n")
    nodes = counts.filter(F.col("size") == cfg.longest - 1)
    nodes = nodes.select("lang", F.col("phrase").alias("node"), "n")
    into = often.select("lang", "phrase", _rest("phrase").alias("node"), "n")
    out = often.select(
        "lang", F.col("phrase").alias("next"), _first("phrase", cfg.longest - 1).alias("node"), "n"
    )
    # a node of as many occurrences as an edge has no other edge on that side, and no piece's end
    key = ["lang", "node", "n"]
    links = into.join(nodes, key).join(out, key).select("lang", "phrase", "next", "node")
    words = grams.filter(F.col("size") == 0).select("lang", "n")
    return Graph(counts, words, write_once(links, "links"))


def ranked_edges(graph: Graph) -> DataFrame:
    """lang, head, place, phrase: the edges of all unary paths of two edges or more.

    Paths have no cycle: a piece that walks into one could not leave it, as none ends there.
    """
    heads = graph.links.select("lang", F.col("phrase").alias("phrase")).unionByName(
        graph.links.select("lang", F.col("next").alias("phrase"))
    )
    before = graph.links.select("lang", F.col("next").alias("phrase"), F.col("phrase").alias("head"))
    step = heads.distinct().join(before, ["lang", "phrase"], "left").select(
        "lang",
        "phrase",
        F.coalesce("head", "phrase").alias("head"),
        F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("place"),
    )
    while True:
        step = write_once(step, "ranks")
        further = step.filter("place > 0").select(
            "lang",
            F.col("phrase").alias("head"),
            F.col("head").alias("further"),
            F.col("place").alias("more"),
        )
        moved = step.join(further, ["lang", "head"], "left").select(
            "lang",
            "phrase",
            F.coalesce("further", "head").alias("head"),
            (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
        )
        if step.join(further, ["lang", "head"], "left_semi").isEmpty():
            return step
        step = moved


def passages(graph: Graph, cfg: PhraseConfig | None = None) -> DataFrame:
    """lang, passage, n_words, n: every compacted path, the longest stretches always continued
    alike, with the occurrences of each of its edges. A path is no longer than a piece."""
    longest = (cfg or PhraseConfig()).longest
    edges = graph.counts.filter(F.col("size") == longest).select("lang", "phrase", "n")
    ranks = ranked_edges(graph)
    placed = edges.join(ranks, ["lang", "phrase"], "left").select(
        "lang",
        "n",
        F.coalesce("head", "phrase").alias("head"),
        F.struct(
            F.coalesce("place", F.lit(0)).alias("place"),
            F.substring_index("phrase", " ", -1).alias("word"),
        ).alias("step"),
    )
    paths = placed.groupBy("lang", "head").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list("step")).alias("steps")
    )
    last = F.transform(F.expr("slice(steps, 2, size(steps))"), lambda s: s["word"])
    return paths.select(
        "lang",
        F.array_join(F.concat(F.array("head"), last), " ").alias("passage"),
        (F.size("steps") + longest - 1).cast("long").alias("n_words"),
        "n",
    )


def _inner(longest: int) -> Column:
    """All stretches of two words or more that are shorter than `phrase`."""
    words = F.split("phrase", " ")
    parts = [
        F.when(F.size(words) >= at + size + (at == 0), F.array_join(F.slice(words, at + 1, size), " "))
        for size in range(2, longest)
        for at in range(longest - size + 1)
    ]
    return F.array_compact(F.array(*parts))


def score(graph: Graph, cfg: PhraseConfig | None = None) -> DataFrame:
    """lang, phrase, a, l, r, score, path_words of all candidates that no longer phrase covers.

    `path_words` is the number of words of the unary path that the phrase's edge lies on; of a
    shorter phrase, its own words.
    """
    cfg = cfg or PhraseConfig()
    counts = graph.counts
    candidates = counts.filter("size >= 2")
    settled = graph.links.select("lang", F.col("node").alias("phrase"))
    open_ = candidates.join(settled, ["lang", "phrase"], "left_anti")
    inner = candidates.filter("size >= 3").select(
        "lang", F.explode(_inner(cfg.longest)).alias("phrase"), "n"
    )
    covers = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    exact = "decimal(38, 0)"
    covered = F.col("longer").cast(exact) * 100 >= F.col("n").cast(exact) * cfg.inside
    left = open_.join(covers, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | ~covered
    )
    cuts = left.select(
        "lang",
        "phrase",
        "size",
        F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    )
    cuts = cuts.withColumns(
        {
            "head": F.expr("substring_index(phrase, ' ', k)"),
            "tail": F.expr("substring_index(phrase, ' ', k - size)"),
        }
    )
    l_of = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    r_of = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    value = F.expr("cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) div (l + r)")
    scored = cuts.join(l_of, ["lang", "head"]).join(r_of, ["lang", "tail"])
    best = scored.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut")
    )
    ranks = ranked_edges(graph)
    lengths = ranks.groupBy("lang", "head").agg((F.count("*") + cfg.longest - 1).alias("path_words"))
    on_path = ranks.join(lengths, ["lang", "head"]).select("lang", "phrase", "path_words")
    return best.join(on_path, ["lang", "phrase"], "left").select(
        "lang",
        "phrase",
        "a",
        "cut.l",
        "cut.r",
        "cut.score",
        F.coalesce("path_words", F.col("size").cast("long")).alias("path_words"),
    )


def top_phrases(graph: Graph, first: int, cfg: PhraseConfig | None = None) -> DataFrame:
    """The first phrases of each language by `score`, with `rank` from 1 and `n`, the words of the
    language. Ranked in salted parts first, so no task ranks all phrases of a language."""
    scored = score(graph, cfg)
    salts = (cfg or PhraseConfig()).top_salts
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    part = Window.partitionBy("lang", salt).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = some.withColumn("rank", F.row_number().over(whole).cast("long"))
    return ranked.filter(F.col("rank") <= first).join(graph.words, "lang")
