"""Similarity self-join of texts by the Jaccard measure of their word n-grams.

1. One pass over the texts: the set of n-gram hashes, its key, and MinHash values in bands;
   numbers of bands and rows follow from the threshold and the recall wanted.
2. The band values are shuffled. A bucket of several different sets links each of them to the
   least one, never to each other: the edges grow with the members of a bucket, not their pairs.
3. Sets connected by buckets form a cluster. Inside it all pairs are verified on their full
   n-gram sets, also those that no bucket holds. Small clusters share a task; a large one is
   dealt to blocks and each pair of blocks is a task of its own, so no task holds a whole
   cluster, and a task returns one row per set and not the pairs.
4. Verified links make the classes.

Equal n-gram sets are one node whatever their number, so copies are never paired.

Defined results: words are runs of letters, digits and underscores in lower case; a text of
fewer than n words has one n-gram of all its words; a text without words (null, empty) links to
nothing and is a class of its own; repeated rows are copies of each other; null ids are kept; an
empty table gives no row; other columns are ignored. Texts are told apart by 64-bit hashes. A very
long text is one set of n-grams, held whole by a task; of equal ids the row of least hash stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.columns import fresh
from reasonloom.llm.components import components
from reasonloom.llm.tokens import arrow_rows, char_batches, release_words
from reasonloom.session import write_once

WORD = re.compile(r"\w+")
SIGNED = np.int64
MAX_WORDS = 400_000  # whose hashes a task remembers
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JoinConfig:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    far: float = 0.3  # texts no more alike than this should seldom meet
    far_rate: float = 0.1
    block_sets: int = 512
    block_grams: int = 500_000
    salts: int = 32


def choose_bands(cfg: JoinConfig) -> tuple[int, int]:
    """The fewest rows, and bands for the recall at the threshold, at which few far pairs meet."""
    rows = 1
    while True:
        bands = math.ceil(math.log(1 - cfg.recall) / math.log(1 - cfg.threshold**rows))
        if 1 - (1 - cfg.far**rows) ** bands <= cfg.far_rate:
            return bands, rows
        rows += 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * FACTOR
    return (x ^ (x >> np.uint64(29))) * FACTOR


class Shingler:
    """Sorted distinct n-gram hashes of texts; remembers the hashes of words seen."""

    def __init__(self, n: int, max_words: int = MAX_WORDS):
        self.n, self.max_words = n, max_words
        self.known: dict[str, int] = {}

    def grams(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = total * FACTOR + hashed[k : len(hashed) - n + 1 + k]
        return np.unique(mix(total))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = (bands * rows, 1)
        self.a = rng.integers(1, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size, np.uint64)
        self.bands, self.rows = bands, rows
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def band_values(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max)
        for start in range(0, len(grams), 4096):
            some = grams[start : start + 4096]
            least = np.minimum(least, (some * self.a + self.b).min(axis=1))
        value = self.salt.copy()
        for column in least.reshape(self.bands, self.rows).T:
            value = mix(value * FACTOR + column)
        return value.view(SIGNED)


def _columns(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), row_key().alias("row_key"), text.alias("text"))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def signatures(docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    """doc_id, row_key, set_id (null without words), n_grams, band values; a row per document."""
    bands, rows = choose_bands(cfg)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        shingler, minhash = Shingler(cfg.n), MinHash(bands, rows)
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                ids, sizes, values = [], [], []
                for *_, text in group:
                    grams = shingler.grams(text)
                    sizes.append(len(grams))
                    key = xxhash.xxh3_64_intdigest(grams.tobytes()) if len(grams) else None
                    ids.append(None if key is None else key - 2**63)
                    values.append(minhash.band_values(grams) if len(grams) else None)
                columns = [
                    pa.array([row[0] for row in group], pa.int64()),
                    pa.array([row[1] for row in group], pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(values, pa.list_(pa.int64())),
                ]
                names = ["doc_id", "row_key", "set_id", "n_grams", "bands"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, row_key long, set_id long, n_grams int, bands array<long>"
    return _columns(docs).mapInArrow(sign, schema)


def bucket_edges(signed: DataFrame) -> DataFrame:
    """Every set of a bucket of several sets, with the least set of that bucket."""
    members = signed.filter("set_id is not null").select(
        "set_id", F.explode("bands").alias("bucket")
    )
    least = members.groupBy("bucket").agg(
        F.min("set_id").alias("least"), F.max("set_id").alias("most")
    )
    shared = least.filter("least <> most").select("bucket", "least")
    met = members.join(shared, "bucket").filter("set_id <> least")
    return met.select("set_id", "least").distinct()


def _grams_of(rows: DataFrame, cfg: JoinConfig) -> DataFrame:
    """set_id, cluster, copies, n_blocks, text -> the same with the n-gram set for the text."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        shingler = Shingler(cfg.n)
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                columns = [
                    pa.array([row[k] for row in group], pa.int64()) for k in range(4)
                ]
                grams = [shingler.grams(row[-1]).view(SIGNED) for row in group]
                columns.append(pa.array(grams, pa.list_(pa.int64())))
                names = ["set_id", "cluster", "copies", "n_blocks", "grams"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "set_id long, cluster long, copies long, n_blocks long, grams array<long>"
    return rows.mapInArrow(shingle, schema)


def _shared_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set but the last, the sizes of its intersections with all later ones."""
    sizes = np.array([len(s) for s in sets])
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(numbers.max() + 1, np.int32)
    for i in range(len(sets) - 1):
        own = numbers[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        later = starts[i + 1]
        yield i, np.add.reduceat(marked[numbers[later:]], starts[i + 1 :] - later)
        marked[own] = 0


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def verified(
    sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, threshold: float, across: bool
):
    """Links of each set, counted in copies of its partners, and a spanning forest of the links.

    `side` tells blocks apart; with `across` only pairs of two blocks are looked at, so there is
    none if all sets are of one block.
    """
    sizes = np.array([len(s) for s in sets])
    links = np.zeros(len(sets), np.int64)
    parent = list(range(len(sets)))
    hook = list(range(len(sets)))
    some = len(sets) > 1 and not (across and len(set(side.tolist())) == 1)
    for i, shared in _shared_counts(sets) if some else ():
        union = sizes[i] + sizes[i + 1 :] - shared
        linked = shared / union >= threshold
        if across:
            linked &= side[i + 1 :] != side[i]
        partners = np.flatnonzero(linked) + i + 1
        links[i] += copies[partners].sum()
        links[partners] += copies[i]
        for j in partners.tolist():
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                hook[max(a, b)] = min(a, b)
    return links, hook


def verify(candidates: DataFrame, n_sets: int, cfg: JoinConfig) -> DataFrame:
    """set_id, links, and one other set of the same class (or itself), a row per set and task."""
    units = max(1, -(-n_sets // cfg.block_sets))
    own = F.pmod(F.xxhash64("set_id"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))).alias("other")
    dealt = _grams_of(candidates, cfg).select("*", own.alias("side"), other)
    small = F.col("n_blocks") == 1
    unit = F.pmod(F.xxhash64("cluster"), F.lit(units))
    dealt = dealt.select(
        "set_id",
        "cluster",
        "copies",
        "grams",
        "side",
        F.when(small, unit).otherwise(F.col("cluster")).alias("unit"),
        F.when(small, -1).otherwise(F.least("side", "other")).alias("p"),
        F.when(small, -1).otherwise(F.greatest("side", "other")).alias("q"),
    )

    def check(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, p, q = key  # blocks that differ: pairs inside either belong to its own task
        out = []
        for _, part in rows.groupby("cluster", sort=False):
            sets = [g.view(np.uint64) for g in part["grams"]]
            copies, side = part["copies"].to_numpy(), part["side"].to_numpy()
            links, hook = verified(sets, copies, side, cfg.threshold, across=p != q)
            ids = part["set_id"].to_numpy()
            out.append(pd.DataFrame({"set_id": ids, "links": links, "partner": ids[hook]}))
        return pd.concat(out)

    schema = "set_id long, links long, partner long"
    return dealt.groupBy("unit", "p", "q").applyInPandas(check, schema)


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The text of each member set, from one of its documents."""
    wanted = members.select("set_id", "cluster", "copies", "n_blocks", "sample.row_key")
    # a merge join at every size: the plan does not turn with the size of either side
    found = _columns(docs).hint("merge").join(wanted, "row_key").dropDuplicates(["row_key"])
    return found.select("set_id", "cluster", "copies", "n_blocks", "text")


def _join_sets(docs: DataFrame, cfg: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and each n-gram set with its class and links."""
    signed = write_once(signatures(docs, cfg), "signatures")
    sets = (
        signed.filter("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.count("*").alias("copies"),
            F.max("n_grams").alias("n_grams"),
            F.min(F.struct("doc_id", "row_key")).alias("sample"),
        )
    )
    clusters = components(bucket_edges(signed), "set_id", "least").select(
        F.col("node").alias("set_id"), F.col("label").alias("cluster")
    )
    members = write_once(sets.join(clusters, "set_id"), "members")
    n_blocks = F.greatest(
        F.ceil(F.count("*") / cfg.block_sets), F.ceil(F.sum("n_grams") / cfg.block_grams)
    )
    blocks = members.groupBy("cluster").agg(n_blocks.cast("long").alias("n_blocks"))
    # the few large clusters meet their many members under a salt, so no task gets all of one
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cfg.salts - 1).cast("long"))).alias("salt")
    large = blocks.filter("n_blocks > 1").select("cluster", "n_blocks", salts)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(cfg.salts)))
    dealt = salted.join(large, ["cluster", "salt"], "left").withColumn(
        "n_blocks", F.coalesce("n_blocks", F.lit(1).cast("long"))
    )
    candidates = _with_texts(docs, dealt.drop("salt"))
    checked = write_once(verify(candidates, members.count(), cfg), "verified")

    links = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    labels = components(checked.filter("set_id <> partner"), "set_id", "partner").select(
        F.col("node").alias("set_id"), "label"
    )
    known = sets.join(links, "set_id", "left").join(labels, "set_id", "left")
    known = known.select(
        "set_id",
        "copies",
        "sample",
        F.coalesce("label", "set_id").alias("label"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return signed, write_once(known, "sets")


def ngram_join(docs: DataFrame, cfg: JoinConfig | None = None) -> DataFrame:
    """doc_id, class_id (least document id of the class), n_links, class_size; a row per document.

    `n_links` counts the other documents, copies included, of at least the threshold.
    """
    signed, sets = _join_sets(docs, cfg or JoinConfig())
    classes = sets.groupBy("label").agg(
        F.min("sample.doc_id").alias("class_id"), F.sum("copies").alias("class_size")
    )
    of_sets = sets.join(classes, "label").select("set_id", "class_id", "n_links", "class_size")
    rows = signed.select("doc_id", "set_id").join(of_sets, "set_id")
    alone = signed.filter("set_id is null").select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("class_size"),
    )
    return rows.select("doc_id", "class_id", "n_links", "class_size").unionByName(alone)


def one_of_each(docs: DataFrame, cfg: JoinConfig | None = None) -> DataFrame:
    """One row of each class, that of the least document id; texts without words all stay."""
    signed, sets = _join_sets(docs, cfg or JoinConfig())
    key = fresh(docs, "row_key")
    chosen = sets.groupBy("label").agg(F.min("sample").alias("s")).select("s.row_key")
    wordless = signed.filter("set_id is null").select("row_key").distinct()
    keyed = docs.withColumn(key, row_key())
    first = keyed.join(chosen.withColumnRenamed("row_key", key), key, "left_semi")
    others = keyed.join(wordless.withColumnRenamed("row_key", key), key, "left_semi")
    return first.dropDuplicates([key]).unionByName(others).select(*docs.columns)
