"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A seed is the hash of the words that a mask selects from a stretch of text; the words between
them are ignored. The two masks are chosen so that every window of 13 words in which at most two
differ holds an equal seed of at least one mask (`tests/llm` counts all cases). Documents and
benchmark are joined on seeds, and each hit is verified word by word on the whole window.

Before the join, a document's words and seeds are looked up in two Bloom bitmaps, literals of the
plan, that let every true seed pass. Each is sized by its number of keys, 16 bits for one, within
2^17 to 2^`most_bits` bits, so at most 8 MiB; up to four million keys about one in 200 other seeds
passes, beyond that more, and the join drops them. Equal benchmark windows are one before the join,
whatever the number of items that hold them; those are looked up for the windows found. All of it
is native expressions; a document is read once, and only its seeds that pass travel.

Defined results: words are runs of letters and digits in lower case; an item of 8 to 12 words is
one window and must match exactly, a shorter one is not looked for; null and empty texts match
nothing; repeated rows and null ids are treated alike; a window of several items counts for each of
them; empty tables give no match; other columns are ignored or, by `keep_clean`, kept; a very long
text is one row, whose words a task holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.columns import fresh
from reasonloom.llm.ngram_join import row_key

PROBES = (0, 19, 38)  # the shifts of a 64-bit key that give its places in a bitmap
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))


@dataclass(frozen=True)
class SeedConfig:
    window: int = 13
    substitutions: int = 2
    min_words: int = 8
    masks: tuple[tuple[int, ...], ...] = MASKS
    least_bits: int = 17  # of a bitmap: 2^17 bits are 16 KiB
    most_bits: int = 26


def hashed_words(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _computed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """With a column that later filters cannot write out again: a one-row generator holds it."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _slots(key: Column, bits: int) -> list[tuple[Column, Column]]:
    """Word and bit of the places of a key in a bitmap."""
    places = [
        F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in PROBES
    ]
    return [(F.shiftright(p, 6).cast("int"), p.bitwiseAND(F.lit(63)).cast("int")) for p in places]


@dataclass(frozen=True)
class Bitmap:
    bits: int
    longs: Column  # a literal array of 2^(bits - 6) longs

    def holds(self, key: Column) -> Column:
        """True for every key of the bitmap, and for few others."""
        tests = [F.getbit(F.get(self.longs, word), bit) == 1 for word, bit in _slots(key, self.bits)]
        return reduce(Column.__and__, tests)


def bitmap_bits(n_keys: int, cfg: SeedConfig) -> int:
    """16 bits for a key, within the bounds."""
    return min(max((16 * n_keys).bit_length(), cfg.least_bits), cfg.most_bits)


def bitmap(keys: DataFrame, key: str, cfg: SeedConfig) -> Bitmap:
    """The bits of all keys; at most 2^(most_bits - 6) longs reach the driver."""
    distinct = keys.select(key).distinct()
    bits = bitmap_bits(distinct.count(), cfg)
    one = F.lit(1).cast("long")
    places = F.array(
        *(
            F.struct(word.alias("word"), F.call_function("shiftleft", one, bit).alias("bit"))
            for word, bit in _slots(F.col(key), bits)
        )
    )
    set_bits = distinct.select(F.inline(places)).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = set_bits.toArrow()
    longs = ["0"] * (1 << (bits - 6))
    for word, value in zip(table["word"].to_pylist(), table["bits"].to_pylist(), strict=True):
        longs[word] = str(value)
    return Bitmap(bits, F.split(F.lit(",".join(longs)), ",").cast("array<bigint>"))


def _seed(mask_no: int, mask: tuple[int, ...], words: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(mask_no), *(F.get(words, at + offset) for offset in mask))


def item_windows(bench: DataFrame, cfg: SeedConfig) -> DataFrame:
    """item_id, window: the hashes of the words of each window of each item."""
    rows = bench.select(F.col("item_id").cast("long"), "text")
    items = _computed(rows, hashed_words(F.col("text")), "words")
    n = F.size("words")
    last = F.greatest(n - cfg.window, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last), lambda s: F.slice("words", s + 1, F.lit(cfg.window))
    )
    return items.filter(n >= cfg.min_words).select("item_id", F.explode(windows).alias("window"))


def benchmark_seeds(windows: DataFrame, cfg: SeedConfig) -> DataFrame:
    """key, offset of the seed in its window, window."""
    n = F.size("window")
    per_mask = []
    for k, mask in enumerate(cfg.masks):
        last = n - mask[-1] - 1
        offsets = F.when(last < 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        )
        per_mask.append(F.transform(offsets, _make_seed(k, mask, F.col("window"))))
    seeds = F.explode(F.concat(*per_mask)).alias("seed")
    return windows.select("window", seeds).select("window", F.col("seed.key"), F.col("seed.offset"))


def _make_seed(k: int, mask: tuple[int, ...], words: Column):
    return lambda at: F.struct(_seed(k, mask, words, at).alias("key"), at.alias("offset"))


def _all_known(known: Column, mask: tuple[int, ...]):
    def test(at: Column) -> Column:
        passed = F.get(known, at)
        for offset in mask[1:]:
            passed = passed & F.get(known, at + offset)
        return passed

    return test


def document_seeds(docs: DataFrame, words_map: Bitmap, seeds_map: Bitmap, cfg: SeedConfig) -> DataFrame:
    """doc_id, row_key, key, place of the seed, and the words around it from `low` on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    rows = _computed(rows, hashed_words(F.col("text")), "words").drop("text")
    known = F.transform("words", words_map.holds)
    rows = _computed(rows.filter(F.size("words") >= cfg.min_words), known, "known")
    reach = cfg.window - 1 - min(mask[-1] for mask in cfg.masks)
    around = cfg.window + reach
    per_mask = []
    for k, mask in enumerate(cfg.masks):
        last = F.size("words") - mask[-1] - 1
        places = F.when(last < 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        )
        likely = F.filter(places, _all_known(F.col("known"), mask))
        per_mask.append(F.transform(likely, _make_seed(k, mask, F.col("words"))))
    seeds = F.filter(F.concat(*per_mask), lambda seed: seeds_map.holds(seed["key"]))

    def with_words(seed: Column) -> Column:
        low = F.greatest(seed["offset"] - reach, F.lit(0))
        near = F.slice("words", low + 1, F.lit(around))
        return F.struct(
            seed["key"].alias("key"),
            seed["offset"].alias("place"),
            low.alias("low"),
            near.alias("near"),
        )

    return rows.select("doc_id", "row_key", F.inline(F.transform(seeds, with_words)))


def window_matches(docs: DataFrame, bench: DataFrame, cfg: SeedConfig) -> DataFrame:
    """doc_id, row_key, window, first_word, matched; once or more for each place of a window in a
    document row."""
    windows = item_windows(bench, cfg).select("window").distinct().persist()
    try:
        seeds = benchmark_seeds(windows, cfg)
        words_map = bitmap(windows.select(F.explode("window").alias("key")), "key", cfg)
        seeds_map = bitmap(seeds, "key", cfg)
    finally:
        windows.unpersist()
    hits = document_seeds(docs, words_map, seeds_map, cfg).join(seeds, "key")
    begin = F.col("place") - F.col("offset")
    inside = F.col("near")
    n = F.size("window")
    there = F.slice(inside, F.greatest(begin - F.col("low"), F.lit(0)) + 1, n)
    same = F.zip_with(there, F.col("window"), lambda a, b: F.when(a == b, 1).otherwise(0))
    equal = F.aggregate(same, F.lit(0), lambda total, x: total + x)
    allowed = F.when(n < cfg.window, 0).otherwise(cfg.substitutions)
    found = hits.filter(begin >= F.col("low")).select(
        "doc_id",
        "row_key",
        "window",
        begin.alias("first_word"),
        equal.alias("matched"),
        (n - allowed).alias("least"),
    )
    return found.filter("matched >= least")


def contaminated(docs: DataFrame, bench: DataFrame, cfg: SeedConfig | None = None) -> DataFrame:
    """doc_id, item_id, first_word (of the first window), matched (most equal words of a window); a
    row for every item of which a document holds a window."""
    cfg = cfg or SeedConfig()
    first, most = F.min("first_word").cast("long"), F.max("matched").cast("long")
    found = window_matches(docs, bench, cfg).groupBy("doc_id", "window").agg(
        first.alias("first_word"), most.alias("matched")
    )
    rows = found.join(item_windows(bench, cfg).distinct(), "window")
    return rows.groupBy("doc_id", "item_id").agg(
        first.alias("first_word"), most.alias("matched")
    )


def keep_clean(docs: DataFrame, bench: DataFrame, cfg: SeedConfig | None = None) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark is found, unchanged."""
    key = fresh(docs, "row_key")
    found = window_matches(docs, bench, cfg or SeedConfig())
    found = found.select(F.col("row_key").alias(key)).distinct()
    kept = docs.withColumn(key, row_key()).join(found.hint("shuffle_hash"), key, "left_anti")
    return kept.select(*docs.columns)
