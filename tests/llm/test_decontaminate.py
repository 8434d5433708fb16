import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from reasonloom.llm import decontaminate, queries

WORD = re.compile(r"[^\W_]+")


def brute_force(documents, items):
    """(doc_id, item_id) -> first word and most equal words, over all windows of both sides."""
    windows = defaultdict(set)
    for item_id, text in items:
        words = WORD.findall(text.lower())
        for s in range(max(1, len(words) - 12)):
            window = tuple(words[s : s + 13])
            if len(window) >= 8:
                windows[window].add(item_id)
    held = defaultdict(set)
    for window in windows:
        for k, word in enumerate(window):
            held[k, word].add(window)
    found = {}
    for doc_id, text in documents:
        words = WORD.findall((text or "").lower())
        for s in range(len(words)):
            equal = Counter(w for k in range(13) if s + k < len(words) for w in held[k, words[s + k]])
            for window, n in equal.items():
                if n >= (11 if len(window) == 13 else len(window)) and s + len(window) <= len(words):
                    for key in ((doc_id, item_id) for item_id in windows[window]):
                        first, most = found.get(key, (s, 0))
                        found[key] = min(first, s), max(most, n)
    return found


def found_by(docs, bench):
    rows = decontaminate.contaminated(docs, bench).collect()
    return {(r.doc_id, r.item_id): (r.first_word, r.matched) for r in rows}


def test_every_window_with_two_substitutions_holds_a_seed():
    cfg = decontaminate.SeedConfig()
    for changed in combinations(range(cfg.window), cfg.substitutions):
        assert any(
            not any(at + k in changed for k in mask)
            for mask in cfg.masks
            for at in range(cfg.window - mask[-1])
        )


def test_query_equals_brute_force(spark, small_dir, small_documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    documents = [(r.doc_id, r.text) for r in small_documents.select("doc_id", "text").collect()]
    rows = queries.op6_decontamination(spark, small_dir).collect()
    got = {(r.doc_id, r.item_id): (r.first_word, r.matched) for r in rows}
    assert got == brute_force(documents, items)


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(common, k=rng.choice([7, 8, 12, 13, 14, 30])))) for k in range(30)]
    items += [(100, items[0][1]), (101, items[5][1].upper())]  # repeated items
    documents = []
    for k in range(80):
        _, passage = rng.choice(items)
        words = passage.lower().split()
        cut = rng.randrange(0, max(1, len(words) - 12))
        words = words[cut : cut + rng.choice([12, 13, 20, 40])]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        around = rng.choices(common, k=rng.randrange(30))
        documents.append((k, " ".join([*around, *words, *rng.choices(common, k=rng.randrange(20))])))
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute_force(documents, items)
    assert found_by(docs, bench) == wanted and len(wanted) > 20
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert kept == {k for k, _ in documents} - {k for k, _ in wanted}


def test_every_item_of_a_window(spark):
    """Copies of an item and items within others are found as well, each with its own windows."""
    words = [f"w{k}" for k in range(40)]
    items = [(1, words[:30]), (2, words[:30]), (3, words[10:25]), (4, words[20:]), (5, words[:9])]
    items = [(k, " ".join(w)) for k, w in items]
    documents = [(1, " ".join(["x", *words[8:26]])), (2, " ".join(words)), (3, "none of it")]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    got = {(r.doc_id, r.item_id): (r.first_word, r.matched) for r in rows}
    wanted = {}
    for item in items:  # each by itself
        wanted |= brute_force(documents, [item])
    assert got == wanted and len(rows) == len(wanted)
    assert {k for _, k in got} == {1, 2, 3, 4, 5}


def test_bitmaps_grow_with_the_benchmark(spark):
    cfg = decontaminate.SeedConfig()
    sizes = [decontaminate.bitmap_bits(n, cfg) for n in (0, 5_000, 10_000, 500_000, 4_000_000, 10**9)]
    assert sizes == [17, 17, 18, 23, 26, 26]
    keys = spark.range(500_000).select(F.xxhash64("id").alias("key"))
    made = decontaminate.bitmap(keys, "key", cfg)
    assert made.bits == 23 and keys.filter(~made.holds(F.col("key"))).isEmpty()
    others = spark.range(10**6, 10**6 + 200_000).select(F.xxhash64("id").alias("key"))
    assert others.filter(made.holds(F.col("key"))).count() < 0.02 * 200_000


def test_a_large_benchmark_lets_few_seeds_pass(spark):
    """Half a million different words: clean documents of these words send under a seed in 25 words."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), word_of), " ")
    bench = spark.range(4_000).select(F.col("id").alias("item_id"), text.alias("text"))
    docs = spark.range(10**6, 10**6 + 500).select(F.col("id").alias("doc_id"), text.alias("text"))
    cfg = decontaminate.SeedConfig()
    windows = decontaminate.item_windows(bench, cfg).select("window").distinct()
    seeds = decontaminate.benchmark_seeds(windows, cfg)
    words_map = decontaminate.bitmap(windows.select(F.explode("window").alias("key")), "key", cfg)
    seeds_map = decontaminate.bitmap(seeds, "key", cfg)
    passed = decontaminate.document_seeds(docs, words_map, seeds_map, cfg).count()
    assert passed < 500 * 200 / 25


def word_of(k):
    return F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(500_000)).cast("string"))


def test_odd_rows(spark, odd_documents):
    story = odd_documents.filter("doc_id = 6").first().text
    items = [(1, None), (2, ""), (3, "too short for it"), (None, None), (4, " ".join(story.split()[40:60]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(odd_documents, bench).collect()
    assert {r.doc_id for r in got} == {4, 5, 6, None, 10} and {r.item_id for r in got} == {4}
    kept = decontaminate.keep_clean(odd_documents, bench)
    assert kept.columns == odd_documents.columns
    assert kept.count() == odd_documents.count() - 6
    for docs, items in ((odd_documents.limit(0), bench), (odd_documents, bench.limit(0))):
        assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.keep_clean(odd_documents, bench.limit(0)).count() == odd_documents.count()


def test_native_plan(spark, small_documents, small_dir):
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    found = decontaminate.contaminated(small_documents, bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
