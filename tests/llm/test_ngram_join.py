import random
from collections import Counter, defaultdict

import pytest

from reasonloom.llm import ngram_join, queries
from reasonloom.llm.components import components


def brute_force(rows, threshold=0.8):
    """Class (by place of its first row) and links of every row, by all pairs with a common gram."""
    shingler = ngram_join.Shingler(5)
    sets = [frozenset(shingler.grams(text).tolist()) for _, text in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))
    for k, grams in enumerate(sets):
        for g in grams:
            holders[g].append(k)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for k, grams in enumerate(sets):
        shared = Counter(j for g in grams for j in holders[g] if j > k)
        for j, n in shared.items():
            if n / (len(grams) + len(sets[j]) - n) >= threshold:
                links[k] += 1
                links[j] += 1
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return {doc_id: (least[find(k)], links[k]) for k, (doc_id, _) in enumerate(rows)}


def joined(df, cfg=None):
    return {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(df, cfg).collect()}


def near_copies(n, changes, size=120):
    rng = random.Random(n)
    base = [f"word{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
        out.append((k, " ".join(words)))
    return out


def test_query_equals_brute_force(spark, small_dir, small_documents):
    rows = queries.op3_ngram_join(spark, small_dir)
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows.collect()}
    assert got == brute_force([(r.doc_id, r.text) for r in small_documents.collect()])


@pytest.mark.parametrize("block_sets", [512, 16])
def test_a_large_group_of_near_copies(spark, block_sets):
    """In one block, and dealt to pairs of blocks."""
    rows = near_copies(150, 5) + [(1000 + k, t) for k, t in near_copies(60, 2, 30)]
    rows += [(2000 + k, rows[0][1]) for k in range(40)]  # exact copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, ngram_join.JoinConfig(block_sets=block_sets)) == brute_force(rows)


def test_more_blocks_than_texts(spark):
    """Some blocks of a cluster stay empty: no pair is counted for them again."""
    rows = []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(200)]
        texts = [base, [*base[:-1], "last"], ["first", *base[1:]]][: 2 + group % 2]
        rows += [(10 * group + k, " ".join(words)) for k, words in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, ngram_join.JoinConfig(block_grams=150)) == brute_force(rows)


def test_bands_reach_the_recall():
    cfg = ngram_join.JoinConfig()
    bands, rows = ngram_join.choose_bands(cfg)
    assert 1 - (1 - cfg.threshold**rows) ** bands >= cfg.recall
    assert 1 - (1 - cfg.far**rows) ** bands <= cfg.far_rate


def test_minhash_agrees_as_often_as_sets_are_alike():
    import numpy as np

    minhash = ngram_join.MinHash(1000, 1)
    a = ngram_join.mix(np.arange(1000, dtype=np.uint64))
    b = ngram_join.mix(np.arange(200, 1200, dtype=np.uint64))
    same = (minhash.band_values(a) == minhash.band_values(b)).mean()
    assert abs(same - 800 / 1200) < 0.06


@pytest.mark.parametrize("order", ["chain", "reversed", "star", "mixed"])
def test_components(spark, order):
    edges = {
        "chain": [(k, k + 1) for k in range(60)],
        "reversed": [(k + 1, k) for k in range(60)],
        "star": [(k, 0) for k in range(1, 200)],
        "mixed": [(7, 3), (3, 7), (3, 3), (9, 8), (8, 7), (20, 21)],
    }[order]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(df, "a", "b").collect()}
    for a, b in edges:
        assert got[a] == got[b] <= min(a, b)
    assert set(got.values()) == ({3, 20} if order == "mixed" else {0})


def test_one_of_each(spark, small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    wanted = {c for c, _ in brute_force(rows).values()}
    kept = ngram_join.one_of_each(small_documents)
    assert kept.columns == small_documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_odd_rows(odd_documents):
    rows = ngram_join.ngram_join(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    story = [r for r in rows if r.n_links]
    # two rows 4, rows 5, 6 and 10 (upper case), and the null id: one class
    assert len(story) == 6 and {r.class_size for r in story} == {6} and {r.n_links for r in story} == {5}
    kept = ngram_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    # five without words (rows 1, 2, 3, null; "?!. 123" has one) stay, and one of each class
    assert kept.count() == 4 + 1 + 5
    assert ngram_join.ngram_join(odd_documents.limit(0)).count() == 0
    assert ngram_join.one_of_each(odd_documents.limit(0)).count() == 0


def test_recall_just_above_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85, each of its own words: nearly all are found."""
    rnd = random.Random(8)
    rows, alike = [], {}
    for k in range(400):
        words = [f"p{k}w{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 400))]
        changed = list(words)
        while True:
            at = rnd.randrange(len(words))
            before, changed[at] = changed[at], f"p{k}x{rnd.randrange(10**6)}"
            a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, changed))
            share = len(a & b) / len(a | b)
            if share < 0.8:
                changed[at] = before
                break
            alike[k] = share
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    near = {k for k, share in alike.items() if 0.8 <= share <= 0.85}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in ngram_join.ngram_join(docs).collect()}
    found = sum(classes[2 * k] == classes[2 * k + 1] for k in near)
    assert len(near) > 150 and found >= 0.995 * len(near)
    assert all(classes[2 * k] // 2 == k for k in range(400))
