"""Phrases and passages against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reasonloom.llm import collocations
from reasonloom.llm.collocations import PhraseConfig

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_counts(rows, longest=4):
    totals, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    return totals, counts


def plain_top(rows, cfg, first):
    totals, counts = plain_counts(rows, cfg.longest)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= cfg.min_count and len(p) > 1}
        covered = set()
        for p, longer in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * longer >= cfg.inside * f[p[i : i + size]]:
                        covered.add(p[i : i + size])
        found = []
        for p in candidates.keys() - covered:
            cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            phrase = " ".join(p)
            found.append((-score, -f[p], phrase.encode(), phrase, f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase, -a, left, right, totals[lang], -score))
    return sorted(out)


def top(docs, cfg, first=2000):
    found = collocations.top_phrases(collocations.build_graph(docs, cfg), first, cfg)
    return sorted(map(tuple, found.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    words = ["the", "of", "Of", "new", "york", "città", "naïve", "x", "a-b", "q#", "İz"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", " ? ", ""]
    passage = "to be or not to be that is the question whether it is nobler in the mind"
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rnd.randint(0, 30)):
            parts += [rnd.choice(words), rnd.choice(marks[:2] if rnd.random() < 0.8 else marks)]
        if i % 3 == 0:
            parts += [" ; ", passage, " ", rnd.choice(words)]
        rows.append((i, "".join(parts) or None, rnd.choice(["en", "it", None, "und"])))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("longest", [3, 5])
def test_random_corpus(corpus, longest):
    rows, docs = corpus
    cfg = PhraseConfig(longest=longest, min_count=5, top_salts=3)
    wanted = plain_top([(lang, text) for _, text, lang in rows], cfg, 40)
    assert top(docs, cfg, 40) == wanted and len(wanted) > 60


def test_buckets_and_blocks_change_nothing(corpus):
    rows, docs = corpus
    wanted = top(docs, PhraseConfig(min_count=5))
    assert top(docs, PhraseConfig(min_count=5, bucket_bits=16, block_chars=300)) == wanted


def test_full_buckets_change_nothing(corpus, monkeypatch):
    _, docs = corpus
    wanted = top(docs, PhraseConfig(min_count=5))
    full = lambda docs, cfg: (collocations.np.full(2**cfg.bucket_bits // 64, -1),) * 2
    monkeypatch.setattr(collocations, "_frequent_buckets", full)
    assert top(docs, PhraseConfig(min_count=5, bucket_bits=16)) == wanted


def plain_passages(rows, cfg):
    """Unary paths walked edge by edge."""
    _, counts = plain_counts(rows, cfg.longest)
    out = []
    for lang, f in counts.items():
        edges = {p: a for p, a in f.items() if len(p) == cfg.longest and a >= cfg.min_count}
        after = {}
        for e, a in edges.items():
            for g, b in edges.items():
                if e[1:] == g[:-1] and a == b == f[e[1:]]:
                    after[e] = g
        for e in edges.keys() - set(after.values()):
            path, words = e, list(e)
            while path in after:
                path = after[path]
                words.append(path[-1])
            out.append((lang, " ".join(words), len(words), edges[e]))
    return sorted(out)


def test_passages(corpus):
    rows, docs = corpus
    cfg = PhraseConfig(min_count=5)
    found = collocations.passages(collocations.build_graph(docs, cfg), cfg)
    got = sorted(map(tuple, found.collect()))
    assert got == plain_passages([(lang, text) for _, text, lang in rows], cfg)
    assert max(r[2] for r in got) >= 15


def test_odd_rows(spark, odd_documents):
    cfg = PhraseConfig(min_count=2)
    rows = [(r["lang"], r["text"]) for r in odd_documents.collect()]
    assert top(odd_documents, cfg) == plain_top(rows, cfg, 2000)
    empty = collocations.build_graph(odd_documents.limit(0))
    assert collocations.score(empty).count() == 0 and collocations.passages(empty).count() == 0


def test_counts_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000 // 4
    rows = [("en", 2, "a b", big), ("en", 1, "a", 2 * big), ("en", 1, "b", 2 * big - 1)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    words = spark.createDataFrame([("en", 4 * big)], "lang string, n long")
    links = spark.createDataFrame([], "lang string, phrase string, next string, node string")
    found = collocations.score(collocations.Graph(counts, words, links)).first()
    assert found["score"] == 2_000_000 * big // (4 * big - 1)


def test_arguments():
    for wrong in ({"longest": 2}, {"bucket_bits": 40}):
        with pytest.raises(ValueError):
            PhraseConfig(**wrong)


def test_a_hot_phrase(corpus):
    rows, docs = corpus
    hot = docs.withColumn("text", F.lit("the the the the the"))
    cfg = PhraseConfig(min_count=5)
    assert top(hot, cfg) == plain_top([(r[2], "the the the the the") for r in rows], cfg, 2000)
