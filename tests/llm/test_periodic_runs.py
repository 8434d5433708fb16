"""Runs against a plain comparison of all lags."""

import hashlib
import random
import re
import zlib

import pytest

from reasonloom.llm import periodic_runs, queries
from reasonloom.llm.periodic_runs import RunConfig, runs_of_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_left(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def random_words(rnd, n):
    words = [str(rnd.randrange(rnd.choice([1, 2, 3, 60]))) for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n > 8 else 0):
        a = rnd.randrange(n)
        q = rnd.randint(1, max(1, (n - a) // rnd.randint(3, 9)))
        for i in range(a, rnd.randint(a, n)):
            words[i] = words[a + (i - a) % q]
    return words


@pytest.mark.parametrize("direct", [1, 2, 4, 16])
def test_random_texts(direct):
    rnd = random.Random(direct)
    for _ in range(150):
        texts = [random_words(rnd, rnd.randint(0, 300)) for _ in range(rnd.randint(1, 5))]
        sizes, runs, left = runs_of_texts([" ".join(t) for t in texts], RunConfig(direct=direct))
        assert sizes == [len(t) for t in texts]
        for words, found, kept in zip(texts, runs, left, strict=True):
            wanted = plain_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in found] == wanted
            assert kept == plain_left(words, wanted)


def test_long_texts_have_all_scales():
    text = ["a"] * 50_000 + ["b", "c"] * 20_000 + [str(i % 9_001) for i in range(40_000)]
    _, runs, _ = runs_of_texts([" ".join(text)], RunConfig())
    assert [tuple(r.values()) for r in runs[0]] == [
        (0, 50_000, 1), (50_000, 40_000, 2), (90_000, 40_000, 9_001)
    ]


def test_arguments():
    for wrong in ({"min_exponent": 3}, {"direct": 12}, {"direct": 0}):
        with pytest.raises(ValueError):
            RunConfig(**wrong)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_left(words, runs)))
    return (doc_id, len(runs), *first, *digests, len(words))


def test_query(spark, small_dir):
    rows = queries.op12_periodic_runs(spark, small_dir)
    assert dict(rows.dtypes)["runs_sha256"] == "string"
    assert {kind for _, kind in rows.dtypes} == {"bigint", "string"}
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(expected(d["doc_id"], d["text"]) for d in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, odd_documents):
    found = periodic_runs.digest(periodic_runs.periodic_runs(queries.with_runs(odd_documents)))
    key = lambda r: tuple((x is None, x) for x in r)
    texts = odd_documents.select("doc_id", "text").collect()
    short = [r for r in texts if len(r["text"] or "") < 100_000]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(texts)
    wanted = [expected(*r) for r in short]
    assert sorted((r for r in got if r[0] != 7), key=key) == sorted(wanted, key=key)
    empty = odd_documents.limit(0)
    assert periodic_runs.digest(periodic_runs.periodic_runs(empty)).count() == 0
