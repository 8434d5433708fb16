import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reasonloom.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    words = WORD.findall(text or "")
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, duplicates, len(covered)


def test_query_equals_plain_python(spark, small_dir, small_documents):
    texts = {r.doc_id: r.text for r in small_documents.collect()}
    rows = queries.op5_quality_rules(spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        measures = base_measures(texts[r.doc_id])
        assert tuple(r)[1:6] == measures
        assert r.base_failed == (measures[0] < 50 or 100 * measures[4] > 50 * measures[0])
        assert not (r.base_failed and r.kept)


def test_good_documents_are_kept(spark, medium_dir):
    labels = spark.read.parquet(f"{medium_dir}/labels.parquet").filter("quality = 1")
    rows = queries.op5_quality_rules(spark, medium_dir).join(labels, "doc_id")
    assert rows.filter("NOT base_failed AND NOT kept").isEmpty()


TEXTS = [
    None, "", " ", "a", "a b", "a b c", "a b c a b c", "a b c d a b c", "x x x x x", "a b c x a b c b c x",
    "l\nl\nl", "l\n\n\nm\nl", "a\x0bb\x0cc\rd\te", "\u00a0 \u2003 word", "\ud7ff\U0001f600 x", "# $ % & | < > *",
    "one\n one\none\n", "w " * 3000, " ".join(f"w{i % 50}" for i in range(2000)),
]


def test_measures_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in quality.measure(rows, "text").collect()}
    assert got == {k: base_measures(t) for k, t in enumerate(TEXTS)}


def test_the_order_follows_rejections_and_cost_but_not_the_verdict(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 60), "id").alias("text")
    )
    slow = F.length(F.repeat(F.sha2(F.repeat("text", 300), 512), 50)) < 0
    rules = [
        quality.Rule("never", lambda c: slow),
        quality.Rule("half", lambda c: F.col("doc_id") % 2 == 0),
        quality.Rule("few", lambda c: F.col("doc_id") % 100 == 1),
    ]
    order = [r.name for r in quality.rule_order(rows, F.col("text"), rules)]
    assert order[-1] == "never" and order.index("half") < order.index("few")
    verdicts = [
        rows.filter(quality.cascade(given, F.col("text")).isNull()).count()
        for given in (rules, rules[::-1])
    ]
    assert verdicts == [980, 980]


def test_rows_leave_the_cascade_at_the_first_rule_they_fail(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rules = [
        quality.Rule("first", lambda c: F.col("doc_id") == 1),
        quality.Rule("bomb", lambda c: F.raise_error(F.lit("evaluated")).isNull() & (F.col("doc_id") == 1)),
    ]
    one = rows.filter("doc_id = 1").select(quality.cascade(rules, F.col("text")).alias("v"))
    assert one.first().v == "first"
    with pytest.raises(Exception):
        rows.select(quality.cascade(rules, F.col("text"))).collect()


def test_base_rules_in_the_cascade(spark, medium_dir, odd_documents):
    """`keep_good` and `assess` agree, whatever the order of the rules."""
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    wanted = sorted(r.doc_id for r in quality.assess(docs).filter("kept").collect())
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == wanted
    cfg = quality.QualityConfig()
    prepared, _, name = quality._with_words(quality.measure(docs, "text"), "text")
    words = F.col(name)
    rules = (*quality.base_rules(cfg), *quality.RULES)
    for given in (rules, rules[::-1]):
        verdict = quality.cascade(given, F.coalesce("text", F.lit("")), words)
        assert sorted(r.doc_id for r in prepared.filter(verdict.isNull()).collect()) == wanted
    bounds = prepared.select("n_repeat_words", quality.most_repeated_words(words).alias("most"))
    assert bounds.filter("n_repeat_words > most").isEmpty()


def test_repeats_are_judged_exactly(spark):
    single = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    rows = [(k, " ".join(single[: 100 - k] + ["xxx yyy zzz"] * k)) for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    for k, text in rows:
        n, *_, repeats = base_measures(text)
        assert (k in kept) == (100 * repeats <= 50 * n)


def test_other_scripts(spark):
    hindi = "\u092f\u0939 \u090f\u0915 \u0938\u093e\u0927\u093e\u0930\u0923 \u0935\u093e\u0915\u094d\u092f \u0939\u0948 \u091c\u093f\u0938\u092e\u0947\u0902 \u0915\u0908 \u0936\u092c\u094d\u0926 \u0939\u0948\u0902 "
    chinese = "".join(chr(0x4E00 + (i * 37) % 5000) + ("\uff0c " if i % 17 == 16 else "") for i in range(1700))
    latin = " ".join("x" * 15 + f"y{i}" for i in range(80))
    rows = [(1, " ".join(f"{hindi}{chr(0x0915 + i % 20)}{chr(0x0915 + i // 20)}" for i in range(12))), (2, chinese), (3, latin)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = quality.measure(docs, "text").select("doc_id", quality.cascade(quality.RULES, F.col("text")).alias("v"))
    assert {r.doc_id: r.v for r in verdicts.collect()} == {1: None, 2: None, 3: "long words"}


def test_odd_rows(odd_documents):
    rows = quality.assess(odd_documents)
    assert rows.count() == odd_documents.count()
    kept = quality.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == rows.filter("kept").count() > 0
    assert quality.assess(odd_documents.limit(0)).count() == 0
    assert quality.keep_good(odd_documents.limit(0)).count() == 0


def test_native_plan(small_documents):
    plan = quality.assess(small_documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
