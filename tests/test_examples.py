"""Golden numbers, edge rows, and an independent emulation of the example rules."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import emulation
from reasonloom.functions import losses
from reasonloom.functions import text as T
from reasonloom.operators import batching, examples, scores, spans, vocab
from reasonloom.plans import queries
from reasonloom.plans.reasoning import SYSTEM_PROMPT, reasoning

# the tokenizers run in Spark's workers
cloudpickle.register_pickle_by_value(emulation)
cloudpickle.register_pickle_by_value(sys.modules[__name__])
CFG = examples.ExampleConfig(max_length=256, system_prompt=SYSTEM_PROMPT)
COLUMNS = "example_id long, problem string, generated_solution string"

# solution, think tokens, answer tokens, status; counts only where the row is usable
EDGES = [
    ("q", r"<think>a</think> \boxed{5}", 1, 1, "ok"),
    ("q", "5", None, None, "no_boxed"),
    ("q", None, None, None, "no_boxed"),
    ("q", r"<think>a \boxed{5}", None, None, "think_unclosed"),
    ("q", r"a</think>\boxed{5}", None, None, "think_orphan_end"),
    ("q", r"a \boxed{5}", 0, 1, "ok"),
    ("q", r"<think>a</think>\boxed{}", None, None, "answer_unmapped"),
    ("q", r"\boxed{\frac{1}{2}}", 0, 4, "ok"),
    ("q", r"\boxed{1} \boxed{2}", 0, 1, "ok"),
    ("q", r"</think><think>a</think>\boxed{5}", 1, 1, "ok"),
    ("q", r"<think></think>\boxed{5}", 0, 1, "ok"),
    ("q", r"<think>\boxed{1}</think>\boxed{2}", 5, 1, "ok"),
    ("q", r"<think>a</think><think>b</think>\boxed{5}", 1, 1, "ok"),
    (r"q <think> \boxed{9}", r"<think>a b c d a b c d</think>\boxed{x + 1}", 8, 3, "ok"),
    (None, "<think>a b c d</think>\\boxed{\U0001f600 7}", 4, 2, "ok"),
    ("q", "\\boxed{a\nb}", 0, 2, "ok"),
    ("w " * 300, r"<think>a</think> \boxed{5}", None, None, "answer_unmapped"),
    ("q", r"\boxed{5", None, None, "no_boxed"),
    ("q", r"\boxed{<think>} \boxed{1}", None, None, "think_unclosed"),
    ("q", "  \\boxed{  7  }", 0, 1, "ok"),
]


@pytest.fixture(scope="module")
def edge_rows(spark):
    rows = [(i, problem, solution) for i, (problem, solution, *_) in enumerate(EDGES)]
    return spark.createDataFrame(rows, COLUMNS)


def test_edge_rows(edge_rows):
    made = examples.build_examples(edge_rows, CFG).orderBy("example_id").collect()
    for row, (_, _, n_think, n_answer, status) in zip(made, EDGES):
        assert row.status == status
        if status == "ok":
            assert (row.n_think, row.n_ans) == (n_think, n_answer)


def agrees(row, wanted):
    assert row.tokens == wanted["tokens"]
    assert row.target_start == wanted["start"]
    assert row.n_tgt == wanted["n_tgt"]
    assert row.status == wanted["status"]
    assert row.n_think == len(wanted["think"])
    assert row.n_ans == len(wanted["answer"])
    if wanted["think"]:
        assert row.think_open + 1 == wanted["think"][0]
    if wanted["answer"]:
        assert list(range(row.answer_lo, row.answer_hi)) == wanted["answer"]


@pytest.mark.parametrize("prompt", [SYSTEM_PROMPT, examples.DEFAULT_SYSTEM_PROMPT, None])
def test_edge_rows_against_emulation(edge_rows, prompt):
    # The default prompt has think tags and a box of its own; they must not count.
    for row in examples.build_examples(edge_rows, examples.ExampleConfig(256, prompt)).collect():
        agrees(row, emulation.example(row.problem, row.generated_solution, 256, prompt))


@pytest.mark.parametrize("length", [256, 1024])
def test_whole_texts_against_emulation(spark, medium_dir, length):
    cfg = examples.ExampleConfig(max_length=length, system_prompt=SYSTEM_PROMPT)
    made = examples.build_examples(reasoning(spark, medium_dir), cfg).collect()
    assert len(made) == 1000
    for row in made:
        agrees(row, emulation.example(row.problem, row.generated_solution, length, SYSTEM_PROMPT))


def test_callers_tokenizer_gives_the_same_examples(edge_rows):
    cfg = examples.ExampleConfig(
        max_length=256, system_prompt=SYSTEM_PROMPT, tokenizer=emulation.spans
    )
    own = examples.build_examples(edge_rows, CFG).orderBy("example_id").collect()
    given = examples.build_examples(edge_rows, cfg).orderBy("example_id").collect()
    for a, b in zip(own, given):
        same = ("tokens", "target_start", "n_tgt", "n_think", "n_ans", "status", "think_open")
        assert [a[c] for c in same] == [b[c] for c in same]
        if a.n_ans:
            assert (a.answer_lo, a.answer_hi) == (b.answer_lo, b.answer_hi)


def with_specials(text):
    """A tokenizer that puts special tokens around every text."""
    return [("<s>", 0, 0), *emulation.spans(text), ("</s>", len(text), len(text))]


def test_special_tokens_of_a_callers_tokenizer(edge_rows):
    cfg = examples.ExampleConfig(256, SYSTEM_PROMPT, with_specials, "<s>")
    made = examples.build_examples(edge_rows, cfg).collect()
    for row in made:
        wanted = emulation.example(row.problem, row.generated_solution, 255, SYSTEM_PROMPT)
        assert row.tokens[:1] == ["<s>"]
        assert [t for t in row.tokens[1:] if t != "</s>"] == wanted["tokens"]
        assert row.target_start == wanted["start"] + 1
        assert (row.n_think, row.n_ans) == (len(wanted["think"]), len(wanted["answer"]))
        assert row.status == wanted["status"]


@pytest.mark.parametrize("tokenizer, bos", [(None, None), (emulation.spans, None), (with_specials, "<s>")])
def test_arrays(edge_rows, tokenizer, bos):
    cfg = examples.ExampleConfig(256, SYSTEM_PROMPT, tokenizer, bos)
    made = examples.build_examples(edge_rows, cfg)
    rows = examples.example_arrays(made, cfg).collect()
    for row in rows:
        arrays = (row.input_ids, row.labels, row.loss_mask, row.answer_mask, row.think_mask)
        assert {len(a) for a in (*arrays, row.attention_mask)} == {256}
        assert row.labels == row.input_ids
        assert row.input_ids[: row.n_tok] == row.tokens
        assert set(row.input_ids[row.n_tok :]) <= {examples.PAD}
        assert sum(row.attention_mask) == row.n_tok
        assert sum(row.loss_mask) == row.n_tgt
        assert sum(row.think_mask) == row.n_think
        assert sum(row.answer_mask) == row.n_ans
        for mask in (row.answer_mask, row.think_mask):
            assert all(target for inside, target in zip(mask, row.loss_mask) if inside)


def test_encoded_arrays(edge_rows):
    made = examples.build_examples(edge_rows, CFG)
    words = vocab.build_vocab(vocab.token_rows(made))
    ids = {r.token: r.id for r in words.collect()}
    assert [ids[t] for t in vocab.RESERVED] == [0, 1, 2, 3, 4]
    assert sorted(ids.values()) == list(range(len(ids)))
    encoded = vocab.encode_examples(made, words)
    for row in examples.example_arrays(encoded, CFG, "token_ids").collect():
        assert row.input_ids == [ids[t] for t in row.tokens] + [0] * (256 - row.n_tok)


def test_empty_prompt_is_no_prompt(edge_rows):
    with_empty = examples.render_prompt(edge_rows, "").select("prompt").collect()
    assert with_empty == examples.render_prompt(edge_rows, None).select("prompt").collect()
    assert with_empty[0].prompt == "Question: q\n"


def test_spans_cover_the_text(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    wanted = {r.doc_id: emulation.spans(r.text) for r in rows.collect()}
    got = {}
    for r in spans.token_spans(rows, "text", "doc_id").orderBy("doc_id", "i").collect():
        assert r.i == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.token, r.s, r.e))
    assert got == {k: v for k, v in wanted.items() if v}


def test_spans_stop_at_max_length(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet")
    every = spans.token_spans(rows, "text", "doc_id").filter("i < 20")
    first = spans.token_spans(rows, "text", "doc_id", max_length=20)
    assert first.exceptAll(every).isEmpty() and every.exceptAll(first).isEmpty()


def test_spans_of_null_and_empty_text(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, " a ")], "k long, t string")
    got = spans.token_spans(rows, "t", "k").collect()
    assert [tuple(r) for r in got] == [(4, 0, "a", 1, 2)]


WORD_CASES = [
    None, "", " ", "a", " a", "a ", " a  b ", "a\x1cb", "a\x85b", "a\xa0b", "a\u3000b\u2003c",
    "a\u200bb", "\x0b\x0c", "a\ufeffb c", "\u1680x\u2028y\u2029z\u202f\u205fw",
]


def test_words_are_pythons_words(spark):
    rows = spark.createDataFrame(list(enumerate(WORD_CASES)), "k int, t string")
    for row in rows.select("t", T.word_count("t").alias("n"), T.word_count_bound("t").alias("b")).collect():
        assert row.n == len((row.t or "").split())
        assert row.n <= row.b


NUMBERS = {
    "0.9": 0.9, "1": 1.0, "1.": 1.0, ".5": 0.5, "-2e3": -2000.0, "+1.5E-1": 0.15, "n/a": None,
    "": None, "0.9d": None, "0.9f": None, "0x1p0": None, "1_0": None, "NaN": None, "inf": None,
    " 1": None, "0.9\n": None, None: None,
}


def test_lenient_cast(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    for row in rows.select("t", T.to_number("t").alias("x")).collect():
        assert row.x == NUMBERS[row.t]


# Golden numbers of the shorter variant of the corpus (1,200 characters), worked out beforehand.


@pytest.fixture(scope="module")
def golden(spark, medium_dir):
    return examples.build_examples(reasoning(spark, medium_dir, 1200), CFG)


def test_golden_statuses(golden):
    got = {r.status: r.n for r in examples.example_report(golden).collect()}
    assert got == {
        "ok": 338,
        "think_unclosed": 222,
        "answer_unmapped": 219,
        "no_boxed": 154,
        "think_orphan_end": 67,
    }


def test_golden_vocabulary(golden):
    # Plain tokens that occur, plus the reserved ones whether they occur or not.
    words = vocab.build_vocab(vocab.token_rows(golden))
    assert words.filter("n is not null").count() == 34230


def test_golden_batch_scores(golden):
    usable, token_losses = queries.score_input_of(golden)
    rows = scores.combined(usable, token_losses, "batch_id").collect()
    assert len(rows) == 50

    def mean(name):
        return round(sum(r[name] for r in rows) / len(rows), 6)

    assert abs(mean("base") - 8.04892) < 5e-6
    assert mean("eff") == 0.222433
    assert mean("rep") == 0.245705
    assert mean("total") == 8.083449


def test_golden_batches(golden):
    placed = batching.assign_batches(batching.assign_shards(golden, 2, 42), 4)
    assert placed.select("shard", "batch_id").distinct().count() == 250
    kept = batching.collate(placed, CFG)
    assert kept.count() == 250 - 49
    assert kept.agg(F.sum("n_kept")).first()[0] == 338


def test_golden_cross_entropy(spark, medium_dir):
    rows = spark.read.parquet(f"{medium_dir}/embeddings.parquet").filter("vec_id < 2")
    got = rows.select("vec_id", losses.token_ce("embedding", "label").alias("ce")).collect()
    assert [round(r.ce, 6) for r in sorted(got)] == [4.20329, 4.296138]


PARTS = [
    "<think>", "</think>", "<answer>", "</answer>", "\\boxed{", "\\boxed", "{", "}", "a", "bc", "1",
    " ", "  ", "\n", "\x85", "　", "<", "think>", "</", "\\", "é", "é", "\U0001f600",
    "中文", ".",
]


@pytest.mark.parametrize("length", [5, 12, 60])
def test_random_texts_against_emulation(spark, length):
    draw = random.Random(length)

    def text(n):
        return "".join(draw.choice(PARTS) for _ in range(draw.randrange(n)))

    rows = [
        (i, draw.choice([None, text(4)]), draw.choice([text(12), text(40), "\\boxed{" + text(9)]))
        for i in range(1500)
    ]
    cfg = examples.ExampleConfig(max_length=length)
    made = examples.build_examples(spark.createDataFrame(rows, COLUMNS), cfg).collect()
    for row in made:
        agrees(row, emulation.example(row.problem, row.generated_solution, length))
    if length == 60:
        assert {row.status for row in made} == {
            "ok", "no_boxed", "think_unclosed", "think_orphan_end", "answer_unmapped",
        }
