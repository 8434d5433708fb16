import numpy as np
import pytest

from reasonloom.llm import langid, queries


def plain_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        moves = best[:, None] - penalty * (1 - np.eye(len(best)))
        back.append(moves.argmax(axis=0))
        best = moves.max(axis=0) + row
    return best.max()


def value(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (path[1:] != path[:-1]).sum()


@pytest.mark.parametrize("size", [1, 3, 128])
def test_paths_are_best_whatever_the_blocks(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        lengths = rng.integers(1, 30, rng.integers(1, 8))
        scores = rng.normal(size=(lengths.sum(), 4)) * 3
        path = langid.best_paths(scores, lengths, 2.5, size)
        at = 0
        for n in lengths.tolist():
            part = scores[at : at + n]
            assert abs(value(part, path[at : at + n], 2.5) - plain_viterbi(part, 2.5)) < 1e-6
            at += n


def test_held_out_languages(spark, medium_dir):
    rows = queries.op4_language_id(spark, medium_dir)
    documents = spark.read.parquet(f"{medium_dir}/documents.parquet").select("doc_id", "lang")
    assert rows.count() == documents.count()
    assert rows.filter("held_out <> (crc32(cast(doc_id AS string)) % 5 = 0)").isEmpty()
    held = rows.filter("held_out").join(documents, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


@pytest.fixture(scope="module")
def model(spark, medium_dir):
    return langid.fit(spark.read.parquet(f"{medium_dir}/documents.parquet"))


def test_spans_of_a_mixed_text(spark, medium_dir, model):
    documents = spark.read.parquet(f"{medium_dir}/documents.parquet")
    parts = {}
    for r in documents.filter("crc32(cast(doc_id AS string)) % 5 = 0 AND n_chars > 900").collect():
        parts.setdefault(r.lang, r.text[:600])
    text = "\n".join(parts[x] for x in ("de", "es", "en"))
    row = langid.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["de", "es", "en"]
    assert abs(row.spans[1].start - 600) < 40 and abs(row.spans[2].start - 1200) < 40
    assert all(a.end <= b.start for a, b in zip(row.spans, row.spans[1:]))


def test_letterless_texts(spark, model):
    rows = list(enumerate(["12 \u00bd \u00b2 _ 34", "!?", "\u0301", "\u2460", "1a", "\u0646\u0635"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert {k for k, lang in got.items() if lang == "und"} == {0, 1, 2, 3}
    spans = langid.spans(df, model).filter("size(spans) > 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in spans) == [4, 5]


def test_scripts_narrow_the_languages(spark):
    rows = [(k, "это русский текст", "ru") for k in range(40)]
    rows += [(100 + k, "this is some text", "en") for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.scripts["cyrillic"] == {model.langs.index("ru")}
    words = ["незнакомое", "unseenword"]
    assert [model.langs[k] for k in model.word_scores(words).argmax(axis=1)] == ["ru", "en"]


def test_odd_rows(odd_documents, model, spark):
    rows = langid.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    und = [r for r in rows if r.lang_pred == "und"]
    assert len(und) == 5 and {r.score for r in und} == {0.0}  # null twice, empty, blank, no letter
    assert langid.predict(odd_documents.limit(0), model).count() == 0
    assert langid.spans(odd_documents, model).count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    untrained = langid.predict(odd_documents, langid.fit(none)).collect()
    assert {r.lang_pred for r in untrained} == {"und"}
    langid.fit(odd_documents)  # null languages and ids, repeated rows


def test_the_sample_is_right_at_any_size():
    cfg = langid.LangConfig()
    counts = {"en": 10_000_000_000, "de": 2_000_000, "rare": 10, "und": 1_000}
    shares = langid.sample_shares(counts, cfg)
    for lang, n in counts.items():
        assert shares[lang] * n == pytest.approx(min(n, 1_250))
    many = {str(k): 10**6 for k in range(1_000)}
    assert {round(s * 10**6) for s in langid.sample_shares(many, cfg).values()} == {200}
    assert langid.sample_shares({}, cfg) == {}


@pytest.mark.parametrize("common", [30, 6_000])
def test_a_rare_language_is_learned_at_every_size(spark, common):
    said = ("the cat sat on the mat", "all that glitters is not gold", "it was the best of times")
    rare = ("kissa istui matolla", "kaikki ei ole kultaa joka kiiltää", "oli paras aika")
    rows = [(k, f"{said[k % 3]} {k % 700}", "en") for k in range(common)]
    rows += [(10**6 + k, rare[k % 3], "fi") for k in range(13)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fi"]
    texts = spark.createDataFrame([(1, "kissa ei istui kultaa"), (2, "the best cat is gold")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(texts, model).collect()} == {1: "fi", 2: "en"}


def test_scripts_without_blanks_between_them(spark):
    rows = [(k, "\u6211\u4eec\u5728\u8fd9\u91cc\u5de5\u4f5c", "zh") for k in range(60)]
    rows += [(100 + k, "this is some text about work", "en") for k in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "\u6211\u4eec\u5728\u8fd9\u91ccthis is some text about work\u5de5\u4f5c\u6211\u4eec\u5728"
    row = langid.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(s.start, s.end, s.lang) for s in row.spans] == [(0, 5, "zh"), (5, 33, "en"), (33, 38, "zh")]
    assert langid.words_of("\u6211Abc \u0439i1z") == ["\u6211", "abc", "\u0439", "i", "z"]
