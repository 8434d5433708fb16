import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonloom.llm import queries, toxicity


def test_held_out_labels(spark, medium_dir):
    labels = spark.read.parquet(f"{medium_dir}/labels.parquet")
    rows = queries.op1_toxicity(spark, medium_dir)
    documents = spark.read.parquet(f"{medium_dir}/documents.parquet")
    assert rows.count() == documents.count()
    assert rows.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert rows.filter("(predicted = 1) <> (score >= 0.7)").isEmpty()
    assert rows.filter("held_out <> (crc32(cast(doc_id AS string)) % 3 = 1)").isEmpty()
    held = rows.filter("held_out").join(labels, "doc_id").collect()
    found = sum(r.predicted for r in held if r.toxic)
    assert found >= 0.7 * sum(r.toxic for r in held)
    assert not any(r.predicted for r in held if not r.toxic)


def test_held_out_labels_are_not_used(spark, small_dir):
    documents, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.expr("crc32(cast(doc_id AS string)) % 3 = 1")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [
        toxicity.score(documents, toxicity.fit(documents, given)).orderBy("doc_id").collect()
        for given in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    good = np.where(truth, rng.random(4000) < 0.9, rng.random(4000) < 0.02)
    weak = np.where(truth, rng.random(4000) < 0.5, rng.random(4000) < 0.1)
    fires = np.column_stack([good, weak, weak, weak])  # one voter three times
    label = np.where(rng.random(4000) < 0.5, truth, np.nan).astype(float)
    model = toxicity.LabelModel()
    post = model.fit(fires, label)
    assert abs(model.in_toxic[0] - 0.9) < 0.05 and abs(model.in_toxic[1] - 0.5) < 0.08
    assert model.weight[0] > 0.9 and max(model.weight[1:4]) < 0.45
    unseen = np.isnan(label)
    assert ((post > 0.5) == truth)[unseen].mean() > 0.93


def test_odd_rows(odd_documents, spark):
    labels = spark.createDataFrame(
        [(4, 1), (4, 0), (6, None), (None, 1), (8, 0), (7, 0)], "doc_id long, toxic int"
    )
    model = toxicity.fit(odd_documents, labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.keep_clean(odd_documents, model)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score(odd_documents.limit(0), model).count() == 0


def test_without_labels_the_fixed_words_decide(spark):
    rows = [(1, "what a lovely day it is today"), (2, "you idiot are a moron and a loser"), (3, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents, none)
    got = {r.doc_id: r.predicted for r in toxicity.score(documents, model).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert not toxicity.score(documents, model).filter("score IS NULL").count()


@pytest.mark.parametrize("text", [None, "", "a", "\x00"])
def test_counts_of_poor_texts(text):
    voters = toxicity.Voters()
    assert voters.counts(text)[: voters.n_voters].sum() == 0
