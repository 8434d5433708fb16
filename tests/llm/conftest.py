import pytest
from pyspark.sql import functions as F

ODD_COLUMNS = ("row_key", "words", "row", "bands", "known", "window", "Block", "score")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    story = " ".join(words[(i * i + i // 7) % 10] + str(i % 41) for i in range(300))
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, story, "en"), (4, story, "en"),
        (5, story, None), (6, story + " omega", "de"), (None, story, "de"), (None, None, None),
        (7, long_text, "en"), (8, "short text", "fr"), (9, "?!. 123", "fr"),
        (10, "x" * 50_000, "es"), (10, story.upper(), "es"), (11, "Licensed under the Apache License, Version 2.0.", "en"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {c: F.lit("clash") for c in ODD_COLUMNS}
    return table.withColumns({"source": F.lit("s"), "n_chars": F.length("text"), **extra})


@pytest.fixture(scope="session")
def small_documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")
