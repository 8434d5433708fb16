"""A reasoning corpus derived from the `documents` table, used by queries and tests.

The text below is valid in Spark and in DuckDB. `doc_id % 8` chooses the shape of
the solution, so that every status of an example occurs; other remainders put
nulls and odd values into the other columns. Whole texts are used, unless a test
asks for the shorter variant whose numbers were worked out beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reasonloom.session import spread

SYSTEM_PROMPT = "You are an AI assistant."


def reasoning_sql(documents: str = "documents", body_chars: int | None = None) -> str:
    body = "text" if body_chars is None else f"substr(text, 1, {body_chars})"
    half = "body" if body_chars is None else "substr(body, 1, 300)"
    number = "cast(n_chars AS varchar(20))"
    # whole texts: where the solution is null or has no thought, the body stands elsewhere
    tail, asked = ("", "split_part(text, chr(10), 1)") if body_chars else (
        ", ' ', body",
        "CASE WHEN doc_id % 31 = 0 THEN text ELSE split_part(text, chr(10), 1) END",
    )
    return f"""
SELECT doc_id AS example_id,
       source AS source_file,
       CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {asked} END AS problem,
       CASE WHEN doc_id % 31 = 0 THEN NULL
            WHEN doc_id % 8 = 0 THEN concat('<think>', body, '</think>', chr(10),
                                            'The final answer is ', box, '.')
            WHEN doc_id % 8 = 1 THEN concat('<think>', body, '</think> no final answer')
            WHEN doc_id % 8 = 2 THEN concat('<think>', body, ' ', box)
            WHEN doc_id % 8 = 3 THEN concat(body, '</think>', box)
            WHEN doc_id % 8 = 4 THEN concat(body, ' ', box)
            WHEN doc_id % 8 = 5 THEN concat('<think>', {half}, ' ', {half}, '</think>', chr(92),
                                            'boxed{{', chr(92), 'frac{{1}}{{', {number}, '}}}}')
            WHEN doc_id % 8 = 6 THEN concat('<think>', body, '</think>', chr(92), 'boxed{{}}')
            ELSE concat('<think></think>', chr(92), 'boxed{{x + 1}}', ' ',
                        chr(92), 'boxed{{0}}'{tail}) END AS generated_solution,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            WHEN doc_id % 5 = 0 THEN 'no_answer_extracted'
            ELSE 'has_answer_extracted' END AS problem_type,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            WHEN doc_id % 7 = 0 THEN 'n/a'
            WHEN doc_id % 13 = 0 THEN '1.0'
            ELSE concat('0.', cast(doc_id % 10 AS varchar(4))) END AS pass_rate_72b_tir,
       {number} AS expected_answer
FROM (SELECT *, {body} AS body,
             concat(chr(92), 'boxed{{', {number}, '}}') AS box FROM {documents}) d"""


def reasoning(
    spark: SparkSession, sf_dir: str, body_chars: int | None = None, spread_rows: bool = False
) -> DataFrame:
    """`spread_rows` is for work on the text that is worth a shuffle of a small input."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if spread_rows:
        documents = spread(documents)
    # Braces are doubled once more because spark.sql formats its text.
    text = reasoning_sql("@", body_chars).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("@", "{documents}"), documents=documents)
