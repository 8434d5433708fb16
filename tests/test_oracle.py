"""Every registered query against its DuckDB text, values and types."""

import glob
import math

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES = contract.QUERIES
ORACLE = contract.ORACLE
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def comparable(rows):
    def cell(value):
        if isinstance(value, float):
            return (1, "nan") if math.isnan(value) else (1, round(value, 6))
        return (0, "") if value is None else (1, value)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, small_dir, name):
    result = QUERIES[name](spark, small_dir)
    expected = duck(small_dir).execute(ORACLE[name])
    types = {d[0]: TYPES[str(d[1])] for d in expected.description}
    assert dict(result.dtypes) == types
    columns = sorted(result.columns)
    order = [[d[0] for d in expected.description].index(c) for c in columns]
    wanted = [tuple(row[i] for i in order) for row in expected.fetchall()]
    got = [tuple(row) for row in result.select(*columns).collect()]
    assert comparable(got) == comparable(wanted)


def test_global_index_of_a_table_of_several_files(spark, tmp_path):
    folder = str(tmp_path / "documents.parquet")
    rows = spark.range(300).selectExpr("3 * id + 5 AS doc_id", "cast(id AS string) AS text")
    rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(folder)
    assert len(glob.glob(f"{folder}/part-*")) == 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    result = QUERIES["global_index"](spark, str(tmp_path)).select("doc_id", "source_file", "global_idx")
    got = [tuple(row) for row in result.collect()]
    assert comparable(got) == comparable(con.execute(ORACLE["global_index"]).fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
