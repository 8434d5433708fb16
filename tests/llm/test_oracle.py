"""Registered queries against their DuckDB text, values and types."""

import pytest

import __spark_entry__ as contract
from reasonloom.llm import queries

TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, duck, medium_dir, name):
    result = queries.QUERIES[name](spark, medium_dir)
    expected = duck(medium_dir).execute(queries.ORACLE[name])
    names = [d[0] for d in expected.description]
    assert dict(result.dtypes) == {d[0]: TYPES[str(d[1])] for d in expected.description}
    got = sorted(tuple(r) for r in result.select(*names).collect())
    assert got == sorted(expected.fetchall()) and got


def test_all_are_registered():
    registered = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in registered) == 1
    assert "pipeline" in registered
    assert set(queries.ORACLE) <= set(contract.oracle_sql()) <= set(registered)
