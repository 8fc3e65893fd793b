import pytest

from tallyloom.llm import queries
from tests.oracle import DATA, connect, rows_of, twin


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_duckdb(spark, name):
    got, names, _ = rows_of(queries.queries()[name](spark, f"{DATA}/sf0.01"))
    want, wanted, _ = twin(connect("sf0.01"), queries.oracle_sql()[name])
    assert names == wanted and sorted(map(str, got)) == sorted(map(str, want))
