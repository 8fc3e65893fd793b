import pytest

from tallyloom import registry as catalog
from tests.oracle import DATA, connect, rows_of, twin


@pytest.fixture(scope="module")
def con():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, con, name):
    got, names, _ = rows_of(catalog.queries()[name](spark, f"{DATA}/sf0.001"))
    want, wanted, _ = twin(con, catalog.oracle_sql()[name])
    assert names == wanted
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, f"{DATA}/sf0.001").count() > 0
