"""Tables in which one (type, refs) key comes with several contents: contacts of one name link to one student by different addresses."""

import duckdb
import pytest

from tallyloom import library
from tallyloom.operators import conflicts as c
from tallyloom.operators import rules
from tallyloom.world import TABLES, context
from tests.oracle import DATA, rows_of, twin

SHIFTED = {"customer": {"c_custkey": "c_custkey"}, "supplier": {"s_suppkey": "s_suppkey"}, "orders": {"o_orderkey": "o_orderkey", "o_custkey": "c_custkey"}, "lineitem": {"l_orderkey": "o_orderkey", "l_suppkey": "s_suppkey"}}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Three copies of sf0.001 with keys of their own; names and balances repeat."""
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    source = lambda t: f"read_parquet('{DATA}/sf0.001/{t}.parquet')"
    step = {k: con.execute(f"SELECT max({k}) + 1 FROM {source(t)}").fetchone()[0] for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"))}
    for t in TABLES:
        moved = ", ".join(f"{k} + i * {step[of]} AS {k}" for k, of in SHIFTED[t].items())
        con.execute(f"COPY (SELECT * REPLACE ({moved}) FROM {source(t)}, range(3) AS r(i)) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return folder, con


def test_a_run_still_refuses_contradictory_conflicts(spark, repeated):
    with pytest.raises(c.ContradictoryConflicts):
        c.assemble(rules.evaluate(context(spark, str(repeated[0]))))


@pytest.mark.parametrize("name", ["conflict_set", "surviving_conflicts", "counts_by_type", "fix_targets", "conflict_scores", "precedence_checks"])
def test_contradictory_conflicts_all_stay(spark, repeated, name):
    folder, con = repeated
    got, names, _ = rows_of(library.queries()[name](spark, str(folder)))
    want, wanted, _ = twin(con, library.oracle_sql()[name])
    assert names == wanted and sorted(map(str, got)) == sorted(map(str, want))
