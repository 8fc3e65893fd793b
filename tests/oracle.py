"""Run a query in Spark and its twin in DuckDB and compare rows and columns."""

from decimal import Decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(f"{DATA}/{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, Decimal):
        return str(x.normalize() + 0)
    return x


def rows_of(df):
    df = df.select(*sorted(df.columns))
    return [tuple(map(plain, r)) for r in df.collect()], df.columns, [f.dataType.simpleString() for f in df.schema.fields]


def twin(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [tuple(plain(r[i]) for i in order) for r in found.fetchall()], [names[i] for i in order], [str(found.description[i][1]) for i in order]
