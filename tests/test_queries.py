"""Every query gives the rows that another engine, or a person, works out from the definition."""

from pathlib import Path

import duckdb
import pytest

from ferryline import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(str(tuple(list(v) if isinstance(v, (list, tuple)) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    other = duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    picked = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.SQL[name]}) q").fetchall()
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(picked)


def test_every_query_has_one_name():
    assert sum(len(m.QUERIES) for m in queries.MODULES) == len(queries.QUERIES) == len(queries.SQL)
