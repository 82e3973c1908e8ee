"""Every registered query outside the training-data subpackage against its DuckDB equivalent."""

import duckdb
import pytest

from loadweave import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    text = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in catalogue.ORACLE_SQL:
        assert columns
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert plain(rows) == plain(duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
