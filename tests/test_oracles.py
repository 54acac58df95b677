"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import datetime

import duckdb
import pytest

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(found, names, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = rows([tuple(r) for r in df.collect()], df.columns, columns)
    assert got or name in ("dup_variant_check",)
    if name in plans.ORACLES:
        c = duck.execute(plans.ORACLES[name])
        names = [d[0] for d in c.description]
        assert sorted(names) == columns
        assert got == rows(c.fetchall(), names, columns)
