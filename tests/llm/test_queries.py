"""Queries with SQL give DuckDB's rows; the others of this package run over whole tables."""

import duckdb
import pytest

from tests.test_oracles import TABLES, rows
from tidemark.llm import queries


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_those_of_sql(spark, name, folder):
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    c = con.execute(queries.ORACLES[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    assert rows([tuple(r) for r in df.collect()], df.columns, columns) == rows(c.fetchall(), names, columns)


def test_rollup_of_several_batches(spark):
    """The net of inserts, a revision, deletes and inserts is the plain count."""
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        docs, tokens = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = docs + 1, tokens + len(t.encode(r.text or "", add_special_tokens=False).ids)
    got = queries.op9_token_rollup(spark, folder).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == want and {r.tokenizer for r in got} == {"word_bpe_49k"}
